"""Comparison, sources, sinks, streaming and the driver contract."""

import json

from pyspark.sql import functions as F

import __spark_entry__
from legajo.operators import decisions, identity, vehicle
from legajo.plans import catalog, compare
from legajo.sources import images, sinks
from legajo.streaming import documents
from tests.texts import CARD, FRONT, VEHICLE, ZONE

RUNS = [("tesseract", "none", "t", 80.0, 0.5, True, None, 0), ("google_vision", "none", "t", 95.0, 1.2, True, None, 1), ("google_vision", "standard", "t", 95.0, 1.8, True, None, 2), ("tesseract", "standard", "", 0.0, 0.1, False, "boom", 3)]
SCHEMA = compare.RUNS.removeprefix("path string, ")


def test_best_runs_keep_the_first_on_ties(spark):
    runs = spark.createDataFrame(RUNS, SCHEMA)
    assert compare.best(runs, compare.by_confidence()).first().ordinal == 1
    assert compare.best(runs, compare.by_speed()).first().ordinal == 0
    assert compare.best(runs, compare.by_balance()).first().ordinal == 0
    got = compare.recommendations(runs).first().recommendations
    assert got["recommended_engine"] == "google_vision" and got["best_accuracy"] == "google_vision + none (95.0%)" and got["tesseract_avg_confidence"] == "80.0%"
    assert compare.recommendations(runs.where("not success")).first().recommendations == {"error": "no engine succeeded"}
    assert compare.recommendations(runs.limit(0)).first().recommendations == {"error": "no results"}
    tied = spark.createDataFrame([("tesseract", "m", "", 9.0, 1.0, True, None, 0), ("google_vision", "m", "", 9.0, 1.0, True, None, 1)], SCHEMA)
    assert compare.recommendations(tied).first().recommendations["recommended_engine"] == "tesseract"


def ocr(engine, mode, content):
    if engine == "google_vision" and mode == "bad":
        raise ValueError("no credit")
    return {"text": content.decode(), "confidence": 50.0}


def test_run_matrix(spark):
    pictures = spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, content binary")
    rows = compare.run_matrix(pictures, ["tesseract", "google_vision"], ["none", "bad"], ocr).collect()
    assert len(rows) == 8 and sum(not r.success for r in rows) == 2
    assert {r.error for r in rows if not r.success} == {"ValueError: no credit"}


def test_image_gates(spark, tmp_path):
    heads = {"a.jpg": b"\xff\xd8\xff\xe0", "b.png": b"\x89PNG\r\n", "c.webp": b"RIFF0000WEBP", "d.wav": b"RIFF0000WAVE", "e.txt": b"hello", "big.png": b"\x89PNG" + bytes(images.MAX_BYTES - 3), "edge.png": b"\x89PNG" + bytes(images.MAX_BYTES - 4)}
    for name, data in heads.items():
        (tmp_path / name).write_bytes(data)
    df = images.gated(images.read_images(spark, str(tmp_path))).select(F.element_at(F.split("path", "/"), -1).alias("f"), "status")
    assert {r.f: r.status for r in df.collect()} == {"a.jpg": 200, "b.png": 200, "c.webp": 200, "d.wav": 200, "e.txt": 400, "big.png": 413, "edge.png": 200}
    small = images.read_images(spark, str(tmp_path)).where(images.size_ok()).select("path")
    assert "PushedFilters" in small._jdf.queryExecution().executedPlan().toString()
    said = images.with_ocr(images.read_images(spark, str(tmp_path)).where("length < 100"), lambda b: {"text": str(len(b)), "confidence": 1} if b != b"hello" else 1 / 0)
    assert sorted((r.text or "", bool(r.error)) for r in said.collect()) == [("", True), ("12", False), ("12", False), ("4", False), ("6", False)]


def test_rotation_and_confidence(spark):
    scores = spark.createDataFrame([("a", 0, 10.0, 5), ("a", 90, 80.0, 9), ("b", 0, 50.0, 5), ("b", 180, 51.0, 5), ("c", 90, 1.0, 0), ("c", 270, 1.0, 0)], "path string, angle int, horizontal double, words int")
    assert {r.path: r.angle for r in images.best_rotation(scores).collect()} == {"a": 90, "b": 0, "c": 90}
    df = spark.createDataFrame([([90.0, -1.0, 80.5],), ([],), ([-1.0],)], "c array<double>")
    assert [r.m for r in df.selectExpr(f"{images.word_confidence('c')} as m").collect()] == [85.25, 0.0, 0.0]


def test_fallback_reasons(spark):
    rows = [(1, FRONT, 90.0), (2, FRONT.replace("78Z", "78A"), 90.0), (3, FRONT.replace("NOMBRE\nANA", ""), 90.0), (4, FRONT + "\nEQUIPO 1", 60.0), (5, ZONE, 60.0), (6, FRONT, 20.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c double")
    got = identity.extract(df, "date'2025-06-30'").selectExpr("doc_id", f"{decisions.identity_fallback('datos', 'c', 'text')} as r").orderBy("doc_id").collect()
    assert [r.r for r in got] == ["accepted", "number missing or invalid", "name missing", "back side without address", "machine-readable zone only", "low confidence"]
    cars = spark.createDataFrame([(1, VEHICLE, 90.0), (2, "x", 90.0), (3, "1234BCF", 90.0), (4, VEHICLE, 40.0), (5, VEHICLE.replace("BCF", "AEI"), 90.0)], "doc_id long, text string, c double")
    got = vehicle.extract(cars).selectExpr("doc_id", f"{decisions.vehicle_fallback('datos', 'c')} as r").orderBy("doc_id").collect()
    assert [r.r for r in got] == ["accepted", "plate missing", "brand missing", "low confidence", "plate invalid"]


def test_stream_and_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(1, "dni", FRONT, "tesseract", 90.0), (2, "nif", CARD, "tesseract", 90.0), (3, None, VEHICLE, "tesseract", 90.0)], documents.SCHEMA)
    texts.write.parquet(f"{tmp_path}/in")
    query = documents.to_parquet(documents.results(documents.read_texts(spark, f"{tmp_path}/in"), "2025-06-30"), f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r.doc_id: r.valido for r in out.collect()} == {1: True, 2: True, 3: True}
    said = [json.loads(r.value) for r in sinks.as_json(out).collect()]
    assert {x["doc_id"] for x in said} == {1, 2, 3} and all("errores_detectados" in x for x in said)
    logs = [r.value for r in sinks.log_records(out.withColumn("id", F.lit("12345678Z")), "id").collect()]
    assert all("1234****Z" in x and "12345678Z" not in x for x in logs)


def test_costs(spark):
    got = spark.sql(f"select {compare.monthly_cost('n')} as c from values (500), (1000), (3000), (6000000) as t(n)").collect()
    assert [r.c for r in got] == [0.0, 0.0, 3.0, 4999 * 1.5 + 600]


def test_contract(spark):
    assert set(catalog.oracle_sql()) == set(catalog.queries()) and len(catalog.queries()) > 50
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[:3] == ["doc_id", "valido", "confianza_global"]


def test_no_shuffle_in_projections(spark):
    for name in ("d_validate", "v_validate", "n_validate", "f1_doc_check", "l7_gather"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan, name


def test_mixed_texts_compile(spark):
    """No plan of mixed texts falls back to interpreted code."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("r11_findings_by_code", "r17_tier", "r20_route"):
            df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
            assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 250_000, name
            assert df.count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
