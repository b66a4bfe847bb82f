"""Comparison of OCR runs, usage figures and costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_matrix(images: DataFrame, engines: list[str], modes: list[str], ocr: Callable[[str, str, bytes], dict]) -> DataFrame:
    """One row for each image (path, content), engine and mode; a failure is a row with success = false.

    ``ocr(engine, mode, content)`` returns text and confidence; engines that nobody knows are passed over. Engines times modes is a
    constant, so this multiplies rows by a fixed factor.
    """
    engines = [e for e in engines if e in ENGINES]
    if not engines or not modes:
        return images.sparkSession.createDataFrame([], RUNS)
    plan = [F.struct(F.lit(e).alias("engine"), F.lit(m).alias("preprocess_mode"), F.lit(i * len(modes) + j).alias("ordinal")) for i, e in enumerate(engines) for j, m in enumerate(modes)]
    cells = images.select("path", "content", F.explode(F.array(*plan)).alias("run")).select("path", "content", "run.*")

    def run(frames):
        import time

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                began = time.time()
                try:
                    got, error = ocr(r.engine, r.preprocess_mode, r.content), None
                except Exception as e:  # one image must not fail the job
                    got, error = {}, f"{type(e).__name__}: {e}"
                rows.append((r.path, r.engine, r.preprocess_mode, got.get("text", ""), float(got.get("confidence", 0.0)), round(time.time() - began, 3), error is None, error, r.ordinal))
            yield type(frame)(rows, columns=[c.split()[0] for c in RUNS.split(", ")])

    return cells.mapInPandas(run, RUNS)


#: Engines that runs can name (fixed values).
ENGINES = ("tesseract", "google_vision")
RUNS = "path string, engine string, preprocess_mode string, text string, confidence double, processing_time double, success boolean, error string, ordinal int"


def best(runs: DataFrame, order, keys: list[str] | None = None) -> DataFrame:
    """The successful run that comes first by ``order``, ties by ordinal; for each key, or overall without keys."""
    keys = keys or []
    names = [c for c in runs.columns if c not in keys]
    first = runs.where("success").groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(order, "ordinal")).alias("r"))
    return first.where("r is not null").select(*keys, "r.*")


def by_confidence():
    return -F.col("confidence")


def by_speed():
    return F.col("processing_time")


def by_balance():
    return -(F.col("confidence") / (F.col("processing_time") + 0.1))


def engine_means(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean confidence of the successful runs of either engine, 0 without any."""
    mean = lambda e: F.coalesce(F.avg(F.when(F.col("success") & (F.col("engine") == e), F.col("confidence"))), F.lit(0.0))
    return runs.groupBy(*(keys or [])).agg(mean("tesseract").alias("tesseract_avg"), mean("google_vision").alias("google_vision_avg"))


def recommendations(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys and ``recommendations``, a map of texts; an error entry without runs or without a successful one.

    All of it is one aggregation, so it scales with partial aggregates.
    """
    names = F.struct("engine", "preprocess_mode", "confidence", "processing_time")
    pick = lambda order: F.min_by(names, F.when(F.col("success"), F.struct(order, F.col("ordinal").alias("o"))))
    mean = lambda e: F.coalesce(F.avg(F.when(F.col("success") & (F.col("engine") == e), F.col("confidence"))), F.lit(0.0))
    found = runs.groupBy(*(keys or [])).agg(
        pick(by_confidence().alias("x")).alias("c"), pick(by_speed().alias("x")).alias("s"), pick(by_balance().alias("x")).alias("b"),
        mean("tesseract").alias("t"), mean("google_vision").alias("g"), F.count("*").alias("n"), F.count_if("success").alias("ok"),
    )
    pairs = {
        "best_accuracy": F.concat("c.engine", F.lit(" + "), "c.preprocess_mode", F.lit(" ("), F.col("c.confidence").cast("string"), F.lit("%)")),
        "best_speed": F.concat("s.engine", F.lit(" + "), "s.preprocess_mode", F.lit(" ("), F.col("s.processing_time").cast("string"), F.lit("s)")),
        "best_balance": F.concat("b.engine", F.lit(" + "), "b.preprocess_mode"),
        "recommended_engine": F.when(F.col("g") > F.col("t"), "google_vision").otherwise("tesseract"),
        "tesseract_avg_confidence": F.concat(F.bround("t", 2).cast("string"), F.lit("%")),
        "google_vision_avg_confidence": F.concat(F.bround("g", 2).cast("string"), F.lit("%")),
    }
    error = F.create_map(F.lit("error"), F.when(F.col("n") == 0, "no results").otherwise("no engine succeeded"))
    good = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return found.select(*(keys or []), F.when(F.col("ok") > 0, good).otherwise(error).alias("recommendations"))


def findings(results: DataFrame) -> DataFrame:
    """One row for each finding: doc_id, tipo_documento, list, code, severity, field, evidence."""
    tagged = lambda c: F.transform(c, lambda f: F.struct(F.lit(c).alias("list"), f.alias("f")))
    both = F.concat(tagged("errores_detectados"), tagged("alertas"))
    # outer, since a plain explode would push copies of the whole rule table below as a filter
    rows = results.select("doc_id", "tipo_documento", F.explode_outer(both).alias("x")).where("x is not null")
    return rows.select("doc_id", "tipo_documento", "x.list", "x.f.code", "x.f.severity", "x.f.field", "x.f.evidence")


def findings_by_code(results: DataFrame) -> DataFrame:
    return findings(results).groupBy("tipo_documento", "code", "severity").agg(F.count("*").alias("n"))


def usage(requests: DataFrame, day: str, kind: str, ok: str, latency: str) -> DataFrame:
    """Requests by day and kind: number, success rate, mean latency."""
    return requests.groupBy(F.to_date(day).alias("day"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.expr(ok), 1.0).otherwise(0.0)).alias("success_rate"), F.avg(latency).alias("mean_latency")
    )


def monthly_cost(n: str) -> str:
    """Price of ``n`` requests in a month: 1000 free, 1.50 a thousand, 0.60 a thousand beyond five million."""
    return f"(greatest(0, least({n}, 5000000) - 1000) * 1.5D + greatest(0, {n} - 5000000) * 0.6D) / 1000D"


def first_results(results: DataFrame, key: str, order: str) -> DataFrame:
    """The first result of each content key, so repeated images are answered once."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return results.withColumn("_n", rank).where("_n = 1").drop("_n")
