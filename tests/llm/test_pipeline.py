"""The pipeline's stages against brute force on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from legajo.llm import bpe, mixing, toxicity
from tests.llm.test_classifiers import texts as labelled
from tests.llm.test_jaccard import WORD
from tests.llm.test_jaccard import brute as groups_of
from tests.llm.test_jaccard import corpus as near_copies
from tests.llm.test_substring import brute as repeats_of
from tests.llm.test_substring import corpus as passages


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(4)
    rows = [(t, lang, toxic) for _, t, lang, toxic in labelled(400, 7)] + [(t, "en", 0) for t in near_copies(5, 60) + passages(6, 50)]
    r.shuffle(rows)
    docs = [(i, t, lang, r.choice(["a", "b", None]), len(t)) for i, (t, lang, _) in enumerate(rows)] + [(9000, None, None, None, None), (9001, "", "en", "a", 0), (9002, rows[0][0], "en", "a", 5), (9002, rows[0][0], "en", "a", 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, (_, _, x) in enumerate(rows) if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, sf_dir, tmp_path):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        out, given = spark.read.parquet(f"{tmp_path}/{k}"), docs.collect()
        pairs = [(r.doc_id, r.text) for r in given]
        if k < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), corpus_pipeline.id_crc() % 5 != 0)
            bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
            assert 50 < len(bad) < 200 and rows(out) == Counter(tuple(r) for r in given if r.doc_id not in bad)
        elif name == "ngram_jaccard":
            least = {d: c for d, _, c in groups_of(pairs)}
            assert rows(out) == Counter({tuple(r): 1 for r in given if least[r.doc_id] == r.doc_id}) and len(given) > out.count()
        elif name == "substring_dedup":
            want = Counter((x[0], tuple(x[4])) for x in repeats_of(pairs, 50))
            assert Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in out.collect()) == want
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
            got, old = {r.doc_id: r.text for r in out.collect()}, dict(pairs)
            assert {d: len(WORD.findall(t)) for d, t in got.items()} == {d: n for d, n in taken.items() if n}
            assert all(set(WORD.findall(t)) <= set(WORD.findall(old[d])) for d, t in got.items())
            assert any(t == old[d] for d, t in got.items()) and any(taken[d] > len(WORD.findall(old[d])) for d in got)
        else:
            library = Tokenizer.from_file(bpe.vocabulary_path())
            assert {r.doc_id: r.n_tokens for r in out.collect()} == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in pairs}
        docs, before = out, docs
    assert before is not None
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(docs)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    t, u, v = ("one two three four five six seven " * 3, "apple pear plum fig " * 4, " ".join(f"v{i}" for i in range(60)))
    rows = [(1, t), (5, t), (5, u), (7, v), (7, v + " more"), (None, t), (9, ""), (9, ""), (None, None), (8, " "), (2, u), (2, u), (None, "alone in the world")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, comp long").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert sum(n for (i, x), n in got.items() if i == 7) == 1
    assert got - Counter([(7, v), (7, v + " more")]) == Counter([(1, t), (2, u), (9, ""), (9, ""), (None, None), (8, " "), (None, "alone in the world")])
    mixed = corpus_pipeline.mix_sources(spark, docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text")), "")
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == round(1.5 * sum(len(WORD.findall(x or "")) for _, x in rows))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chosen_runs():
    assert mixing.chosen([10, 0], [20, 10]) == [[(0, 20)]]
    assert mixing.chosen([0, 0, 10], [10, 10, 20]) == [[(0, 20)], [(0, 10)]]
    assert mixing.chosen([5, 40, 5], [9, 60, 7]) == [[(5, 7), (40, 60)], [(5, 9)]]
