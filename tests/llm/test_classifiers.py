"""Operators 5 and 9: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from legajo.llm import convnet, langid, toxicity
from legajo.llm.common import low_marks, mark_of, sampled
from legajo.llm.convnet import ConvNet
from legajo.llm.words import Words

SYLLABLES = {"en": "th ing ea ou the and er".split(), "de": "sch ung ö ß ein der ch".split(), "es": "ción ñ que os ar la".split()}


def texts(n, seed):
    r = random.Random(seed)
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 200))]
        toxic = int(r.random() < 0.3)
        for _ in range(4 * toxic):
            words[r.randrange(len(words))] = r.choice(["zorch", "blarg", "fnord"])
        yield i, " ".join(words), lang, toxic


def test_windows_cover_every_gram():
    for sizes in ([0], [1, 128, 129], [125, 126, 0, 1000]):
        data = np.random.default_rng(1).integers(0, 256, sum(sizes)).astype(np.uint8)
        offsets = np.cumsum([0, *sizes])
        ids, row, room = langid.windows(data, offsets)
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            grams = {tuple(data[i : i + 4]) for i in range(a, b - 3)}
            seen = {tuple(w[i : i + 4] - 1) for w in ids[row == k] for i in range(125) if (w[i : i + 4] > 0).all()}
            assert grams == seen


def test_language(spark):
    rows = [(i, t, lang, "s") for i, t, lang, _ in texts(900, 1)]
    odd = [(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, "123 !!", None, None), (5003, rows[0][1] * 400, None, "s"), (5003, rows[0][1] * 400, None, "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (i in set(held)) for i, *_ in rows)
    truth = {i: lang for i, _, lang, _ in rows}
    assert np.mean([by[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (5000, 5001, 5002)) and by[5003].lang_pred == truth[0]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 5").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_toxicity(spark):
    rows = list(texts(1500, 2))
    odd = [(9000, None, "en", 0), (9001, "", None, 0), (9002, "calm words " * 40_000 + "zorch blarg fnord zorch", None, 0), (9002, "x", None, 0)]
    docs = spark.createDataFrame([(i, t, lang, "a") for i, t, lang, _ in rows + odd], "doc_id long, text string, lang string, label string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, _, x in rows[:1200]] + [(0, 1, None), (None, 1, 1), (77_777, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id < 9000}
    held = [(i, x) for i, _, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out for i, _ in held) and sum(r.held_out for r in by.values()) == len(held)
    assert np.mean([by[i].predicted == x for i, x in held]) > 0.95
    assert max(r.predicted for r in got if r.doc_id == 9002) == 1  # the end of a long text counts
    model = toxicity.train(docs, labels)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count() and clean.where("text is null").count() == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs.limit(5), labels.limit(0)).collect()} == {0.0}


def test_languages_are_learned_from_the_sample():
    r = random.Random(3)
    vocab = {"aa": [f"a{i}" for i in range(40)], "bb": [f"b{i}" for i in range(40)], "cc": [f"c{i}" for i in range(40)]}
    rows = [(x, " ".join(r.choice(vocab[x]) for _ in range(20)) + " und") for x in vocab for _ in range(toxicity.LANG_DOCS + 5)] + [("rare", "zz zz")]
    words = Words(pa.array([t for _, t in rows]), True, toxicity._BREAKS)
    ids = toxicity.word_ids(words)
    buckets = np.unique(ids)
    model = toxicity.Model(buckets, None, np.zeros((len(buckets) + 1, 0)), np.array([0.5]))
    known = model.known(ids)
    model.odds = toxicity.language_odds([known[a:b] for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)], [x for x, _ in rows], len(buckets) + 1)
    assert model.odds.shape[1] == 3 and model.odds.dtype == np.float32
    new = Words(pa.array(["a1 a2 unseen", "", "c3", "b1 B2 c3", "never"]), True, toxicity._BREAKS)
    assert model.groups(model.known(toxicity.word_ids(new)), new.rows).tolist() == [0, 3, 2, 1, 3]


def naive_forward(net, ids):
    """Logits of one sequence, filter by filter."""
    padded = [*ids, *[0] * (net.width - 1)]
    best = []
    for f in range(net.conv.shape[1]):
        values = [sum(float(net.table[padded[i + w], d]) * float(net.conv[w * net.dim + d, f]) for w in range(net.width) for d in range(net.dim)) for i in range(len(ids))]
        best.append(max(values) + float(net.bias[f]))
    return np.array(best) @ net.dense.astype(float) + net.out


def small_net():
    net = ConvNet(12, 3, (1, 2, 3), 2, 3, seed=5)
    net.bias += np.random.default_rng(1).normal(0, 0.1, net.bias.shape).astype(np.float32)
    return net


def test_forward_equals_a_naive_one():
    net, r = small_net(), np.random.default_rng(2)
    sequences = [r.integers(0, 12, n) for n in (7, 1, 30, 2, 4)]
    gap = np.zeros(net.width - 1, int)
    starts = np.cumsum([0, *[len(s) + len(gap) for s in sequences[:-1]]])
    pooled = net.pooled(np.concatenate([np.concatenate([gap, s]) for s in sequences] + [gap]), starts)
    want = [naive_forward(net, [*gap, *s]) for s in sequences]
    assert np.allclose(pooled @ net.dense + net.out, want, atol=1e-5)


def test_gradients_equal_differences():
    net, r = small_net(), np.random.default_rng(4)
    sequences, y = [r.integers(1, 12, n) for n in (5, 9, 3)], np.array([0, 2, 1])

    def loss():
        z = np.array([naive_forward(net, [*[0] * (net.width - 1), *s]) for s in sequences])
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(3), y]))

    grads = net.gradients(sequences, y, np.ones(3, np.float32))
    for name in ("conv", "bias", "dense", "out"):
        value = getattr(net, name)
        for at in list(np.ndindex(value.shape))[::5]:
            if name == "conv" and not net.mask[at]:
                assert grads[name][at] == 0
                continue
            old, step = value[at], 1e-2
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-2
    touched, rows = grads["table"]
    for k, t in enumerate(touched.tolist()):
        if t:
            old = net.table[t, 1]
            net.table[t, 1] = old + 1e-2
            up = loss()
            net.table[t, 1] = old - 1e-2
            down = loss()
            net.table[t, 1] = old
            assert abs((up - down) / 2e-2 - rows[k, 1]) < 2e-2


def test_samples_are_bounded_and_whole(spark):
    rows = [(i, "ab"[i % 10 == 0], "x" * (i % 50)) for i in range(3000)] + [(1, "b", "x")] * 500
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string").withColumn("mark", mark_of("doc_id", 1))
    low = low_marks(df, "kind", 40)
    one = low.groupBy("kind", "mark").agg(F.min("text").alias("text")).withColumn("n", F.length("text").cast("long"))
    got = sampled(one, "kind", 40, 10_000, 45)
    kinds = got.column("kind").to_pylist()
    assert kinds.count("a") == 40 and kinds.count("b") == 40 and max(got.column("n").to_pylist()) <= 45
    marks = {r.mark for r in df.where("kind = 'a' and length(text) <= 45").orderBy("mark").select("mark").distinct().orderBy("mark").limit(40).collect()}
    assert {m for m, k in zip(got.column("mark").to_pylist(), kinds, strict=True) if k == "a"} == marks
    assert sum(sampled(one, "kind", 40, 100, 45).column("n").to_pylist()) <= 200
    assert sampled(one.limit(0), "kind", 40, 100, 45).num_rows == 0


def test_scores_do_not_depend_on_neighbours(spark):
    rows = [(i, t, lang, toxic) for i, t, lang, toxic in texts(300, 5)]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, toxic int"))
    column = pa.array([t or "" for _, t, _, _ in rows] + [""])
    together = toxicity.scores_of(model, column)
    alone = [toxicity.scores_of(model, column.slice(i, 1))[0] for i in range(len(column))]
    assert np.allclose(together, alone, atol=1e-6)


def test_every_labelled_row_trains(spark):
    """The toxic half with the higher marks has a word of its own; a sample of the 3,000 lowest never saw it."""
    r = random.Random(6)
    plain = [f"w{i}" for i in range(30)]
    marks = {x.doc_id: x.mark for x in spark.range(7000).select(F.col("id").alias("doc_id"), mark_of("id", 9).alias("mark")).collect()}
    middle = sorted(marks.values())[3500]
    rows = [(i, " ".join(r.choice(plain) for _ in range(8)) + (" zorch" if m > middle else " blarg"), 1) for i, m in marks.items()]
    rows += [(10_000 + i, " ".join(r.choice(plain) for _ in range(9)), 0) for i in range(700)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(1, rows[1][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(50_000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    calm, blarg, zorch = toxicity.scores_of(model, pa.array(["w1 w2 w3 w4 w5", "w1 w2 blarg w3 w4", "w1 w2 zorch w3 w4"]))
    assert calm < 0.5 <= min(blarg, zorch)
    stored = toxicity.labelled(docs, labels)
    assert stored.count() == len(rows) + 1 and stored.select("shard").distinct().count() == 2
    again = toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(again.net.table, model.net.table) and np.array_equal(again.thresholds, model.thresholds)


def test_a_text_of_megabytes_trains(spark):
    docs = spark.createDataFrame([(i, "calm day " * 5 + "zorch" * (i % 2), "en") for i in range(60)] + [(99, "dull " * 430_000 + "zorch", "en")], "doc_id long, text string, lang string")
    stored = toxicity.labelled(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))
    assert stored.selectExpr("max(octet_length(ids)) / 4").first()[0] == 430_001 and stored.count() == 61


def test_word_counts_equal_brute_force(spark):
    rows = list(texts(200, 8))
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    stored = toxicity.labelled(docs, spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, toxic int"))
    names = ["de", "en"]
    buckets, got = toxicity.word_counts(stored, names, 3)
    want = np.zeros((6, (1 << toxicity.BITS) + 1), np.int64)
    for _, t, lang, toxic in rows:
        group = 2 * (names.index(lang) if lang in names else 2) + toxic
        want[group, np.unique(toxicity.word_ids(Words(pa.array([t]), True, toxicity._BREAKS)))] += 1
    assert np.array_equal(buckets, np.flatnonzero(want.sum(0) >= 3)) and np.array_equal(got[:, 1:], want[:, buckets])


def test_long_sequences_go_by_blocks(monkeypatch):
    net, r = small_net(), np.random.default_rng(9)
    sequences, y = [r.integers(1, 12, n) for n in (5, 90, 31)], np.array([0, 2, 1])
    whole = net.gradients(sequences, y, np.ones(3, np.float32))
    monkeypatch.setattr(convnet, "BLOCK", 16)
    cut = net.gradients(sequences, y, np.ones(3, np.float32))
    assert np.array_equal(whole["table"][0], cut["table"][0]) and np.allclose(whole["table"][1], cut["table"][1])
    assert all(np.allclose(whole[k], cut[k], atol=1e-6) for k in ("conv", "bias", "dense", "out"))


def test_thresholds_of_counted_probabilities():
    p = np.array([0.1, 0.4, 0.7, 0.9])
    assert np.isclose(toxicity.best_threshold(p, np.array([30, 1, 0, 0]), np.array([1, 0, 10, 9]), 0.9), 0.55)
    assert toxicity.best_threshold(p, np.array([30, 1, 0, 0]), np.array([0, 0, 5, 9]), 0.9) == 0.9
    assert toxicity.best_threshold(p[:0], np.zeros(0), np.zeros(0), 0.8) == 0.8
