"""Operator 9: toxicity by a convolutional text classifier.

Words (runs of ASCII letters, digits, apostrophes and non-ASCII characters, ASCII letters lower-cased) are hashed into a table of
embeddings; filters over 1, 2 and 3 words, max pooling over the whole text and softmax follow, trained in numpy.
The raw probability is mapped to the score so that 0.5 is the threshold calibrated for the text's language. The language of a text
is learned too: sums of log odds of its words, counted by ``lang`` in the rows that train (never read when scoring).

Training takes every row with a text whose id has a label, and its whole text; repeated rows train as often as they occur. By a hash of the
id four fifths train and one fifth calibrates. The rows are stored by shards, drawn by a hash of id and text, of about ``SHARD_ROWS`` rows (more where a
class is rare), in an order of their own. In each epoch every shard takes its steps from the same weights, in one stream that holds a
few MB, and the weights (and Adam's state) of the shards are averaged by their rows; with a single shard this is plain training. Words in fewer than
``MIN_DOCS`` rows that train, or in less than ``MIN_SHARE`` of them, keep the zero embedding, so unknown words are neutral; the others start from
their log odds, which filters over single words alone would nearly keep (the README tells what the wider filters add).
Only their rows of the table are kept and broadcast: less than 1 / ``MIN_SHARE`` times the different words of a mean text.
Thresholds come from counts of all calibrating rows by probability, told apart in steps of 1 / ``STEPS`` of its log odds, which bounds what the driver gets.
The ids of labelled rows are looked for by a bitmap of fixed size before texts are tokenised, and joined then; scoring is one map over all whole texts, free style (mapInArrow).
Null and empty texts get the score of a text without words. A document with contradicting labels trains as toxic; without any
label of either class all scores are 0. Of languages that tie for a text the first in code-point order counts, a text at its threshold scores 0.5.
Repeated rows repeat, other columns are ignored, an empty table stays empty.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, bitmap_of, chunks, drop_scratch, give_back, id_crc, mark_of, parts_for, text_buffers, text_or_empty, written
from legajo.llm.convnet import ConvNet, pace
from legajo.llm.words import Words

BITS, DIM, WIDTHS, FILTERS = 20, 4, (1, 2, 3), 8
EPOCHS, RATE, BATCH, DECAY = 12, 0.02, 32, 0.3
#: Rows of a shard, and how many of the rarer class it should have at least.
SHARD_ROWS, SHARD_CLASS = 4096, 200
#: Bytes of ids that are put in a new order at once, and floats that are averaged at once.
BUFFER_BYTES, PIECE = 1 << 21, 1 << 14
#: Cells of the bitmap of labelled ids.
LABEL_BITS = 24
#: A word trains an embedding if it stands in this many of the rows that train and in this share of them.
MIN_DOCS, MIN_SHARE = 3, 1 / 1000
#: Raw probability that counts as toxic where too few rows are left to calibrate by.
FEW_ROWS_THRESHOLD = 0.9
#: Rows that train, and their share, that a language needs for odds of its own.
LANG_DOCS, LANG_SHARE = 30, 1 / 200
#: Steps of the log odds by which calibrating rows are counted.
STEPS = 1024
_BREAKS = ~np.array([chr(b).isalnum() and b < 128 or b >= 128 or b == 39 for b in range(256)])


def word_ids(words: Words) -> np.ndarray:
    """Bucket of each word; 0 is the padding."""
    return (words.hashes & np.uint64((1 << BITS) - 2)).astype(np.int64) + 1


class Model:
    """Network and language odds over the known buckets, and a threshold for each language and, last, for texts of none."""

    def __init__(self, buckets: np.ndarray, net: ConvNet, odds: np.ndarray, thresholds: np.ndarray):
        self.buckets, self.net, self.odds, self.thresholds = buckets, net, odds, thresholds
        self.index: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None}

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Row of the table of each bucket, 0 for unknown ones."""
        if self.index is None:
            self.index = np.zeros((1 << BITS) + 1, np.int32)
            self.index[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return self.index[ids]

    def raw(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row; ids: table rows of all words, ``rows`` offsets into them."""
        n, gap = len(rows) - 1, self.net.width - 1
        flat = np.zeros(len(ids) + gap * (n + 1), np.int32)
        flat[np.arange(len(ids)) + gap * np.repeat(np.arange(1, n + 1), np.diff(rows))] = ids
        return self.net.probabilities(self.net.pooled(flat, rows[:-1] + gap * np.arange(n)))[:, 1].astype(float)

    def groups(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Language of each row, the number of languages for a row without a known word."""
        count = self.odds.shape[1]
        if not count:
            return np.zeros(len(rows) - 1, np.int64)
        sums = np.zeros((len(ids) + 1, count + 1))
        np.cumsum(self.odds[ids], 0, out=sums[1:, :count])
        np.cumsum(ids > 0, out=sums[1:, count])
        found = sums[rows[1:]] - sums[rows[:-1]]
        return np.where(found[:, count] > 0, found[:, :count].argmax(1), count)

    def scores(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        ids = self.known(ids)
        p, t = self.raw(ids, rows), self.thresholds[self.groups(ids, rows)]
        return np.clip(np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)), 0, 1)


def best_threshold(p: np.ndarray, clean: np.ndarray, toxic: np.ndarray, fallback: float) -> float:
    """The threshold with most of (caught toxic share - 3 x flagged clean share), midway in its gap; fallback with few of a class.

    p: ascending probabilities; clean, toxic: how many rows have each.
    """
    if toxic.sum() < 15 or clean.sum() < 15:
        return fallback
    cuts = np.concatenate([p[:1] / 2, (p[1:] + p[:-1]) / 2, [(1 + p[-1]) / 2]])
    caught, flagged = (np.concatenate([x[::-1].cumsum()[::-1], [0]]) / x.sum() for x in (toxic, clean))
    gain = caught - 3 * flagged
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(np.clip(cuts[best].mean(), 0.02, 0.98))


def document_counts(sequences: list[np.ndarray], size: int) -> np.ndarray:
    """How many sequences hold each id."""
    out = np.zeros(size, np.int64)
    for x in sequences:
        out[np.unique(x)] += 1
    return out


def log_odds(k0: np.ndarray, k1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Start of the embeddings: log odds of documents of class 1 with the word, less two standard errors; 0 for the padding.

    k0, k1: documents of each class with the word, of n0 and n1.
    """
    odds = np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1))
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5)))
    odds[k0 + k1 == 0] = 0
    odds[0] = 0
    return odds.astype(np.float32)


def language_odds(sequences: list[np.ndarray], langs: list, size: int) -> np.ndarray:
    """``share_odds`` of the languages of ``LANG_DOCS`` sequences at least, in code-point order."""
    names = sorted({x for x in langs if x is not None and langs.count(x) >= LANG_DOCS})
    counts = [document_counts([s for s, x in zip(sequences, langs, strict=True) if x == name], size) for name in names]
    return share_odds(np.array(counts).reshape(len(names), size), np.array([langs.count(x) for x in names]))


def share_odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(size, languages): log share of a language's documents that hold the word, less the mean over languages."""
    if not len(counts):
        return np.zeros((counts.shape[1], 0), np.float32)
    logs = np.log((counts.T + 0.5) / (totals + 1))
    odds = logs - logs.mean(1, keepdims=True)
    odds[0] = 0
    return odds.astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, allowed=None) -> DataFrame | None:
    """Written: shard, mark, label, lang and ids (bucket of each word, 32-bit) of every row with a text whose id has a label; None without labels of both classes."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = (marked.where(allowed) if allowed is not None else marked).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    marked = written(marked, "labels", parts_for(labels))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    shards = max(1, min(-(-sum(counts.values()) // SHARD_ROWS), min(counts.values()) // SHARD_CLASS))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(marked.select(mark_of("doc_id", 9).alias("mark")), "mark", LABEL_BITS))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64("text").alias("h"), "text")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.has(batch.column("mark").to_numpy())))
            for part in chunks(batch):
                words = Words(part.column("text"), True, _BREAKS)
                found = word_ids(words).astype(np.int32)
                cells = [found[a:b].tobytes() for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "mark", "lang", "h")] + [pa.array(cells, pa.binary())], ["doc_id", "mark", "lang", "h", "ids"])

    rows = arrow_map(texts.withColumn("mark", mark_of("doc_id", 9)), run, "doc_id long, mark long, lang string, h long, ids binary").join(marked, "doc_id")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)).cast("int"))
    out = written(rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "mark", "doc_id", "h", "lang").select("shard", "mark", "label", "lang", "ids"), "labelled")
    drop_scratch(marked)
    shared.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame, allowed=None) -> Model | None:
    """Model from the labelled documents that meet ``allowed``, a condition on doc_id; None without both classes."""
    rows = labelled(docs, labels, allowed)
    model = None if rows is None else fitted(rows)
    if rows is not None:
        drop_scratch(rows)
    give_back()
    return model


def fitted(rows: DataFrame, widths: tuple[int, ...] = WIDTHS) -> Model | None:
    """Model from all rows that ``labelled`` gave."""
    sc = rows.sparkSession.sparkContext
    calibrates = F.pmod("mark", F.lit(5)) == 0
    counts = {(r["label"], r["c"]): r["count"] for r in rows.groupBy("label", calibrates.alias("c")).count().collect()}
    if len({label for label, _ in counts}) < 2:
        return None
    split = sum(counts.values()) >= 50
    learn, held = (rows.where(~calibrates), rows.where(calibrates)) if split else (rows, rows)
    of = np.array([sum(n for (label, c), n in counts.items() if label == k and not (split and c)) for k in (0, 1)])
    langs = {r["lang"]: r["count"] for r in learn.where("lang is not null").groupBy("lang").count().where(F.col("count") >= max(LANG_DOCS, LANG_SHARE * of.sum())).collect()}
    names = sorted(langs)
    buckets, groups = word_counts(learn, names, max(MIN_DOCS, MIN_SHARE * of.sum()))
    size = len(buckets) + 1
    net = ConvNet(size, DIM, widths, FILTERS, 2, seed=9, zero=True)
    by = groups.reshape(len(names) + 1, 2, size)
    net.table[:, 0] = 0.3 * log_odds(by[:, 0].sum(0), by[:, 1].sum(0), *of)
    model = Model(buckets, net, share_odds(by[:-1].sum(1), np.array([langs[x] for x in names])), np.array([0.5]))
    net.begin()
    weights = (of.sum() / 2 / np.maximum(of, 1)).astype(np.float32)
    for epoch in range(EPOCHS):
        shared = sc.broadcast(model)
        net.put(averaged(epoch_of(learn, shared, weights, epoch), len(net.state())))
        shared.destroy()
    net.end()
    shared = sc.broadcast(model)
    group, p, clean, toxic = probabilities(held, shared)
    shared.destroy()
    each = np.unique(p, return_inverse=True)[1]
    fallback = best_threshold(np.unique(p), np.bincount(each, clean), np.bincount(each, toxic), FEW_ROWS_THRESHOLD)
    model.thresholds = np.array([best_threshold(p[group == g], clean[group == g], toxic[group == g], fallback) for g in range(len(names) + 1)])
    return model


def word_counts(rows: DataFrame, langs: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that ``least`` rows hold, and how many rows of each language (last: of others) and class do: (2 * languages + 2, buckets + 1)."""
    at = {x: 2 * i for i, x in enumerate(langs)}

    def run(batches):
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for part in (p for b in batches for p in chunks(b, name="ids")):
            ids, ends = id_rows(part)
            group = np.array([at.get(x, 2 * len(langs)) for x in part.column("lang").to_pylist()]) + part.column("label").to_numpy()
            once = np.unique(np.repeat(np.arange(part.num_rows), np.diff(ends)) << 21 | ids)
            waiting.append(group[once >> 21] << 21 | once & (1 << 21) - 1)
            if sum(map(len, waiting)) > 1 << 20:
                keys, counts = merged(keys, counts, waiting)
                waiting = []
        keys, counts = merged(keys, counts, waiting)
        for a in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys[a : a + (1 << 16)]), "n": pa.array(counts[a : a + (1 << 16)])})

    low = F.lit((1 << 21) - 1)
    found = arrow_map(rows.select("lang", "label", "ids"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = found.groupBy(F.col("k").bitwiseAND(low).cast("int").alias("bucket")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("k", "n")).alias("each")).where((F.col("total") >= least) & (F.col("bucket") > 0))
    got = found.select("bucket", F.explode("each").alias("e")).select("bucket", F.shiftright("e.k", 21).cast("int").alias("g"), "e.n").toArrow()
    buckets, place = np.unique(got.column("bucket").to_numpy().astype(np.int64), return_inverse=True)
    out = np.zeros((2 * len(langs) + 2, len(buckets) + 1), np.int64)
    out[got.column("g").to_numpy(), place + 1] = got.column("n").to_numpy()
    return buckets, out


def merged(keys: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, with one more for each of ``more``."""
    fresh = np.concatenate([np.zeros(0, np.int64), *more])
    found, place = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
    return found, np.bincount(place, np.concatenate([counts, np.ones(len(fresh), np.int64)]), len(found)).astype(np.int64)


def id_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one after the other, and the offsets of the rows."""
    data, ends = text_buffers(batch.column("ids"))
    return np.frombuffer(data.tobytes(), np.int32), ends // 4


def buffers(batches):
    """(shard, first mark, ids of each row, labels) of runs of rows of a shard with about ``BUFFER_BYTES``, whatever the batches are."""
    key, found, y, size = (), [], [], 0
    for part in (p for b in batches for p in chunks(b, name="ids")):
        ids, ends = id_rows(part)
        for i, (shard, mark, label) in enumerate(zip(*(part.column(c).to_pylist() for c in ("shard", "mark", "label")), strict=True)):
            if found and (shard != key[0] or size >= BUFFER_BYTES):
                yield *key, found, np.array(y)
                found, y, size = [], [], 0
            if not found:
                key = (shard, mark)
            found.append(ids[ends[i] : ends[i + 1]])
            y.append(label)
            size += 4 * len(found[-1])
    if found:
        yield *key, found, np.array(y)


def epoch_of(rows: DataFrame, shared, weights: np.ndarray, epoch: int) -> DataFrame:
    """The state of the network after the steps of each shard: piece, shard, at, docs, values."""

    def run(batches):
        last, begun = None, 0
        for shard, mark, found, y in buffers(batches):
            if shard != last:
                if last is not None:
                    yield pieces(net.state(), last, first, docs)
                model, last, first, docs, begun = copy.deepcopy(shared.value), shard, mark, 0, 0
                net = model.net
            found = [model.known(x) for x in found]
            order = np.random.default_rng([11, epoch, shard, begun]).permutation(len(y))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                net.learn([found[i] for i in part.tolist()], y[part], weights[y[part]], pace(RATE, epoch, EPOCHS), DECAY)
            docs, begun = docs + len(y), begun + 1
        if last is not None:
            yield pieces(net.state(), last, first, docs)

    return arrow_map(rows.select("shard", "mark", "label", "ids"), run, "piece int, shard int, at long, docs long, values binary")


def pieces(state: np.ndarray, shard: int, at: int, docs: int) -> pa.RecordBatch:
    cells = [state[a : a + PIECE].tobytes() for a in range(0, len(state), PIECE)]
    n = len(cells)
    return pa.RecordBatch.from_pydict({"piece": pa.array(range(n), pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "at": pa.array([at] * n, pa.int64()), "docs": pa.array([docs] * n, pa.int64()), "values": pa.array(cells, pa.binary())})


def averaged(parts: DataFrame, size: int) -> np.ndarray:
    """Mean state by rows, added up in the order of the shards."""

    def run(batches):
        last, total, docs = None, None, 0
        for batch in batches:
            for piece, n, cell in zip(*(batch.column(c).to_pylist() for c in ("piece", "docs", "values")), strict=True):
                if piece != last:
                    if last is not None:
                        yield mean(last, total, docs)
                    last, total, docs = piece, 0.0, 0
                total, docs = total + n * np.frombuffer(cell, np.float32).astype(float), docs + n
        if last is not None:
            yield mean(last, total, docs)

    def mean(piece, total, docs):
        return pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "values": pa.array([(total / docs).astype(np.float32).tobytes()], pa.binary())})

    tasks = min(-(-size // PIECE), parts.sparkSession.sparkContext.defaultParallelism)
    got = arrow_map(parts.repartitionById(tasks, F.col("piece") % tasks).sortWithinPartitions("piece", "shard", "at"), run, "piece int, values binary").toArrow().sort_by("piece")
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in got.column("values")])


def probabilities(rows: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of a text, probability (ascending within a group), and how many clean and toxic rows have both."""

    def run(batches):
        model = shared.value
        for part in (p for b in batches for p in chunks(b, name="ids")):
            ids, ends = id_rows(part)
            ids = model.known(ids)
            p = np.clip(model.raw(ids, ends), 1e-9, 1 - 1e-9)
            step = np.rint(STEPS * np.log(p / (1 - p))).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"g": pa.array(model.groups(ids, ends), pa.int64()), "step": pa.array(step), "label": part.column("label")})

    found = arrow_map(rows.select("label", "ids"), run, "g long, step long, label int").groupBy("g", "step").agg(F.count_if(F.col("label") == 0).alias("clean"), F.sum("label").alias("toxic")).toArrow().sort_by([("g", "ascending"), ("step", "ascending")])
    g, step, clean, toxic = (found.column(c).to_numpy() for c in ("g", "step", "clean", "toxic"))
    return g, 1 / (1 + np.exp(-step / STEPS)), clean, toxic


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in (p for b in batches for p in chunks(b)):
            value = scores_of(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(value, pa.float64()), "predicted": pa.array((value >= 0.5).astype(np.int32), pa.int32())})

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, score double, predicted int")


def scores_of(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    words = Words(texts, True, _BREAKS)
    return model.scores(word_ids(words), words.rows)


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches):
        for batch in (p for b in batches for p in _chunks_with_nulls(b)):
            yield batch.filter(pa.array(scores_of(shared.value, batch.column(at).fill_null("")) < 0.5))

    return arrow_map(docs, run, docs.schema)


def _chunks_with_nulls(batch: pa.RecordBatch):
    at = batch.schema.get_field_index("text")
    sizes = chunks(pa.RecordBatch.from_arrays([batch.column(at).fill_null("")], ["text"]))
    start = 0
    for part in sizes:
        yield batch.slice(start, part.num_rows)
        start += part.num_rows


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; documents whose crc32 of the id mod 5 is 0 train nothing."""
    model = train(docs, labels, id_crc() % 5 != 0)
    return score(docs, model).select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted")
