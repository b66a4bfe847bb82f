"""Operator 5: language identification by a byte convolutional network.

Byte embeddings, filters over 2, 3 and 4 bytes, max pooling and softmax, trained in numpy on labelled texts and
applied to batched fixed-length windows that cover the whole text. A document's prediction is the language
with the highest mean probability over its windows, weighted by their bytes; the score is that mean.

Training takes a bounded sample of labelled rows and their whole texts: of each language the ``PER_LANG`` documents with the
lowest hash of the id, as long as their texts stay within ``LANG_BYTES`` (a text of over ``ROW_BYTES`` trains nothing); of rows that share
an id and a language one counts. Scoring is one map over all texts, free style (mapInArrow). Null texts and texts without a letter get
``und`` and score 0; without any labelled text all get ``und``; of languages with equal means the first in code-point order is predicted;
repeated rows repeat; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, chunks, drop_scratch, give_back, id_crc, low_marks, mark_of, sampled, text_buffers, text_or_empty, written
from legajo.llm.convnet import ConvNet

WINDOW, WIDTHS = 128, (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
PER_LANG, LANG_BYTES, ROW_BYTES, EPOCHS = 400, 1 << 20, 1 << 17, 6
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    net: ConvNet


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (windows, WINDOW), the row of each and its bytes; the last window of a row is padded."""
    sizes = np.diff(offsets)
    each = np.maximum(1, -(-(sizes - WINDOW + STRIDE) // STRIDE))
    row = np.repeat(np.arange(len(sizes)), each)
    start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    room = np.minimum(offsets[1:][row] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < room[:, None]
    ids = np.zeros(at.shape, np.int16)
    ids[inside] = data[at[inside]].astype(np.int16) + 1
    return ids, row, room


def window_probabilities(net: ConvNet, ids: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(ids), 64):
        part = net.table[ids[a : a + 64]].reshape(len(ids[a : a + 64]), -1)
        cols = np.lib.stride_tricks.as_strided(part, (len(part), STRIDE, net.width * net.dim), (part.strides[0], 4 * net.dim, 4))
        value = (cols.reshape(-1, net.width * net.dim) @ net.conv).reshape(len(part), STRIDE, -1).max(1)
        out.append(net.probabilities(value + net.bias))
    return np.concatenate(out) if out else np.zeros((0, len(net.out)))


def train(docs: DataFrame, allowed=None) -> Model | None:
    """Model from the rows with text, lang and ``allowed`` (a condition); None if there are none."""
    rows = docs.where(F.col("lang").isNotNull())
    rows = (rows.where(allowed) if allowed is not None else rows).withColumn("mark", mark_of("doc_id", 5))
    low = low_marks(rows.select("lang", "mark", "text"), "lang", PER_LANG, rows.select("lang", "mark")).where(F.col("text").rlike(r"\p{L}"))
    one = low.groupBy("lang", "mark").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    kept = written(one.select("lang", "mark", F.octet_length("row.text").cast("long").alias("n"), "row.text"), "sample")
    sample = sampled(kept, "lang", PER_LANG, LANG_BYTES, ROW_BYTES).sort_by([("lang", "ascending"), ("mark", "ascending")])
    drop_scratch(kept)
    if not sample.num_rows:
        return None
    langs = sorted(set(sample.column("lang").to_pylist()))
    buffers, label = text_buffers(sample.column("text").combine_chunks()), np.searchsorted(langs, sample.column("lang").to_pylist())
    ids, row, room = windows(*buffers)
    keep = room >= np.minimum(48, np.diff(buffers[1])[row])  # no short last windows, but short texts
    ids, row = ids[keep].astype(np.int64), row[keep]
    net = ConvNet(257, 6, WIDTHS, 12, len(langs), seed=5)
    counts = np.bincount(label[row], minlength=len(langs))
    net.fit(list(ids), label[row], EPOCHS, rate=0.02, batch=128, weights=(len(row) / len(langs) / np.maximum(counts, 1))[label[row]])
    give_back()
    return Model(langs, net)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in (p for b in batches for p in chunks(b)):
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if m is not None:
                ids, row, room = windows(*text_buffers(batch.column("text")))
                p = window_probabilities(m.net, ids) * np.maximum(room, 1)[:, None]
                first = np.searchsorted(row, np.arange(batch.num_rows))
                mean = np.add.reduceat(p, first) / np.add.reduceat(np.maximum(room, 1), first)[:, None]
                known = np.asarray(batch.column("letters").to_pylist(), bool)
                lang[known] = np.array(m.langs, object)[mean[known].argmax(1)]
                score[known] = np.clip(mean[known].max(1), 0, 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score, pa.float64())})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), letters), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents whose crc32 of the id mod 4 is 2 train nothing."""
    held = (id_crc() % 4 == 2).alias("held_out")
    return predict(docs, train(docs, id_crc() % 4 != 2)).select("doc_id", held, "lang_pred", "score")
