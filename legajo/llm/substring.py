"""Operator 4: substring dedup by seed and extend.

A window is ``LENGTH`` consecutive words. Its anchor is the least hash of the ``GRAM``-word runs in it (winnowing), so equal windows
have equal anchors, and one anchor stands for a run of neighbouring windows. Documents are joined on anchors: only anchors that
two documents have are seeds. A seed is extended both ways over its whole run of windows: runs of equal content are
settled at once by the least id that has them; where an anchor has different runs, one document for each different run
is extended window by window. A window that also starts in a document with a smaller id marks its words; marks of neighbouring
windows unite to maximal repeats of at least ``LENGTH`` words. All comparisons are on the input, in minima by two hashes of 64 bits,
the anchor's and the run's or window's, so nothing pairs the documents of a common passage with each other, and minima are
pre-aggregated before each shuffle.

Free style: texts are mapped in numpy, the rest is native. The live anchors are broadcast as a bitmap of fixed size. Null texts have no
words; documents without an id neither lose words nor take them from others; rows that share an id are one document
(never smaller than itself); other columns stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, bitmap_of, chunks, free_names, kept, parts_for, text_or_empty, written
from legajo.llm.words import Words

LENGTH, GRAM, BITS, SALTS = 50, 20, 23, 8


def least_within(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    n, out, span = len(values) - width + 1, values, 1
    if n <= 0:
        return values[:0]
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[:n], out[width - span : width - span + n])


def runs(words: Words, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and anchor of each run, and the mask of windows that lie in one row."""
    anchor = least_within(words.grams(gram), length - gram + 1)
    n = len(anchor)
    row = np.searchsorted(words.rows, np.arange(n), "right") - 1
    inside = np.arange(n) + length <= words.rows[row + 1] if n else np.zeros(0, bool)
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(np.searchsorted(np.flatnonzero(inside), first), inside.sum()))
    return row[first], first, count, anchor[first], inside


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in (p for b in batches for p in chunks(b)):
            row, _, _, anchor, _ = runs(Words(batch.column("text"), False), length, gram)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(anchor.view(np.int64))], ["doc_id", "anchor"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, anchor long")


def _seeded(docs: DataFrame, live, length: int, gram: int) -> DataFrame:
    """doc_id, th, anchor, run, start, n and the window hashes of each run whose anchor is live."""

    def run(batches):
        for batch in (p for b in batches for p in chunks(b)):
            words = Words(batch.column("text"), False)
            row, first, count, anchor, _ = runs(words, length, gram)
            keep = live.value.has(anchor)
            row, first, count, anchor = row[keep], first[keep], count[keep], anchor[keep]
            ends = np.cumsum(count)
            at = np.arange(count.sum()) + np.repeat(first - (ends - count), count)
            hashes = words.grams(length)[at] if len(at) else np.zeros(0, np.uint64)
            windows = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes.view(np.int64)))
            content = words.span(first, first + count + length - 1).view(np.int64)
            start = (first - words.rows[row]).astype(np.int32)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(anchor.view(np.int64)), pa.array(content), pa.array(start), pa.array(count.astype(np.int32)), windows],
                ["doc_id", "th", "anchor", "run", "start", "n", "windows"],
            )

    return arrow_map(docs, run, "doc_id long, th long, anchor long, run long, start int, n int, windows array<long>")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, th, marks: word intervals (begin, end) of each document whose windows also start in one with a smaller id.

    docs: doc_id (long), th (hash of the text), text (never null).
    """
    parts = parts_for(docs)
    docs = docs.where("doc_id is not null").select("doc_id", "th", "text")
    shared = _anchors(docs, length, gram).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi")
    live = docs.sparkSession.sparkContext.broadcast(bitmap_of(shared, "anchor", BITS))
    seeds = kept(_seeded(docs, live, length, gram))

    # A run or window of a common passage has many holders, a common anchor many runs: they are dealt over SALTS keys.
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = lambda name: F.pmod(F.xxhash64(name, F.lit(5)), F.lit(SALTS)).cast("int")
    kinds = seeds.groupBy("anchor", "run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = kinds.groupBy("anchor").agg((F.min("run") != F.max("run")).alias("several")).where("several").withColumn("salt", every)
    kinds = kinds.withColumn("salt", salt("run")).join(several, ["anchor", "salt"], "left").withColumn("several", F.coalesce("several", F.lit(False)))
    kinds = kinds.drop("salt").where("several or first != last")
    found = seeds.withColumn("salt", salt("doc_id")).join(kinds.withColumn("salt", every), ["anchor", "run", "salt"])
    mine = F.col("doc_id") == F.col("first")
    settled = kept(found.where(~mine | F.col("several")).select("doc_id", "th", "anchor", "start", "n", (~mine).alias("whole"), F.when(mine, F.col("windows")).alias("windows")))
    seeds.unpersist()
    whole = settled.where("whole").select("doc_id", "th", F.col("start").alias("begin"), (F.col("start") + F.col("n") - 1 + length).alias("end"))
    # equal windows have equal anchors: the two hashes tell them apart where the windows of a corpus are too many for 64 bits
    each = settled.where("not whole").select("doc_id", "th", "anchor", "start", F.posexplode("windows").alias("k", "window")).select("doc_id", "th", "anchor", "window", (F.col("start") + F.col("k")).alias("begin"))
    least = each.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").select("anchor", "window", "first")
    some = each.withColumn("salt", salt("doc_id")).join(least.withColumn("salt", every), ["anchor", "window", "salt"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "th", "begin", (F.col("begin") + length).alias("end"))
    marks = written(whole.union(some).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("marks")), "marks", parts)
    settled.unpersist()
    return marks


def _with_marks(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more, which hold the begins and ends of each row's intervals, and their names."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    key, th, begin, end = free_names(docs, "id", "th", "begin", "end")
    plain = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    marks = repeated_windows(plain, length, gram)
    marks = marks.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.transform("marks", lambda m: m["begin"]).alias(begin), F.transform("marks", lambda m: m["end"]).alias(end))
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64(text_or_empty()) == F.col(th))
    return docs.join(marks.hint("shuffle_hash"), same, "left").drop(key, th), begin, end


def kept_mask(n: int, begin: list[int], end: list[int]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.array(begin), 1)
    np.add.at(change, np.array(end), -1)
    return np.cumsum(change[:-1]) == 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches):
        for batch in (p for b in batches for p in chunks(b)):
            rows = []
            for text, begin, end in zip(batch.column("text"), batch.column(begins).to_pylist(), batch.column(ends).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                n, gone = len(words), 0
                if begin:
                    keep = kept_mask(n, begin, end)
                    gone, words = int(n - keep.sum()), list(compress(words, keep.tolist()))
                rows.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            n, gone, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked, begins, ends = _with_marks(docs.select("doc_id", "text"), length, gram)
    return arrow_map(marked.select("doc_id", text_or_empty().alias("text"), begins, ends), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs``, all columns, with the repeated words cut out of ``text``; untouched texts stay as they are."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (begin, end) in enumerate(zip(batch.column(begins).to_pylist(), batch.column(ends).to_pylist(), strict=True)):
                if begin:
                    words = Words(pa.array([texts[i]], pa.string()), False)
                    keep = kept_mask(len(words.starts), begin, end)
                    # a kept word takes the white space before it along
                    parts = [bytes(words.data[a:b]) for a, b, k in zip([0, *words.ends[:-1].tolist()], words.ends.tolist(), keep.tolist(), strict=True) if k]
                    texts[i] = b"".join(parts).decode()
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    marked, begins, ends = _with_marks(docs, length, gram)
    return arrow_map(marked, run, docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema)
