"""Operator 8: mixing sources to target weights.

A source's words, in a fixed order of its documents, are packed into blocks of ``BLOCK`` words. Each source's target
is turned into slots; every output shard draws multinomial source counts from the slots that are left, so the counts
over all shards meet the targets. A source's slots are mapped through pseudorandom permutations of its block indexes (a keyed
Feistel network with cycle walking, another key for each pass over the source), so no block repeats within a pass
and none is taken more than twice; the last slot is cut to meet the target to the word. Slots and blocks then join by index.

The driver handles one row for each source and ``SHARDS`` times as many counts. Word offsets come from two-level
prefix sums (hash buckets within a source), so a hot source is never numbered in one task. Free style: slots are made in
mapInArrow, the rest is native. Null texts have no words and are never taken; a null source is a source, last in order; a source
without words gets target 0; repeated rows are different documents of equal size; other columns are ignored; an empty table stays empty.
Results depend only on the rows, not on partitioning.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, free_names, text_or_empty, written
from legajo.llm.words import WORD_SQL, Words, mix

BLOCK, SHARDS, SLICE = 256, 64, 1 << 16
#: Least number of a source's hash buckets, rows of a bucket beyond it, and slots that a task makes.
BUCKETS, BUCKET_ROWS, TASK_SLOTS = 1024, 100_000, 1 << 19
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Targets of the sources in order: the total by repeating weights, none above ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * unit > most * sizes[i]]
        for i in full or free:
            out[i] = Fraction(most * sizes[i]) if full else weight[i] * unit
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)] if full else []
    return out


class Permutation:
    """A keyed permutation of [0, n) and its inverse, in numpy."""

    def __init__(self, n: int, key: int):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.n, self.half, self.low = n, np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = mix(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 63) - 1))

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left + k) & self.low), left
            else:
                left, right = right, left ^ (mix(right + k) & self.low)
        return (left << self.half) | right

    def __call__(self, index: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._step(np.asarray(index, np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._step(x[out], back)
        return x.astype(np.int64)


def pass_key(source: int, number: int) -> int:
    return (source * 64 + number) * 2654435761 + 17


def slots_of(source: int, size: int, target: int, block: int) -> tuple[int, int]:
    """Slots that reach ``target`` words, and the words that the last one takes."""
    blocks = -(-size // block)
    passes, rest = divmod(target, size) if size else (0, 0)
    if not rest:
        return passes * blocks, block
    tail, place = size - (blocks - 1) * block, int(Permutation(blocks, pass_key(source, passes))(np.array([blocks - 1]), back=True)[0])
    words = lambda m: m * block - (block - tail) * (place < m)  # noqa: E731  in the first m slots of a pass
    m = max(1, rest // block)
    while words(m) < rest:
        m += 1
    return passes * blocks + m, rest - words(m - 1)


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Multinomial counts (shards, sources) from the slots that are left; columns sum to ``slots``."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        want = -(-int(left.sum()) // (shards - k))
        while want > 0 and left.sum() > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and row, a digest of id, source and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text_or_empty(), F.lit(WORD_SQL)).cast("long").alias("size"), row_key().alias("row"))


def row_key():
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "source", "text")]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts).cast("binary")))


def _plan(rows: list, block: int, seed: int) -> list[tuple]:
    """(source, sid, source_size, target, blocks, slots, last) in code-point order, null last."""
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    goal = targets([int(r.size or 0) for r in rows])
    out = []
    for i, (r, t) in enumerate(zip(rows, goal, strict=True)):
        size = int(r.size or 0)
        out.append((r.source, i, size, float(t), -(-size // block), *slots_of(i, size, min(MOST * size, round(t)), block)))
    return out


def _slots(spark, plan: list[tuple], shards: int, seed: int) -> DataFrame:
    """shard, slot, sid, block, words: every slot with its block index; a slot takes the block's first words."""
    counts = draw([p[5] for p in plan], shards, seed)
    before = np.cumsum(counts, 0) - counts
    inside = np.cumsum(counts, 1) - counts
    runs = [(k, int(inside[k, i]), i, p[4], int(before[k, i]), int(counts[k, i]), p[5], p[6]) for k in range(shards) for i, p in enumerate(plan) if counts[k, i]]
    df = spark.createDataFrame(runs, "shard int, slot long, sid int, blocks long, first long, n long, slots long, last long")
    cut = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))))
    size, block = SLICE, BLOCK

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                j = r["first"] + r["k"] + np.arange(min(size, r["n"] - r["k"]))
                number, place = np.divmod(j, r["blocks"])
                index = np.empty_like(j)
                for e in np.unique(number):
                    index[number == e] = Permutation(r["blocks"], pass_key(r["sid"], int(e)))(place[number == e])
                words = np.where(j == r["slots"] - 1, r["last"], block)
                same = lambda v, t: pa.array(np.full(len(j), v), t)
                yield pa.RecordBatch.from_pydict({"shard": same(r["shard"], pa.int32()), "slot": pa.array(r["slot"] + r["k"] + np.arange(len(j)), pa.int64()), "sid": same(r["sid"], pa.int32()), "block": pa.array(index, pa.int64()), "words": pa.array(words, pa.int64())})

    # the seeds are tiny, the slots are not: their number decides how many tasks make them
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // TASK_SLOTS))
    return arrow_map(cut.repartition(tasks, "shard", "sid", "k"), run, "shard int, slot long, sid int, block long, words long")


def mix_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source and its target, and the taken pieces.

    Documents: doc_id, size, sid, source_size, target, source, row, bucket and nth (with sid, its key), copy (number among rows of the same id,
    source and text) and start (first word in the source).
    Pieces: the same with shard, slot, from and to (words of the document, from <= to); documents that nothing is taken of have one piece without shard.
    Buckets grow in number with the rows; rows equal in id, source and text share one.
    """
    spark, slim = docs.sparkSession, written(sized(docs), "sizes")
    plan = _plan((sums := slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()), BLOCK, seed)
    buckets = max([BUCKETS, *[-(-r.n // BUCKET_ROWS) for r in sums]])
    table = spark.createDataFrame([(s, i, n, t) for s, i, n, t, *_ in plan], "name string, sid int, source_size long, target double")
    named = slim.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    named = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), F.lit(buckets)).cast("int"))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "row")
    inner = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = named.withColumn("upto", inner).withColumn("nth", F.row_number().over(order))
    placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy("sid", "bucket", "doc_id", "row").orderBy("nth"))).join(sums, ["sid", "bucket"])
    placed = placed.select("doc_id", "size", "sid", "source_size", "target", "source", "row", "bucket", "nth", "copy", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    blocks = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    # Both sides grow with the corpus, whatever the planner makes of the slots' small seed table: never broadcast.
    joined = blocks.join(_slots(spark, plan, shards, seed).hint("merge"), ["sid", "block"], "left")
    origin = F.col("block") * BLOCK - F.col("start")
    pieces = joined.select("doc_id", "size", "sid", "source_size", "target", "source", "row", "bucket", "nth", "copy", "shard", "slot", F.greatest(F.lit(0), origin).alias("from"), F.least("size", origin + F.col("words")).alias("to"))
    return placed, pieces.withColumn("to", F.when(F.col("shard").isNotNull(), F.greatest("to", "from")))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    _, pieces = mix_documents(docs)
    taken = F.sum(F.coalesce(F.col("to") - F.col("from"), F.lit(0))).cast("long").alias("taken")
    return pieces.groupBy("doc_id", "size", "sid", "bucket", "nth", "source_size", "target").agg(taken).select("doc_id", "size", "source_size", "target", "taken")


def chosen(begin: list[int], end: list[int]) -> list[list[tuple[int, int]]]:
    """Word runs in reading order, neighbours united; what is taken twice makes a second list."""
    layers: list[list[tuple[int, int]]] = [[], []]
    seen: set[int] = set()
    for a, b in sorted(zip(begin, end, strict=True)):
        layer = layers[a in seen]
        seen.add(a)
        if layer and layer[-1][1] == a:
            layer[-1] = (layer[-1][0], b)
        else:
            layer.append((a, b))
    return [x for x in layers if x]


def mixed_texts(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the taken words as text: pieces keep their white space, a whole text stays as it is.

    Rows are told apart by id, source and text; of rows equal in all three each gets pieces of its own. Rows that nothing is taken of go.
    """
    names = docs.columns
    at = names.index("text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    _, pieces = mix_documents(docs)
    taken = pieces.where("shard is not null and to > from").groupBy("row", "copy").agg(F.collect_list(F.struct("from", "to")).alias("p"))
    taken = taken.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("copy", "p"))).alias("p"))
    row, copy, piece, begins, ends = free_names(docs, "row", "copy", "piece", "begin", "end")
    taken = taken.select(F.col("row").alias(row), F.col("p").alias(piece))
    # rows and their copies' pieces meet by digest, where equal rows are numbered without another shuffle
    joined = docs.withColumn(row, row_key()).join(taken.hint("merge"), row)
    joined = joined.withColumn(copy, F.row_number().over(Window.partitionBy(row).orderBy(row))).withColumn(piece, F.col(piece)[F.col(copy)]).where(F.col(piece).isNotNull())
    joined = joined.select(*names, F.transform(piece, lambda x: x["from"]).alias(begins), F.transform(piece, lambda x: x["to"]).alias(ends))

    def run(batches):
        for batch in batches:
            texts = []
            for text, begin, end in zip(batch.column(at), batch.column(begins).to_pylist(), batch.column(ends).to_pylist(), strict=True):
                words = Words(pa.array([text.as_py()], pa.string()), False)
                raw, n = words.data.tobytes(), len(words.starts)
                parts = []
                for layer in chosen(begin, end):
                    parts.append("".join(raw[(words.ends[a - 1] if k and a else 0 if not a else words.starts[a]) : (len(raw) if b == n else words.ends[b - 1])].decode() for k, (a, b) in enumerate(layer)))
                texts.append("\n".join(parts))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(joined, run, docs.schema)
