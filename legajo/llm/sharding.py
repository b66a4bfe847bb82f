"""Operator 1: sharding by vector bin packing of bytes, tokens and rows.

Groups of equal texts are the things to pack. Light groups are gathered by hash into a fixed number of cells; a group
that holds more than ``1 / (shards * PIECES)`` of all bytes, tokens or rows is split into pieces about that large by a hash of its ids, or of
row numbers that are stored with the sizes where one id holds more than a piece, so a group of copies never has to fit one shard. Fewer than ``3 * shards * PIECES`` groups can be that heavy, so
the items (cells and pieces) that the driver packs are bounded by parameters, whatever the input. Largest first, each
item goes to the shard where the dot product of its (bytes, tokens, rows) with the residual capacity is highest; the weights let
bytes lead. The law is ``bytes``: shards get nearly equal sizes.

Slots come from one window per item plus the item's offset in its shard, so no task numbers a whole shard. Null texts
count as empty (size 16, crc32 0), a null id sorts first, repeated rows get slots of their own, other columns are ignored, and
an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import text_or_empty, written
from legajo.llm.words import WORD_SQL

CELLS_PER_SHARD, PIECES = 256, 32
WEIGHTS = (1.0, 0.05, 0.05)


def pack(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows), by greatest dot product with the residual capacity."""
    total = items.sum(0)
    share = items / np.where(total > 0, total, 1) * shards
    residual, out = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for i in np.argsort(-(share @ np.array(weights)), kind="stable"):
        out[i] = np.argmax(residual @ (share[i] * weights))
        residual[out[i]] -= share[i]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and group of every row, without the texts."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD_SQL)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard of every row."""
    spark, slim = docs.sparkSession, written(measured(docs).withColumn("mark", F.monotonically_increasing_id()), "sizes")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    total = slim.agg(*sums).first()
    cells, parts = shards * CELLS_PER_SHARD, shards * PIECES
    share = F.greatest(*[F.col(c) / F.lit(max(total[c] or 0, 1)) for c in "btr"]) * parts
    heavy = slim.groupBy("grp").agg(*sums).select("grp", "r", share.alias("share")).where("share > 1").orderBy("grp").collect()
    first, rows = cells, []
    for h in heavy:
        n = int(min(h.r, np.ceil(h.share)))
        rows.append((h.grp, first, n, h.r))
        first += n
    # fewer than 3 * parts groups, and fewer than twice as many ids that hold more than a piece's rows, whatever the input
    split = spark.createDataFrame(rows, "grp long, first long, pieces long, rows long")
    crowds = slim.join(F.broadcast(split), "grp").groupBy("grp", "doc_id", "pieces", "rows").agg(F.count("*").alias("n")).where("n > 1 and n * pieces > rows")
    crowds = spark.createDataFrame(crowds.select("grp", "doc_id").collect(), "grp long, doc_id long").select(F.col("grp").alias("_grp"), F.col("doc_id").alias("_id"), F.lit(True).alias("crowd"))
    slim = slim.join(F.broadcast(crowds), (F.col("grp") == F.col("_grp")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_grp", "_id")
    piece = F.col("first") + F.pmod(F.when(F.col("crowd"), F.xxhash64("mark", F.lit(1))).otherwise(F.xxhash64("doc_id", F.lit(1))), F.col("pieces"))
    item = F.coalesce(piece, F.pmod(F.xxhash64("grp", F.lit(2)), F.lit(cells)))
    placed = slim.join(F.broadcast(split), "grp", "left").withColumn("item", item)
    found = placed.groupBy("item").agg(*sums).orderBy("item").collect()
    sizes = np.array([(x.b, x.t, x.r) for x in found], float).reshape(-1, 3)
    where = pack(sizes, shards)
    order = np.lexsort([np.arange(len(found)), where])
    count = sizes[order, 2].astype(np.int64)
    start = np.cumsum(count) - count
    base = np.zeros(shards, np.int64)
    np.add.at(base, where[order], count)
    begin = (np.cumsum(base) - base)[where[order]]
    plan = [(found[i].item, int(where[i]), int(s - b)) for i, s, b in zip(order.tolist(), start.tolist(), begin.tolist(), strict=True)]
    target = spark.createDataFrame(plan, "item long, shard int, offset long")
    row = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "text_crc32", "size"))
    return placed.join(F.broadcast(target), "item").select(
        "doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + row - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
