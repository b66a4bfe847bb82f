"""Operator 6: embedding near-dedup by NN-descent.

Equal vectors become one class first, so copies are never paired. The neighbour graph starts from blocks of vectors that
lie together in several random-hyperplane orders and is refined by neighbours-of-neighbours joins: each vector is a pivot whose
neighbours and reverse neighbours meet, and what improves a list is merged into it, until few lists change. A list has ``K``
places; it is enlarged to ``K_MOST`` while it is saturated with neighbours beyond the threshold. Vectors whose lists are saturated even
then are completed exactly: they are grouped in cells, the centres of cells are compared with all vectors, and the vectors of a cell with all
that the angles leave possible, in blocks that emit counts and the components to be joined, but no pairs.
Recall is audited: a sample of ``AUDIT`` vectors, enlarged until it holds ``ENOUGH`` links, is compared with all rows in blocks, and while the
links found fall short of ``RECALL``, further orders are drawn and refined; after ``ROUNDS`` of them all vectors are completed exactly. Links are kept if their cosine in double precision meets the threshold.

Free style: numpy in mapInArrow over sorted partitions, grouped by streaming, so memory is bounded by a batch. Vectors that are null, empty,
zero or hold null or non-finite components, and rows without an id, link with nothing; vectors of different length don't link;
repeated rows count as other vectors; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, drop_scratch, parts_for, written
from legajo.llm.graph import components

K, K_MOST, ORDERS, BITS, BLOCK, SCAN = 8, 32, 4, 16, 256, 512
ROUNDS, STEPS, CHANGED, AUDIT, RECALL = 3, 6, 0.02, 256, 0.99
#: Slack of the half-precision cosines that lists are ranked by.
SLACK = 0.01
#: Links that a sample needs for its recall to count.
ENOUGH = 100
#: Cosine to its component's root from which a vector lies in the root's cell.
WIDE = 0.7


def vectors(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision."""
    out = []
    for x in column:
        v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
        v = v / np.abs(v).max()
        out.append(v / np.sqrt(np.dot(v, v)))
    return out


def _nodes(df: DataFrame) -> DataFrame:
    """id (least of its class), weight (rows of the class), key and other (two hashes that tell vectors apart), dim, unit vector (double) and half (for ranking)."""

    def run(batches):
        for batch in batches:
            units = vectors(batch.column("embedding"))
            keep = [batch.column(c) for c in ("id", "weight", "key", "other")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([len(v) for v in units], pa.int32()), pa.array([v.tobytes() for v in units], pa.binary()), pa.array([v.astype(np.float16).tobytes() for v in units], pa.binary())],
                ["id", "weight", "key", "other", "dim", "unit", "half"],
            )

    classes = df.where("not dead").groupBy("key", "other").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    return arrow_map(classes.select("id", "weight", "key", "other", "embedding"), run, "id long, weight long, key long, other long, dim int, unit binary, half binary")


def _matrix(column, kind) -> np.ndarray:
    """Rows of equal length from a binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1).astype(np.float32 if kind == np.float16 else kind)


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted stream; a group is the rows of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = np.asarray(batch.column(k))
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != np.asarray(held[-1].column(k))[-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            if held or cuts[-1] > 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], ["u", "v", "s"])


def _top(ids: np.ndarray, sims: np.ndarray, floor: float) -> pa.RecordBatch:
    """The nearest K of each row of a block and all beyond the threshold up to K_MOST."""
    np.fill_diagonal(sims, -2)
    k = min(K_MOST, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, 1)[:, :k]
    s = np.take_along_axis(sims, near, 1)
    order = np.argsort(-s, 1, kind="stable")
    near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
    keep = (np.arange(k) < K) | (s >= floor)
    return _edges(np.repeat(ids, k).reshape(s.shape)[keep], ids[near][keep], s[keep])


def _seeded(nodes: DataFrame, orders: range, floor: float) -> DataFrame:
    """u, v, s from blocks of neighbours in random-hyperplane orders."""

    def coded(batches):
        for batch in batches:
            dims, half = np.asarray(batch.column("dim")), batch.column("half")
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                x = _matrix(half.take(at), np.float16)
                for t in orders:
                    planes = np.random.default_rng([t, int(d)]).normal(size=(d, BITS)).astype(np.float32)
                    code = ((x @ planes) > 0) @ (1 << np.arange(BITS))
                    n = len(code)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(np.full(n, d), pa.int32()), pa.array(code, pa.int32()), batch.column("id").take(at), half.take(at)], ["t", "dim", "code", "id", "half"])

    def blocks(batches):
        for table in streamed(batches, ["t", "dim"]):
            # whole orders of a partition may be long: they are cut into blocks, batch by batch
            ids, t, d = (table.column(c).to_numpy() for c in ("id", "t", "dim"))
            starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                for i in range(a, b, BLOCK):
                    lo = max(a, min(i, b - BLOCK))  # the last block reaches back
                    hi = min(b, lo + BLOCK)
                    if hi - lo > 1:
                        x = _matrix(table.column("half").slice(lo, hi - lo), np.float16)
                        yield _top(ids[lo:hi], x @ x.T, floor)

    def bounded(batches):
        """Cut the stream into stretches of some thousand rows first."""
        for batch in batches:
            for i in range(0, batch.num_rows, 16 * BLOCK):
                yield from blocks(iter([batch.slice(i, 16 * BLOCK)]))

    codes = arrow_map(nodes.select("id", "dim", "half"), coded, "t int, dim int, code int, id long, half binary")
    dealt = codes.repartitionByRange("t", "dim", "code", "id").sortWithinPartitions("t", "dim", "code", "id")
    return arrow_map(dealt, bounded, "u long, v long, s float")


def _lists(edges: DataFrame, floor: float) -> DataFrame:
    """u, v, s, new: each vector's list, from edges with the flag ``new``; an edge that was there before is old."""
    edges = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return edges.withColumn("k", rank).where(f"k <= {K_MOST}").where((F.col("k") <= K) | (F.col("s") >= floor)).drop("k")


def _refined(nodes: DataFrame, lists: DataFrame, floor: float) -> DataFrame:
    """u, v, s that a neighbours-of-neighbours join finds and that improve a list."""
    worst = lists.groupBy("u").agg(F.min("s").alias("s"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("id"), F.when((F.col("n") >= K_MOST) | ((F.col("n") >= K) & (F.col("s") < floor)), F.col("s")).alias("worst"))
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "new")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    back = back.withColumn("k", rank).where(f"k <= {K_MOST}").where((F.col("k") <= K) | (F.col("s") >= floor)).drop("k")
    member = lists.union(back).groupBy("u", "v").agg(F.max("new").alias("new")).select(F.col("u").alias("pivot"), F.col("v").alias("id"), "new")
    active = member.where("new").select("pivot").distinct()
    member = member.join(active, "pivot", "left_semi")
    member = member.union(active.select("pivot", F.col("pivot").alias("id"), F.lit(False)))
    full = member.join(nodes.select("id", "dim", "half").join(worst, "id", "left"), "id")

    def run(batches):
        for table in streamed(batches, ["pivot"]):
            pivot, ids, new, dims = (table.column(c).to_numpy() for c in ("pivot", "id", "new", "dim"))
            limit = table.column("worst").fill_null(-2.0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
            sizes = np.diff(np.append(starts, len(pivot)))
            for d in np.unique(dims[starts]):
                for m in np.unique(sizes):
                    group = starts[(dims[starts] == d) & (sizes == m)]
                    if m < 2 or not len(group):
                        continue
                    for a in range(0, len(group), 512):
                        at = group[a : a + 512, None] + np.arange(m)
                        x = _matrix(table.column("half").take(pa.array(at.ravel())), np.float16).reshape(len(at), m, d)
                        sims = x @ x.transpose(0, 2, 1)
                        i, j = np.triu_indices(m, 1)
                        s, u, v = sims[:, i, j], at[:, i], at[:, j]
                        fresh = (new[u] | new[v]) & (ids[u] != ids[v])
                        for p, q in ((u, v), (v, u)):
                            keep = fresh & (s > limit[p])
                            yield _edges(ids[p[keep]], ids[q[keep]], s[keep])

    dealt = full.select("pivot", "id", "new", "dim", "half", "worst").repartition("pivot").sortWithinPartitions("pivot", "id")
    return arrow_map(dealt, run, "u long, v long, s float").groupBy("u", "v").agg(F.max("s").alias("s"))


def _descend(nodes: DataFrame, start: DataFrame, floor: float, n: int) -> DataFrame:
    """Lists after refining the lists of ``start`` (u, v, s, new)."""
    lists = written(_lists(start, floor), "lists", parts_for(nodes))
    for _ in range(STEPS):
        found = _refined(nodes, lists, floor).withColumn("new", F.lit(True))
        then, lists = lists, written(_lists(lists.withColumn("new", F.lit(False)).union(found), floor), "lists", parts_for(nodes))
        changed = lists.where("new").count()
        drop_scratch(then)
        if changed <= CHANGED * K * n:
            break
    return lists


def _exact(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b whose cosine in double precision meets the threshold."""

    def run(batches):
        for batch in batches:
            keep = [float(np.dot(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64))) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    one, other = nodes.select(F.col("id").alias("a"), F.col("unit").alias("x")), nodes.select(F.col("id").alias("b"), F.col("unit").alias("y"))
    return arrow_map(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _crossed(left: DataFrame, right: DataFrame, nodes: DataFrame, fn: Callable[[pa.Table, pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the rows and the cosines of each block of ``left`` with each block of ``right`` (both: g, id, equal further columns) of its group g."""
    sizes = left.groupBy("g").agg(F.ceil(F.count("*") / SCAN).cast("int").alias("i_blocks"))
    sizes = sizes.join(right.groupBy("g").agg(F.ceil(F.count("*") / SCAN).cast("int").alias("j_blocks")), "g")
    rows = left.withColumn("side", F.lit(0)).union(right.withColumn("side", F.lit(1))).join(sizes, "g").join(nodes.select("id", "weight", "unit"), "id")
    own = F.pmod(F.xxhash64("id", F.lit(4)), F.when(F.col("side") == 0, F.col("i_blocks")).otherwise(F.col("j_blocks"))).cast("int")
    across = F.when(F.col("side") == 0, F.col("j_blocks")).otherwise(F.col("i_blocks"))
    rows = rows.withColumn("own", own).withColumn("across", F.explode(F.sequence(F.lit(0), across - 1)))
    i, j = (F.when(F.col("side") == k, F.col("own")).otherwise(F.col("across")) for k in (0, 1))
    rows = rows.select(*left.columns, "side", i.alias("i"), j.alias("j"), "weight", "unit")

    def run(batches):
        for table in streamed(batches, ["g", "i", "j"]):
            g, i, j, side = (table.column(c).to_numpy() for c in ("g", "i", "j", "side"))
            starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for a, b in zip(starts, [*starts[1:], len(g)], strict=True):
                x, y = (table.slice(a, b - a).filter(pa.array(side[a:b] == k)) for k in (0, 1))
                if x.num_rows and y.num_rows:
                    yield from fn(x, y, _matrix(x.column("unit"), np.float64) @ _matrix(y.column("unit"), np.float64).T)

    return arrow_map(rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "id"), run, schema)


def _celled(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """cell, id, root, angle: each of ``members`` (id, root, leader) lies with its component's root if that is near, else with its leader."""

    def run(batches):
        for batch in batches:
            cells, angles = [], []
            for x, r, y, root, leader in zip(*(batch.column(c).to_pylist() for c in ("x", "r", "y", "root", "leader")), strict=True):
                x, r, y = (np.frombuffer(v, np.float64) for v in (x, r, y))
                near = float(np.dot(x, r)) >= WIDE
                cells.append(root if near else leader)
                angles.append(float(np.arccos(np.clip(np.dot(x, r if near else y), -1, 1))))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), batch.column("id"), batch.column("root"), pa.array(angles, pa.float64())], ["cell", "id", "root", "angle"])

    for key, name in (("id", "x"), ("root", "r"), ("leader", "y")):
        members = members.join(nodes.select(F.col("id").alias(key), F.col("unit").alias(name)), key)
    return arrow_map(members.select("id", "root", "leader", "x", "r", "y"), run, "cell long, id long, root long, angle double")


def _scanned(nodes: DataFrame, labels: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links of ``members`` (id, root, leader) with all nodes, exactly: rows (joins false, id, weight linked) and (joins true, root, root linked).

    A member's cell has a centre and the widest angle of its members to it; whatever links with one of them is within that angle plus
    the threshold's. So centres are compared with all nodes, and members only with what is near enough to their cell's centre.
    labels: id, root, whole (is a member) of all nodes.
    """
    cells = written(_celled(nodes, members), "cells", parts_for(nodes))
    reach = F.least(F.lit(np.pi), F.max("angle") + float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6)
    centres = cells.groupBy(F.col("cell").alias("id")).agg(reach.alias("reach")).join(nodes.select("id", F.col("dim").alias("g")), "id")

    def close(x, y, sims):
        for k, cell in enumerate(x.column("id").to_pylist()):
            ids = y.column("id").to_numpy()[sims[k] >= np.cos(x.column("reach")[k].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell), pa.int64()), pa.array(ids, pa.int64())], ["g", "id"])

    everything = nodes.select(F.col("dim").alias("g"), "id", F.lit(0.0).alias("reach"))
    against = written(_crossed(centres.select("g", "id", "reach"), everything, nodes, close, "g long, id long"), "against", parts_for(nodes))

    def linked(x, y, sims):
        ids, others = x.column("id").to_numpy(), y.column("id").to_numpy()
        near = (sims >= threshold) & (ids[:, None] != others)
        root, other = x.column("root").to_numpy(), y.column("root").to_numpy()
        rest = ~y.column("whole").to_numpy()
        i, j = np.nonzero(near & (root[:, None] != other))
        joins = np.unique(np.stack([root[i], other[j]], 1), axis=0)
        for flag, a, b in (
            (False, ids, near @ y.column("weight").to_numpy()),
            (False, others[rest], x.column("weight").to_numpy() @ near[:, rest]),
            (True, joins[:, 0], joins[:, 1]),
        ):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), flag), pa.bool_()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["joins", "a", "b"])

    one = cells.select(F.col("cell").alias("g"), "id", "root", F.lit(True).alias("whole"))
    return _crossed(one, against.join(labels, "id").select("g", "id", "root", "whole"), nodes, linked, "joins boolean, a long, b long")


def _completed(nodes: DataFrame, near: DataFrame, pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """id, n, root of each node; written. ``pairs`` are the links known; those of the nodes in ``whole`` (id) are all found here."""
    label = components(pairs)
    labels = nodes.select("id").join(label, F.col("id") == F.col("node"), "left").join(whole.withColumn("whole", F.lit(True)), "id", "left")
    labels = written(labels.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("whole", F.lit(False)).alias("whole")), "labels", parts_for(nodes))
    each = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    each = each.join(whole, "id", "left_anti").join(whole.select(F.col("id").alias("other")), "other", "left_anti")
    counts = each.join(nodes.select(F.col("id").alias("other"), "weight"), "other").select("id", F.col("weight").alias("n"))
    if not whole.isEmpty():
        least = near.select(F.col("u").alias("id"), F.col("v")).union(whole.select("id", "id")).groupBy("id").agg(F.min_by("v", F.xxhash64("v", F.lit(9))).alias("leader"))
        found = written(_scanned(nodes, labels, labels.where("whole").join(least, "id").select("id", "root", "leader"), threshold), "scanned", parts_for(nodes))
        counts = counts.union(found.where("not joins").select("a", "b"))
        above = components(found.where("joins").select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = labels.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    return written(labels.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "root"), "result", parts_for(nodes))


def audit(nodes: DataFrame, result: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Share of the links of a sample of vectors, found by comparing it with all rows, that ``result`` (id, n) has.

    The sample starts with about ``sample`` vectors and grows until its links weigh ``ENOUGH`` or it holds all vectors.
    """
    n = nodes.count()
    all_rows = nodes.select(F.col("dim").alias("g"), "id")

    def run(x, y, sims):
        near = (sims >= threshold) & (x.column("id").to_numpy()[:, None] != y.column("id").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x.column("id").to_numpy(), pa.int64()), pa.array(near @ y.column("weight").to_numpy(), pa.int64())], ["id", "true"])

    while True:
        picked = all_rows if sample >= n else all_rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
        true = _crossed(picked, all_rows, nodes, run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
        total = true.join(result.select("id", "n"), "id", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0))))).first()
        if sample >= n or (total[0] or 0) >= ENOUGH:
            return (total[1] or 0) / total[0] if total[0] else 1.0
        sample *= 4


def links(nodes: DataFrame, threshold: float) -> DataFrame:
    """id, n (weight of linked vectors of other classes), root of each node; written."""
    floor, n = threshold - SLACK, nodes.count()
    lists = None
    for r in range(ROUNDS):
        start = _seeded(nodes, range(r * ORDERS, (r + 1) * ORDERS), floor).withColumn("new", F.lit(True))
        lists = _descend(nodes, start if lists is None else start.unionByName(lists.withColumn("new", F.lit(False))), floor, n)
        near = lists.where(F.col("s") >= floor)
        pairs = written(_exact(nodes, near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), threshold), "links", parts_for(nodes))
        whole = written(near.groupBy("u").count().where(F.col("count") >= K_MOST).select(F.col("u").alias("id")), "whole", parts_for(nodes))
        result = _completed(nodes, near, pairs, whole, threshold)
        if audit(nodes, result, threshold) >= RECALL:
            return result
    return _completed(nodes, near, pairs, nodes.select("id"), threshold)


def near_dedup(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    dead = F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") == 0) | F.coalesce(odd, F.lit(True)) | F.coalesce(zero, F.lit(True))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("dead", dead)
    rows = rows.withColumn("key", F.xxhash64("embedding", F.size("embedding"))).withColumn("other", F.xxhash64(F.lit(11), "embedding"))
    nodes = written(_nodes(rows), "nodes")
    found = nodes.select("id", "key", "other", "weight").join(links(nodes, threshold), "id")
    out = rows.select("vec_id", "dead", "key", "other").join(found, ["key", "other"], "left")
    lonely = F.col("dead") | F.col("id").isNull()
    component = F.when(lonely, F.col("vec_id")).otherwise(F.col("root"))
    return out.select("vec_id", F.when(lonely, F.lit(0)).otherwise(F.col("n") + F.col("weight") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
