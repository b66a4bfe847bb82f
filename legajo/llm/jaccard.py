"""Operator 3: n-gram Jaccard join with set-relation skipping, as components of documents.

Sets are the distinct word shingles of a text, as 64-bit hashes. Equal sets, told by two hashes of 64 bits, become one set first. Each set lists
its prefix (of n elements the first n - ceil(0.8 n) + 1) in one global order: the most frequent elements, as many as a
bitmap of fixed size holds well, come last, else by hash. Two linked sets share an element of their prefixes.

Answers are derived from highly similar sets in two rounds. Round one verifies each index list's entries against the
list's most central set only (the one with the fewest rare elements before); what links shares one component, i.e. takes over that set's answers. Round two looks only at lists whose entries
are still in different components, and only for pairs across them. There, a list is cut into blocks by set size and position: an
entry's position bounds the sizes that can still reach the overlap, and these sizes bound the partner's position, so it skips all other blocks.
Parity bitmaps of the sets, a lower bound of their difference, then reject most pairs that share a passage only. What remains is derived from the
answers of hubs, the sets that round one found near: the hubs' difference is computed once, and a pair's lies within the two
sets' differences from their hubs of it; only pairs that this leaves open are verified. Verification is exact on whole sets (up to hash collisions). Pairs within a component are never emitted, so a group of near copies costs its lists, not its square.

All texts are mapped in numpy (free style); the lists of common elements are salted for the count and split by AQE in the joins. What is
broadcast has a fixed size: bitmaps of 2**BITS cells, whose saturation costs time, not results. Nulls, empty texts and texts without words
have an empty set and link with nothing; a text with fewer words than k is one shingle; a null id is no component's id unless alone;
repeated rows repeat and link (they are equal texts); other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from legajo.llm.common import Bitmap, arrow_map, bitmap_of, chunks, kept, parts_for, text_or_empty, written
from legajo.llm.graph import components
from legajo.llm.words import Words, mix, shingle_sets

WORDS_EACH, BITS, LOCAL_SETS, SALTS, DEALT = 5, 23, 2, 32, 8
#: Longs of the bitmap of a set below each size.
SIGNATURES = ((600, 8), (2400, 32), (float("inf"), 128))
#: Linked if DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Ratio of the sizes, and of the positions, from one block of a list to the next.
GROWTH, DEEPER = 1.08, 4.0


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of 64 bits over all elements of a set of hashes (sorted) and their number."""
    if not len(tokens):
        return 0, 0
    with np.errstate(over="ignore"):
        h = (mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens + np.uint64(len(tokens)))))
        both = mix(np.array([h[0] * np.uint64(31) + h[1], h[1] * np.uint64(37) + h[0] + np.uint64(len(tokens))], np.uint64))
        return tuple(both.view(np.int64).tolist())


class Names:
    """Identity of a set in 64 bits: its first hash, or the second one where different sets share the first.

    clashes: the first hashes that different sets share, about N * N / 2**65 of N sets: three of 1e10. bits: of the first hash, fewer in tests only.
    """

    def __init__(self, bits: int = 64, clashes: frozenset[int] = frozenset()):
        self.low, self.clashes = (1 << bits - 1) - 1, clashes

    def both(self, tokens: np.ndarray) -> tuple[int, int]:
        one, other = set_id(tokens)
        return (one if self.low == (1 << 63) - 1 else one & self.low), other

    def __call__(self, tokens: np.ndarray) -> int:
        one, other = self.both(tokens)
        return other if one in self.clashes else one


def prefix_size(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def _sets(batch: pa.RecordBatch, k: int):
    for part in chunks(batch):
        yield part, shingle_sets(Words(part.column("text"), True), k)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, longer for larger sets: two sets differ in at least as many elements as their bitmaps do in bits.

    Folding a longer one by XOR gives the shorter one, so bitmaps of different length compare.
    """
    bits = 64 * next(longs for most, longs in SIGNATURES if len(tokens) < most)
    odd = np.bincount((mix(tokens) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _profile(docs: DataFrame, k: int, name: Names) -> DataFrame:
    """Rows of two kinds: doc_id, row, n, set, other (the set's second hash), sig of each document; and token, count of elements that several sets of a batch have.

    Elements are counted by their low 32 bits: one counted with another's share comes later in the order, which any order may.
    """

    def run(batches):
        for batch in batches:
            ids, keys, sizes, names, sigs, seen, halves = [], [], [], [], [], set(), [np.zeros(0, np.uint32)]
            for part, sets in _sets(batch, k):
                ids += part.column("doc_id").to_pylist()
                keys += part.column("row").to_pylist()
                sizes += map(len, sets)
                sigs += [signature(s) for s in sets]
                for s in sets:
                    names.append(name.both(s))
                    if names[-1] not in seen:
                        seen.add(names[-1])
                        halves.append(s.astype(np.uint32))
            every, halves = np.concatenate(halves), []
            every.sort()
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
            count = np.diff(np.append(first, len(every)))
            often = count >= LOCAL_SETS
            token, count = every[first[often]].astype(np.int64), count[often]
            n, m = len(ids), len(token)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids + [None] * m, pa.int64()),
                    "row": pa.array(keys + [None] * m, pa.binary()),
                    "n": pa.array(sizes + [None] * m, pa.int32()),
                    "set": pa.array([x for x, _ in names] + [None] * m, pa.int64()),
                    "other": pa.array([y for _, y in names] + [None] * m, pa.int64()),
                    "sig": pa.array(sigs + [None] * m, pa.list_(pa.int64())),
                    "token": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(token, pa.int64())]),
                    "count": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(count, pa.int64())]),
                }
            )

    return arrow_map(docs, run, "doc_id long, row binary, n int, set long, other long, sig array<long>, token long, count long")


def _clashes(profile: DataFrame) -> frozenset[int]:
    """First hashes that different sets share."""
    found = profile.where("n > 0").groupBy("set").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo != hi")
    return frozenset(r["set"] for r in found.select("set").collect())


def _common(profile: DataFrame) -> Bitmap:
    """Bitmap of the most frequent elements, as many as fill an eighth of it."""
    counts = profile.where("token is not null").groupBy("token").agg(F.sum("count").alias("count"))
    level = F.floor(F.log2("count") * 8).alias("level")
    left, least = 1 << (BITS - 3), None
    for r in counts.groupBy(level).count().orderBy(F.desc("level")).collect():  # a row for each eighth of a power of two
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return bitmap_of(counts.where(level >= least) if least is not None else counts.limit(0), "token", BITS)


def _lists(docs: DataFrame, common, k: int, num: int, den: int, named: Names) -> DataFrame:
    """token, set, n, pos, hot: the prefixes of all sets."""

    def run(batches):
        for batch in batches:
            seen, out = set(), []
            for _, sets in _sets(batch, k):
                for s in sets:
                    if not len(s) or (name := named(s)) in seen:
                        continue
                    seen.add(name)
                    hot = common.value.has(s)
                    p = prefix_size(len(s), num, den)
                    order = np.argsort(hot, kind="stable")[:p]
                    out.append((s[order], np.full(p, name, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32), hot[order]))
                if sum(len(x[0]) for x in out) > 200_000:
                    yield _entries(out)
                    out = []
            if out:
                yield _entries(out)

    return arrow_map(docs, run, "token long, set long, n int, pos int, hot boolean")


def _entries(out: list) -> pa.RecordBatch:
    token, name, n, pos, hot = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(name), pa.array(n), pa.array(pos), pa.array(hot)], ["token", "set", "n", "pos", "hot"])


def _wanted(docs: DataFrame, pairs: DataFrame, profile: DataFrame, k: int, name: Names) -> DataFrame:
    """set, tokens (array) of all sets in ``pairs``, from the texts of one document each."""
    need = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    holders = profile.groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(need, "set").select(F.xxhash64("doc_id").alias("h"))
    cells = docs.sparkSession.sparkContext.broadcast(bitmap_of(holders, "h", BITS))

    def run(batches):
        for batch in batches:
            keep = cells.value.has(np.asarray(batch.column("h")))
            batch = batch.filter(pa.array(keep))
            for _, sets in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set", "tokens"])

    found = arrow_map(docs.withColumn("h", F.xxhash64("doc_id")), run, "set long, tokens array<long>")
    return found.join(need, "set", "left_semi").groupBy("set").agg(F.first("tokens").alias("tokens"))


def _differing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, size (of both together) and diff (elements that only one of them has) of the pairs, exactly."""
    one = sets.select(F.col("set").alias("b"), F.col("tokens").alias("y"))
    other = sets.select(F.col("set").alias("a"), F.col("tokens").alias("x"))
    size = (F.size("x") + F.size("y")).cast("long")
    return pairs.join(one, "b").join(other, "a").select("a", "b", size.alias("size"), (size - 2 * F.size(F.array_intersect("x", "y"))).alias("diff"))


def _links(diff, size, num: int, den: int):
    """Whether sets of ``size`` elements together that differ in ``diff`` elements meet the threshold."""
    return diff * (num + den) <= size * (den - num)


def _may_link(n1, pos1, n2, pos2, num: int, den: int):
    """Sizes and positions of a shared element leave room for the overlap, if it is the first that they share."""
    room = F.least(n1 - pos1, n2 - pos2).cast("long")
    return room * (num + den) >= (n1 + n2).cast("long") * num


def _top(num: int, den: int):
    """Greatest size of a partner that an entry's position leaves room for."""
    return F.floor((F.col("n") - F.col("pos")).cast("long") * (num + den) / num) - F.col("n")


def _apart(x: str, y: str):
    """Bits in which two parity bitmaps differ, the longer one folded."""
    m = f"least(size({x}), size({y}))"
    fold = lambda c: f"aggregate(sequence(i, size({c}) - 1, {m}), 0L, (a, j) -> a ^ element_at({c}, j + 1))"
    return F.expr(f"aggregate(sequence(0, {m} - 1), 0L, (t, i) -> t + bit_count({fold(x)} ^ {fold(y)}))")


def _plausible(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b whose bitmaps leave it possible that few enough elements differ, with their size together and ``apart``, the bits that differ."""
    one, other = (sigs.select(*[F.col(c).alias(f"{side}_{c}") for c in sigs.columns]) for side in "xy")
    both = pairs.join(one, F.col("a") == F.col("x_set")).join(other, F.col("b") == F.col("y_set")).withColumn("apart", _apart("x_sig", "y_sig"))
    return both.withColumn("size", (F.col("x_n") + F.col("y_n")).cast("long")).where(_links(F.col("apart"), F.col("size"), num, den)).select("a", "b", "size", "apart")


def _settled(pairs: DataFrame, hubs: DataFrame, sets: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """a, b of the linked ones among ``pairs`` (a, b, size): answers of hubs are computed, those of the sets near them derived.

    hubs: set, hub, off: a set's hub and the number of elements that only one of the two has. The hubs of a pair are verified once for all
    pairs that have them; their difference, less or more what the sets differ from their hubs, bounds the pair's. Only pairs
    that these bounds leave open are verified themselves.
    """
    for side in "ab":
        of = hubs.select(F.col("set").alias(side), F.col("hub").alias(f"h{side}"), F.col("off").alias(f"o{side}"))
        pairs = pairs.join(of, side, "left").withColumn(f"h{side}", F.coalesce(f"h{side}", side)).withColumn(f"o{side}", F.coalesce(f"o{side}", F.lit(0)))
    pairs = pairs.select("a", "b", "size", F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb"), (F.col("oa") + F.col("ob")).alias("off"))
    met = pairs.where("ha != hb").select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()
    met = _differing(met, sets).select(F.col("a").alias("ha"), F.col("b").alias("hb"), "diff")
    known = written(pairs.join(met, ["ha", "hb"], "left").withColumn("diff", F.coalesce("diff", F.lit(0))), "known", parts)
    sure = known.where(_links(F.col("diff") + F.col("off"), F.col("size"), num, den)).select("a", "b")
    open_ = known.where(~_links(F.col("diff") + F.col("off"), F.col("size"), num, den) & _links(F.col("diff") - F.col("off"), F.col("size"), num, den))
    found = _differing(open_.select("a", "b"), sets)
    return sure.union(found.where(_links(F.col("diff"), F.col("size"), num, den)).select("a", "b"))


def join_components(docs: DataFrame, k: int = WORDS_EACH, num: int = NUM, den: int = DEN, row: str | None = None, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links) of every row.

    bits: of a set's first hash (``Names``).
    row: a binary column that tells rows apart where ids don't; it is returned too, with ``comp``, which is equal in a component and null for empty sets.
    """
    spark, parts = docs.sparkSession, parts_for(docs)
    key = F.col(row) if row else F.lit(None).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), key.alias("row"))
    profile = written(_profile(docs, k, Names(bits)), "profile")
    name = Names(bits, _clashes(profile))
    if name.clashes:
        profile = profile.withColumn("set", F.when(F.col("set").isin(*name.clashes), F.col("other")).otherwise(F.col("set")))
    docs = docs.drop("row")
    rows = profile.where("token is null").select("doc_id", "row", "n", "set")
    sigs = profile.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    common = spark.sparkContext.broadcast(_common(profile))
    salt = F.when(F.col("hot"), F.pmod("set", F.lit(SALTS))).otherwise(F.lit(0))
    # An entry stays if its list has another set and the next size above or below allows a link; of a common element, all stay.
    each = Window.partitionBy("token", "salt").orderBy("n")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = _lists(docs, common, k, num, den, name).withColumn("salt", salt).withColumn("least", F.min("set").over(whole)).withColumn("most", F.max("set").over(whole))
    listed = listed.withColumn("above", F.lead("n").over(each)).withColumn("below", F.lag("n").over(each))
    sized = (F.col("above") <= _top(num, den)) | (F.col("below").cast("long") * den >= F.col("n").cast("long") * num)
    listed = listed.where(F.col("hot") | ((F.col("least") != F.col("most")) & F.coalesce(sized, F.lit(False))))
    # equal rows of equal sets from several batches go here, where they already lie together
    live = kept(listed.dropDuplicates(["token", "salt", "set"]).select("token", "set", "n", "pos"))

    # Round one: each list's entries against its most central set, and of those only the nearest.
    first = live.groupBy("token").agg(F.min(F.struct("pos", "set", "n")).alias("f"), F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo != hi").select("token", "f")
    star = live.join(first, "token").where((F.col("set") != F.col("f.set")) & _may_link(F.col("n"), F.col("pos"), F.col("f.n"), F.col("f.pos"), num, den))
    pairs = _plausible(star.select(F.col("f.set").alias("a"), F.col("set").alias("b")).distinct(), sigs, num, den)
    nearest = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m"))  # others wait for round two
    nearest = written(nearest.select(F.col("b").alias("set"), F.col("m.a").alias("hub")), "nearest", parts)
    tried = nearest.select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct()
    found = _differing(tried, _wanted(docs, tried, rows, k, name)).where(_links(F.col("diff"), F.col("size"), num, den))
    found = written(found, "links", parts)
    links = found.select("a", "b")
    ends = found.select(F.col("a").alias("set"), F.col("b").alias("hub"), F.col("diff").alias("off")).union(found.select("b", "a", "diff"))
    hubs = written(ends.join(nearest, ["set", "hub"], "left_semi"), "hubs", parts)
    label = components(links)

    # Round two: pairs across components within a list, block by block.
    entry = live.join(label, live["set"] == label["node"], "left").select("token", "set", "n", "pos", F.coalesce("root", "set").alias("comp"))
    mixed = entry.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    entry = written(entry.join(mixed, "token"), "mixed", parts)
    # Seen from the smaller (or equal) set, the partner's size is at least its own and at most what its position allows; in a block of
    # sizes, positions beyond ``deepest`` leave the partner too few elements, so whole blocks of positions are skipped.
    top = _top(num, den)
    block = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(GROWTH)))
    depth = lambda pos: F.floor(F.log(pos.cast("double") + 1) / float(np.log(DEEPER)))
    largest = F.least(top, F.floor(F.pow(F.lit(GROWTH), F.col("block") + 1) + 1).cast("long"))
    deepest = F.greatest(F.lit(0), F.floor((den * largest - num * F.col("n").cast("long")) / (num + den)))
    probe = entry.where(top >= F.col("n")).withColumn("block", F.explode(F.sequence(block(F.col("n")), block(top))))
    probe = probe.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), depth(deepest))))
    left, right = probe.alias("l"), entry.withColumn("block", block(F.col("n"))).withColumn("depth", depth(F.col("pos"))).alias("r")
    ordered = (F.col("r.n") > F.col("l.n")) | ((F.col("r.n") == F.col("l.n")) & (F.col("r.set") > F.col("l.set")))
    fits = _may_link(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"), num, den)
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.depth") == F.col("r.depth"))
    met = left.join(right, same & (F.col("l.comp") != F.col("r.comp")) & ordered & fits)
    pairs = met.select(F.least("l.set", "r.set").alias("a"), F.greatest("l.set", "r.set").alias("b")).distinct()
    again = written(_plausible(pairs.join(tried, ["a", "b"], "left_anti"), sigs, num, den).select("a", "b", "size"), "pairs", parts)
    if not again.isEmpty():
        sets = [again.select("a", "b")]
        for side in "ab":  # the sets' hubs are verified too
            sets.append(again.select(F.col(side).alias("set")).join(hubs, "set").select(F.col("hub").alias("a"), F.col("hub").alias("b")))
        sets = written(_wanted(docs, sets[0].union(sets[1]).union(sets[2]), rows, k, name), "sets")
        label = components(written(links.union(_settled(again, hubs, sets, parts, num, den)), "links", parts))
    live.unpersist()
    common.destroy()

    named = rows.join(label, rows["set"] == label["node"], "left").select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("comp"))
    # rows alone in their component need no join; a large component's rows are dealt over DEALT keys
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    least = least.select("comp", "least", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("salt"))
    out = named.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(DEALT)).cast("int")).join(least, ["comp", "salt"], "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "row", "comp")
    return out if row else out.drop("row", "comp")
