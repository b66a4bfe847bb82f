"""Operators 1 and 8 against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from legajo.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 120))), r.choice(["a", "b", "b", "b", None, "é"])) for i in range(n)]
    rows += [(n + i, "the same copy of all " * 30, "hot") for i in range(n // 2)]
    return rows + [(9_000_000, None, "a"), (9_000_001, "", "empty"), (9_000_002, "", "empty"), (9_000_002, "", "empty"), (None, "x y", "b"), (7, "long " * 2_000, "b")]


def test_shards(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, shard int")
    got = sharding.shard(docs, 6).collect()
    sized = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, sized(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert set(slots) == set(range(6)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) < 1.02 * min(load.values())
    assert sharding.shard(docs.limit(0)).count() == 0
    again = sharding.shard(docs.repartition(7), 6).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_copies_of_one_id_are_dealt_over_shards(spark):
    r = random.Random(8)
    rows = [(7, "the same row " * 20)] * 3000 + [(None, "no id " * 30)] * 2000 + [(i, "w " * r.randrange(1, 200)) for i in range(3000)] + [(4000, "very long " * 200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    load, slots = Counter(), defaultdict(list)
    for x in got:
        load[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
    assert max(load.values()) < 1.05 * min(load.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mixed_texts_tell_rows_of_one_id_apart(spark):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f h", "s"), (1, "a b c d e f g", "s"), (1, "a b c d e f g", "t"), (None, "q " * 300, "s"), (None, "r " * 300, None), (3, "w " * 9000, "t"), (4, None, "s"), (5, "", "t")]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, source string, _row long").repartition(3)
    size = lambda t: len(WORD.findall(t or ""))
    taken = Counter()
    for x in mixing.mixture(docs).collect():
        taken[x.doc_id, x["size"]] += x.taken
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    got, old = Counter(), Counter()
    for x in out.collect():
        text, (i, t, s) = x.text, rows[x["_row"]]
        assert x.doc_id == i and x.source == s and set(WORD.findall(text)) <= set(WORD.findall(t)) and 0 < size(text) <= 2 * size(t)
        got[i, size(t)] += size(text)
    assert got == Counter({k: n for k, n in taken.items() if n}) and sum(got.values()) == round(1.5 * sum(size(t) for _, t, _ in rows))


def test_pack_is_greedy_by_dot_product():
    items = np.random.default_rng(2).integers(1, 100, (80, 3)).astype(float)
    where = sharding.pack(items, 5, (1, 1, 1))
    share = items / items.sum(0) * 5
    load = np.zeros((5, 3))
    for i in sorted(range(80), key=lambda i: -share[i].sum()):
        dots = [float(np.dot(share[i], 1 - load[s])) for s in range(5)]
        assert abs(dots[where[i]] - max(dots)) < 1e-9
        load[where[i]] += share[i]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 60))
def test_permutation(n, key):
    p = mixing.Permutation(n, key)
    image = p(np.arange(n))
    assert sorted(image.tolist()) == list(range(n)) and (p(image, back=True) == np.arange(n)).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=0, max_size=12))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert sum(got) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * s for t, s in zip(got, sizes, strict=True))
    free = [t / [5, 2, 1][i % 3] for i, (t, s) in enumerate(zip(got, sizes, strict=True)) if t < 2 * s]
    assert len(set(free)) <= 1 and all(t / [5, 2, 1][i % 3] <= free[0] for i, t in enumerate(got) if free)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5000), st.floats(0, 2))
def test_slots_meet_the_target(size, share):
    target = round(size * share)
    n, last = mixing.slots_of(3, size, target, 16)
    blocks = -(-size // 16)
    words = 0
    for j in range(n):
        block = int(mixing.Permutation(blocks, mixing.pass_key(3, j // blocks))(np.array([j % blocks]))[0])
        full = min(16, size - 16 * block)
        words += min(full, last if j == n - 1 else 16)
    assert words == target


def test_mixture(spark):
    rows = corpus(500, 3)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixture(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None)) + [None]
    goal = dict(zip(names, mixing.targets([total[s] for s in names]), strict=True))
    taken = Counter()
    of = defaultdict(set)
    for i, t, s in rows:
        of[i, size(t)].add(s)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        (s,) = of[r.doc_id, r["size"]] if len(of[r.doc_id, r["size"]]) == 1 else [None]
        if len(of[r.doc_id, r["size"]]) == 1:
            assert r.source_size == total[s] and abs(r.target - float(goal[s])) < 1e-6
            taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    again = mixing.mixture(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_draw_sums_to_slots():
    counts = mixing.draw([1000, 0, 7, 300], 9, 4)
    assert counts.sum(0).tolist() == [1000, 0, 7, 300] and max(counts.sum(1)) - min(counts.sum(1)) <= 1
