"""Operator 3 and the component finder against brute force."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from legajo.llm import jaccard
from legajo.llm.graph import components
from legajo.llm.words import Words, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range([0, 120, 220][seed])] + [(1000 + i, 1001 + i) for i in range(40)]
    want = roots({n for e in edges for n in e}, edges)
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == {n: w for n, w in want.items() if n not in loops} and len(got) == len(want) - len(loops)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def corpus(seed, n=220):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Über", "ÜBER", "x y", "é"]
    passage = [r.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.45 or not texts:
            words = [r.choice(vocab) for _ in range(r.choice([1, 2, 4, 5, 6, 9, 30, 80, 150]))]
            if r.random() < 0.4:
                words += passage
        else:
            words = WORD.findall(r.choice(texts[-60:]))
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                at = r.randrange(len(words) + 1)
                words[at : at + r.choice([0, 1, 1])] = [r.choice(vocab)] * r.choice([0, 1])
            if r.random() < 0.3:
                words = [w.upper() if w.isascii() else w for w in words]
        texts.append(r.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    base = [f"hot{i}" for i in range(90)]
    for i in range(60):  # a large group of near copies, whose members are often further than the threshold from each other
        words = list(base)
        words[r.randrange(90)] = f"edit{i}"
        if i % 3 == 0:
            words[r.randrange(90)] = f"other{i}"
        texts.append(" ".join(words))
    return texts


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    edges = []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * (c := len(x & y)) >= 80 * (len(x) + len(y) - c):
                edges.append((i, j))
    root = roots(range(len(rows)), edges)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root[i]].append(d)
    return Counter((d, len(sets[i]), min(x for x in least[root[i]] if x is not None)) for i, (d, _) in enumerate(rows))


def test_shingle_sets_match_python():
    texts = corpus(9, 80) + ["", " \t", "a", "a b c d", "a b c d e", "A b c d E"]
    got = shingle_sets(Words(pa.array(texts), True), 5)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[-1] == got[-2]).all() and jaccard.set_id(got[-1]) == jaccard.set_id(got[-2])


@pytest.mark.parametrize("seed,bits", [(1, 64), (2, 64), (1, 6)])  # with 6 bits, most sets share their first hash with others
def test_join_components_equal_brute_force(spark, seed, bits):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    rows = [*zip(ids, texts, strict=True), (20_000, None), (20_001, ""), (20_002, " \n"), (20_003, texts[3]), (20_003, texts[3])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, set string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(docs, bits=bits).collect())
    assert got == brute(rows)
    assert jaccard.join_components(docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "zz"), (4, "A b c d e f")], "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join_components(docs).collect())) == Counter([(None, 2, 4), (None, 1, None), (4, 2, 4)])
