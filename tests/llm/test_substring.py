"""Operator 4 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from legajo.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, length):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["W1", "é,", "x y"]
    passages = [[r.choice(vocab) for _ in range(r.choice([length - 1, length, length + 1, 2 * length, 5 * length]))] for _ in range(6)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(r.randrange(1, 5)):
            kind = r.random()
            if kind < 0.4:
                words += r.choice(passages)
            elif kind < 0.5:
                words += ["la"] * r.choice([3, length, 3 * length])
            elif kind < 0.6 and texts:
                words += WORD.findall(r.choice(texts))
            else:
                words += [r.choice(vocab) for _ in range(r.randrange(0, 2 * length))]
        texts.append(r.choice([" ", "\n", " \t"]).join(words))
    return texts


def brute(rows, length):
    first = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for p in range(len(w) - length + 1):
                key = tuple(w[p : p + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def test_least_within():
    x = np.random.default_rng(1).integers(0, 99, 60)
    for w in (1, 2, 3, 7, 31, 60, 61):
        assert substring.least_within(x, w).tolist() == [x[i : i + w].min() for i in range(60 - w + 1)]


@pytest.mark.parametrize("seed,length,gram", [(1, 50, 20), (2, 10, 4), (3, 12, 12)])
def test_remove_repeats_equals_brute_force(spark, seed, length, gram):
    texts = corpus(seed, length)
    ids = random.Random(seed).sample(range(1000), len(texts))
    rows = [*zip(ids, texts, strict=True), (5000, None), (5001, ""), (None, texts[0]), (None, texts[0]), (5002, texts[1]), (5002, texts[1]), (-3, texts[2])]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, n int, th string").repartition(3)
    want = brute(rows, length)
    got = substring.remove_repeats(docs, length, gram).collect()
    assert Counter(map(tuple, got)) == Counter(x[:4] for x in want)
    cut = substring.without_repeats(docs, length, gram)
    assert cut.columns == docs.columns
    assert Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in cut.collect()) == Counter((x[0], tuple(x[4])) for x in want)
    same = {(i, t) for (i, t), x in zip(rows, want, strict=True) if not x[2]}
    assert same <= {(r.doc_id, r.text) for r in cut.collect()}
    assert substring.remove_repeats(docs.limit(0)).count() == 0
