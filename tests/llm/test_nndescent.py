"""Operator 6 against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from legajo.llm import nndescent
from tests.llm.test_jaccard import roots


def brute(rows, threshold=0.9):
    ok = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    edges = [(i, j) for a, i in enumerate(ok) for j in ok[:a] if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n = Counter(k for e in edges for k in e)
    root = roots(range(len(rows)), edges)
    least = {}
    for i in ok:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    comp = [least[root[i]] if i in unit else v for i, (v, _) in enumerate(rows)]
    return Counter((v, n[i], comp[i], v is not None and comp[i] == v) for i, (v, _) in enumerate(rows))


def cloud(seed, n, clusters, dim=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    rows = list(x)
    for size in clusters:
        base = r.normal(size=dim)
        rows += [base + r.normal(size=dim) * 0.12 for _ in range(size)]
    rows = np.array(rows, np.float32)
    ids = r.permutation(10 * len(rows))[: len(rows)]
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed,n,clusters", [(1, 300, [2, 3, 2, 9, 40]), (2, 50, [700])])
def test_links_equal_brute_force(spark, seed, n, clusters):
    rows = cloud(seed, n, clusters)
    rows += [(-1, None), (-2, []), (-3, [0.0] * 24), (-4, [1.0, None]), (-5, [float("nan")] * 24), (-6, [float("inf"), 1.0]), (None, rows[0][1]), rows[5], rows[5], (-7, rows[6][1]), (-8, rows[7][1][:10])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    got = Counter(map(tuple, nndescent.near_dedup(df).collect()))
    assert got == brute(rows)
    assert nndescent.near_dedup(df.limit(0)).count() == 0


def test_streamed_groups():
    keys = [1, 1, 2, 2, 2, 2, 3, 4, 4]
    for cut in range(1, 5):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + cut]}) for i in range(0, len(keys), cut)]
        tables = [t.column("k").to_pylist() for t in nndescent.streamed(iter(batches), ["k"])]
        assert sum(tables, []) == keys and not any(set(a) & set(b) for i, a in enumerate(tables) for b in tables[:i])


def groups(seed, size, count, dim=24, inner=0.99, cross=0.93):
    """Groups of vectors whose cosines are about ``inner`` within a group and ``cross`` between groups."""
    r = np.random.default_rng(seed)
    axes = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    share = np.sqrt(cross / inner)
    rows = []
    for g in range(count):
        centre = share * axes[0] + np.sqrt(1 - share**2) * axes[g + 1]
        noise = r.normal(size=(size, dim - count - 1)) @ axes[count + 1 :]
        rows += list((np.sqrt(inner) * centre + np.sqrt(1 - inner) * noise / np.linalg.norm(noise, axis=1)[:, None]).astype(np.float32))
    rows += list(r.normal(size=(100, dim)))
    ids = r.permutation(10 * len(rows))[: len(rows)]
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("size,count,cross", [(45, 2, 0.93), (100, 2, 0.905), (40, 5, 0.92)])
def test_links_across_saturated_groups(spark, size, count, cross):
    rows = groups(3, size, count, cross=cross)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert Counter(map(tuple, nndescent.near_dedup(df).collect())) == brute(rows)


def test_short_recall_of_few_links_ends_in_an_exact_scan(spark, monkeypatch):
    rows = cloud(4, 600, [2, 3])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(nndescent, "ROUNDS", 1)
    monkeypatch.setattr(nndescent, "_descend", lambda nodes, start, floor, n: nndescent.written(nndescent._lists(start.where("false"), floor), "lists"))
    assert Counter(map(tuple, nndescent.near_dedup(df).collect())) == brute(rows)


def test_audit_measures_recall(spark):
    rows = cloud(6, 200, [30, 2])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    nodes = nndescent._nodes(df.withColumn("dead", nndescent.F.lit(False)).withColumn("key", nndescent.F.xxhash64("embedding")).withColumn("other", nndescent.F.lit(1).cast("long"))).cache()
    true = {v: n for v, n, _, _ in brute(rows)}
    whole = spark.createDataFrame(list(true.items()), "id long, n long")
    assert nndescent.audit(nodes, whole, 0.9) == 1.0 and sum(true.values()) > 100
    half = spark.createDataFrame([(v, n // 2) for v, n in true.items()], "id long, n long")
    assert abs(nndescent.audit(nodes, half, 0.9, sample=232) - sum(n // 2 for n in true.values()) / sum(true.values())) < 1e-9
    assert nndescent.audit(nodes, whole.limit(0), 0.9) == 0.0
