"""Buffers, chunks, word hashes and bitmaps."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, bitmap_of, chunks, kept, parts_for, shared_dir, text_buffers, written
from legajo.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b\x0c\r\x1f\x85 😀", max_size=12), max_size=8))
def test_words_equal_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()), False)
    for i, text in enumerate(texts):
        a, b = words.rows[i : i + 2]
        raw = [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)]
        assert raw == WORD.findall(text)


def test_hashes_depend_on_content_only():
    words = Words(pa.array(["a b c d", "x a b c", "c a b", "ab c"]), False)
    h, g = words.hashes, words.grams(2)
    assert h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 6
    assert g[0] == g[5] == g[9] and g[1] == g[6]
    assert words.span(np.array([0]), np.array([3]))[0] == words.span(np.array([5]), np.array([8]))[0]


def test_buffers_of_slices():
    column = pa.array(["ab", "", "é", "xyz"])
    for part in (column, column.slice(1, 2), column.slice(3), column.slice(4), column.cast(pa.large_string())):
        data, ends = text_buffers(part)
        assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == part.to_pylist()


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 100, 3, 3, 0, 50)], "i": list(range(7))})
    for limit in (1, 8, 1000):
        parts = list(chunks(batch, limit))
        assert sum((p.column("i").to_pylist() for p in parts), []) == list(range(7))
        assert all(p.num_rows == 1 or len("".join(p.column("text").to_pylist())) <= limit for p in parts)
    assert list(chunks(batch.slice(0, 0))) == []


def test_bitmap_and_tables(spark):
    values = [0, 5, 63, 64, 1023, 1024, -1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = bitmap_of(df, "v", 10)
    assert set(np.flatnonzero(got.has(np.arange(1024)))) == {v & 1023 for v in values} and len(got.words) == 16
    assert got.has(np.array(values)).all()
    table = written(df, "v", 2)
    assert len(table.inputFiles()) <= 2 and parts_for(table) == spark.sparkContext.defaultParallelism and parts_for(df) > 0
    assert sorted(r.v for r in table.collect()) == sorted(values)
    assert all(f.startswith(shared_dir(spark).replace("file://", "file:")) or f.startswith(shared_dir(spark)) for f in table.inputFiles())
    held = kept(df)
    assert held.count() == len(values)
    held.unpersist()


def test_batches_between_jvm_and_workers_are_small(spark):
    """A worker and the JVM hold several batches at once, two tasks an executor: of 16 MB each they took it near its limit."""
    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("abcdefgh"), 512).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64()), "n": pa.array([b.num_rows], pa.int64())})

    got = arrow_map(df, run, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 5 << 20
