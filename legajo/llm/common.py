"""Shared folder, written tables and Arrow helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes.util
import os
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Bytes of text that one numpy step holds; a longer document makes a step of its own.
CHUNK_BYTES = 1 << 19
#: The same of a tokeniser's step, which encodes each different word of it once.
TOKEN_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a worker, where the session allows more.
BATCH_BYTES = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="legajo-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        path = "file://" + _OWN[app]
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else "file://" + path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/legajo-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


#: Bytes of input that a task of a compacted table stands for.
PART_BYTES = 1 << 26


def parts_for(df: DataFrame) -> int:
    """Files of a table that is no larger than ``df``: one for each ``PART_BYTES`` that the planner expects of it, as many as cores at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), (1 << 31) - 1)


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later readers don't depend on executors.

    parts: for results of a shuffle, the most files, instead of one for each shuffle partition.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and held on the executors' disks, for steps of one call; a lost executor's part is computed again.

    The caller gives it back by ``unpersist`` as soon as what it feeds is written.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver does, in batches of bounded bytes.

    Workers are used again by later tasks, so each task gives back what its allocators hold at its end. Plans read the bound of a batch only
    when they run, so a session that allows more than ``BATCH_BYTES`` has it lowered from here on.
    """
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = df.sparkSession.conf.get(key, None)
    if most is None or _as_bytes(most) > BATCH_BYTES:
        df.sparkSession.conf.set(key, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def _as_bytes(value: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", str(value).lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and sys.platform == "linux":
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made of ``names``."""
    used = {c.lower() for c in df.columns}
    tail = next("_" * n for n in range(1, len(used) + 2) if not any(f"_{x}{'_' * n}" in used for x in names))
    return [f"_{x}{tail}" for x in names]


def id_crc(name: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def map_texts(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, at_end: Callable[[], None] = lambda: None) -> DataFrame:
    """A tokeniser's ``fn`` over Arrow batches of ``columns``, cut into chunks of ``TOKEN_BYTES``; ``text`` is never null there. at_end: called by each task."""
    want = df.select(*[text_or_empty().alias("text") if c == "text" else F.col(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, TOKEN_BYTES):
                yield fn(part)
        at_end()

    return arrow_map(want, run, schema)


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with about ``limit`` bytes of text (or of the column ``name``) or a single row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(text_buffers(batch.column(name))[1]))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column without nulls."""
    n, large = len(column), pa.types.is_large_string(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]), ends - ends[0]


class Bitmap:
    """2**bits cells, one bit each."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.low = words, np.uint64((1 << bits) - 1)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether the low bits of each 64-bit value are set."""
        cell = values.view(np.uint64) & self.low
        return (self.words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(df: DataFrame, column: str, bits: int) -> Bitmap:
    """A cell is set where a value of the long ``column`` has its low bits.

    Its size is fixed: at most 2**(bits-6) rows of 12 bytes come to the driver, whatever the input. Full cells
    make later steps pass more rows, never fewer.
    """
    cell = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(F.shiftright(cell, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out, found = np.zeros(1 << max(bits - 6, 0), np.uint64), words.toArrow()
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return Bitmap(out, bits)


def mark_of(column: str, seed: int):
    """A value's hash from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column).cast("string"), F.lit(seed)), 1)


def low_marks(rows: DataFrame, by: str, most: int, counted: DataFrame | None = None) -> DataFrame:
    """The rows with the lowest ``mark`` of each class ``by``, somewhat over ``most`` different marks (a quarter and five standard errors more) or all, without sorting a class.

    The marks of a class are counted (in ``counted``, where that is given) and cut at the share that is wanted; one row for each class comes to the driver and is broadcast.
    """
    counts = (rows if counted is None else counted).groupBy(by).agg(F.approx_count_distinct("mark").alias("n")).collect()
    limits = [(r[by], (1 << 63) - 1 if r["n"] <= most else int(min(1.0, (1.25 * most + 5 * most**0.5) / r["n"]) * ((1 << 63) - 1024))) for r in counts if r[by] is not None]
    limits = rows.sparkSession.createDataFrame(limits, f"{by} {rows.schema[by].dataType.simpleString()}, below long")
    return rows.join(F.broadcast(limits), by).where("mark <= below").drop("below")


def sampled(rows: DataFrame, by: str, most: int, total: int, each: int) -> pa.Table:
    """The rows of each class in order of ``mark``, up to ``most`` and to ``total`` bytes (column n); rows of over ``each`` bytes are passed over.

    rows: what ``low_marks`` gave, one row for each mark and stored.
    """
    last: dict = {}
    used: dict = {}
    for r in sorted(rows.where(F.col("n") <= each).select(by, "mark", "n").collect(), key=lambda r: r["mark"]):
        count, size = used.get(r[by], (0, 0))
        used[r[by]] = (count + 1, size + r["n"])
        if count < most and size + r["n"] <= total:
            last[r[by]] = r["mark"]
        else:
            used[r[by]] = (most, total)
    limits = rows.sparkSession.createDataFrame(list(last.items()), f"{by} {rows.schema[by].dataType.simpleString()}, upto long")
    return rows.join(F.broadcast(limits), by).where((F.col("n") <= each) & (F.col("mark") <= F.col("upto"))).drop("upto").toArrow()
