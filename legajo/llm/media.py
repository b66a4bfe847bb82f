"""Operator 2: media columns, content-addressed payloads in tar shards.

``store`` turns every text into a payload (UTF-8, zero bytes up to a positive multiple of 64), keeps it losslessly
as an 8-bit grey PNG of 64 samples a row and appends it to its task's tar shard in the shared folder. A shard
holds one member per SHA-256 digest, named by it; rows carry only digest, shard, offset and length, so no text is
shuffled. ``probe`` fills metadata columns from header-only range reads (tar header and PNG header);
``features`` range-reads the members, decodes them and computes from what was stored.

Free style (mapInArrow). A shard is named anew by each task attempt and rows are committed by Spark's writer, so a lost
executor leaves an unreferenced shard at most. Null and empty texts give 64 zero bytes; equal texts get equal values
(metadata, digest, feature) wherever their copies lie; repeated rows repeat; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import arrow_map, scratch, text_or_empty, written

SAMPLES = 64
SHARD_BYTES = 1 << 28
#: Bytes of a shard that lie together when it is read back, and that a task reads.
STRETCH, TASK_BYTES = 1 << 22, 1 << 26
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + bytes(-len(raw) % SAMPLES if raw else SAMPLES), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    lines = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made; a damaged one raises."""
    at, body = len(_MAGIC), b""
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged chunk {kind!r}")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, SAMPLES + 1)[:, 1:].tobytes()


class _Shards:
    """The tar shards that one task attempt writes."""

    def __init__(self, root: str):
        self.files, base = fs.FileSystem.from_uri(root)
        self.base, self.out, self.path = base, None, ""

    def add(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.files.create_dir(self.base, recursive=True)
            self.path = f"{uuid.uuid4().hex}.tar"
            self.out, self.at, self.places = self.files.open_output_stream(f"{self.base}/{self.path}"), 0, {}
        if digest not in self.places:
            media = to_png(payload)
            info = tarfile.TarInfo(digest + ".png")
            info.size = len(media)
            member = info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512)
            self.places[digest] = (self.path, self.at, len(media))
            self.out.write(member)
            self.at += len(member)
        return self.places[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()


def store(docs: DataFrame, root: str) -> DataFrame:
    """Write the shards under ``root``; the manifest: doc_id, n_bytes, payload_bytes, digest, shard, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(root)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                payload, size = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((size, len(payload), digest, *shards.add(digest, payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            names = ["n_bytes", "payload_bytes", "digest", "shard", "offset", "length"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *names])
        shards.close()

    schema = "doc_id long, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"
    rows = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, schema)
    return written(rows, "manifest")


class _Reader:
    """Range reads, one open shard at a time."""

    def __init__(self, root: str):
        self.files, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.file = None, None

    def at(self, shard: str, offset: int, size: int) -> bytes:
        if shard != self.shard:
            if self.file is not None:
                self.file.close()
            self.shard, self.file = shard, self.files.open_input_file(f"{self.base}/{shard}")
        return self.file.read_at(size, offset)

    def header(self, shard: str, offset: int) -> dict:
        head = self.at(shard, offset, 512 + 33)
        member = tarfile.TarInfo.frombuf(head[:512], "utf-8", "strict")
        width, height, depth, colour = struct.unpack(">IIBB", head[528:538])
        if head[512:520] != _MAGIC:
            raise ValueError(f"{shard}@{offset} holds no PNG")
        return {"member": member.name, "media_bytes": member.size, "width": width, "height": height, "bit_depth": depth, "colour_type": colour}


_META = {"member": pa.string(), "media_bytes": pa.int64(), "width": pa.int32(), "height": pa.int32(), "bit_depth": pa.int32(), "colour_type": pa.int32()}
_FEATURES = {"payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _described(manifest: DataFrame, root: str, whole: bool) -> DataFrame:
    kinds = _META | (_FEATURES if whole else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = _Reader(root), {}
        for batch in batches:
            rows = []
            for place in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if place not in known:
                    if len(known) > 20_000:
                        known.clear()
                    row = reader.header(*place)
                    if whole:
                        media = reader.at(place[0], place[1] + 512, row["media_bytes"])
                        row |= describe(media, from_png(media))
                    known[place] = row
                rows.append(known[place])
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *kinds])

    simple = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema] + [f"{k} {simple[v]}" for k, v in kinds.items()])
    return arrow_map(manifest, run, schema)


def describe(media: bytes, payload: bytes) -> dict:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean, entropy = float(np.dot(counts, np.arange(256)) / len(payload)), float(-(share * np.log2(share)).sum())
    return {
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-SAMPLES:]),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"mean={mean:.4f};entropy={abs(entropy):.4f};distinct={len(share)}",
    }


def probe(manifest: DataFrame, root: str) -> DataFrame:
    """Metadata columns from header-only range reads of 545 bytes a row."""
    return _described(manifest, root, False)


def features(manifest: DataFrame, root: str) -> DataFrame:
    """Metadata, digests and features of the stored members, read back whole.

    The manifest is dealt by stretches of the shards, as many tasks as the stored bytes need; each reads its stretches in order.
    """
    stored = manifest.agg(F.sum("length")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-int(stored) // TASK_BYTES))
    dealt = manifest.repartition(tasks, "shard", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("shard", "offset")
    return _described(dealt, root, True)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store all texts in a new folder and describe what was stored."""
    root = scratch(docs.sparkSession, "shards")
    return features(store(docs, root), root).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")
