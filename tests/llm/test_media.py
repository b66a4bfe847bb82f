import hashlib
import tarfile
import zlib

import pytest

from legajo.llm import media
from legajo.llm.common import scratch


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 10_000])
def test_png_round_trip(size):
    payload, n = media.payload_of("x" * size)
    assert n == size and len(payload) % 64 == 0 and len(payload) >= 64
    assert media.from_png(media.to_png(payload)) == payload
    with pytest.raises(Exception):
        media.from_png(media.to_png(payload)[:-9] + b"damaged!!")


def test_media_columns(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "grüße" * 900, 3), (4, "grüße" * 900, 4), (4, "y" * 64, 5), (None, "z" * 300_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = media.media_columns(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for i, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height) == (64, len(payload) // 64)
    assert by[3, 6300].media_sha256 == by[4, 6300].media_sha256 and by[3, 6300].feature == by[4, 6300].feature
    assert media.media_columns(docs.limit(0)).count() == 0


def test_shards_are_tar_files_and_probe_reads_headers(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string").coalesce(1)
    root = scratch(spark, "shards")
    rows = media.probe(media.store(docs, root), root).collect()
    assert len({(r.shard, r.offset) for r in rows}) == 3
    with tarfile.open(f"{root.removeprefix('file://')}/{rows[0].shard}") as tar:
        members = {m.name: m.size for m in tar.getmembers()}
    assert {r.member: r.media_bytes for r in rows} == members and {r.digest + ".png" for r in rows} == set(members)
