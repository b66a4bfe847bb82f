"""Pixel operators against naive versions and drawn pictures, OCR adapters and time limits."""

import struct
import time
import zlib

import numpy as np
import pytest

from legajo.functions import pixels
from legajo.plans import compare
from legajo.sources import images


def noise(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def page(h=400, w=600):
    out = np.full((h, w, 3), 30, np.uint8)
    out[60 : h - 60, 80 : w - 80] = 230
    return out


def stripes():
    out = np.full((500, 700, 3), 255, np.uint8)
    for y in range(60, 450, 40):
        out[y : y + 8, 20:680] = 0
    return out


def test_png_round_trip_and_filters():
    x = noise(23, 17)
    assert (pixels.decoded(pixels.encoded(x)) == x).all()
    assert (pixels.decoded(pixels.encoded(x[..., 0])) == x[..., :1]).all()
    lines, above = b"", np.zeros(17 * 3, int)
    for y in range(23):  # each of the five filters in turn
        line, kind = x[y].reshape(-1).astype(int), y % 5
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, near][kind]
        lines += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    made = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 17, 23, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    assert (pixels.decoded(made) == x).all()
    for bad in (b"", b"hello", made[:60], b"\xff\xd8\xff\xe0"):
        with pytest.raises(pixels.Undecodable):
            pixels.decoded(bad)


def test_regions_equal_flood_fill():
    mask = np.random.default_rng(3).random((40, 50)) < 0.4
    label, seen = pixels.components(mask), np.zeros(mask.shape, int)
    count = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start]:
            continue
        count, todo = count + 1, [start]
        seen[start] = count
        while todo:
            y, x = todo.pop()
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if 0 <= p[0] < 40 and 0 <= p[1] < 50 and mask[p] and not seen[p]:
                    seen[p] = count
                    todo.append(p)
    assert (label > 0).tolist() == mask.tolist()
    assert len({(int(a), int(b)) for a, b in zip(label[mask], seen[mask], strict=True)}) == count


def test_deskew():
    assert pixels.line_angles(pixels.edges(pixels.gray(stripes()), 50, 150), 200)[:3] == [0.0, 0.0, 0.0]
    tilted = pixels.rotated(stripes(), 5)
    assert pixels.skew(pixels.line_angles(pixels.edges(pixels.gray(tilted), 50, 150), 200)) == -5.0
    assert np.abs(pixels.deskewed(tilted)[150:350, 200:500].astype(int) - stripes()[150:350, 200:500]).mean() < 6
    assert (pixels.deskewed(stripes()) == stripes()).all()
    assert pixels.skew([0.4, 0.4]) == 0.0 and pixels.skew([]) == 0.0 and pixels.skew([2.0] * 10 + [90.0] * 50) == 2.0


def test_document_is_found_and_straightened():
    corners = pixels.in_order(pixels.document_corners(page()))
    assert np.abs(corners - [[80, 60], [519, 60], [519, 339], [80, 339]]).max() <= 2
    flat = pixels.straightened(page(), corners)
    assert flat.shape[0] in range(277, 283) and flat.shape[1] in range(437, 443) and flat[20:-20, 20:-20].min() == 230
    assert pixels.document_corners(np.full((50, 60, 3), 9, np.uint8)) is None
    small = np.full((400, 600, 3), 30, np.uint8)
    small[10:60, 10:60] = 230
    assert pixels.document_corners(small) is None


def test_contrast_sharpness_threshold_and_size():
    x = noise(64, 48)
    assert np.abs(pixels._from_lab(pixels._to_lab(x)).astype(int) - x).max() <= 1
    dull = np.random.default_rng(5).integers(100, 131, (512, 512, 1)).astype(np.uint8).repeat(3, 2)
    assert pixels.contrasted(dull).std() > 1.5 * dull.std()
    flat = np.full((30, 30, 3), 77, np.uint8)
    assert (pixels.sharpened(flat) == 77).all() and (pixels.denoised(flat) == 77).all() and (pixels.binarised(flat) == 255).all()
    y, z = 10, 20
    want = np.clip(9 * x[y, z].astype(int) - (x[y - 1 : y + 2, z - 1 : z + 2].astype(int).sum((0, 1)) - x[y, z]), 0, 255)
    assert (pixels.sharpened(x)[y, z] == want).all()
    grainy = np.clip(128 + np.random.default_rng(2).normal(0, 5, (40, 40, 1)), 0, 255).astype(np.uint8).repeat(3, 2)
    assert pixels.denoised(grainy).std() < 0.6 * grainy.std()
    dark = page()
    assert pixels.binarised(dark)[62, 78] == 0
    assert pixels.resized(noise(10, 2000)).shape == (10, 2000, 3) and pixels.resized(np.full((30, 3000, 3), 50, np.uint8)).shape == (20, 2000, 3)
    assert (pixels.resized(np.full((30, 3000, 3), 50, np.uint8)) == 50).all()
    assert pixels.prepared_lightly(flat).tolist() == flat.tolist() and pixels.prepared_lightly(x).std() > x.std()


def test_upright_turn():
    marked = np.zeros((20, 30, 3), np.uint8)
    marked[0, 0] = 255
    box = lambda w, h: {"vertices": [{"x": 0, "y": 0}, {"x": w, "y": 0}, {"x": w, "y": h}, {"x": 0, "y": h}]}
    assert pixels.horizontal_share([box(5, 1), box(1, 5), {"vertices": []}]) == 50.0 and pixels.horizontal_share([]) == 0.0

    def ocr(content):
        if (got := pixels.decoded(content)).shape[0] == 20:
            if got[0, 0, 0]:
                return {"annotations": [box(1, 5)] * 4}
            raise ValueError("no credit")
        return {"annotations": [box(5, 1)] * (3 if got[-1, 0, 0] else 2)}

    assert (pixels.upright(marked, ocr) == np.rot90(marked, 1)).all()
    assert (pixels.upright(marked, lambda c: {"annotations": [box(5, 1)] * (20 + (pixels.decoded(c).shape[0] == 30))}) == marked).all()
    assert (pixels.upright(marked, lambda c: 1 / 0) == marked).all() and (pixels.upright(marked, None) == marked).all()


def test_prepared_images(spark):
    rows = [("a", pixels.encoded(page(200, 300))), ("b", b"no image"), ("c", b"\xff\xd8\xff\xe0")]
    df = spark.createDataFrame(rows, "path string, content binary")
    for mode in ("none", "standard", "document"):
        got = {r.path: r for r in images.prepared(df, mode).collect()}
        assert got["a"].status == 200 and got["b"].status == 400 and got["c"].status == 400 and got["b"].content is None
        assert (pixels.decoded(bytes(got["a"].content)) == pixels.prepared(page(200, 300), mode)).all()
    with pytest.raises(ValueError):
        images.prepared(df, "other")
    tiny = noise(24, 24)
    assert pixels.prepared(tiny, "aggressive").shape == tiny.shape
    assert images.prepared(df.limit(0)).count() == 0


def test_time_limit_and_statuses(spark):
    df = spark.createDataFrame([("slow", b"s"), ("bad", b"b"), ("none", b"n"), ("good", b"g")], "path string, content binary")

    def ocr(content):
        if content == b"s":
            time.sleep(20)
        if content == b"b":
            raise ValueError("broken")
        if content == b"n":
            raise images.EngineMissing("off")
        return {"text": "x", "confidence": 9}

    assert {r.path: r.status for r in images.with_ocr(df.repartition(1), ocr, timeout=1.0).collect()} == {"slow": 504, "bad": 500, "none": 503, "good": 200}
    assert {r.status for r in images.with_ocr(df, None).collect()} == {503}
    for engine in (images.tesseract(), images.vision()):  # neither library is installed here
        assert {r.status for r in images.with_ocr(df, engine).collect()} <= {503, 500}


def test_unknown_engines_are_passed_over(spark):
    df = spark.createDataFrame([("a", b"x")], "path string, content binary")
    got = compare.run_matrix(df, ["other", "tesseract"], ["none"], lambda e, m, c: {"text": e, "confidence": 1}).collect()
    assert [(r.engine, r.success) for r in got] == [("tesseract", True)]
    assert compare.run_matrix(df, ["other"], ["none"], None).count() == 0


def test_mime_gate(spark):
    rows = [("image/png", 4), ("image/webp", 4), ("text/plain", 4), (None, 4), ("image/jpeg", images.MAX_BYTES), ("image/jpeg", images.MAX_BYTES + 1)]
    df = spark.createDataFrame([(m, n, b"\x89PNG") for m, n in rows], "mime string, length long, content binary")
    assert [r.status for r in images.gated(df).collect()] == [200, 200, 400, 400, 200, 413]
