"""Pixel operators that prepare images for OCR, in numpy alone.

Images are arrays (height, width, 3) of 8-bit red, green and blue. The operators follow the usual definitions (Sobel and
hysteresis edges, a line histogram over angle and distance, tile-wise limited histogram equalisation, non-local means, Lanczos
and cubic resampling); results agree with image libraries in kind, not bit by bit.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Thresholds, sizes and factors of the preparation.
SKEW_EDGES, SKEW_VOTES, SKEW_LINES, SKEW_LEAST = (50, 150), 200, 10, 0.5
CLIP, TILES = 2.0, 8
NOISE, PATCH, SEARCH = 10.0, 7, 21
BINARY_SIZE, BINARY_LESS = 11, 2
SHARPEN = ((-1, -1, -1), (-1, 9, -1), (-1, -1, -1))
MOST_WIDTH = 2000
QUAD_EDGES, QUAD_SHARE, QUAD_TOLERANCE = (75, 200), 0.1, 0.02
CONTRAST, SHARPNESS = 1.5, 2.0
MODES = ("none", "standard", "aggressive", "document")

_PNG = b"\x89PNG\r\n\x1a\n"


class Undecodable(ValueError):
    """Bytes that are no image, or of a kind that needs a library that is absent."""


def decoded(content: bytes) -> np.ndarray:
    """PNG of 8 bits without interlace natively, everything else by Pillow, where that is installed."""
    if content.startswith(_PNG) and content[24] == 8 and content[25] in (0, 2, 4, 6) and content[28] == 0:
        return _png(content)
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise Undecodable("this kind of image needs Pillow") from e
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except Exception as e:
        raise Undecodable(str(e)) from e


def _png(content: bytes) -> np.ndarray:
    width, height = struct.unpack(">II", content[16:24])
    depth = {0: 1, 2: 3, 4: 2, 6: 4}[content[25]]
    at, body = 8, b""
    try:
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            body += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += 12 + size
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * depth)
    except (struct.error, zlib.error, ValueError) as e:
        raise Undecodable(str(e)) from e
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, depth)
    out = out.reshape(height, width, depth)
    return np.ascontiguousarray(out[..., :3] if depth > 2 else np.repeat(out[..., :1], 3, 2))


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, depth), 0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    out, up = [0] * depth + line.tolist(), [0] * depth + above.tolist()
    for i in range(depth, len(out)):
        left, high, corner = out[i - depth], up[i], up[i - depth]
        if kind == 3:
            guess = (left + high) // 2
        else:
            guess = min((left, high, corner), key=lambda v: abs(left + high - corner - v))
        out[i] = (out[i] + guess) & 255
    return np.array(out[depth:], np.uint8)


def encoded(image: np.ndarray) -> bytes:
    """PNG of a colour or grey image."""
    image = np.ascontiguousarray(image)
    height, width = image.shape[:2]
    flat = image.reshape(height, -1)
    lines = np.zeros((height, flat.shape[1] + 1), np.uint8)
    lines[:, 1:] = flat
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return _PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(image: np.ndarray) -> np.ndarray:
    return _bytes(image @ np.array([0.299, 0.587, 0.114])) if image.ndim == 3 else image


def correlated(x: np.ndarray, kernel: np.ndarray, border: str = "reflect") -> np.ndarray:
    """Sum of the neighbours weighted by an odd kernel, as float."""
    ky, kx = kernel.shape
    pad = [(ky // 2, ky // 2), (kx // 2, kx // 2)] + [(0, 0)] * (x.ndim - 2)
    wide = np.pad(x.astype(float), pad, mode=border if min(x.shape[:2]) > max(ky, kx) // 2 else "edge")
    out = np.zeros(x.shape)
    for dy in range(ky):
        for dx in range(kx):
            if kernel[dy, dx]:
                out += kernel[dy, dx] * wide[dy : dy + x.shape[0], dx : dx + x.shape[1]]
    return out


def gaussian(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return (line / line.sum())[:, None]


def blurred(x: np.ndarray, size: int, border: str = "reflect") -> np.ndarray:
    return correlated(correlated(x, gaussian(size), border), gaussian(size).T, border)


def edges(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin ridges of the gradient above ``low`` that hang together with one above ``high``."""
    smooth, slope = np.array([[1.0], [2.0], [1.0]]), np.array([[-1.0, 0.0, 1.0]])
    gx = correlated(correlated(x, smooth, "edge"), slope, "edge")
    gy = correlated(correlated(x, smooth.T, "edge"), slope.T, "edge")
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    sector = np.rint(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    ridge = np.zeros(size.shape, bool)
    h, w = size.shape
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], wide[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        ridge |= (sector == k) & (size > behind) & (size >= ahead)
    weak = ridge & (size > low)
    label = components(weak)
    strong = np.unique(label[weak & (size > high)])
    return weak & np.isin(label, strong)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the regions that hang together over eight neighbours; 0 outside. Rows are joined run by run."""
    wide = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(wide, axis=1)
    y, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    up = list(range(len(y)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first = np.searchsorted(y, np.arange(mask.shape[0] + 1))
    a, b = start.tolist(), stop.tolist()
    for row in range(1, mask.shape[0]):
        i, j = int(first[row - 1]), int(first[row])
        last_i, last_j = j, int(first[row + 1])
        while i < last_i and j < last_j:
            if a[i] <= b[j] and a[j] <= b[i]:
                up[find(j)] = find(i)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    label = np.zeros(mask.shape, np.int32)
    for r, (row, s, e) in enumerate(zip(y.tolist(), a, b, strict=True)):
        label[row, s:e] = find(r) + 1
    return label


def line_angles(mask: np.ndarray, votes: int) -> list[float]:
    """Angles in degrees against the horizontal of the lines with more than ``votes`` pixels, most pixels first."""
    y, x = np.nonzero(mask)
    reach = int(np.hypot(*mask.shape)) + 1
    counts = np.zeros((180, 2 * reach + 1), np.int64)
    for k in range(180):
        t = np.radians(k)
        counts[k] = np.bincount(np.rint(x * np.cos(t) + y * np.sin(t)).astype(int) + reach, minlength=2 * reach + 1)
    wide = np.pad(counts, 1)
    peak = (counts > votes) & (counts > wide[:-2, 1:-1]) & (counts >= wide[2:, 1:-1]) & (counts > wide[1:-1, :-2]) & (counts >= wide[1:-1, 2:])
    k, r = np.nonzero(peak)
    return [float(k[i]) - 90.0 for i in np.argsort(-counts[k, r], kind="stable")]


def skew(angles: list[float]) -> float:
    """Median of the first angles where it exceeds half a degree, else 0."""
    middle = float(np.median(angles[:SKEW_LINES])) if angles else 0.0
    return middle if abs(middle) > SKEW_LEAST else 0.0


def deskewed(image: np.ndarray) -> np.ndarray:
    angle = skew(line_angles(edges(gray(image), *SKEW_EDGES), SKEW_VOTES))
    return rotated(image, angle) if angle else image


def _cubic(t: np.ndarray) -> np.ndarray:
    t, a = np.abs(t), -0.75
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0))


def rotated(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned counter-clockwise about the centre, by cubic interpolation; the border repeats."""
    h, w = image.shape[:2]
    cy, cx = h // 2, w // 2
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    out = np.empty(image.shape, np.uint8)
    for top in range(0, h, 256):
        y, x = np.mgrid[top : min(h, top + 256), 0:w].astype(float)
        sx, sy = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy
        fx, fy = np.floor(sx), np.floor(sy)
        total = np.zeros((*sx.shape, image.shape[2]))
        for j in range(-1, 3):
            wy, iy = _cubic(sy - fy - j), np.clip(fy + j, 0, h - 1).astype(int)
            for i in range(-1, 3):
                weight = wy * _cubic(sx - fx - i)
                total += weight[..., None] * image[iy, np.clip(fx + i, 0, w - 1).astype(int)]
        out[top : top + 256] = _bytes(total)
    return out


def turned(image: np.ndarray, angle: int) -> np.ndarray:
    """By a multiple of 90 degrees, counter-clockwise."""
    return np.ascontiguousarray(np.rot90(image, angle // 90))


def horizontal_share(annotations: list) -> float:
    """Percentage of the boxes with four corners and more that are wider than high."""
    boxes = [np.array([(v["x"], v["y"]) for v in a["vertices"]]) for a in annotations if len(a.get("vertices") or []) >= 4]
    spans = [b.max(0) - b.min(0) for b in boxes]
    return 100.0 * sum(bool(s[0] > s[1]) for s in spans) / len(spans) if spans else 0.0


def upright(image: np.ndarray, ocr) -> np.ndarray:
    """The turn with the best text, if it beats the image as it is by more than a twentieth. ocr: gets a PNG; None leaves the image.

    A turn whose call fails is left out.
    """
    if ocr is None:
        return image
    scores = {}
    for angle in (0, 90, 180, 270):
        try:
            found = ocr(encoded(turned(image, angle))).get("annotations") or []
        except Exception:  # one failed call must not cost the image
            continue
        scores[angle] = 2 * horizontal_share(found) + 0.1 * len(found)
    if not scores:
        return image
    own, best = scores.get(0, 0.0), max(scores, key=lambda a: scores[a])
    return turned(image, best) if scores[best] - own > 0.05 * own and scores[best] > 0 else image


def resized(image: np.ndarray, most: int = MOST_WIDTH) -> np.ndarray:
    """At most ``most`` pixels wide, by Lanczos interpolation over eight neighbours."""
    h, w = image.shape[:2]
    if w <= most:
        return image
    out = image.astype(float)
    for axis, (old, new) in enumerate(((h, int(h * (most / w))), (w, most))):
        at = (np.arange(max(new, 1)) + 0.5) * old / max(new, 1) - 0.5
        base = np.floor(at).astype(int)
        taps = np.arange(-3, 5)
        t = at[:, None] - (base[:, None] + taps)
        weight = np.sinc(t) * np.sinc(t / 4) * (np.abs(t) < 4)
        weight /= weight.sum(1, keepdims=True)
        index = np.clip(base[:, None] + taps, 0, old - 1)
        out = sum(np.take(out, index[:, k], axis) * weight[:, k].reshape([-1 if i == axis else 1 for i in range(out.ndim)]) for k in range(8))
    return _bytes(out)


_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def _to_lab(image: np.ndarray) -> np.ndarray:
    v = image / 255.0
    v = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92) @ _TO_XYZ.T / _WHITE
    f = np.where(v > 0.008856, np.cbrt(v), 7.787 * v + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def _from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    v = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE @ np.linalg.inv(_TO_XYZ).T
    return _bytes(255 * np.where(v > 0.0031308, 1.055 * np.maximum(v, 1e-12) ** (1 / 2.4) - 0.055, 12.92 * v))


def equalised(x: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Grey levels equalised tile by tile with limited histograms, mapped between the four nearest tiles."""
    h, w = x.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(x, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if th * tiles - h <= h and tw * tiles - w <= w else "edge")
    area, table = th * tw, np.zeros((tiles, tiles, 256))
    limit = max(1, int(clip * area / 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + excess // 256
            rest = excess % 256
            if rest:
                counts[:: max(1, 256 // rest)][:rest] += 1
            table[i, j] = np.rint(np.cumsum(counts) * 255 / area)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    near = lambda y, x_: table[np.clip(y, 0, tiles - 1)[:, None], np.clip(x_, 0, tiles - 1)[None], x]
    return _bytes((near(y0, x0) * (1 - wx) + near(y0, x0 + 1) * wx) * (1 - wy) + (near(y0 + 1, x0) * (1 - wx) + near(y0 + 1, x0 + 1) * wx) * wy)


def contrasted(image: np.ndarray) -> np.ndarray:
    """Lightness equalised tile by tile, colours kept."""
    lab = _to_lab(image)
    lab[..., 0] = equalised(_bytes(lab[..., 0] * 255 / 100)) * (100 / 255)
    return _from_lab(lab)


def denoised(image: np.ndarray, strength: float = NOISE, patch: int = PATCH, search: int = SEARCH) -> np.ndarray:
    """Non-local means: each pixel the mean of its surroundings, weighted by the likeness of the patches around."""
    lab = _to_lab(image) * np.array([255 / 100, 1, 1])
    h, w = image.shape[:2]
    r, p = search // 2, patch // 2
    wide = np.pad(lab, ((r + p, r + p), (r + p, r + p), (0, 0)), mode="reflect" if min(h, w) > r + p else "edge")
    total, weights = np.zeros(lab.shape), np.zeros((h, w, 2))
    own = wide[r : r + h + 2 * p, r : r + w + 2 * p]
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + h + 2 * p, dx : dx + w + 2 * p]
            d = (own - other) ** 2
            d = np.stack([d[..., 0], d[..., 1:].mean(-1)], -1)
            s = np.pad(d.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
            mean = (s[patch:, patch:] - s[:-patch, patch:] - s[patch:, :-patch] + s[:-patch, :-patch]) / patch**2
            weight = np.exp(-np.maximum(mean, 0) / strength**2)
            total += weight[..., [0, 1, 1]] * other[p : p + h, p : p + w]
            weights += weight
    return _from_lab(total / weights[..., [0, 1, 1]] / np.array([255 / 100, 1, 1]))


def binarised(image: np.ndarray) -> np.ndarray:
    """255 where a grey level exceeds its weighted surroundings less a constant, else 0."""
    x = gray(image)
    return np.where(x > _bytes(blurred(x, BINARY_SIZE, "edge")).astype(int) - BINARY_LESS, 255, 0).astype(np.uint8)


def sharpened(image: np.ndarray) -> np.ndarray:
    return _bytes(correlated(image, np.array(SHARPEN, float)))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order."""
    points = np.unique(points, axis=0)

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    seq = points.tolist()
    return np.array(half(seq) + half(seq[::-1]) if len(seq) > 2 else seq, float)


def _area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _simplified(polygon: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed polygon that lie further than ``tolerance`` from the line between the corners kept around them."""

    def between(part: np.ndarray) -> list:
        if len(part) < 3:
            return [part[0]]
        d = part[-1] - part[0]
        off = np.abs(d[0] * (part[:, 1] - part[0, 1]) - d[1] * (part[:, 0] - part[0, 0])) / max(float(np.hypot(*d)), 1e-9)
        k = int(off.argmax())
        return between(part[: k + 1]) + between(part[k:]) if off[k] > tolerance else [part[0]]

    a = int(np.hypot(*(polygon - polygon.mean(0)).T).argmax())
    ring = np.roll(polygon, -a, 0)
    b = int(np.hypot(*(ring - ring[0]).T).argmax())
    return np.array(between(ring[: b + 1]) + between(np.vstack([ring[b:], ring[:1]])))


def document_corners(image: np.ndarray) -> np.ndarray | None:
    """Four corners (x, y) of the outline with the largest area, if it covers over a tenth of the image and has four.

    Outlines are the convex hulls of edges that hang together.
    """
    label = components(edges(blurred(gray(image), 5), *QUAD_EDGES))
    y, x = np.nonzero(label)
    if not len(y):
        return None
    order = np.argsort(label[y, x], kind="stable")
    y, x = y[order], x[order]
    cuts = np.flatnonzero(np.diff(label[y, x])) + 1
    hulls = [_hull(np.stack([px, py], 1)) for px, py in zip(np.split(x, cuts), np.split(y, cuts), strict=True)]
    best = max(hulls, key=lambda p: _area(p) if len(p) > 2 else 0.0)
    if len(best) < 4 or _area(best) <= QUAD_SHARE * label.size:
        return None
    length = float(np.hypot(*(best - np.roll(best, -1, 0)).T).sum())
    corners = _simplified(best, QUAD_TOLERANCE * length)
    return corners if len(corners) == 4 else None


def in_order(corners: np.ndarray) -> np.ndarray:
    """Upper left, upper right, lower right, lower left, by the sums and differences of the coordinates."""
    total, apart = corners.sum(1), corners[:, 1] - corners[:, 0]
    return corners[[total.argmin(), apart.argmin(), total.argmax(), apart.argmax()]].astype(float)


def straightened(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral as a rectangle with its longer sides, by linear interpolation; black outside."""
    quad = in_order(corners)
    side = lambda i, j: int(np.hypot(*(quad[i] - quad[j])))
    w, h = max(side(2, 3), side(1, 0), 1), max(side(1, 2), side(0, 3), 1)
    to = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows, right = [], []
    for (u, v), (x, y) in zip(to, quad, strict=True):  # from the rectangle back to the image
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.append(np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0], 1).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w].astype(float)
    x, y, z = (m[k, 0] * u + m[k, 1] * v + m[k, 2] for k in range(3))
    x, y = x / z, y / z
    fx, fy = np.floor(x).astype(int), np.floor(y).astype(int)
    wide, total = np.pad(image, ((1, 1), (1, 1), (0, 0))).astype(float), 0.0
    for j in (0, 1):
        for i in (0, 1):
            weight = (1 - np.abs(y - fy - j)) * (1 - np.abs(x - fx - i))
            total = total + weight[..., None] * wide[np.clip(fy + j + 1, 0, wide.shape[0] - 1), np.clip(fx + i + 1, 0, wide.shape[1] - 1)]
    return _bytes(total)


def prepared(image: np.ndarray, mode: str = "standard", ocr=None) -> np.ndarray:
    """An image as OCR gets it. ocr: a callable that the choice of the upright turn asks; without one the turn stays."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "none":
        return image
    if mode == "document" and (corners := document_corners(image)) is not None:
        image = straightened(image, corners)
    image = deskewed(upright(resized(image), ocr))
    if mode == "aggressive":
        return sharpened(contrasted(denoised(image)))
    return contrasted(image) if mode == "standard" else image


def prepared_lightly(image: np.ndarray) -> np.ndarray:
    """Contrast about the mean grey level, then sharpness against a smoothed copy, by fixed factors."""
    middle = float(int(gray(image).mean() + 0.5))
    image = _bytes(middle + CONTRAST * (image - middle))
    kernel = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13
    smooth = image.astype(float)
    smooth[1:-1, 1:-1] = _bytes(correlated(image, kernel))[1:-1, 1:-1]
    return _bytes(smooth + SHARPNESS * (image - smooth))
