"""Images and OCR as pluggable sources.

The OCR engine is a callable given by the user: it gets an image's bytes and returns ``text``, ``confidence`` and optionally
``annotations``. Two adapters (``tesseract``, ``vision``) call libraries that are imported when they are first used. Pixels are prepared
in numpy (``legajo.functions.pixels``), all steps of an image in one map.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 5 * 1024 * 1024
MIMES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
OCR_SCHEMA = "path string, text string, confidence double, annotations array<struct<text:string,vertices:array<struct<x:int,y:int>>>>, status int, error string"
TIMEOUT = 30.0
#: Confidence of an engine that gives none (fixed value).
CONSTANT_CONFIDENCE = 95.0


class EngineMissing(RuntimeError):
    """The OCR engine can't be used here."""


def read_images(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content; the size gate reaches the reader before any content is read."""
    reader = spark.readStream if stream else spark.read
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.format("binaryFile").load(path)


def size_ok(length: str = "length") -> Column:
    """Exactly 5 MiB still passes."""
    return F.col(length) <= MAX_BYTES


def mime_ok(mime: str = "mime") -> Column:
    return F.coalesce(F.col(mime).isin(*MIMES), F.lit(False))


def image_type(content: str = "content") -> Column:
    """jpeg, png or webp by the first bytes (any RIFF counts as webp), else NULL."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(start(3) == "FFD8FF", "jpeg").when(start(4) == "89504E47", "png").when(start(4) == "52494646", "webp")


def gated(images: DataFrame) -> DataFrame:
    """``images`` with ``status``: 200, or the code that the first failing gate gives (400 type, 413 size)."""
    gate = F.when(~size_ok(), 413).when(image_type().isNull(), 400).otherwise(200)
    if "mime" in images.columns:
        gate = F.when(~mime_ok(), 400).otherwise(gate)
    return images.withColumn("status", gate)


def within(seconds: float, call: Callable[[], dict]) -> dict:
    """The result of a call; TimeoutError if it takes longer. A call that hangs is left behind in its own thread."""
    box: list = []

    def run() -> None:
        try:
            box.append((call(), None))
        except Exception as e:
            box.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"no answer within {seconds:g} s")
    got, error = box[0]
    if error is not None:
        raise error
    return got


def status_of(error: Exception | None) -> int:
    """503 without an engine, 504 after the time limit, 500 otherwise."""
    if error is None:
        return 200
    return 503 if isinstance(error, EngineMissing) else 504 if isinstance(error, TimeoutError) else 500


def with_ocr(images: DataFrame, ocr: Callable[[bytes], dict] | None, concurrency: int | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """Text, confidence, annotations, status and error of each image; an image that fails is a row with an error.

    concurrency: most calls at a time, as partitions. timeout: seconds of a call. Without an engine all rows get status 503. Contents end
    here: they are not kept.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    if ocr is None:
                        raise EngineMissing("no OCR engine")
                    got = within(timeout, lambda content=r.content: ocr(content))
                    rows.append((r.path, got.get("text", ""), float(got.get("confidence", 0.0)), got.get("annotations") or [], 200, None))
                except Exception as e:  # one image must not fail the job
                    rows.append((r.path, None, None, [], status_of(e), f"{type(e).__name__}: {e}"))
            yield type(frame)(rows, columns=["path", "text", "confidence", "annotations", "status", "error"])

    rows = images.select("path", "content")
    return (rows.repartition(concurrency) if concurrency else rows).mapInPandas(run, OCR_SCHEMA)


def tesseract(languages: str = "spa+cat+eng", layout: int = 6) -> Callable[[bytes], dict]:
    """An engine by the local OCR program; its confidence is the mean of the positive word confidences."""

    def ocr(content: bytes) -> dict:
        try:
            import io

            import pytesseract
            from PIL import Image
        except ImportError as e:
            raise EngineMissing(str(e)) from e
        options = {"lang": languages, "config": f"--psm {layout}"}
        image = Image.open(io.BytesIO(content))
        words = pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT, **options)
        good = [c for c in map(float, words["conf"]) if c > 0]
        return {"text": pytesseract.image_to_string(image, **options).strip(), "confidence": round(sum(good) / len(good), 2) if good else 0.0}

    return ocr


def vision(document: bool = True) -> Callable[[bytes], dict]:
    """An engine by the cloud service, for documents or for scattered text with the boxes of its words."""

    def ocr(content: bytes) -> dict:
        try:
            from google.cloud import vision as service
        except ImportError as e:
            raise EngineMissing(str(e)) from e
        client, image = service.ImageAnnotatorClient(), service.Image(content=content)
        got = client.document_text_detection(image=image) if document else client.text_detection(image=image)
        if got.error.message:
            raise RuntimeError(got.error.message)
        if document:
            text, boxes = got.full_text_annotation.text, []
        else:
            found = list(got.text_annotations)
            text = found[0].description if found else ""
            boxes = [{"text": a.description, "vertices": [{"x": v.x, "y": v.y} for v in a.bounding_poly.vertices]} for a in found[1:]]
        return {"text": text, "confidence": CONSTANT_CONFIDENCE if text else 0.0, "annotations": boxes}

    return ocr


def prepared(images: DataFrame, mode: str = "standard", ocr: Callable[[bytes], dict] | None = None) -> DataFrame:
    """path, content (PNG), status and error of each image after the steps of ``mode``; one that can't be read gets status 400 and no content.

    One map without a shuffle; an image is decoded once for all steps. ``ocr`` is asked for the upright turn, four times an image.
    """
    from legajo.functions import pixels

    if mode not in pixels.MODES:
        raise ValueError(f"mode must be one of {pixels.MODES}")

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows.append((r.path, pixels.encoded(pixels.prepared(pixels.decoded(r.content), mode, ocr)), 200, None))
                except Exception as e:  # one image must not fail the job
                    rows.append((r.path, None, 400 if isinstance(e, pixels.Undecodable) else 500, f"{type(e).__name__}: {e}"))
            yield type(frame)(rows, columns=["path", "content", "status", "error"])

    return images.select("path", "content").mapInPandas(run, "path string, content binary, status int, error string")


def word_confidence(confidences: str) -> str:
    """Mean of the positive word confidences to two decimals, 0 without any."""
    good = f"filter({confidences}, c_ -> c_ > 0)"
    return f"coalesce(bround(aggregate({good}, 0D, (a_, c_) -> a_ + c_, a_ -> if(size({good}) > 0, a_ / size({good}), 0D)), 2), 0D)"


def best_rotation(scores: DataFrame, gain: float = 0.05) -> DataFrame:
    """path, angle: the rotation with the highest score 2 * horizontal + 0.1 * words, if it beats angle 0 by ``gain`` of it.

    scores: path, angle, horizontal, words.
    """
    value = (2 * F.col("horizontal") + 0.1 * F.col("words")).alias("s")
    best = scores.groupBy("path").agg(F.max(F.struct(value, (-F.col("angle")).alias("a"))).alias("b"), F.max(F.when(F.col("angle") == 0, value)).alias("own"))
    return best.select("path", F.when(F.col("b.s") - F.coalesce("own", F.lit(0.0)) > gain * F.coalesce("own", F.lit(0.0)), -F.col("b.a")).otherwise(F.lit(0)).cast("int").alias("angle"))


def skew_angle(angles: str) -> str:
    """Median of the first ten line angles where it exceeds half a degree, else 0."""
    ten = f"array_sort(slice({angles}, 1, 10))"
    n = f"size({ten})"
    median = f"if({n} % 2 = 1, get({ten}, {n} div 2), (get({ten}, {n} div 2 - 1) + get({ten}, {n} div 2)) / 2)"
    return f"coalesce(if(abs({median}) > 0.5, cast({median} as double), 0D), 0D)"
