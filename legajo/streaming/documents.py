"""The same projection over a stream of texts: stateless, so append mode and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from legajo.plans.pipeline import analyze

SCHEMA = "doc_id long, doc_type string, text string, ocr_engine string, ocr_confidence double"


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def results(texts: DataFrame, as_of: str | None = None) -> DataFrame:
    return analyze(texts, as_of)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once files of results."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)


def answered_once(stream: DataFrame, key: str, time: str, ttl: str = "24 hours") -> DataFrame:
    """Rows whose content key was not seen within ``ttl``."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])
