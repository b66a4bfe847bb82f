"""Results as JSON lines and figures of a run as log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import checks


def as_json(results: DataFrame) -> DataFrame:
    """One typed JSON text for each result row."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    as_json(results).write.text(path)


def log_records(results: DataFrame, number: str = "datos.numero_documento") -> DataFrame:
    """JSON log records without personal data."""
    info = F.expr(checks.log_info(number, "confianza_global", "raw.ocr_engine"))
    return results.select(F.to_json(F.struct(F.lit("INFO").alias("level"), F.lit("document").alias("event"), "doc_id", "valido", info.alias("info"))).alias("value"))
