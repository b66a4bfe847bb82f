"""From document texts to result rows: routing by family, extraction and validation, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.operators import decisions, fiscal, identity, vehicle

FAMILIES = {"dni": identity, "permiso_circulacion": vehicle, "nif": fiscal}
RESULT = ("doc_id", "valido", "confianza_global", "tipo_documento", "alertas", "errores_detectados", "raw", "meta", "error")


def date_expr(as_of: str | None) -> str:
    """SQL of the day that counts as today."""
    return f"date'{as_of}'" if as_of else "current_date()"


def analyze_family(df: DataFrame, family: str, as_of: str | None = None) -> DataFrame:
    """Results of one family's texts (doc_id, text, ocr_engine, ocr_confidence, ...), with its own ``datos``."""
    ops, today = FAMILIES[family], date_expr(as_of)
    return ops.validate(ops.extract(df, today), today)


def analyze(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Results of mixed texts; ``datos`` as JSON, since its fields differ by family. Rows of no family get error 'unknown type'.

    A missing doc_type is told from the text.
    """
    told = df.withColumn("doc_type", F.coalesce("doc_type", F.expr(decisions.doc_type("text"))))
    # A generator of one row each: no projection goes through it, so a union of sources below it isn't multiplied by the families.
    told = told.select(F.inline(F.array(F.struct(*told.columns))))
    out = None
    for family in FAMILIES:
        part = analyze_family(told.where(F.col("doc_type") == family), family, as_of).select(*RESULT, F.to_json("datos").alias("datos"))
        out = part if out is None else out.unionByName(part)
    other = told.where(~F.coalesce(F.col("doc_type").isin(*FAMILIES), F.lit(False)))
    empty = {c: F.lit(None).cast(out.schema[c].dataType) for c in out.columns} | {"doc_id": F.col("doc_id"), "valido": F.lit(False), "confianza_global": F.lit(0), "error": F.lit("unknown type")}
    return out.unionByName(other.select(*[empty[c].alias(c) for c in out.columns]))
