"""Adding SQL expressions to a DataFrame stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Columns that don't depend on each other, in one projection."""
    return df.withColumns({name: F.expr(e) for name, e in exprs.items()})


def as_struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def null(kind: str = "string") -> str:
    return f"cast(null as {kind})"
