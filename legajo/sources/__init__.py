"""Readers of tables, document texts and images."""

from legajo.sources.tables import read_table

__all__ = ["read_table"]
