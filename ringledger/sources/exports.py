"""Listings as CSV and documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Column order of the exported listings.
BOARD_EXPORT = ("position", "id", "score")
PEER_EXPORT = ("msisdn", "calls", "duration", "sms")


def export_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """Write a listing with a header line, quoting only cells that need it."""
    rows = df.select(*[f"`{c}`" for c in columns]) if columns else df
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """Write one JSON document per row."""
    df.write.json(path)
