"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.schema import OPERATOR_DIVISOR


def plus(names: Iterable[str]) -> Column:
    """The sum of several columns of one row."""
    total = None
    for name in names:
        total = F.col(name) if total is None else total + F.col(name)
    return total


def operator_code(imsi: str = "imsi") -> Column:
    """Operator of an IMSI by integer division; 0 means none."""
    return F.expr(f"{imsi} div {OPERATOR_DIVISOR}").cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` in double, NULL where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def id_text(name: str) -> Column:
    """Identifiers are answered and ordered as text."""
    return F.col(name).cast("string")


def sums(names: Iterable[str]) -> list[Column]:
    """One additive aggregate per counter, under the counter's own name."""
    return [F.sum(name).alias(name) for name in names]


def present(df: DataFrame, counters: Iterable[str]) -> DataFrame:
    """Rows with at least one counter above zero. Apply it to merged state, never to a part."""
    return df.filter(F.greatest(*[F.col(name) for name in counters]) > 0)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Counters under the names they are reported with."""
    return df.withColumnsRenamed(dict(names))


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """One JSON document per row, fields in column order."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))
