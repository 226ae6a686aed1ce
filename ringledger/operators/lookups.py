"""Answers for given keys: found rows under report names, and the keys without an answer.

Keys come as a DataFrame, so one request or a million are one query. A few keys reach the scan
as a filter, more are broadcast, and beyond that both sides shuffle and AQE splits what is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.columns import id_text, plus, renamed
from ringledger.functions.workspace import NAMED_KEYS, cut, small_side
from ringledger.schema import (
    LINK_REPORT,
    OPERATOR_BOARDS,
    OPERATOR_REPORT,
    SUBSCRIBER_BOARDS,
    SUBSCRIBER_REPORT,
    TOTAL_REPORT,
)


def found(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``table`` whose key is asked for, each once: a filter for few keys, else one join
    on the whole key."""
    held = cut(keys.select(*on).distinct(), "keys")
    named = held.limit(NAMED_KEYS + 1).collect()
    if len(named) > NAMED_KEYS:
        return table.join(small_side(held), on, "left_semi")
    # The first part alone lets the scan skip row groups; the pairs are then told apart.
    first = F.col(on[0]).isin(list({key[0] for key in named}))
    if len(on) == 1:
        return table.filter(first)
    return table.filter(first).join(small_side(held), on, "left_semi")


def missing(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keys asked for that ``table`` does not hold."""
    return keys.select(*on).distinct().join(table.select(*on), on, "left_anti")


def subscriber_report(usage: DataFrame, keys: DataFrame) -> DataFrame:
    rows = found(usage, keys, ["msisdn"])
    report = renamed(rows, SUBSCRIBER_REPORT)
    return report.select(
        id_text("msisdn").alias("msisdn"), *[f"`{n}`" for n in SUBSCRIBER_REPORT.values()]
    )


def operator_report(traffic: DataFrame, keys: DataFrame) -> DataFrame:
    report = renamed(found(traffic, keys, ["mccmnc"]), OPERATOR_REPORT)
    return report.select(
        id_text("mccmnc").alias("mccmnc"), *[f"`{n}`" for n in OPERATOR_REPORT.values()]
    )


def link_report(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weights of given (owner, peer) pairs."""
    report = renamed(found(links, pairs, ["owner", "peer"]), LINK_REPORT)
    return report.select(
        id_text("owner").alias("first-party"),
        id_text("peer").alias("second-party"),
        *LINK_REPORT.values(),
    )


def totals_report(totals: DataFrame) -> DataFrame:
    return renamed(totals, TOTAL_REPORT)


def store_keys(
    subscribers: DataFrame,
    operators: DataFrame,
    links: DataFrame,
    totals: DataFrame,
    progress: DataFrame,
) -> DataFrame:
    """How many keys each kind of result holds. Totals and progress are one key each once they
    hold anything; a board is one once anybody has a score on it. Each table is read once."""

    def counted(kind: str, table: DataFrame, boards: dict[str, tuple[str, ...]]) -> DataFrame:
        filled = [F.coalesce(F.max(plus(c) > 0), F.lit(False)).cast("bigint") for c in boards.values()]
        row = table.agg(F.count("*").alias("keys"), sum(filled, F.lit(0)).alias("boards"))
        return row.select(
            F.explode(
                F.array(
                    F.struct(F.lit(kind).alias("kind"), F.col("keys").alias("keys")),
                    F.struct(F.lit("boards").alias("kind"), F.col("boards").alias("keys")),
                )
            ).alias("x")
        ).select("x.*")

    def any_of(kind: str, df: DataFrame) -> DataFrame:
        return df.limit(1).agg(F.count("*").alias("keys")).select(F.lit(kind).alias("kind"), "keys")

    owners = links.agg(F.countDistinct("owner").alias("keys"))
    return (
        counted("subscribers", subscribers, SUBSCRIBER_BOARDS)
        .union(counted("operators", operators, OPERATOR_BOARDS))
        .union(owners.select(F.lit("links").alias("kind"), "keys"))
        .union(any_of("totals", totals.filter("records > 0")))
        .union(any_of("progress", progress))
        .groupBy("kind")
        .agg(F.sum("keys").alias("keys"))
    )


def health(keys: DataFrame, max_hops: int, max_visited: int) -> DataFrame:
    """One row: the store answers, how many keys it holds, and the search bounds."""
    return keys.agg(F.coalesce(F.sum("keys"), F.lit(0)).cast("bigint").alias("keys")).select(
        F.lit("ok").alias("status"),
        F.lit("up").alias("store"),
        "keys",
        F.lit(max_hops).alias("max-hops"),
        F.lit(max_visited).alias("max-visited"),
    )
