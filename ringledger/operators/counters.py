"""Additive counters from records: per subscriber, per operator, per contact, and totals.

Every table is a plain sum, so partial aggregation shrinks each task's rows to one per key
before the shuffle (a hot key included), and parts merge by adding them up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions.columns import operator_code, present, sums
from ringledger.schema import (
    LINK_COUNTERS,
    OPERATOR_COUNTERS,
    SUBSCRIBER_COUNTERS,
    TOTAL_COUNTERS,
)


def _when(code: str, value: Column) -> Column:
    return F.sum(F.when(F.col("usage") == code, value).otherwise(F.lit(0).cast("bigint")))


def _one() -> Column:
    return F.lit(1).cast("bigint")


_SUBSCRIBER_SUMS = {
    "voice_out": ("MOC", "duration"),
    "voice_in": ("MTC", "duration"),
    "data_rx": ("D", "bytes_rx"),
    "data_tx": ("D", "bytes_tx"),
    "sms_out": ("SMS-MO", None),
    "sms_in": ("SMS-MT", None),
    "noans": ("U", None),
    "busy": ("B", None),
    "failed": ("X", None),
}
_TOTAL_SUMS = {
    "moc_cnt": ("MOC", None),
    "mtc_cnt": ("MTC", None),
    "sms_mo_cnt": ("SMS-MO", None),
    "sms_mt_cnt": ("SMS-MT", None),
    "data_cnt": ("D", None),
    "noans_cnt": ("U", None),
    "busy_cnt": ("B", None),
    "failed_cnt": ("X", None),
    "moc_dur": ("MOC", "duration"),
    "mtc_dur": ("MTC", "duration"),
    "data_dur": ("D", "duration"),
    "data_rx": ("D", "bytes_rx"),
    "data_tx": ("D", "bytes_tx"),
}


def _usage_sums(wanted: dict[str, tuple[str, str | None]], names: tuple[str, ...]) -> list[Column]:
    columns = []
    for name in names:
        code, value = wanted[name]
        columns.append(_when(code, F.col(value) if value else _one()).alias(name))
    return columns


def total_sums() -> list[Column]:
    """The fourteen totals as aggregates of records, for any grouping."""
    return [F.count("*").alias("records")] + _usage_sums(_TOTAL_SUMS, TOTAL_COUNTERS[1:])


def batch_summary(rows: DataFrame) -> DataFrame:
    """Everything of a batch that is small, in one pass: totals per source and operator.

    ``rows`` are parsed lines with ``counted`` true for the records that count. Operator 0
    holds what counts for no operator. Totals, operators, marks and accounting are sums of
    the result, see :func:`summary_tables`.
    """
    counted = F.col("counted")
    known = counted & (F.col("msisdn") != 0)
    zero = F.lit(0).cast("bigint")
    return (
        rows.withColumn("mccmnc", F.when(known, operator_code("imsi")).otherwise(F.lit(0)))
        .withColumn("usage", F.when(counted, F.col("usage")))
        .groupBy("source", "mccmnc")
        .agg(
            F.count("usage").alias("records"),
            *[F.coalesce(c, zero).alias(n) for n, c in zip(TOTAL_COUNTERS[1:], total_sums()[1:])],
            F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
            F.max(F.when(counted, F.col("sequence"))).alias("seq"),
        )
    )


def summary_tables(summary: DataFrame) -> dict[str, DataFrame]:
    """Totals, operators, progress and accounts of a batch from its summary."""
    names = {"voice_out": "moc_dur", "voice_in": "mtc_dur", "sms_out": "sms_mo_cnt",
             "sms_in": "sms_mt_cnt"}
    return {
        "totals": merge_totals(summary.select(*TOTAL_COUNTERS)),
        "operators": summary.filter("mccmnc != 0")
        .groupBy("mccmnc")
        .agg(*[F.sum(c).alias(n) for n, c in names.items()]),
        "progress": summary.filter((F.col("source") != "") & (F.col("seq") > 0))
        .groupBy("source")
        .agg(F.max("seq").alias("seq")),
        "accounts": summary.groupBy("source").agg(
            F.sum("records").alias("parsed"), F.sum("rejected").alias("rejected")
        ),
    }


def subscriber_sums(records: DataFrame) -> DataFrame:
    """Counters per subscriber, subscribers without any counter still in. Merge-ready."""
    return (
        records.filter("msisdn != 0")
        .groupBy("msisdn")
        .agg(*_usage_sums(_SUBSCRIBER_SUMS, SUBSCRIBER_COUNTERS))
    )


def operator_sums(records: DataFrame) -> DataFrame:
    """Counters per operator. Only calls and messages of a known subscriber count."""
    return (
        records.filter(
            (F.col("msisdn") != 0) & F.col("usage").isin("MOC", "MTC", "SMS-MO", "SMS-MT")
        )
        .withColumn("mccmnc", operator_code("imsi"))
        .filter("mccmnc != 0")
        .groupBy("mccmnc")
        .agg(*_usage_sums(_SUBSCRIBER_SUMS, OPERATOR_COUNTERS))
    )


def link_sums(records: DataFrame) -> DataFrame:
    """Counters per ordered contact pair, each record counted in both directions.

    Both directions carry the same sums, so the unordered pair is aggregated, half the rows
    and half the groups, and mirrored afterwards. A subscriber's contact with itself is both
    directions at once and counts twice.
    """
    voice = F.col("usage").isin("MOC", "MTC")
    nothing = F.lit(0).cast("bigint")
    pairs = (
        records.filter(
            (F.col("msisdn") != 0)
            & (F.col("peer_msisdn") != 0)
            & F.col("usage").isin("MOC", "MTC", "SMS-MO", "SMS-MT")
        )
        .groupBy(
            F.least("msisdn", "peer_msisdn").alias("lo"),
            F.greatest("msisdn", "peer_msisdn").alias("hi"),
        )
        .agg(
            F.sum(F.when(voice, F.col("duration")).otherwise(nothing)).alias("dur"),
            F.sum(F.when(voice, nothing).otherwise(_one())).alias("sms"),
            F.sum(F.when(voice, _one()).otherwise(nothing)).alias("cnt"),
        )
    )

    def row(owner: str, peer: str, times: int = 1) -> Column:
        return F.struct(
            F.col(owner).alias("owner"),
            F.col(peer).alias("peer"),
            *[(F.col(c) * times).alias(c) for c in LINK_COUNTERS],
        )

    return pairs.select(
        F.explode(
            F.when(F.col("lo") == F.col("hi"), F.array(row("lo", "hi", 2))).otherwise(
                F.array(row("lo", "hi"), row("hi", "lo"))
            )
        ).alias("link")
    ).select("link.*")


def totals(records: DataFrame) -> DataFrame:
    """One row of fourteen counters over every record; zeros when there is none."""
    zero = F.lit(0).cast("bigint")
    return records.agg(*total_sums()).select(
        *[F.coalesce(name, zero).alias(name) for name in TOTAL_COUNTERS]
    )


def subscriber_usage(records: DataFrame) -> DataFrame:
    """Subscribers with something counted."""
    return present(subscriber_sums(records), SUBSCRIBER_COUNTERS)


def operator_traffic(records: DataFrame) -> DataFrame:
    """Operators with something counted."""
    return present(operator_sums(records), OPERATOR_COUNTERS)


def contact_links(records: DataFrame) -> DataFrame:
    """Contact pairs with something counted, both directions."""
    return present(link_sums(records), LINK_COUNTERS)


# --- merging parts -----------------------------------------------------------------------


def _merged(parts: tuple[DataFrame, ...], keys: list[str], counters: tuple[str, ...]) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys).agg(*sums(counters))


def merge_subscribers(*parts: DataFrame) -> DataFrame:
    return present(_merged(parts, ["msisdn"], SUBSCRIBER_COUNTERS), SUBSCRIBER_COUNTERS)


def merge_operators(*parts: DataFrame) -> DataFrame:
    return present(_merged(parts, ["mccmnc"], OPERATOR_COUNTERS), OPERATOR_COUNTERS)


def merge_links(*parts: DataFrame) -> DataFrame:
    return present(_merged(parts, ["owner", "peer"], LINK_COUNTERS), LINK_COUNTERS)


def merge_totals(*parts: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts)
    zero = F.lit(0).cast("bigint")
    return every.agg(
        *[F.coalesce(F.sum(name), zero).alias(name) for name in TOTAL_COUNTERS]
    )


def reconcile_totals(emitted: DataFrame, consumed: DataFrame) -> DataFrame:
    """The same fourteen fields of two totals rows side by side, with the difference."""

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.unpivot([], list(TOTAL_COUNTERS), "field", value)

    return (
        long(emitted, "emitted")
        .join(long(consumed, "consumed"), "field")
        .withColumn("difference", F.col("emitted") - F.col("consumed"))
    )
