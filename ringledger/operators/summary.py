"""Sums, ratios and shares that the dashboards show, from counters and totals.

Totals are a single row, so what is read against them takes them as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions.columns import plus, ratio
from ringledger.schema import RATIO_METRICS, SUM_METRICS, USAGE_BANDS


def sum_metric(name: str) -> Column:
    return plus(SUM_METRICS[name])


def ratio_metric(name: str) -> Column:
    top, bottom = RATIO_METRICS[name]
    return ratio(plus(top), plus(bottom))


def dashboard_sums(rows: DataFrame) -> DataFrame:
    """Calls, messages, data volume and failed attempts of totals or sample rows."""
    return rows.select(*[sum_metric(name).alias(name) for name in SUM_METRICS])


def dashboard_ratios(rows: DataFrame) -> DataFrame:
    """Failure share and average durations, NULL where nothing was counted."""
    return rows.select(*[ratio_metric(name).alias(name) for name in RATIO_METRICS])


def usage_mix(totals: DataFrame) -> DataFrame:
    """Share of each usage count. No rows while nothing is counted."""
    total = plus(USAGE_BANDS)
    bands = [
        F.struct(
            F.lit(label).alias("usage"),
            F.col(name).alias("value"),
            ratio(F.col(name), total).alias("share"),
        )
        for name, label in USAGE_BANDS.items()
    ]
    return (
        totals.filter(total > 0)
        .select(F.explode(F.array(*bands)).alias("band"))
        .select("band.*")
    )


def operator_share(operators: DataFrame, totals: DataFrame) -> DataFrame:
    """Each operator's call seconds against all call seconds."""
    every = totals.select(F.col("moc_dur") + F.col("mtc_dur")).scalar()
    voice = F.col("voice_out") + F.col("voice_in")
    return operators.select("mccmnc", voice.alias("voice"), ratio(voice, every).alias("share"))


def failure_against_store(subscribers: DataFrame, totals: DataFrame) -> DataFrame:
    """Failed attempts of each subscriber beside the failure share of all records."""
    store_share = totals.select(ratio_metric("fail-share")).scalar()
    return subscribers.select(
        "msisdn",
        (F.col("noans") + F.col("busy") + F.col("failed")).alias("failures"),
        store_share.alias("store_failure_share"),
        (F.col("voice_out") + F.col("voice_in")).alias("voice"),
    )
