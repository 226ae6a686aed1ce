"""The ``events`` table read as call records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one record. The mapping gives each usage code its share, some records
    no subscriber, no peer, no operator, or the subscriber itself as peer."""
    slot = F.col("event_id") % 100
    usage = (
        F.when(slot < 20, "MOC").when(slot < 40, "MTC").when(slot < 52, "SMS-MO")
        .when(slot < 64, "SMS-MT").when(slot < 94, "D").when(slot < 97, "U")
        .when(slot < 99, "B").otherwise("X")
    )
    user = F.col("user_id")
    turn = user % 5
    operator = (
        F.when(turn == 0, 42502).when(turn == 1, 26204).when(turn == 2, 31026)
        .when(turn == 3, 20801).otherwise(99999).cast("bigint")
    )
    number = F.lit(972500000000) + user
    zero = F.lit(0).cast("bigint")
    is_data = F.col("usage") == "D"
    return (
        events(spark, sf_dir)
        .withColumn("usage", usage)
        .select(
            F.lit("events").alias("source"),
            (F.col("event_id") + 1).cast("decimal(20,0)").alias("sequence"),
            F.when(user % 50 == 49, user)
            .otherwise(operator * 10000000000 + user)
            .alias("imsi"),
            F.lit("").alias("imei"),
            "usage",
            F.when(F.col("event_id") % 97 == 0, zero).otherwise(number).alias("msisdn"),
            F.col("ts").alias("call_time"),
            F.when(F.col("usage").isin("MOC", "MTC", "D"), F.floor("value").cast("bigint"))
            .otherwise(zero)
            .alias("duration"),
            F.when(is_data, F.floor(F.col("value") * 100).cast("bigint"))
            .otherwise(zero)
            .alias("bytes_rx"),
            F.when(is_data, F.col("event_id") % 1000 * 15).otherwise(zero).alias("bytes_tx"),
            zero.alias("peer_imsi"),
            F.when(is_data | (F.col("event_id") % 53 == 0), zero)
            .when(F.col("event_id") % 101 == 0, number)
            .otherwise(number + 1 + F.col("event_id") % 3)
            .alias("peer_msisdn"),
        )
    )
