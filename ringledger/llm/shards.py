"""Contiguous shards of equal bytes from prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut
from ringledger.llm.rows import texts


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes and 1; null text: 1) and ``text_crc32`` (of the bytes; null text: that of no bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return texts(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def balanced(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Each row's shard: rows in the order of ``doc_id`` (nulls first), cut where the bytes before a row pass an equal target.

    Only ids, sizes and checksums move. They are dealt by ranges of the order, and rows that are
    equal in all of it are told apart by where they were read, so that a repeated row cannot fill a
    range. Each range's totals are a row; their running sums give every range its start, and sums
    within a range do the rest. A shard holds its target give or take one row. Shards may stay
    empty when there are fewer rows than shards; an empty table gives no rows. ``slot`` counts a
    shard's rows from 0 in the same order.
    """
    rows = sized(docs).withColumn("at", F.monotonically_increasing_id()).repartitionByRange("doc_id", "text_crc32", "size", "at")
    held = cut(rows.withColumn("part", F.spark_partition_id()), "shard-sizes")
    parts = cut(held.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows")), "shard-parts")
    # One row per range of the table above: a window over all of them is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = parts.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_bytes").over(whole).alias("total"))
    within = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size", "at").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.select("*", (F.sum("size").over(within) - F.col("size")).alias("bytes_here"), (F.count("*").over(within) - 1).alias("rows_here")).join(F.broadcast(starts), "part")
    placed = placed.select("doc_id", "size", "text_crc32", F.expr(f"cast((bytes_before + bytes_here) * {shards} div total as int)").alias("shard"), (F.col("rows_before") + F.col("rows_here")).alias("row"))
    placed = cut(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
