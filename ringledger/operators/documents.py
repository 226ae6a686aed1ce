"""Pages and series as JSON documents, one per request.

A page document holds at most the page cap of rows, a series at most its point limit, so each
list is bounded. A whole listing is not a document; export it instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.columns import id_text
from ringledger.functions.ranking import page_bounds
from ringledger.functions.workspace import cut, only
from ringledger.operators.boards import board_page
from ringledger.operators.contacts import peer_counts, peer_page
from ringledger.schema import (
    PEER_LIMIT,
    PEER_LIMIT_MAX,
    RETENTION_DAYS,
    TOP_LIMIT,
    TOP_LIMIT_MAX,
    WINDOW_SECONDS,
)


def _page(offset: int | None, limit: int | None, default: int, cap: int) -> tuple[int, int]:
    offset, limit = page_bounds(offset, limit, default, cap)
    if limit == 0:
        raise ValueError("a whole listing is not a document")
    return offset, limit


def board_document(
    name: str, entries: DataFrame, offset: int | None = None, limit: int | None = None
) -> DataFrame:
    """A page of a board with its whole count. An empty board is an empty page."""
    offset, limit = _page(offset, limit, TOP_LIMIT, TOP_LIMIT_MAX)
    entries = cut(entries.select("board", "id", "score"), "board")
    listed = board_page(entries, offset, limit).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "id", "score"))),
            lambda e: e.dropFields("position"),
        )
    )
    fields = F.struct(
        F.lit(name).alias("board"),
        F.col("count"),
        F.lit(offset).alias("offset"),
        F.lit(limit).alias("limit"),
        listed.scalar().alias("entries"),
    )
    return entries.agg(F.count("*").alias("count")).select(F.to_json(fields).alias("document"))


def peer_documents(
    links: DataFrame,
    owners: DataFrame | None = None,
    sort: str | None = None,
    offset: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A page of peers per owner: ids alone, or with weights when sorted by them. An owner in
    no link has no document; a page past the end is empty."""
    offset, limit = _page(offset, limit, PEER_LIMIT, PEER_LIMIT_MAX)
    if owners is not None:
        links = only(links, owners, "owner")
    weights = [] if sort is None else ["duration", "calls", "sms"]
    row = F.struct("position", "msisdn", *weights)
    pages = (
        peer_page(links, None, sort, offset, limit)
        .groupBy("owner")
        .agg(F.sort_array(F.collect_list(row)).alias("page"))
    )
    kind = "string" if sort is None else "struct<msisdn:string,duration:bigint,calls:bigint,sms:bigint>"
    peers = F.transform(
        "page", lambda p: p["msisdn"] if sort is None else p.dropFields("position")
    )
    fields = [
        F.col("owner").alias("msisdn"),
        F.col("count"),
        F.lit(offset).alias("offset"),
        F.lit(limit).alias("limit"),
        *([] if sort is None else [F.lit(sort).alias("sort")]),
        F.coalesce(peers, F.array().cast(f"array<{kind}>")).alias("peers"),
    ]
    return (
        peer_counts(links)
        .select(id_text("owner").alias("owner"), "count")
        .join(pages, "owner", "left")
        .select("owner", F.to_json(F.struct(*fields)).alias("document"))
    )


def series_document(points: DataFrame, metric: str, window: str, now: int) -> DataFrame:
    """A series with the window it was read for. ``points`` is a downsampled series."""
    seconds = WINDOW_SECONDS.get(window, RETENTION_DAYS * 86400)
    point = F.sort_array(F.collect_list(F.struct("ts", "value")))
    return points.agg(point.alias("points")).select(
        F.to_json(
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(window).alias("window"),
                F.lit(seconds).alias("seconds"),
                F.lit(now - seconds).alias("from"),
                F.lit(now).alias("to"),
                F.col("points"),
            )
        ).alias("document")
    )
