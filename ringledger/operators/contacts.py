"""Peer lists of contact owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions.columns import id_text, ratio
from ringledger.functions.ranking import page_bounds, ranked, top_per_group
from ringledger.functions.workspace import cut, only, small_side
from ringledger.operators.boards import board_page
from ringledger.schema import PEER_LIMIT


def peer_order(sort: str | None) -> list[Column]:
    """Heaviest first by seconds or messages, ties by the other, then by id text; without a
    sort by id text alone."""
    name = id_text("peer")
    if sort is None:
        return [name.asc()]
    if sort == "dur":
        return [F.desc("dur"), F.desc("sms"), name.asc()]
    if sort == "sms":
        return [F.desc("sms"), F.desc("dur"), name.asc()]
    raise ValueError("bad sort")


def peer_counts(links: DataFrame) -> DataFrame:
    """Distinct peers of every owner. Links hold each peer once."""
    return links.groupBy("owner").agg(F.count("*").alias("count"))


def peer_page(
    links: DataFrame,
    owners: DataFrame | None = None,
    sort: str | None = None,
    offset: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A page of the peer list of every owner asked for, with position and whole count.

    A short page takes at most ``offset + limit`` rows per owner from each input partition, so
    an owner with a large share of all links costs no more than others. Long pages, and a limit
    of 0, which lists everything, take the split ranking. No limit is made smaller.
    """
    offset, limit = page_bounds(offset, limit, PEER_LIMIT)
    order = peer_order(sort)
    if owners is not None:
        links = only(links, owners, "owner")
    if limit == 0:
        rows = ranked(links, ["owner"], order)
    else:
        rows = top_per_group(links, ["owner"], order, offset + limit)
    page = rows.filter(F.col("position") > offset).join(peer_counts(links), "owner")
    weights = (
        []
        if sort is None
        else [F.col("dur").alias("duration"), F.col("cnt").alias("calls"), F.col("sms")]
    )
    return page.select(
        id_text("owner").alias("owner"),
        F.col("count"),
        F.col("position").cast("bigint").alias("position"),
        id_text("peer").alias("msisdn"),
        *weights,
    )


def heaviest_peers(links: DataFrame, k: int, sort: str = "dur") -> DataFrame:
    """The ``k`` heaviest peers of every owner in hand, with ``position``."""
    return top_per_group(links, ["owner"], peer_order(sort), k)


def average_call(links: DataFrame) -> DataFrame:
    """Seconds per call of every link, NULL without calls."""
    return links.select(
        "owner", "peer", "dur", "cnt", ratio(F.col("dur"), F.col("cnt")).alias("average_call")
    )


def voice_per_peer(subscribers: DataFrame, links: DataFrame) -> DataFrame:
    """Call seconds of a subscriber spread over its peers. Subscribers in no link, or without
    call seconds, have none."""
    voice = F.col("voice_out") + F.col("voice_in")
    return (
        subscribers.select("msisdn", voice.alias("voice"))
        .filter("voice > 0")
        .join(peer_counts(links).withColumnRenamed("owner", "msisdn"), "msisdn")
        .select(
            "msisdn", "voice", F.col("count").alias("peers"),
            ratio(F.col("voice"), F.col("count")).alias("voice_per_peer"),
        )
    )


def suggestions(entries: DataFrame, links: DataFrame, k: int, sort: str = "dur") -> DataFrame:
    """The first ``k`` of a board, each with its heaviest peer. An entry in no link has none."""
    page = small_side(cut(board_page(entries, 0, k), "page"))
    wanted = page.select(F.col("id").cast("bigint").alias("owner"))
    first = heaviest_peers(only(links, wanted, "owner"), 1, sort).select(
        id_text("owner").alias("id"), id_text("peer").alias("peer")
    )
    return page.join(first, "id", "left").select("position", "id", "score", "peer")
