"""Leaderboards: views over the counters, never stored, so they cannot drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringledger.functions.columns import id_text, plus, ratio
from ringledger.functions.ranking import page_bounds, page_rows, ranked
from ringledger.functions.workspace import cut
from ringledger.schema import OPERATOR_BOARDS, SUBSCRIBER_BOARDS, TOP_LIMIT, TOP_LIMIT_MAX


def board(name: str, subscribers: DataFrame, operators: DataFrame) -> DataFrame:
    """One board as (board, id, score). Zero scores are not on it."""
    if name in SUBSCRIBER_BOARDS:
        table, key, counters = subscribers, "msisdn", SUBSCRIBER_BOARDS[name]
    elif name in OPERATOR_BOARDS:
        table, key, counters = operators, "mccmnc", OPERATOR_BOARDS[name]
    else:
        raise ValueError(f"no such board: {name}")
    return table.select(
        F.lit(name).alias("board"), id_text(key).alias("id"), plus(counters).alias("score")
    ).filter("score > 0")


def all_boards(subscribers: DataFrame, operators: DataFrame) -> DataFrame:
    """All six boards; each counter table is read once."""

    def spread(table: DataFrame, key: str, boards: dict) -> DataFrame:
        entries = [
            F.struct(F.lit(name).alias("board"), plus(counters).alias("score"))
            for name, counters in boards.items()
        ]
        return (
            table.select(id_text(key).alias("id"), F.explode(F.array(*entries)).alias("e"))
            .select("e.board", "id", "e.score")
            .filter("score > 0")
        )

    return spread(subscribers, "msisdn", SUBSCRIBER_BOARDS).unionByName(
        spread(operators, "mccmnc", OPERATOR_BOARDS)
    )


_ORDER = ("score", "id")


def board_page(
    entries: DataFrame, offset: int | None = None, limit: int | None = None
) -> DataFrame:
    """A page of one board with positions: score, then id text, both descending.

    A limit of 0 is the rest of the board; positions then come from the split ranking of all of
    it. Long and deep pages find the scores that hold them by counts and rank only these.
    """
    offset, limit = page_bounds(offset, limit, TOP_LIMIT)
    descending = [F.desc(c) for c in _ORDER]
    if limit == 0:
        rows = board_positions(entries).filter(F.col("position") > offset)
        return rows.select("position", "id", "score")
    if offset + limit > TOP_LIMIT_MAX:
        held = cut(entries, "board")
        return page_rows(held, "score", [F.desc("id")], offset, limit).select("position", "id", "score")
    page = entries.orderBy(*descending).offset(offset).limit(limit)
    place = F.row_number().over(Window.partitionBy("board").orderBy(*descending))
    return page.select((place + offset).cast("bigint").alias("position"), "id", "score")


def board_count(entries: DataFrame) -> DataFrame:
    """How many entries a board has in all."""
    return entries.agg(F.count("*").alias("count"))


def leader_share(page: DataFrame) -> DataFrame:
    """Each entry of a page against the first entry of that page, its highest score."""
    page = cut(page, "page")
    leader = page.agg(F.max("score")).scalar()
    return page.withColumn("of_leader", ratio(F.col("score"), leader))


def board_positions(entries: DataFrame) -> DataFrame:
    """Position of every entry of every board in hand."""
    return ranked(entries, ["board"], [F.desc(c) for c in _ORDER])
