"""Positions and pages inside groups that may be arbitrarily large."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, name: str = "position"
) -> DataFrame:
    """The first ``k`` rows of every group with their position. No task ever holds a group.

    Below Spark's threshold the rank filter becomes a group limit that runs before the shuffle,
    so a group sends at most ``k`` rows per input partition. From the threshold on Spark plans no
    such limit; then the rows are positioned by :func:`ranked`, which needs an ``order`` that
    names each row of a group uniquely.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k < limit:
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return df.withColumn(name, place).filter(F.col(name) <= k)
    return ranked(df, groups, order, name).filter(F.col(name) <= k)


def ranked(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Position of every row in its group, with no group ever held by one task.

    The rows are range-sorted by group and order, which splits a hot group over many tasks,
    and numbered in that order. Each task's share of a group then needs only the count of
    the shares before it, a table with at most one row per group and task. ``order`` must
    name each row of a group uniquely.
    """
    numbered = cut(
        df.sort(*[F.col(g) for g in groups], *order).withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "ranked",
    ).withColumn("_task", F.shiftright("_row", 33))

    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shares = (
        numbered.groupBy(*groups, "_task")
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        numbered.join(shares, [*groups, "_task"])
        .withColumn(name, (F.col("_row") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .drop("_row", "_task", "_first", "_before")
    )


#: Ranges that the span of scores is cut into in each round, and the rows that may be sorted at once.
RANGES, SORTED = 4096, 100_000


def page_rows(
    df: DataFrame, score: str, ties: Sequence[Column], offset: int, limit: int, name: str = "position"
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` by ``score`` descending, then ``ties``, with
    their position. Only the part that holds the page is ever sorted.

    Counts for equal ranges of scores tell which range the first and the last row of the page lie
    in; each is cut again until it has few rows or one score. At most ``RANGES`` counts reach the
    driver for each round, and a round narrows the range ``RANGES`` times, so 64-bit scores take six
    rounds at most. ``score`` is a whole number without nulls, of a span below 2**63; ``ties`` and it name each row
    uniquely. A page past the end is empty.
    """
    bounds = df.agg(F.min(score), F.max(score)).first()
    if bounds[0] is None or limit <= 0:
        return df.limit(0).withColumn(name, F.lit(0).cast("bigint"))
    low, high = int(bounds[0]), int(bounds[1])
    first = _range_of(df, score, low, high, offset)
    if first is None:
        return df.limit(0).withColumn(name, F.lit(0).cast("bigint"))
    last = _range_of(df, score, low, high, offset + limit - 1)
    least, before = last[0] if last else low, first[2]
    part = df.filter(F.col(score).between(least, first[1]))
    # Positions inside the part go through the split ranking: one score may be shared by very many.
    own = ranked(part.withColumn("_all", F.lit(0)), ["_all"], [F.desc(score), *ties], name)
    place = F.col(name) + before
    return own.drop("_all").withColumn(name, place.cast("bigint")).filter(
        (F.col(name) > offset) & (F.col(name) <= offset + limit)
    )


def _range_of(
    df: DataFrame, score: str, low: int, high: int, place: int
) -> tuple[int, int, int] | None:
    """A range of scores that holds the row at ``place`` (from 0, highest first), as its lowest and
    highest score and the number of rows above it; None past the end."""
    before = 0
    while True:
        width = -(-(high - low + 1) // RANGES)
        step = F.expr(f"({high}L - `{score}`) div {width}L")
        rows = df.filter(F.col(score).between(low, high))
        counts = sorted(rows.groupBy(step.cast("int").alias("step")).count().collect())
        ends, total = [], before
        for row in counts:
            total += row["count"]
            ends.append(total)
        at = bisect_right(ends, place)
        if at == len(ends):
            return None
        before = ends[at] - counts[at]["count"]
        top = high - counts[at]["step"] * width
        low, high = max(low, top - width + 1), top
        if low == high or counts[at]["count"] <= SORTED:
            return low, high, before


def page_bounds(
    offset: int | None, limit: int | None, default: int, cap: int | None = None
) -> tuple[int, int]:
    """Checked page arguments: negatives are refused, a missing limit is the default, a limit
    over a cap is the cap. A limit of 0 stays 0 and means everything."""
    if offset is None:
        offset = 0
    if limit is None:
        limit = default
    if offset < 0:
        raise ValueError("bad offset")
    if limit < 0:
        raise ValueError("bad limit")
    return offset, limit if cap is None else min(limit, cap)
