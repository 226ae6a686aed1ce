"""Packing token sequences: best fit over run lengths, in a sequential pass of the driver.

Pieces and gaps are whole numbers up to the sequence length, so both sorted lists are held as runs of
equal values: at most ``limit`` runs of pieces, however many pieces there are. A step takes the
longest run left, sweeps its successors among the sorted gaps, gives each gap of the smallest fitting
run as many pieces as go in, and puts the changed gaps back in order; pieces that no gap holds open
new sequences. Which piece of a run gets which gap follows from its rank alone, so no two pieces ask
for the same one. Spark finds the ranks (counts per task and length, then prefix sums) and places
every piece by a join of its rank with the steps' ranges.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut
from ringledger.llm.bpe import worker_codec
from ringledger.llm.rows import batches, map_arrow, texts
from ringledger.llm.tokens import default_vocabulary, packed

#: Sequences hold so many tokens.
LIMIT = 2048

#: Text encoded at once: the more, the fewer chunks come anew and the fewer passes over the merges.
ENCODED_BYTES = 8 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, separator: int = 0) -> DataFrame:
    """Token pieces of every text: its ids and then ``separator``, cut every ``limit`` ids.

    A null text counts as empty: one piece that is the separator. ``part`` is the task and ``nth``
    the piece's number among those of its length there.
    """
    path, end = vocabulary or default_vocabulary(), packed([separator])

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, counts = worker_codec(path), TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch, values in batches(found, ENCODED_BYTES):
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), codec.encode(values), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at : at + 4 * limit]
                    n = len(own) // 4
                    for column, value in zip(out, (doc, k, at // 4, n, zlib.crc32(own), part, counts[n]), strict=True):
                        column.append(value)
                    counts[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return map_arrow(texts(docs), lambda: task, PIECES)


def best_fit(runs: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: ``(length, first rank, end rank, first sequence, per sequence, offset)``.

    ``runs`` has the number of pieces of each length. The pieces of a row lie in consecutive
    sequences, ``per sequence`` in each, one after the other from ``offset`` on.
    """
    placed: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def put_back(gap: int, first: int, count: int) -> None:
        if not gap or not count:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((first, count))

    for length in sorted(runs, reverse=True):
        left, rank = runs[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                each = limit // length
                gap, first, count = limit, opened, -(-left // each)
                opened += count
            each = gap // length
            full = min(count, left // each)
            if full:
                placed.append((length, rank, rank + full * each, first, each, limit - gap))
                rank, left = rank + full * each, left - full * each
                put_back(gap - each * length, first, full)
            if full < count:
                if 0 < left < each:
                    placed.append((length, rank, rank + left, first + full, left, limit - gap))
                    put_back(gap - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                put_back(gap, first + full, count - full)
    return placed


PLAN = "length long, from long, until long, first long, each long, base long"


def pack(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``found`` (columns of :func:`pieces`, lengths from 1 to ``limit``) with ``sequence_id`` and ``offset``.

    Repeated rows and ids are pieces like any others. An empty table gives no rows.
    """
    spark = found.sparkSession
    held = cut(found, "pieces")
    counts = cut(held.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # One row for each length at most, so 2048 by default.
    runs = {int(x[0]): int(x[1]) for x in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = spark.createDataFrame(best_fit(runs, limit), PLAN).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from", "until", "first", "each", "base"))).alias("rows"))
    ranked = held.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(plan), "length").withColumn("row", F.expr("filter(rows, x -> rank >= x.from and rank < x.until)[0]"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("row.first + (rank - row.from) div row.each").alias("sequence_id"),
        F.expr("row.base + (rank - row.from) % row.each * length").alias("offset"),
    )


def packed_documents(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces with their sequence and place in it; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, limit, vocabulary), limit)
