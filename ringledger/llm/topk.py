"""Exact top k by inner product, reading sorted lists only in order.

Each dimension of a block of vectors is a list sorted by value. A query reads a list from its top where
its own component is positive and from its bottom where it is negative, all lists to the same depth,
and never looks an entry up. What it has read of a vector plus the worst that can be left is the
vector's lower bound; with the last value read in place of each missing one it is the upper bound.
Vectors whose upper bound stays under the k-th best lower bound cannot qualify. A query reads on, each time
half of what is unread, until all but k vectors cannot qualify or its lists end; then the final scores
of those left are resolved.

For a block of queries both bounds are matrix products: the lists read to one depth give two matrices
of the block's vectors, one for positive and one for negative components. Once few vectors are left to a
query, only theirs are worked out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries of a block: what a task holds is bounded by these.
ROWS, QUERIES = 4096, 1024

#: Blocks of vectors that one task goes through for a block of queries.
SPAN = 8

#: The share of a block's pairs from which on bounds are worked out for all pairs at once; either way gives the same bounds.
DENSE = 0.125


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """``vec_id`` and ``x``, each component as floor(factor * x) with x as double.

    Vectors that are null or empty, or hold a null or non-finite component, are left out, as are null
    ids. Scores are exact as long as the sums stay below 2**53.
    """
    finite = F.expr("not exists(embedding, v -> v is null or isnan(v) or abs(cast(v as double)) = double('infinity'))")
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return found.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * factor).cast("double")).alias("x"))


def _best(ids: np.ndarray, own: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, then the smaller checksum."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((own[some], ids[some], -scores[some]))[:k]]


class Block:
    """The sorted lists of some vectors, all of one width."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray | None = None):
        self.ids, self.x, self.own = ids, x, np.zeros(len(ids), np.int64) if own is None else own
        self.order = np.argsort(x, axis=0, kind="stable")
        self.place = np.argsort(self.order, axis=0, kind="stable")

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is known after ``depth`` entries of each list: lower and upper values, from the top and from the bottom."""
        n, width = self.x.shape
        at = np.arange(width)
        top, bottom = self.place >= n - depth, self.place < depth
        least, most = self.x[self.order[0], at], self.x[self.order[-1], at]
        return (
            np.where(top, self.x, least), np.where(top, self.x, self.x[self.order[n - depth], at]),
            np.where(bottom, self.x, most), np.where(bottom, self.x, self.x[self.order[depth - 1], at]),
        )

    def survivors(self, left: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
        """How deep each query read; of ``left`` (queries by vectors) stays what can still qualify."""
        n = len(self.ids)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        low, depths = floor.copy(), np.zeros(len(queries), np.int64)
        depth, open_ = max(1, n // 2), np.flatnonzero(left.sum(axis=1) > 0)
        while len(open_):
            top_low, top_high, bottom_low, bottom_high = self.read(depth)
            depths[open_] = depth
            if left[open_].mean() >= DENSE:
                lower = up[open_] @ top_low.T + down[open_] @ bottom_low.T
                lower[~left[open_]] = -np.inf
                if n >= k:
                    low[open_] = np.maximum(low[open_], np.partition(lower, n - k, axis=1)[:, n - k])
                left[open_] &= up[open_] @ top_high.T + down[open_] @ bottom_high.T >= low[open_, None]
            else:
                for q in open_:
                    some = np.flatnonzero(left[q])
                    lower = top_low[some] @ up[q] + bottom_low[some] @ down[q]
                    if len(some) >= k:
                        low[q] = max(low[q], np.partition(lower, len(some) - k)[len(some) - k])
                    left[q, some] = top_high[some] @ up[q] + bottom_high[some] @ down[q] >= low[q]
            if depth == n:
                break
            open_ = open_[left[open_].sum(axis=1) > k]
            depth = n - (n - depth) // 2
        return depths

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, query_own: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of its k best here; ``floor`` has scores below which none counts."""
        query_own = np.zeros(len(query_ids), np.int64) if query_own is None else query_own
        left = (query_ids[:, None] != self.ids[None, :]) | (query_own[:, None] != self.own[None, :])
        self.survivors(left, queries, k, floor)
        out = []
        for q, row in enumerate(left):
            some = np.flatnonzero(row)
            found = self.x[some] @ queries[q]
            best = _best(self.ids[some], self.own[some], found, k)
            out.append((some[best], found[best]))
        return out


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows of equal width: ``name``, ``width``, arrays of ids, checksums and values.

    Repeated rows are one. Rows are dealt by a hash of id and vector, so that no id fills a block.
    """
    widths = rows.select("vec_id", "x").distinct().withColumn("width", F.size("x")).withColumn("own", F.xxhash64("x"))
    # One row for each width of vector in the table.
    counts = widths.groupBy("width").agg(F.count("*").alias("n"))
    dealt = widths.join(F.broadcast(counts), "width").withColumn(name, F.pmod(F.xxhash64("vec_id", "own"), F.ceil(F.col("n") / size)).cast("int"))
    held = dealt.groupBy("width", name).agg(F.sort_array(F.collect_list(F.struct("vec_id", "own", "x"))).alias("rows"))
    return held.select("width", name, F.col("rows.vec_id").alias("ids"), F.col("rows.own").alias("own"), F.flatten("rows.x").alias("values"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: each query's k highest inner products over ``vectors``.

    Both tables have ``vec_id`` and ``x`` (whole numbers as doubles). A query's own row is no candidate.
    Rows that agree in id and vector are one row; different vectors of one id are candidates, and queries,
    of their own, each with its own ranks. Ties go to the smaller id, then to the smaller checksum of the vector; fewer candidates than k give fewer rows; vectors of another width are not
    compared. Every block of queries meets every span of vector blocks in one task, which holds one
    block of each; the k best of each span are merged by query.
    """
    held = _blocks(vectors, rows, "block").withColumn("span", F.floor(F.col("block") / SPAN).cast("int"))
    asked = _blocks(queries, block, "group")
    # The queries are a stated set, met in blocks: each vector block is sent to each query block once.
    groups = asked.groupBy("width").agg(F.max("group").alias("last"))
    left = held.join(F.broadcast(groups), "width").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("last")))).select("width", "group", "span", "ids", "own", "values")
    spans = held.groupBy("width").agg(F.max("span").alias("last"))
    right = asked.join(F.broadcast(spans), "width").withColumn("span", F.explode(F.sequence(F.lit(0), F.col("last")))).select("width", "group", "span", "ids", "own", "values")

    return _answered(left, right, k)


def _answered(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    columns = ("query_id", "query_own", "vec_id", "own", "score")

    def task(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: np.array([], np.int64) for c in columns})
        if not len(candidates) or not len(queries):
            return empty
        width = int(key[0])
        query_ids, query_own = (np.asarray(queries[c].iloc[0], np.int64) for c in ("ids", "own"))
        x = np.asarray(queries["values"].iloc[0], np.float64).reshape(-1, width)
        best = [(np.array([], np.int64), np.array([], np.int64), np.array([])) for _ in query_ids]
        floor = np.full(len(query_ids), -np.inf)
        for ids, own, values in zip(candidates["ids"], candidates["own"], candidates["values"], strict=True):
            block = Block(np.asarray(ids, np.int64), np.asarray(values, np.float64).reshape(-1, width), np.asarray(own, np.int64))
            for q, (places, scores) in enumerate(block.answer(query_ids, x, k, floor, query_own)):
                every = tuple(np.append(a, b) for a, b in zip(best[q], (block.ids[places], block.own[places], scores), strict=True))
                some = _best(*every, k)
                best[q] = tuple(a[some] for a in every)
                if len(some) == k:
                    floor[q] = best[q][2][-1]
        counts = [len(b[0]) for b in best]
        if not sum(counts):
            return empty
        found = (np.repeat(query_ids, counts), np.repeat(query_own, counts), *(np.concatenate([b[n] for b in best]).astype(np.int64) for n in range(3)))
        return pd.DataFrame(dict(zip(columns, found, strict=True)))

    keys = ["width", "group", "span"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, ", ".join(f"{c} long" for c in columns))
    # Fewer than 1000 a query, so each task drops all but its own k before the shuffle.
    order = Window.partitionBy("query_id", "query_own").orderBy(F.desc("score"), "vec_id", "own")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_twentieth(vectors: DataFrame, k: int = 20) -> DataFrame:
    """The k best of every vector whose id is divisible by 20."""
    rows = quantised(vectors)
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k)
