"""Contact graph around subscribers, for many seeds at once.

Each step expands one id of every seed's graph by its heaviest peers, heaviest first, until
the graph is full. All groups are bounded by the expand limit and the node cap, which are
what the graph is asked to show.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringledger.functions.columns import id_text
from ringledger.functions.workspace import cut, only, small_side
from ringledger.operators.contacts import heaviest_peers, peer_counts
from ringledger.schema import EXPAND_LIMIT, MAX_NODES


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _merged_nodes(parts: list[DataFrame]) -> DataFrame:
    return (
        _union(parts)
        .groupBy("seed", "id")
        .agg(
            F.max("expanded").alias("expanded"),
            F.max("shown").alias("shown"),
            F.max("total").alias("total"),
        )
    )


def ego_network(
    links: DataFrame,
    picks: DataFrame,
    steps: int,
    sort: str = "dur",
    limit: int = EXPAND_LIMIT,
    max_nodes: int = MAX_NODES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and refusals of the graph around every seed.

    ``picks`` is (seed, step, id): the id expanded at each step, one per seed and step; step 0
    is the seed itself. A pick in no link changes nothing, and after step 0 a full graph
    refuses picks. ``nodes`` is (seed, id, expanded, shown, total), ``edges`` (seed, a, b,
    duration, calls, sms) once per unordered pair, ``refused`` (seed, step, refused) counts
    peers left off because the graph was full.
    """
    picks = cut(picks.select("seed", "step", "id"), "ego-picks")
    asked = only(links, picks.select(F.col("id").alias("owner")), "owner")
    top = heaviest_peers(asked, limit, sort)
    shown = top.groupBy("owner").agg(F.count("*").alias("shown"))
    answers = cut(
        top.join(shown, "owner").join(
            peer_counts(asked).withColumnRenamed("count", "total"), "owner"
        ),
        "ego-answers",
    )

    nodes: DataFrame | None = None
    edges: list[DataFrame] = []
    refusals: list[DataFrame] = []
    for step in range(steps):
        picked = picks.filter(F.col("step") == step).select("seed", F.col("id").alias("owner"))
        if nodes is not None:
            sizes = nodes.groupBy("seed").agg(F.count("*").alias("size"))
            picked = picked.join(sizes, "seed", "left").filter(
                F.coalesce("size", F.lit(0)) < max_nodes
            ).select("seed", "owner")
        pulled = picked.join(answers, "owner")

        centre = pulled.filter("position = 1").select(
            "seed", F.col("owner").alias("id"), F.lit(True).alias("expanded"), "shown", "total"
        )
        before = centre if nodes is None else _merged_nodes([nodes, centre])
        size = before.groupBy("seed").agg(F.count("*").alias("size"))
        known = before.select("seed", F.col("id").alias("peer"), F.lit(True).alias("known"))
        arrival = F.sum(F.when(F.col("known"), 0).otherwise(1)).over(
            Window.partitionBy("seed").orderBy("position").rowsBetween(
                Window.unboundedPreceding, 0
            )
        )
        placed = cut(
            pulled.join(known, ["seed", "peer"], "left")
            .withColumn("known", F.coalesce("known", F.lit(False)))
            .withColumn("arrival", arrival)
            .join(size, "seed")
            .withColumn(
                "kept", F.col("known") | (F.col("arrival") + F.col("size") <= max_nodes)
            ),
            "ego-step",
        )
        added = placed.filter("kept AND NOT known").select(
            "seed",
            F.col("peer").alias("id"),
            F.lit(False).alias("expanded"),
            F.lit(0).cast("bigint").alias("shown"),
            F.lit(0).cast("bigint").alias("total"),
        )
        nodes = _merged_nodes([before, added])
        if step + 1 < steps:
            nodes = cut(nodes, "ego-nodes")
        edges.append(
            placed.filter("kept").select(
                "seed",
                F.least(id_text("owner"), id_text("peer")).alias("a"),
                F.greatest(id_text("owner"), id_text("peer")).alias("b"),
                F.col("dur").alias("duration"),
                F.col("cnt").alias("calls"),
                "sms",
            )
        )
        refusals.append(
            placed.filter("NOT kept")
            .groupBy("seed")
            .agg(F.count("*").alias("refused"))
            .select("seed", F.lit(step).alias("step"), "refused")
        )

    unique = _union(edges).groupBy("seed", "a", "b").agg(
        *[F.max(c).alias(c) for c in ("duration", "calls", "sms")]
    )
    listed = nodes.select("seed", id_text("id").alias("id"), "expanded", "shown", "total")
    return listed, unique, _union(refusals)


def node_strength(edges: DataFrame, sort: str = "dur") -> DataFrame:
    """Sum of the known edges of each node. An edge counts at both of its ends."""
    weight = "sms" if sort == "sms" else "duration"
    return (
        edges.select("seed", F.explode(F.array("a", "b")).alias("id"), weight)
        .groupBy("seed", "id")
        .agg(F.sum(weight).alias("strength"))
    )


def remove_nodes(
    nodes: DataFrame, edges: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The graph without the given (seed, id) rows and without the edges that touch them."""
    gone = small_side(removed.select("seed", "id").distinct())
    left = edges.join(gone.withColumnRenamed("id", "a"), ["seed", "a"], "left_anti").join(
        gone.withColumnRenamed("id", "b"), ["seed", "b"], "left_anti"
    )
    return nodes.join(gone, ["seed", "id"], "left_anti"), left.select(edges.columns)


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per seed. A graph holds at most the node cap and, per expansion, the
    expand limit of edges, so each list is bounded."""
    listed = nodes.groupBy("seed").agg(
        F.sort_array(F.collect_list(F.struct("id", "expanded", "shown", "total"))).alias("nodes")
    )
    linked = edges.groupBy("seed").agg(
        F.sort_array(F.collect_list(F.struct("a", "b", "duration", "calls", "sms"))).alias("edges")
    )
    return listed.join(linked, "seed", "left").select(
        "seed",
        F.to_json(F.struct(id_text("seed").alias("centre"), "nodes", "edges")).alias("document"),
    )
