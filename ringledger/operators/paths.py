"""Shortest contact paths for a DataFrame of pairs.

Every pair is searched from both ends, one level a round, always on the side whose frontier
is narrower (the first party's when equal). The levels around an id are shared by all pairs
that start or end there. A level keeps, for each id reached, the least route to it in text
order, which is the order in which ids are discovered when each id visits its peers by text;
so the route answered and the count of discovered ids at which a search gives up are exact.

Without ``max_visited`` a search ends only at a path, at an empty level or at ``max_hops``. With it,
a search that discovers more ids gives up, so of one level only the first ``max_visited + 1``
discoveries can matter, and of one id only its first ``2 * max_visited + 2`` peers: at most
``max_visited + 1`` of them are known already, so the others alone end the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.columns import id_text
from ringledger.functions.ranking import top_per_group
from ringledger.functions.workspace import cut, fresh_path, small_side
from ringledger.schema import MAX_HOPS, MAX_VISITED

#: Owners with more peers are not held by one partition; their edges stay a table that each
#: round joins with the frontier on them, so that a skewed join can split them.
HEAVY_OWNER = 100_000

#: What is known of an undecided pair: the depth reached and the frontier width of each side,
#: and how many ids were discovered.
_STATE = ("src", "dst", "depth_a", "depth_b", "width_a", "width_b", "visited")
_TURN = ("on_a", "root", "depth", "far", "far_depth")
_FRONT = "root bigint, node bigint, route string, place bigint, depth int"

FOUND, NONE, GAVE_UP = "found", "none within hops", "gave up"


def _all_edges(links: DataFrame, max_visited: int | None) -> tuple[DataFrame, DataFrame | None]:
    """All edges a search can use, held in partitions and order of their owner, so that no
    round shuffles or sorts them again; and those of heavy owners apart, if there are any.
    With a bound on visited ids, owners with more peers than it needs are cut down first.
    Lost blocks are read again from the written table.
    """
    edges = cut(links.select("owner", "peer").filter("owner != peer"), "path-edges")
    most = HEAVY_OWNER if max_visited is None else min(HEAVY_OWNER, 2 * max_visited + 2)
    heavy = edges.groupBy("owner").count().filter(F.col("count") > most).select("owner")
    apart = None
    if not heavy.isEmpty():
        heavy = small_side(cut(heavy, "path-heavy"))
        apart = edges.join(heavy, "owner", "left_semi")
        if max_visited is not None:
            order = [id_text("peer").asc()]
            apart = top_per_group(apart, ["owner"], order, 2 * max_visited + 2).drop("position")
        apart = cut(apart, "path-edges")
        edges = edges.join(heavy, "owner", "left_anti")
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = (
        edges.repartition(partitions, "owner")
        .sortWithinPartitions("owner")
        .persist(StorageLevel.DISK_ONLY)
    )
    return held, apart


def _at_depths(fronts: DataFrame, depths: list[int], shift: int = 0) -> DataFrame:
    """Levels of the given depths only; the others are not read."""
    return fronts.filter(F.col("depth").isin([d + shift for d in depths]))


def _expand(
    fronts: DataFrame,
    turn: DataFrame,
    depths: list[int],
    edges: tuple[DataFrame, DataFrame | None],
    max_visited: int | None,
) -> DataFrame:
    """The next level of every (root, depth) whose turn it is and that has none yet: ids not
    reached before, by least route."""
    beyond = _at_depths(fronts, depths, 1).select("root", (F.col("depth") - 1).alias("depth"))
    widened = (
        _at_depths(fronts, depths)
        .join(turn.select("root", "depth"), ["root", "depth"], "left_semi")
        .join(beyond, ["root", "depth"], "left_anti")
    )
    steps = [
        widened.join(part, F.col("node") == F.col("owner")).select(
            "root",
            (F.col("depth") + 1).alias("depth"),
            F.col("peer").alias("node"),
            F.concat_ws(",", "route", id_text("peer")).alias("route"),
        )
        for part in edges
        if part is not None
    ]
    reached = (
        reduce(DataFrame.unionByName, steps)
        .groupBy("root", "depth", "node")
        .agg(F.min("route").alias("route"))
    )
    fresh = reached.join(fronts.select("root", "node"), ["root", "node"], "left_anti")
    if max_visited is None:
        return fresh.select("root", "node", "route", F.lit(0).cast("bigint").alias("place"), "depth")
    return top_per_group(
        fresh, ["root", "depth"], [F.col("route").asc()], max_visited + 1, "place"
    ).select("root", "node", "route", F.col("place").cast("bigint").alias("place"), "depth")


def _after(
    fronts: DataFrame, turn: DataFrame, depths: list[int], far: list[int], max_visited: int | None
) -> DataFrame:
    """Each pair after its turn: the width of the new level, and the first id in it that the
    other side has reached. ``outcome`` stays NULL while the pair is undecided.

    Two sides that have not met are disjoint, so they can only meet in the far side's last
    level.
    """
    near = _at_depths(fronts, depths, 1).select(
        "root", (F.col("depth") - 1).alias("depth"), "node", "route", "place"
    )
    other = _at_depths(fronts, far).select(
        F.col("root").alias("far"), F.col("depth").alias("far_depth"), "node",
        F.lit(True).alias("both"),
    )
    level = (
        turn.join(near, ["root", "depth"], "left")
        .join(other, ["far", "far_depth", "node"], "left")
        .groupBy(*_STATE, *_TURN)
        .agg(
            F.count("node").cast("int").alias("width"),
            F.min(F.when(F.col("both"), F.struct("route", "place", "node"))).alias("met"),
        )
    )
    on_a, met = F.col("on_a"), F.col("met").isNotNull()
    # Discoveries up to and including the meeting id count against the bound.
    visited = F.col("visited") + F.coalesce("met.place", "width")
    within = F.lit(True) if max_visited is None else visited <= max_visited
    return level.select(
        "src",
        "dst",
        (F.col("depth_a") + on_a.cast("int")).alias("depth_a"),
        (F.col("depth_b") + (~on_a).cast("int")).alias("depth_b"),
        F.when(on_a, F.col("width")).otherwise(F.col("width_a")).alias("width_a"),
        F.when(on_a, F.col("width_b")).otherwise(F.col("width")).alias("width_b"),
        visited.cast("bigint").alias("visited"),
        *_TURN,
        F.col("met.node").alias("met_node"),
        F.col("met.route").alias("near_route"),
        F.when(~within, GAVE_UP)
        .when(met, FOUND)
        .when(F.col("width") == 0, NONE)
        .alias("outcome"),
    )


def _routes(found: DataFrame, fronts: DataFrame) -> DataFrame:
    """Whole routes of met pairs: out to the meeting id from one side, back from the other."""
    other = fronts.select(
        F.col("root").alias("far"), F.col("depth").alias("far_depth"),
        F.col("node").alias("met_node"), F.split("route", ",").alias("far_route"),
    )
    on_a, near = F.col("on_a"), F.split("near_route", ",")
    head = F.when(on_a, near).otherwise(F.col("far_route"))
    back = F.reverse(F.when(on_a, F.col("far_route")).otherwise(near))
    return found.join(other, ["far", "far_depth", "met_node"]).select(
        "src", "dst", F.concat(head, F.slice(back, F.lit(2), F.size(back))).alias("route")
    )


def shortest_paths(
    links: DataFrame,
    pairs: DataFrame,
    max_hops: int = MAX_HOPS,
    max_visited: int | None = None,
) -> DataFrame:
    """``(src, dst, found, hops, route, outcome)`` for every distinct pair of ids.

    An id is its own path, seen or not. ``outcome`` tells a pair without a path inside
    ``max_hops`` from one whose search gave up after more than ``max_visited`` ids; neither has
    a route.
    """
    spark = pairs.sparkSession
    pairs = cut(pairs.select("src", "dst").distinct(), "path-pairs")
    edges = _all_edges(links, max_visited)
    state = pairs.filter("src != dst").select(
        "src", "dst", *[F.lit(n).alias(c) for c, n in zip(_STATE[2:6], (0, 0, 1, 1))],
        F.lit(0).cast("bigint").alias("visited"),
    )

    # All levels of all roots are one table by depth that grows by one write a round.
    path = fresh_path(spark, "path-fronts")
    start = (
        state.select(F.explode(F.array("src", "dst")).alias("root"))
        .distinct()
        .select(
            "root",
            F.col("root").alias("node"),
            id_text("root").alias("route"),
            F.lit(1).cast("bigint").alias("place"),
            F.lit(0).alias("depth"),
        )
    )
    start.write.partitionBy("depth").parquet(path)
    fronts = spark.read.schema(_FRONT).parquet(path)

    rounds: list[DataFrame] = []
    for _ in range(max_hops):
        on_a = F.col("width_a") <= F.col("width_b")
        turn = state.select(
            *_STATE,
            on_a.alias("on_a"),
            F.when(on_a, F.col("src")).otherwise(F.col("dst")).alias("root"),
            F.when(on_a, F.col("depth_a")).otherwise(F.col("depth_b")).alias("depth"),
            F.when(on_a, F.col("dst")).otherwise(F.col("src")).alias("far"),
            F.when(on_a, F.col("depth_b")).otherwise(F.col("depth_a")).alias("far_depth"),
        )
        # At most max_hops of each.
        seen = turn.agg(F.collect_set("depth"), F.collect_set("far_depth")).first()
        near, far = sorted(seen[0]), sorted(seen[1])
        if not near:
            break
        level = _expand(fronts, turn, near, edges, max_visited)
        level.write.mode("append").partitionBy("depth").parquet(path)
        fronts = spark.read.schema(_FRONT).parquet(path)
        rounds.append(cut(_after(fronts, turn, near, far, max_visited), "path-state"))
        state = rounds[-1].filter(F.col("outcome").isNull()).select(*_STATE)
    edges[0].unpersist()

    same = pairs.filter("src = dst").select("src", "dst", F.array(id_text("src")).alias("route"))
    routes = same
    gave_up = None
    if rounds:
        every = reduce(DataFrame.unionByName, rounds)
        routes = same.unionByName(_routes(every.filter(F.col("outcome") == FOUND), fronts))
        gave_up = every.filter(F.col("outcome") == GAVE_UP).select("src", "dst", "outcome")
    answer = pairs.join(routes, ["src", "dst"], "left")
    if max_visited is None or gave_up is None:
        answer = answer.withColumn("outcome", F.lit(None).cast("string"))
    else:
        answer = answer.join(gave_up, ["src", "dst"], "left")
    found = F.col("route").isNotNull()
    return answer.select(
        "src",
        "dst",
        found.alias("found"),
        F.when(found, F.size("route") - 1).alias("hops"),
        "route",
        F.when(found, F.lit(FOUND)).otherwise(F.coalesce("outcome", F.lit(NONE))).alias("outcome"),
    )


def path_hops(paths: DataFrame, links: DataFrame) -> DataFrame:
    """One row per hop of every found path with what the link carried, zeros where nothing."""
    hops = cut(
        paths.filter("found").select(
            "src",
            "dst",
            F.posexplode(
                F.arrays_zip(
                    F.slice("route", F.lit(1), F.size("route") - 1).alias("from"),
                    F.slice("route", F.lit(2), F.size("route")).alias("to"),
                )
            ).alias("hop", "step"),
        )
        .select("src", "dst", "hop", F.col("step.from"), F.col("step.to")),
        "path-hops",
    )
    ends = hops.select(
        F.col("from").cast("bigint").alias("owner"), F.col("to").cast("bigint").alias("peer")
    ).distinct()
    carried = links.join(small_side(ends), ["owner", "peer"]).select(
        id_text("owner").alias("from"), id_text("peer").alias("to"), "dur", "cnt", "sms"
    )
    zero = F.lit(0).cast("bigint")
    return hops.join(carried, ["from", "to"], "left").select(
        "src", "dst", F.col("hop").cast("int").alias("hop"), "from", "to",
        F.coalesce("dur", zero).alias("duration"),
        F.coalesce("cnt", zero).alias("calls"),
        F.coalesce("sms", zero).alias("sms"),
    )


def path_documents(
    paths: DataFrame,
    hops: DataFrame | None = None,
    max_hops: int = MAX_HOPS,
    max_visited: int = MAX_VISITED,
) -> DataFrame:
    """The answer of each pair: its route and, when given, the weights of its hops; or the
    bounds inside which none was found. A route has at most ``max_hops`` hops."""
    rows = paths
    if hops is not None:
        weights = hops.groupBy("src", "dst").agg(
            F.sort_array(
                F.collect_list(F.struct("hop", "from", "to", "duration", "calls", "sms"))
            ).alias("carried")
        )
        rows = paths.join(weights, ["src", "dst"], "left").withColumn(
            "carried",
            F.when(
                F.col("found"),
                F.coalesce(
                    F.transform("carried", lambda h: h.dropFields("hop")),
                    F.array().cast(
                        "array<struct<from:string,to:string,duration:bigint,calls:bigint,"
                        "sms:bigint>>"
                    ),
                ),
            ),
        )
    lost = ~F.col("found")
    fields = [
        F.when(lost, F.lit("path not found")).alias("error"),
        F.when(lost, F.lit(max_hops)).alias("max-hops"),
        F.when(lost, F.lit(max_visited)).alias("max-visited"),
        F.col("route").alias("path"),
    ]
    if hops is not None:
        fields.append(F.col("carried").alias("hops"))
    return rows.select("src", "dst", "found", F.to_json(F.struct(*fields)).alias("document"))
