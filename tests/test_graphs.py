"""Paths and contact graphs against plain breadth-first searches in Python."""

import json
import random

import pytest

from ringledger.operators import ego, paths

LINKS = "owner bigint, peer bigint, dur bigint, sms bigint, cnt bigint"


def graph_df(spark, edges):
    rows = []
    for (a, b), (dur, sms, cnt) in edges.items():
        rows.append((a, b, dur, sms, cnt))
        if a != b:
            rows.append((b, a, dur, sms, cnt))
    return spark.createDataFrame(rows, LINKS)


def adjacency(edges):
    out = {}
    for a, b in edges:
        out.setdefault(str(a), set()).add(str(b))
        out.setdefault(str(b), set()).add(str(a))
    return out


def search(peers, src, dst, max_hops=6, max_visited=10_000):
    """The search the answers must equal: two sides, the narrower one widened each round, ids
    discovered one by one with peers by text, given up once too many are discovered."""
    if src == dst:
        return [src]
    trails, fronts, visited = ({src: None}, {dst: None}), ([src], [dst]), 0
    for _ in range(max_hops):
        side = 0 if len(fronts[0]) <= len(fronts[1]) else 1
        found = []
        for node in fronts[side]:
            for peer in sorted(peers.get(node, ())):
                if peer in trails[side]:
                    continue
                visited += 1
                if visited > max_visited:
                    return None
                trails[side][peer] = node
                if peer in trails[1 - side]:
                    head, tail, at = [], [], peer
                    while at is not None:
                        head.append(at)
                        at = trails[0][at]
                    at = trails[1][peer]
                    while at is not None:
                        tail.append(at)
                        at = trails[1][at]
                    return head[::-1] + tail
                found.append(peer)
        fronts = (found, fronts[1]) if side == 0 else (fronts[0], found)
        if not found:
            return None
    return None


def routes(spark, links, pairs, **bounds):
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    out = {}
    for row in paths.shortest_paths(links, df, **bounds).collect():
        assert row.found == (row.route is not None)
        assert row.hops == (len(row.route) - 1 if row.found else None)
        assert (row.outcome == paths.FOUND) == row.found
        assert row.outcome != paths.GAVE_UP or bounds.get("max_visited") is not None
        out[(row.src, row.dst)] = row.route
    return out


CHAIN = {(1, 2): (60, 3, 2), (2, 3): (90, 5, 4)}


def test_chain_with_weights(spark):
    links = graph_df(spark, CHAIN)
    pairs = spark.createDataFrame([(1, 3), (9, 9), (1, 9)], "src bigint, dst bigint")
    found = paths.shortest_paths(links, pairs)
    hops = paths.path_hops(found, links)
    documents = {
        (r.src, r.dst): json.loads(r.document)
        for r in paths.path_documents(found, hops).collect()
    }
    assert documents[(1, 3)] == {
        "path": ["1", "2", "3"],
        "hops": [
            {"from": "1", "to": "2", "duration": 60, "calls": 2, "sms": 3},
            {"from": "2", "to": "3", "duration": 90, "calls": 4, "sms": 5},
        ],
    }
    assert documents[(9, 9)] == {"path": ["9"], "hops": []}
    assert documents[(1, 9)] == {
        "error": "path not found", "max-hops": 6, "max-visited": 10000
    }


def test_hop_without_a_link_carried_nothing(spark):
    links = graph_df(spark, CHAIN)
    pairs = spark.createDataFrame([(1, 3)], "src bigint, dst bigint")
    found = paths.shortest_paths(links, pairs)
    hops = paths.path_hops(found, links.filter("owner != 2")).orderBy("hop").collect()
    assert [(h.duration, h.calls, h.sms) for h in hops] == [(60, 2, 3), (0, 0, 0)]


def test_longer_than_the_hop_bound(spark):
    links = graph_df(spark, {(i, i + 1): (1, 0, 1) for i in range(1, 9)})
    got = routes(spark, links, [(1, 7), (1, 8), (1, 4)])
    assert len(got[(1, 7)]) == 7 and got[(1, 8)] is None and len(got[(1, 4)]) == 4
    assert routes(spark, links, [(1, 4)], max_hops=2)[(1, 4)] is None


@pytest.mark.parametrize(
    "seed,cap,heavy", [(1, None, 100_000), (2, 10_000, 100_000), (3, None, 10), (4, 3, 100_000), (5, 12, 10)]
)
def test_random_graphs(spark, monkeypatch, seed, cap, heavy):
    """Routes, reach and giving up, with ids of different widths and contact with oneself,
    with and without owners too heavy for one partition."""
    monkeypatch.setattr(paths, "HEAVY_OWNER", heavy)
    rng = random.Random(seed)
    ids = rng.sample(range(1, 3000), 60)
    edges = {}
    for _ in range(85):
        edges[(rng.choice(ids), rng.choice(ids))] = (1, 0, 1)
    hub = ids[0]
    for other in ids[1:25]:
        edges[(hub, other)] = (1, 0, 1)
    pairs = list({(rng.choice(ids), rng.choice(ids)) for _ in range(120)} | {(hub, ids[50]), (9999, hub)})
    peers = adjacency(edges)
    got = routes(spark, graph_df(spark, edges), pairs, max_visited=cap)
    expected = {(s, d): search(peers, str(s), str(d), max_visited=cap or 10**9) for s, d in pairs}
    assert got == expected
    assert any(expected.values()) and not all(expected.values())


def test_wide_star_gives_up(spark):
    """400 peers of 40 each and an unreachable target: it ends."""
    edges = {(1, 1000 + i): (1, 0, 1) for i in range(400)}
    for i in range(400):
        for j in range(40):
            edges[(1000 + i, 100_000 + i * 40 + j)] = (1, 0, 1)
    edges[(7, 8)] = (1, 0, 1)
    links = graph_df(spark, edges)
    got = routes(spark, links, [(1, 7), (100_000, 100_041)])
    assert got[(1, 7)] is None
    assert got[(100_000, 100_041)] == search(adjacency(edges), "100000", "100041")


def test_hub_beyond_the_bound_is_cut_down_exactly(spark, monkeypatch):
    edges = {(5, 1000 + i): (1, 0, 1) for i in range(300)}
    edges |= {(1000, 1): (1, 0, 1), (1299, 2): (1, 0, 1), (1, 3): (1, 0, 1)}
    links, peers = graph_df(spark, edges), adjacency(edges)
    pairs = [(1, 2), (3, 1299), (5, 1), (5, 2), (1000, 1299), (3, 1000)]
    for cap, heavy in ((4, 100_000), (20, 100_000), (200, 50)):
        monkeypatch.setattr(paths, "HEAVY_OWNER", heavy)
        got = routes(spark, links, pairs, max_visited=cap)
        assert got == {(s, d): search(peers, str(s), str(d), max_visited=cap) for s, d in pairs}


def test_edges_are_shuffled_once(spark):
    """A round joins the held edges without moving them."""
    edges, apart = paths._all_edges(graph_df(spark, CHAIN), 10)
    assert apart is None
    front = spark.createDataFrame([(1,), (2,)], "owner bigint").hint("merge")
    joined = front.join(edges.hint("merge"), "owner")
    rows = {(r.owner, r.peer) for r in joined.collect()}
    assert rows == {(1, 2), (2, 1), (2, 3)}
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    held = plan[plan.index("InMemoryTableScan") - 200 : plan.index("InMemoryTableScan")]
    assert "Exchange" not in held and "Sort [" not in held
    edges.unpersist()


# --- contact graphs --------------------------------------------------------------------------


def pull(edges, picks, limit, cap, sort="dur"):
    weights = {}
    for (a, b), w in edges.items():
        weights.setdefault(a, {})[b] = w
        weights.setdefault(b, {})[a] = w
    nodes, known, refused = {}, {}, {}
    for step, node in enumerate(picks):
        if step and len(nodes) >= cap:
            continue
        peers = weights.get(node, {})
        if not peers:
            continue
        main, tie = (1, 0) if sort == "sms" else (0, 1)
        order = sorted(peers, key=lambda p: (-peers[p][main], -peers[p][tie], str(p)))
        shown = order[:limit]
        nodes[node] = (True, len(shown), len(order))
        for peer in shown:
            if peer not in nodes:
                if len(nodes) >= cap:
                    refused[step] = refused.get(step, 0) + 1
                    continue
                nodes[peer] = (False, 0, 0)
            dur, sms, cnt = peers[peer]
            known[tuple(sorted((str(node), str(peer))))] = (dur, cnt, sms)
    return nodes, known, refused


@pytest.mark.parametrize("limit,cap,sort", [(50, 500, "dur"), (3, 6, "dur"), (4, 5, "sms"), (2, 1, "dur")])
def test_ego_networks(spark, limit, cap, sort):
    rng = random.Random(limit * 100 + cap)
    ids = list(range(1, 25))
    edges = {}
    for _ in range(70):
        a, b = sorted((rng.choice(ids), rng.choice(ids)))
        edges[(a, b)] = (rng.randrange(9), rng.randrange(5), rng.randrange(1, 4))
    picks = {seed: [seed, rng.choice(ids), rng.choice(ids)] for seed in [*ids[:12], 999]}
    rows = [(s, i, n) for s, nodes in picks.items() for i, n in enumerate(nodes) if s != 999 or i == 0]
    df = spark.createDataFrame(rows, "seed bigint, step int, id bigint")
    nodes, known, refused = ego.ego_network(graph_df(spark, edges), df, 3, sort, limit, cap)
    got_nodes, got_edges, got_refused = {}, {}, {}
    for r in nodes.collect():
        got_nodes.setdefault(r.seed, {})[int(r.id)] = (r.expanded, r.shown, r.total)
    for r in known.collect():
        got_edges.setdefault(r.seed, {})[(r.a, r.b)] = (r.duration, r.calls, r.sms)
    for r in refused.collect():
        got_refused.setdefault(r.seed, {})[r.step] = r.refused
    for seed, chosen in picks.items():
        expected = pull(edges, chosen if seed != 999 else [999], limit, cap, sort)
        assert got_nodes.get(seed, {}) == expected[0]
        assert got_edges.get(seed, {}) == expected[1]
        assert got_refused.get(seed, {}) == expected[2]


def test_strength_removal_and_documents(spark):
    edges = {(1, 2): (60, 3, 2), (1, 1): (10, 1, 1), (2, 3): (5, 0, 1)}
    picks = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "seed bigint, step int, id bigint")
    nodes, known, _ = ego.ego_network(graph_df(spark, edges), picks, 2)
    strength = {r.id: r.strength for r in ego.node_strength(known).collect()}
    assert strength == {"1": 80, "2": 65, "3": 5}
    by_sms = {r.id: r.strength for r in ego.node_strength(known, "sms").collect()}
    assert by_sms == {"1": 5, "2": 3, "3": 0}
    gone = spark.createDataFrame([(1, "2")], "seed bigint, id string")
    left_nodes, left_edges = ego.remove_nodes(nodes, known, gone)
    assert sorted(r.id for r in left_nodes.collect()) == ["1", "3"]
    assert [(r.a, r.b) for r in left_edges.collect()] == [("1", "1")]
    document = json.loads(ego.graph_documents(nodes, known).first().document)
    assert document["centre"] == "1" and len(document["nodes"]) == 3
    assert document["edges"][0] == {"a": "1", "b": "1", "duration": 10, "calls": 1, "sms": 1}
