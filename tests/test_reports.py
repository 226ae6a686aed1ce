"""Boards, peers, lookups, summaries."""

import json
import random
import re

import pytest
from helpers import record, records_df

from ringledger.functions.columns import as_json
from ringledger.functions import ranking
from ringledger.functions.ranking import ranked, top_per_group
from ringledger.operators import boards, contacts, counters, documents, lookups, summary
from ringledger.schema import LINK_COUNTERS, OPERATOR_COUNTERS, SUBSCRIBER_COUNTERS, TOTAL_COUNTERS
from pyspark.sql import functions as F


def table(spark, key, counter_names, rows):
    schema = ", ".join([f"{k} BIGINT" for k in key] + [f"{c} BIGINT" for c in counter_names])
    return spark.createDataFrame(rows, schema)


def subscribers(spark, voices):
    return table(
        spark, ["msisdn"], SUBSCRIBER_COUNTERS, [(m, v) + (0,) * 8 for m, v in voices.items()]
    )


def no_operators(spark):
    return table(spark, ["mccmnc"], OPERATOR_COUNTERS, [])


def links_df(spark, rows):
    return table(spark, ["owner", "peer"], LINK_COUNTERS, rows)


def voice_board(spark, voices):
    return boards.board("voice", subscribers(spark, voices), no_operators(spark))


def page(df):
    return [(r.position, r.id, r.score) for r in df.orderBy("position").collect()]


def test_board_pages(spark):
    entries = voice_board(spark, {1: 30, 2: 20, 3: 10})
    assert page(boards.board_page(entries)) == [(1, "1", 30), (2, "2", 20), (3, "3", 10)]
    assert page(boards.board_page(entries, 1, 1)) == [(2, "2", 20)]
    assert page(boards.board_page(entries, 9)) == []
    assert page(boards.board_page(entries, 1, 0)) == [(2, "2", 20), (3, "3", 10)]
    assert boards.board_count(entries).first()[0] == 3


def test_board_ties_go_by_text_descending(spark):
    entries = voice_board(spark, {9: 5, 10: 5, 100: 5, 7: 6})
    assert [i for _, i, _ in page(boards.board_page(entries))] == ["7", "9", "100", "10"]
    assert [i for _, i, _ in page(boards.board_page(entries, 0, 0))] == ["7", "9", "100", "10"]


def test_zero_scores_are_not_on_a_board(spark):
    entries = voice_board(spark, {1: 0, 2: 4})
    assert page(boards.board_page(entries)) == [(1, "2", 4)]
    every = boards.all_boards(subscribers(spark, {1: 0, 2: 4}), no_operators(spark))
    assert [(r.board, r.id) for r in every.collect()] == [("voice", "2")]


def test_unknown_board_and_bad_pages_are_refused(spark):
    with pytest.raises(ValueError):
        boards.board("calls", subscribers(spark, {}), no_operators(spark))
    entries = voice_board(spark, {1: 1})
    for offset, limit in [(-1, 1), (0, -1)]:
        with pytest.raises(ValueError):
            boards.board_page(entries, offset, limit)


def test_limits_have_defaults_and_caps(spark):
    entries = voice_board(spark, {i: i for i in range(1, 701)})
    assert boards.board_page(entries).count() == 20
    assert boards.board_page(entries, 0, 600).count() == 600
    links = links_df(spark, [(1, p, p, 0, 1) for p in range(1, 1203)])
    assert contacts.peer_page(links).count() == 100
    assert contacts.peer_page(links, limit=1100).count() == 1100
    assert contacts.peer_page(links, limit=0).count() == 1202


def test_leader_share_is_of_the_page(spark):
    entries = voice_board(spark, {1: 30, 2: 20, 3: 10})
    shares = boards.leader_share(boards.board_page(entries, 1)).orderBy("position").collect()
    assert [s.of_leader for s in shares] == [1.0, 0.5]


def test_deep_pages_sort_only_what_holds_them(spark, monkeypatch):
    """Spread and tied scores, pages across range ends and past the last row, against a plain sort."""
    rng = random.Random(5)
    rows = [(str(i), rng.choice([7, 7, 7, rng.randrange(1, 60), rng.randrange(1, 1 << 62)])) for i in range(900)]
    entries = spark.createDataFrame(rows, "id string, score bigint").repartition(4).cache()
    expected = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    monkeypatch.setattr(ranking, "RANGES", 8)
    monkeypatch.setattr(ranking, "SORTED", 20)
    sorted_rows = []
    plain = ranking.ranked
    monkeypatch.setattr(ranking, "ranked", lambda df, *a: sorted_rows.append(df.count()) or plain(df, *a))
    for offset, limit in [(0, 5), (130, 40), (890, 30), (899, 1), (900, 5), (0, 0)]:
        got = ranking.page_rows(entries, "score", [F.desc("id")], offset, limit).orderBy("position").collect()
        assert [(r.position, r.id, r.score) for r in got] == [(n + 1, *expected[n]) for n in range(900)[offset : offset + limit]]
    assert sorted_rows[0] <= 25 and len(sorted_rows) == 4
    none = entries.filter("false")
    assert ranking.page_rows(none, "score", [F.desc("id")], 0, 5).count() == 0


def test_ranking_of_a_hot_group_is_split_and_exact(spark):
    """One group holds most rows; positions still match a plain sort."""
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(50)) for i in range(5000)]
    rows += [(f"g{i % 40}", i, rng.randrange(50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, id int, v int").repartition(8)
    out = ranked(df, ["g"], [F.desc("v"), F.asc("id")])
    expected = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        expected |= {(g, r[1]): i + 1 for i, r in enumerate(members)}
    assert {(r.g, r.id): r.position for r in out.collect()} == expected


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(4)
    top = top_per_group(df, ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {(r.g, r.id) for r in top.collect()} == {
        (0, 999), (0, 996), (1, 997), (1, 994), (2, 998), (2, 995)
    }


@pytest.mark.parametrize("k", [999, 1000, 10_001, 20_002])
def test_no_task_holds_a_group(spark, k):
    """Whatever k is, a window over whole groups comes only behind a group limit."""
    hub = spark.range(30_000).select(F.lit(1).alias("g"), "id").repartition(4)
    top = top_per_group(hub, ["g"], [F.desc("id")], k)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit|TakeOrdered", plan) or "row_number" not in plan
    got = top.agg(F.count("*"), F.min("id"), F.max("id"), F.max("position")).first()
    assert tuple(got) == (k, 30_000 - k, 29_999, k)


def peers(df):
    return [r.msisdn for r in df.orderBy("position").collect()]


def test_peer_orders(spark):
    links = links_df(
        spark,
        # owner, peer, dur, sms, cnt
        [(1, 20, 50, 1, 1), (1, 3, 50, 2, 1), (1, 100, 90, 0, 1), (1, 4, 50, 1, 1), (2, 9, 1, 1, 1)],
    )
    assert peers(contacts.peer_page(links).filter("owner = '1'")) == ["100", "20", "3", "4"]
    one = spark.createDataFrame([(1,)], "owner bigint")
    assert peers(contacts.peer_page(links, one, "dur")) == ["100", "3", "20", "4"]
    assert peers(contacts.peer_page(links, one, "sms")) == ["3", "20", "4", "100"]
    assert peers(contacts.peer_page(links, one, "sms", 1, 2)) == ["20", "4"]
    assert peers(contacts.peer_page(links, one, "sms", 9, 2)) == []
    with pytest.raises(ValueError):
        contacts.peer_page(links, one, "calls")
    first = contacts.peer_page(links, one, "dur").orderBy("position").first()
    assert (first["count"], first.duration, first.calls, first.sms) == (4, 90, 1, 0)


def test_averages_without_calls_are_null(spark):
    links = links_df(spark, [(1, 2, 0, 3, 0), (1, 3, 90, 0, 4)])
    got = {r.peer: r.average_call for r in contacts.average_call(links).collect()}
    assert got == {2: None, 3: 22.5}


def test_voice_per_peer_and_suggestions(spark):
    subs = subscribers(spark, {1: 90, 5: 10})
    links = links_df(spark, [(1, 2, 0, 3, 0), (1, 3, 90, 0, 4), (2, 1, 0, 3, 0)])
    (row,) = contacts.voice_per_peer(subs, links).collect()
    assert (row.msisdn, row.peers, row.voice_per_peer) == (1, 2, 45.0)
    entries = boards.board("voice", subs, no_operators(spark))
    rows = contacts.suggestions(entries, links, 5).orderBy("position").collect()
    assert [(r.id, r.peer) for r in rows] == [("1", "3"), ("5", None)]


def test_lookups(spark):
    subs = subscribers(spark, {1: 90})
    keys = spark.createDataFrame([(1,), (7,), (7,)], "msisdn bigint")
    (row,) = lookups.subscriber_report(subs, keys).collect()
    assert row["msisdn"] == "1" and row["voice-out"] == 90 and row["no-answer"] == 0
    assert [r.msisdn for r in lookups.missing(subs, keys, ["msisdn"]).collect()] == [7]
    links = links_df(spark, [(1, 2, 5, 6, 7)])
    pairs = spark.createDataFrame([(1, 2), (2, 9)], "owner bigint, peer bigint")
    (row,) = lookups.link_report(links, pairs).collect()
    assert row.asDict() == {
        "first-party": "1", "second-party": "2", "duration": 5, "calls": 7, "sms": 6
    }


def test_totals_document_keeps_field_order(spark):
    totals = counters.totals(records_df(spark, [record(duration=9)]))
    text = as_json(lookups.totals_report(totals)).first().document
    assert list(json.loads(text)) == [c.replace("_", "-") for c in TOTAL_COUNTERS]
    assert text.startswith('{"records":1,"moc-cnt":1,"mtc-cnt":0')


def test_summaries_of_nothing(spark):
    empty = counters.totals(records_df(spark, []))
    assert tuple(summary.dashboard_sums(empty).first()) == (0, 0, 0, 0)
    assert tuple(summary.dashboard_ratios(empty).first()) == (None,) * 4
    assert summary.usage_mix(empty).count() == 0
    ops = table(spark, ["mccmnc"], OPERATOR_COUNTERS, [(1, 5, 5, 0, 0)])
    assert summary.operator_share(ops, empty).first().share is None


def test_summaries(spark):
    rows = [record("MOC", duration=30), record("MTC", duration=10), record("U"), record("B")]
    df = records_df(spark, rows)
    totals = counters.totals(df)
    ratios = summary.dashboard_ratios(totals).first()
    assert ratios["fail-share"] == 0.5 and ratios["avg-moc-dur"] == 30.0
    mix = {r.usage: r.share for r in summary.usage_mix(totals).collect()}
    assert mix["voice out"] == 0.25 and sum(mix.values()) == 1.0 and len(mix) == 8
    (share,) = summary.operator_share(counters.operator_traffic(df), totals).collect()
    assert share.share == 1.0
    (row,) = summary.failure_against_store(counters.subscriber_usage(df), totals).collect()
    assert (row.failures, row.store_failure_share, row.voice) == (2, 0.5, 40)


def test_key_inventory(spark):
    df = records_df(spark, [record()])
    subs, ops = counters.subscriber_usage(df), counters.operator_traffic(df)
    keys = lookups.store_keys(
        subs, ops, counters.contact_links(df), counters.totals(df), df.select("source"),
    )
    assert {r.kind: r["keys"] for r in keys.collect()} == {
        "subscribers": 1, "operators": 1, "links": 2, "boards": 2, "totals": 1, "progress": 1
    }
    assert lookups.health(keys, 6, 10000).first()["keys"] == 8


def test_documents(spark):
    entries = voice_board(spark, {1: 30, 2: 20, 3: 10})
    text = documents.board_document("voice", entries, 1, 1).first().document
    assert text == (
        '{"board":"voice","count":3,"offset":1,"limit":1,"entries":[{"id":"2","score":20}]}'
    )
    empty = json.loads(documents.board_document("voice", voice_board(spark, {})).first().document)
    assert empty["count"] == 0 and empty["entries"] == [] and empty["limit"] == 20
    links = links_df(spark, [(1, 20, 50, 1, 1), (1, 3, 50, 2, 1), (2, 1, 1, 1, 1)])
    one = spark.createDataFrame([(1,), (9,)], "owner bigint")
    (row,) = documents.peer_documents(links, one).collect()
    assert row.document == '{"msisdn":"1","count":2,"offset":0,"limit":100,"peers":["20","3"]}'
    (row,) = documents.peer_documents(links, one, "dur", 5, 2).collect()
    assert json.loads(row.document)["peers"] == [] and json.loads(row.document)["count"] == 2
    with pytest.raises(ValueError):
        documents.board_document("voice", entries, 0, 0)
    points = spark.createDataFrame([(2, None), (1, 0.5)], "ts bigint, value double")
    document = json.loads(documents.series_document(points, "fail-share", "1h", 5000).first()[0])
    assert (document["seconds"], document["from"], document["to"]) == (3600, 1400, 5000)
    assert document["points"] == [{"ts": 1, "value": 0.5}, {"ts": 2}]
