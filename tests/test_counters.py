import pytest
from helpers import IMSI, OTHER, OTHER_IMSI, PEER, SUB, record, records_df, tuples

from ringledger.operators import counters
from ringledger.schema import SUBSCRIBER_COUNTERS, TOTAL_COUNTERS


def usage(spark, *rows):
    return {r.msisdn: r for r in counters.subscriber_usage(records_df(spark, rows)).collect()}


def traffic(spark, *rows):
    return {r.mccmnc: r for r in counters.operator_traffic(records_df(spark, rows)).collect()}


def links(spark, *rows):
    return {
        (r.owner, r.peer): (r.dur, r.sms, r.cnt)
        for r in counters.contact_links(records_df(spark, rows)).collect()
    }


def test_each_usage_counts_in_its_own_counter(spark):
    rows = [
        record("MOC", duration=10), record("MTC", duration=20), record("SMS-MO"), record("SMS-MT"),
        record("D", duration=5, rx=7, tx=8, peer=0), record("U"), record("B"), record("X"),
    ]
    row = usage(spark, *rows)[SUB]
    assert [row[c] for c in SUBSCRIBER_COUNTERS] == [10, 20, 7, 8, 1, 1, 1, 1, 1]
    operator = traffic(spark, *rows)[25501]
    assert tuple(operator)[1:] == (10, 20, 1, 1)
    total = counters.totals(records_df(spark, rows)).first()
    assert [total[c] for c in TOTAL_COUNTERS] == [8, 1, 1, 1, 1, 1, 1, 1, 1, 10, 20, 5, 7, 8]


def test_no_subscriber_counts_only_in_totals(spark):
    rows = [record(msisdn=0, duration=9)]
    assert usage(spark, *rows) == {} and traffic(spark, *rows) == {} and links(spark, *rows) == {}
    total = counters.totals(records_df(spark, rows)).first()
    assert (total.records, total.moc_cnt, total.moc_dur) == (1, 1, 9)


def test_operator_is_integer_division_of_own_imsi(spark):
    rows = [
        record(imsi=IMSI, duration=1), record(imsi=OTHER_IMSI, duration=2),
        record(imsi=9_999_999_999, duration=4), record(imsi=1010000000001, duration=8),
    ]
    assert {k: v.voice_out for k, v in traffic(spark, *rows).items()} == {
        25501: 1, 26002: 2, 101: 8
    }


@pytest.mark.parametrize("code", ["D", "U", "B", "X"])
def test_data_and_failures_never_count_for_an_operator(spark, code):
    assert traffic(spark, record(code, duration=9, rx=9, tx=9)) == {}
    assert links(spark, record(code, duration=9)) == {}


def test_links_both_ways_and_repeated(spark):
    rows = [record("MOC", duration=60), record("MTC", duration=30), record("SMS-MO"), record("SMS-MT")]
    assert links(spark, *rows) == {(SUB, PEER): (90, 2, 2), (PEER, SUB): (90, 2, 2)}


def test_both_legs_of_a_call_count_twice(spark):
    rows = [record("MOC", SUB, OTHER, 60), record("MTC", OTHER, SUB, 60)]
    assert links(spark, *rows) == {(SUB, OTHER): (120, 0, 2), (OTHER, SUB): (120, 0, 2)}


def test_contact_with_itself_counts_twice(spark):
    assert links(spark, record("MOC", SUB, SUB, 60), record("SMS-MO", SUB, SUB)) == {
        (SUB, SUB): (120, 2, 2)
    }


def test_peer_never_seen_has_links_but_no_usage(spark):
    rows = [record()]
    assert PEER not in usage(spark, *rows) and (PEER, SUB) in links(spark, *rows)


def test_no_peer_no_link(spark):
    assert links(spark, record(peer=0)) == {}


def test_zero_entities_do_not_exist(spark):
    """A zero-second call leaves no counter, yet its link has a call."""
    rows = [record(duration=0)]
    assert usage(spark, *rows) == {} and traffic(spark, *rows) == {}
    assert links(spark, *rows) == {(SUB, PEER): (0, 0, 1), (PEER, SUB): (0, 0, 1)}


def test_empty_totals_are_one_row_of_zeros(spark):
    rows = counters.totals(records_df(spark, [])).collect()
    assert [tuple(r) for r in rows] == [(0,) * 14]


def test_sums_beyond_32_bits_and_overflow_is_an_error(spark):
    big = 2**32
    row = usage(spark, record(duration=big), record(duration=big))[SUB]
    assert row.voice_out == 2 * big
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        usage(spark, record(duration=2**63 - 1), record(duration=1))


def _mixed(n, salt):
    codes = ["MOC", "MTC", "SMS-MO", "SMS-MT", "D", "U", "B", "X"]
    return [
        record(
            codes[(i * 7 + salt) % 8], msisdn=(i * 3 + salt) % 5, peer=(i * 5 + salt) % 6,
            duration=i % 4, rx=i, tx=2 * i, imsi=(i % 3) * 10**10 + i,
        )
        for i in range(n)
    ]


def test_fold_of_union_is_merge_of_folds(spark):
    a, b = records_df(spark, _mixed(60, 1)), records_df(spark, _mixed(45, 4))
    both = a.unionByName(b)
    for fold, part, merge in [
        (counters.subscriber_usage, counters.subscriber_sums, counters.merge_subscribers),
        (counters.operator_traffic, counters.operator_sums, counters.merge_operators),
        (counters.contact_links, counters.link_sums, counters.merge_links),
        (counters.totals, counters.totals, counters.merge_totals),
    ]:
        assert tuples(fold(both)) == tuples(merge(part(a), part(b)))


def test_links_are_symmetric_and_match_brute_force(spark):
    rows = _mixed(200, 2)
    expected = {}
    for r in rows:
        code, a, b, duration = r[4], r[5], r[11], r[7]
        if a == 0 or b == 0 or code not in ("MOC", "MTC", "SMS-MO", "SMS-MT"):
            continue
        add = (duration, 0, 1) if code in ("MOC", "MTC") else (0, 1, 0)
        for key in ((a, b), (b, a)):
            expected[key] = tuple(x + y for x, y in zip(expected.get(key, (0, 0, 0)), add))
    got = links(spark, *rows)
    assert got == expected
    assert all(got[(b, a)] == w for (a, b), w in got.items())


def test_voice_of_subscribers_is_voice_of_totals(spark):
    df = records_df(spark, [record("MOC", msisdn=i % 7 + 1, duration=i) for i in range(50)])
    total = counters.totals(df).first().moc_dur
    assert sum(r.voice_out for r in counters.subscriber_usage(df).collect()) == total


def test_reconcile(spark):
    a = counters.totals(records_df(spark, [record(), record("D", rx=5)]))
    b = counters.totals(records_df(spark, [record()]))
    diff = {r.field: r.difference for r in counters.reconcile_totals(a, b).collect()}
    assert {k: v for k, v in diff.items() if v} == {"records": 1, "data_cnt": 1, "data_rx": 5, "data_dur": 60}
    assert len(diff) == 14


def test_partial_aggregation_before_the_shuffle(spark):
    plan = counters.subscriber_usage(records_df(spark, [record()]))._jdf.queryExecution().toString()
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") >= 1
