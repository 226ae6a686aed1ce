"""Known values of the records made from the given tables."""

import pytest

from ringledger.operators import boards, counters
from ringledger.sources import tables

GOLDEN = {
    "sf0.001": (
        (1000, 200, 200, 120, 120, 300, 30, 20, 10, 10336, 9595, 14574, 1472661, 2378250),
        (15, 5, 97, 7, 18),
        [(972500000008, 1703), (972500000012, 1687), (972500000004, 1575)],
    ),
    "sf0.01": (
        (10000, 2000, 2000, 1200, 1200, 3000, 300, 200, 100, 96904, 96074, 152737, 15423051, 23782500),
        (150, 5, 953, 53, 153),
        [(972500000149, 2005), (972500000041, 1923), (972500000020, 1893)],
    ),
    "sf0.1": (
        (100000, 20000, 20000, 12000, 12000, 30000, 3000, 2000, 1000, 991072, 986081, 1488198,
         150292800, 237825000),
        (1500, 5, 9511, 511, 1503),
        [(972500000575, 2672), (972500001345, 2622), (972500001178, 2603)],
    ),
}


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_golden(spark, sf):
    records = tables.event_records(spark, f"/root/testdata/{sf}")
    totals, sizes, leaders = GOLDEN[sf]
    assert tuple(counters.totals(records).first()) == totals
    subscribers, operators = counters.subscriber_usage(records), counters.operator_traffic(records)
    links = counters.contact_links(records)
    assert (
        subscribers.count(), operators.count(), links.count(),
        links.filter("owner = peer").count(), links.select("owner").distinct().count(),
    ) == sizes
    page = boards.board_page(boards.board("voice", subscribers, operators), 0, 3)
    assert [(int(r.id), r.score) for r in page.orderBy("position").collect()] == leaders
