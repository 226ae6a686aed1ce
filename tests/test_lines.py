from datetime import datetime
from decimal import Decimal

import pytest
from helpers import DATA, DATA_FIELDS, IMSI, OTHER_IMSI, PEER, SUB, VOICE, VOICE_FIELDS, line, lines_df
from pyspark.sql import functions as F

from ringledger.sources import lines


def reasons(spark, rows, **options):
    df = lines_df(spark, rows).withColumn("n", F.monotonically_increasing_id())
    parsed = lines.parse_lines(df, **options).orderBy("n")
    return [row.reject_reason for row in parsed.collect()]


def test_good_lines(spark):
    parsed = lines.records_of(lines.parse_lines(lines_df(spark, [VOICE, DATA])))
    voice, data = sorted(parsed.collect(), key=lambda r: r.sequence)
    for row, fields in ((voice, VOICE_FIELDS), (data, DATA_FIELDS)):
        for name in ("sequence", "imsi", "imei", "usage", "msisdn", "duration"):
            assert getattr(row, name) == fields[name]
        for name in ("bytes_rx", "bytes_tx", "peer_imsi", "peer_msisdn"):
            assert getattr(row, name) == (fields[name] or 0)
    assert voice.call_time == datetime(2025, 5, 3, 21, 4, 56)
    assert (voice.peer_imsi, voice.peer_msisdn) == (OTHER_IMSI, PEER)


#: What a field of digits refuses, made from a good value: letters, signs, spaces, fractions.
def not_digits(value):
    return [f"{value}z", f"z{value}", f"+{value}", f"-{value}", f" {value}", f"{value} ", f"{value}.0", f"{value}e1"]


DIGITS = {
    "sequence": 71, "imsi": IMSI, "msisdn": SUB, "duration": 615, "bytes_rx": 5005, "bytes_tx": 707,
    "peer_imsi": OTHER_IMSI, "peer_msisdn": PEER,
}
#: Fields that an empty text is not good enough for, and fields of at most 15 digits.
MANDATORY, SHORT = ("sequence", "imsi", "msisdn", "duration"), ("imsi", "msisdn", "peer_imsi", "peer_msisdn")
COUNTED = ("duration", "bytes_rx", "bytes_tx")
#: Day, month, hour, minute and second outside their ranges, and other layouts of a date or a time.
BAD_DATES = ["00/05/2025", "32/05/2025", "03/00/2025", "03/13/2025", "3/05/2025", "03/5/2025", "03/05/25", "2025-05-03", "03.05.2025", "03/05", ""]
BAD_TIMES = ["24:00:00", "21:60:00", "21:04:60", "1:04:56", "21:4:56", "21:04:5", "21.04.56", "21:04", "210456", ""]
BAD_USAGES = ["", "moc", "MO", "MOCX", "SMS", "SMSMO", "0", " D"]

REJECTED = [
    *((line(**{name: bad}), f"bad_{name}") for name, good in DIGITS.items() for bad in not_digits(good)),
    *((line(**{name: ""}), f"bad_{name}") for name in MANDATORY),
    *((line(**{name: 10**15 + k}), f"bad_{name}") for name in SHORT for k in (0, 7)),
    *((line(**{name: 2**64}), f"bad_{name}") for name in ("sequence", *COUNTED)),
    *((line(**{name: n}), "counter_overflow") for name in COUNTED for n in (2**63, 2**64 - 1)),
    *((line(date=bad), "bad_time") for bad in BAD_DATES),
    *((line(time=bad), "bad_time") for bad in BAD_TIMES),
    *((line(usage=bad), "bad_usage") for bad in BAD_USAGES),
    (VOICE + "\r", "bad_peer_msisdn"),
    *((cut, "field_count") for cut in (VOICE.rpartition("|")[0], VOICE.partition("|")[2], VOICE + "|", "|" + VOICE, VOICE + "|1", "", "|", "words only", line(separator=";"))),
]

ACCEPTED = [
    VOICE,
    DATA,
    *(line(**{name: ""}) for name in ("imei", "bytes_rx", "bytes_tx", "peer_imsi", "peer_msisdn")),
    *(line(**{name: 0}) for name in DIGITS),
    *(line(**{name: f"000{good}"}) for name, good in DIGITS.items() if name not in SHORT),
    *(line(**{name: 10**15 - 1}) for name in SHORT),
    *(line(**{name: 2**63 - 1}) for name in COUNTED),
    line(sequence=2**64 - 1),
    *(line(date=date) for date in ("01/01/2000", "30/02/2024", "31/04/2025")),
    *(line(time=time) for time in ("00:00:00", "23:59:59")),
    *(line(usage=code) for code in ("MOC", "MTC", "SMS-MO", "SMS-MT", "D", "U", "B", "X")),
]


def test_rejected(spark):
    assert reasons(spark, [line for line, _ in REJECTED]) == [why for _, why in REJECTED]


def test_accepted(spark):
    assert reasons(spark, ACCEPTED) == [None] * len(ACCEPTED)


def test_largest_sequence_is_exact(spark):
    parsed = lines.parse_lines(lines_df(spark, [line(sequence=2**64 - 1)]))
    assert parsed.first().sequence == Decimal(18446744073709551615)


def test_day_past_month_end_rolls_over(spark):
    parsed = lines.parse_lines(lines_df(spark, [line(date="30/02/2024")]))
    assert parsed.first().call_time == datetime(2024, 3, 1, 21, 4, 56)


def test_bad_fields_count_when_pruned(spark):
    """Validity depends on fields that no counter reads."""
    bad = [line(date="03/13/2025"), line(peer_imsi="x"), VOICE]
    records = lines.records_of(lines.parse_lines(lines_df(spark, bad)))
    assert records.select("usage").count() == 1


@pytest.mark.parametrize("separator", [",", ";", "\t", "^", "]", "a", " "])
def test_other_separator(spark, separator):
    rows = [VOICE.replace("|", separator), VOICE]
    assert reasons(spark, rows, separator=separator) == [None, "field_count"]


@pytest.mark.parametrize("separator", ["", "||", "\n"])
def test_separator_is_one_character(spark, separator):
    with pytest.raises(ValueError):
        lines.parse_lines(lines_df(spark, [VOICE]), separator=separator)


def test_rejects_keep_the_line(spark):
    rows = lines.rejects_of(lines.parse_lines(lines_df(spark, [VOICE, "garbage"]))).collect()
    assert [(r.line, r.reject_reason) for r in rows] == [("garbage", "field_count")]


def test_lines_round_trip(spark):
    parsed = lines.parse_lines(lines_df(spark, [VOICE, DATA]))
    again = lines.to_lines(lines.records_of(parsed))
    assert sorted(r.value for r in again.collect()) == sorted([VOICE, DATA])


def test_formats_by_name(spark):
    assert lines.has_format("csv") and not lines.has_format("tsv")
    lines.register_format("tsv", lambda df, **o: lines.parse_lines(df, separator="\t"))
    assert lines.has_format("tsv")
    parsed = lines.parse_format("tsv", lines_df(spark, [VOICE.replace("|", "\t")]))
    assert parsed.first().reject_reason is None
    lines.register_format("tsv", lambda df, **o: lines.parse_lines(df, separator=";"))
    parsed = lines.parse_format("tsv", lines_df(spark, [VOICE.replace("|", ";")]))
    assert parsed.first().reject_reason is None
    with pytest.raises(ValueError):
        lines.parse_format("xml", lines_df(spark, [VOICE]))


def test_parse_is_one_pattern_in_the_filter(spark):
    """A good line is matched once and not taken apart field by field to be checked."""
    records = lines.records_of(lines.parse_lines(lines_df(spark, [VOICE])))
    plan = records.select("usage")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1
