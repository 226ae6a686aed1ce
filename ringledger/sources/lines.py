"""Record lines to typed records, with a reason for every refused line, and back again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.schema import (
    CDR_SCHEMA,
    FIELD_COUNT,
    MAX_ID_DIGITS,
    MAX_INT64,
    MAX_UINT64,
    USAGE_CODES,
)

RECORD_FIELDS = tuple(CDR_SCHEMA.fieldNames()[1:])


def _at_most(limit: int) -> str:
    """Pattern of the digit strings with a value up to ``limit``, leading zeros allowed."""
    digits = str(limit)
    options = ["[0-9]{1,%d}" % (len(digits) - 1)]
    for i, digit in enumerate(digits):
        if digit != "0":
            rest = len(digits) - i - 1
            options.append(f"{digits[:i]}[0-{int(digit) - 1}][0-9]{{{rest}}}")
    return "0*(?:" + "|".join([*options, digits]) + ")"


# What each field of a line must look like.
_SEQUENCE = _at_most(MAX_UINT64)
_ANY_COUNT = _at_most(MAX_UINT64)
_COUNT = _at_most(MAX_INT64)
_ID = "[0-9]{1,%d}" % MAX_ID_DIGITS
_OPTIONAL_ID = "[0-9]{0,%d}" % MAX_ID_DIGITS
_USAGE = "(?:" + "|".join(USAGE_CODES) + ")"
_DATE = "(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])/[0-9]{4}"
_TIME = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"


def _optional(pattern: str) -> str:
    return f"(?:{pattern})?"


def _escaped(separator: str) -> str:
    if len(separator) != 1 or separator in "\r\n":
        raise ValueError("the separator is one character and not a line end")
    return separator if separator.isalnum() else "\\" + separator


def _line_pattern(separator: str) -> str:
    """One pattern for a whole good line. A trailing carriage return is not good."""
    sep = _escaped(separator)
    fields = (
        _SEQUENCE, _ID, f"[^{sep}]*", _USAGE, _ID, _DATE, _TIME, _COUNT,
        _optional(_COUNT), _optional(_COUNT), _OPTIONAL_ID, _OPTIONAL_ID,
    )
    return "^" + sep.join(fields) + r"\z"


def parse_lines(lines: DataFrame, separator: str = "|", column: str = "value") -> DataFrame:
    """Add the record fields and ``reject_reason`` to a DataFrame of lines.

    A good line costs one pattern match over its text and the casts of the fields that are
    used; the reason of a bad one is worked out only for that line. The pattern looks at all
    twelve fields, so pruning a field later does not change which lines are kept. The fields
    of a refused line hold what could be read of it. Other columns pass through.
    """
    split = lines.withColumn("_f", F.split(F.col(column), _escaped(separator), -1))

    def field(i: int) -> Column:
        return F.get(F.col("_f"), F.lit(i))

    def number(i: int) -> Column:
        return F.when(field(i) != "", field(i)).otherwise(F.lit("0")).try_cast("bigint")

    def wrong(i: int, pattern: str) -> Column:
        return ~F.coalesce(field(i).rlike("^" + pattern + r"\z"), F.lit(False))

    reason = (
        F.when(F.size("_f") != FIELD_COUNT, "field_count")
        .when(wrong(0, _SEQUENCE), "bad_sequence")
        .when(wrong(1, _ID), "bad_imsi")
        .when(wrong(3, _USAGE), "bad_usage")
        .when(wrong(4, _ID), "bad_msisdn")
        .when(wrong(5, _DATE) | wrong(6, _TIME), "bad_time")
        .when(wrong(7, _ANY_COUNT), "bad_duration")
        .when(wrong(8, _optional(_ANY_COUNT)), "bad_bytes_rx")
        .when(wrong(9, _optional(_ANY_COUNT)), "bad_bytes_tx")
        .when(wrong(10, _OPTIONAL_ID), "bad_peer_imsi")
        .when(wrong(11, _OPTIONAL_ID), "bad_peer_msisdn")
        .otherwise("counter_overflow")
    )

    def part(i: int, start: int, length: int) -> Column:
        return F.substring(field(i), start, length).try_cast("int")

    # A day past the end of its month rolls over into the next one.
    call_time = F.try_make_timestamp_ntz(
        part(5, 7, 4), part(5, 4, 2), F.lit(1), part(6, 1, 2), part(6, 4, 2), part(6, 7, 2)
    ) + F.make_dt_interval(part(5, 1, 2) - 1)

    # Nearly every sequence fits a bigint, which is far cheaper to read than a decimal.
    sequence = F.when(
        F.length(field(0)) <= 18, field(0).try_cast("bigint").cast("decimal(20,0)")
    ).otherwise(field(0).try_cast("decimal(20,0)"))

    values = {
        "sequence": sequence,
        "imsi": number(1),
        "imei": field(2),
        "usage": field(3),
        "msisdn": number(4),
        "call_time": call_time,
        "duration": number(7),
        "bytes_rx": number(8),
        "bytes_tx": number(9),
        "peer_imsi": number(10),
        "peer_msisdn": number(11),
    }
    good = F.coalesce(F.col(column).rlike(_line_pattern(separator)), F.lit(False))
    return split.select(
        *lines.columns,
        *[values[name].alias(name) for name in RECORD_FIELDS],
        F.when(~good, reason).alias("reject_reason"),
    )


def records_of(parsed: DataFrame) -> DataFrame:
    """The good rows, in the record layout."""
    source = F.col("source") if "source" in parsed.columns else F.lit("")
    return parsed.filter(F.col("reject_reason").isNull()).select(
        source.alias("source"), *RECORD_FIELDS
    )


def rejects_of(parsed: DataFrame, column: str = "value") -> DataFrame:
    """The refused lines as they came, each with its reason."""
    source = F.col("source") if "source" in parsed.columns else F.lit("")
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        source.alias("source"), F.col(column).alias("line"), "reject_reason"
    )


# --- record formats by name -----------------------------------------------------------

Format = Callable[..., DataFrame]
_formats: dict[str, Format] = {"csv": parse_lines}


def register_format(name: str, parse: Format) -> None:
    """Make ``parse`` (lines in, record fields and ``reject_reason`` out) known as ``name``."""
    _formats[name] = parse


def has_format(name: str) -> bool:
    return name in _formats


def parse_format(name: str, lines: DataFrame, **options) -> DataFrame:
    """Parse with the format registered as ``name``."""
    if name not in _formats:
        raise ValueError(f"no such format: {name}")
    return _formats[name](lines, **options)


# --- records back to lines --------------------------------------------------------------


def to_lines(records: DataFrame, separator: str = "|") -> DataFrame:
    """One line per record, the inverse of parsing. Optional zeros are written empty."""

    def optional(name: str) -> Column:
        return F.when(F.col(name) == 0, "").otherwise(F.col(name).cast("string"))

    return records.select(
        F.concat_ws(
            separator,
            F.col("sequence").cast("string"),
            F.col("imsi").cast("string"),
            F.col("imei"),
            F.col("usage"),
            F.col("msisdn").cast("string"),
            F.date_format("call_time", "dd/MM/yyyy"),
            F.date_format("call_time", "HH:mm:ss"),
            F.col("duration").cast("string"),
            optional("bytes_rx"),
            optional("bytes_tx"),
            optional("peer_imsi"),
            optional("peer_msisdn"),
        ).alias("value")
    )
