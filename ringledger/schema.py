"""Record layout, code sets, table columns and report names.

Everything in this module must have exactly these values for results to be right.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: record line -------------------------------------------------------
USAGE_CODES = ("MOC", "MTC", "SMS-MO", "SMS-MT", "D", "U", "B", "X")
FIELD_COUNT = 12
MAX_ID_DIGITS = 15
MAX_UINT64 = 18446744073709551615
MAX_INT64 = 9223372036854775807
HEADER_PATTERN = r"^CDR\|([^|]*)\|([0-9]+)"
OPERATOR_DIVISOR = 10_000_000_000

CDR_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("sequence", T.DecimalType(20, 0)),
        T.StructField("imsi", T.LongType()),
        T.StructField("imei", T.StringType()),
        T.StructField("usage", T.StringType()),
        T.StructField("msisdn", T.LongType()),
        T.StructField("call_time", T.TimestampNTZType()),
        T.StructField("duration", T.LongType()),
        T.StructField("bytes_rx", T.LongType()),
        T.StructField("bytes_tx", T.LongType()),
        T.StructField("peer_imsi", T.LongType()),
        T.StructField("peer_msisdn", T.LongType()),
    ]
)

# --- fixed values: counter tables ----------------------------------------------------
SUBSCRIBER_COUNTERS = (
    "voice_out", "voice_in", "data_rx", "data_tx",
    "sms_out", "sms_in", "noans", "busy", "failed",
)
OPERATOR_COUNTERS = ("voice_out", "voice_in", "sms_out", "sms_in")
LINK_COUNTERS = ("dur", "sms", "cnt")
TOTAL_COUNTERS = (
    "records", "moc_cnt", "mtc_cnt", "sms_mo_cnt", "sms_mt_cnt", "data_cnt",
    "noans_cnt", "busy_cnt", "failed_cnt",
    "moc_dur", "mtc_dur", "data_dur", "data_rx", "data_tx",
)

# --- fixed values: report names ------------------------------------------------------
SUBSCRIBER_REPORT = {
    "voice_out": "voice-out", "voice_in": "voice-in",
    "data_tx": "data-out", "data_rx": "data-in",
    "sms_out": "sms-out", "sms_in": "sms-in",
    "noans": "no-answer", "busy": "busy", "failed": "failed",
}
OPERATOR_REPORT = {
    "voice_out": "voice-out", "voice_in": "voice-in",
    "sms_out": "sms-out", "sms_in": "sms-in",
}
LINK_REPORT = {"dur": "duration", "cnt": "calls", "sms": "sms"}
TOTAL_REPORT = {name: name.replace("_", "-") for name in TOTAL_COUNTERS}

# --- fixed values: leaderboards, board name -> counters that are added up --------------
SUBSCRIBER_BOARDS = {
    "voice": ("voice_out", "voice_in"),
    "sms": ("sms_out", "sms_in"),
    "data": ("data_rx", "data_tx"),
    "fail": ("noans", "busy", "failed"),
}
OPERATOR_BOARDS = {
    "op-voice": ("voice_out", "voice_in"),
    "op-sms": ("sms_out", "sms_in"),
}

# --- fixed values: page sizes and search bounds ----------------------------------------
PEER_LIMIT, PEER_LIMIT_MAX = 100, 1000
TOP_LIMIT, TOP_LIMIT_MAX = 20, 500
SUGGESTIONS = 5
MAX_HOPS, MAX_VISITED = 6, 10_000
EXPAND_LIMIT, MAX_NODES = 50, 500

# --- fixed values: sampled totals --------------------------------------------------------
SAMPLE_COLUMNS = ("keys",) + TOTAL_COUNTERS
SUM_METRICS = {
    "calls": ("moc_cnt", "mtc_cnt"),
    "messages": ("sms_mo_cnt", "sms_mt_cnt"),
    "data-vol": ("data_rx", "data_tx"),
    "failures": ("noans_cnt", "busy_cnt", "failed_cnt"),
}
RATIO_METRICS = {
    "fail-share": (("noans_cnt", "busy_cnt", "failed_cnt"), ("records",)),
    "avg-moc-dur": (("moc_dur",), ("moc_cnt",)),
    "avg-mtc-dur": (("mtc_dur",), ("mtc_cnt",)),
    "avg-data-dur": (("data_dur",), ("data_cnt",)),
}
USAGE_BANDS = {
    "moc_cnt": "voice out", "mtc_cnt": "voice in",
    "sms_mo_cnt": "sms out", "sms_mt_cnt": "sms in",
    "data_cnt": "data", "noans_cnt": "no answer",
    "busy_cnt": "busy", "failed_cnt": "failed",
}
OUTCOME_BANDS = {
    "calls": "answered", "noans-cnt": "no answer", "busy-cnt": "busy", "failed-cnt": "failed",
}
WINDOW_SECONDS = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400}
RETENTION_DAYS = 7
RATE_LAG = 60
MAX_POINTS = 600
