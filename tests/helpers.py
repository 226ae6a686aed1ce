"""Small builders shared by the tests."""

from decimal import Decimal

from ringledger.schema import CDR_SCHEMA

SUB, PEER, OTHER = 380501112233, 48600700800, 380501112244
IMSI, OTHER_IMSI = 255011234567890, 260029876543210

#: A record line's fields by name, in their order.
VOICE_FIELDS = {
    "sequence": 71, "imsi": IMSI, "imei": "99-000001-000002-3", "usage": "MOC", "msisdn": SUB,
    "date": "03/05/2025", "time": "21:04:56", "duration": 615, "bytes_rx": "", "bytes_tx": "",
    "peer_imsi": OTHER_IMSI, "peer_msisdn": PEER,
}
DATA_FIELDS = VOICE_FIELDS | {
    "sequence": 72, "usage": "D", "date": "28/02/2025", "time": "00:00:00", "duration": 44,
    "bytes_rx": 5005, "bytes_tx": 707, "peer_imsi": "", "peer_msisdn": "",
}


def line(fields=None, separator="|", **changes):
    """A record line with some of its fields changed."""
    return separator.join(str(x) for x in ((fields or VOICE_FIELDS) | changes).values())


VOICE, DATA = line(), line(DATA_FIELDS)


def record(usage="MOC", msisdn=SUB, peer=PEER, duration=60, rx=0, tx=0, imsi=IMSI, seq=1, source="s"):
    return (source, Decimal(seq), imsi, "", usage, msisdn, None, duration, rx, tx, 0, peer)


def lines_df(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def records_df(spark, rows):
    return spark.createDataFrame(list(rows), CDR_SCHEMA)


def tuples(df):
    return sorted(tuple(row) for row in df.collect())
