"""The registered queries as plain SQL over the same tables, for checking results."""

from __future__ import annotations

from ringledger.plans.catalog import LONG_LAG, PAIR_STEPS, SMALL_GRAPH
from ringledger.schema import (
    MAX_HOPS,
    MAX_VISITED,
    OPERATOR_BOARDS,
    OUTCOME_BANDS,
    RETENTION_DAYS,
    SUBSCRIBER_BOARDS,
    TOTAL_COUNTERS,
    USAGE_BANDS,
)

_CDR = """
b AS (SELECT event_id, ts, user_id, value, event_type, event_id % 100 AS k FROM events),
u AS (SELECT *, CASE WHEN k < 20 THEN 'MOC' WHEN k < 40 THEN 'MTC' WHEN k < 52 THEN 'SMS-MO'
  WHEN k < 64 THEN 'SMS-MT' WHEN k < 94 THEN 'D' WHEN k < 97 THEN 'U' WHEN k < 99 THEN 'B'
  ELSE 'X' END AS usage FROM b),
cdr AS (SELECT event_id, event_type, event_id + 1 AS sequence,
  CASE WHEN user_id % 50 = 49 THEN user_id ELSE (CASE user_id % 5 WHEN 0 THEN 42502
    WHEN 1 THEN 26204 WHEN 2 THEN 31026 WHEN 3 THEN 20801 ELSE 99999 END) * 10000000000 + user_id
  END AS imsi,
  usage, CASE WHEN event_id % 97 = 0 THEN 0 ELSE 972500000000 + user_id END AS msisdn,
  ts AS call_time,
  CASE WHEN usage IN ('MOC', 'MTC', 'D') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS duration,
  CASE WHEN usage = 'D' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS bytes_rx,
  CASE WHEN usage = 'D' THEN event_id % 1000 * 15 ELSE 0 END AS bytes_tx,
  CASE WHEN usage = 'D' OR event_id % 53 = 0 THEN 0
    WHEN event_id % 101 = 0 THEN 972500000000 + user_id
    ELSE 972500000000 + user_id + 1 + event_id % 3 END AS peer_msisdn
  FROM u)"""


def _sum(condition: str, value: str = "1") -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {condition}), 0) AS BIGINT)"


def _of(code: str, value: str = "1") -> str:
    return _sum(f"usage = '{code}'", value)


_SUB_COLUMNS = f"""{_of('MOC', 'duration')} AS voice_out, {_of('MTC', 'duration')} AS voice_in,
  {_of('D', 'bytes_rx')} AS data_rx, {_of('D', 'bytes_tx')} AS data_tx,
  {_of('SMS-MO')} AS sms_out, {_of('SMS-MT')} AS sms_in,
  {_of('U')} AS noans, {_of('B')} AS busy, {_of('X')} AS failed"""

_SUB = f"""
sub AS (SELECT * FROM (SELECT msisdn, {_SUB_COLUMNS} FROM cdr WHERE msisdn <> 0 GROUP BY msisdn)
  WHERE greatest(voice_out, voice_in, data_rx, data_tx, sms_out, sms_in, noans, busy, failed) > 0)"""

_OP = f"""
op AS (SELECT * FROM (SELECT CAST(imsi // 10000000000 AS INTEGER) AS mccmnc,
    {_of('MOC', 'duration')} AS voice_out, {_of('MTC', 'duration')} AS voice_in,
    {_of('SMS-MO')} AS sms_out, {_of('SMS-MT')} AS sms_in
    FROM cdr WHERE msisdn <> 0 AND imsi // 10000000000 <> 0 GROUP BY 1)
  WHERE greatest(voice_out, voice_in, sms_out, sms_in) > 0)"""


def _links(records: str = "cdr") -> str:
    return f"""
contact AS (SELECT * FROM {records} WHERE msisdn <> 0 AND peer_msisdn <> 0
  AND usage IN ('MOC', 'MTC', 'SMS-MO', 'SMS-MT')),
both_ways AS (SELECT msisdn AS owner, peer_msisdn AS peer, usage, duration FROM contact
  UNION ALL SELECT peer_msisdn, msisdn, usage, duration FROM contact),
links AS (SELECT * FROM (SELECT owner, peer,
    {_sum("usage IN ('MOC', 'MTC')", 'duration')} AS dur,
    {_sum("usage IN ('SMS-MO', 'SMS-MT')")} AS sms,
    {_sum("usage IN ('MOC', 'MTC')")} AS cnt
    FROM both_ways GROUP BY owner, peer) WHERE greatest(dur, sms, cnt) > 0)"""


_LINKS = _links()

_TOTAL_COLUMNS = f"""CAST(count(*) AS BIGINT) AS records,
  {_of('MOC')} AS moc_cnt, {_of('MTC')} AS mtc_cnt, {_of('SMS-MO')} AS sms_mo_cnt,
  {_of('SMS-MT')} AS sms_mt_cnt, {_of('D')} AS data_cnt, {_of('U')} AS noans_cnt,
  {_of('B')} AS busy_cnt, {_of('X')} AS failed_cnt,
  {_of('MOC', 'duration')} AS moc_dur, {_of('MTC', 'duration')} AS mtc_dur,
  {_of('D', 'duration')} AS data_dur, {_of('D', 'bytes_rx')} AS data_rx,
  {_of('D', 'bytes_tx')} AS data_tx"""

_TOTALS = f"""
totals AS (SELECT {_TOTAL_COLUMNS} FROM cdr)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_BOARDS = "\nboards AS (" + " UNION ALL ".join(
    [
        f"SELECT '{name}' AS board, CAST({key} AS VARCHAR) AS id, {' + '.join(columns)} AS score "
        f"FROM {table} WHERE {' + '.join(columns)} > 0"
        for table, key, group in (
            ("sub", "msisdn", SUBSCRIBER_BOARDS),
            ("op", "mccmnc", OPERATOR_BOARDS),
        )
        for name, columns in group.items()
    ]
) + ")"

_PLACED = """
placed AS (SELECT board, id, score,
  row_number() OVER (PARTITION BY board ORDER BY score DESC, id DESC) AS position FROM boards)"""

_ALL_BOARDS = _with(_CDR, _SUB, _OP, _BOARDS, _PLACED)


def _peer_page(sort: str | None, offset: int, limit: int | None) -> str:
    order = {
        None: "CAST(peer AS VARCHAR)",
        "dur": "dur DESC, sms DESC, CAST(peer AS VARCHAR)",
        "sms": "sms DESC, dur DESC, CAST(peer AS VARCHAR)",
    }[sort]
    weights = "" if sort is None else ", dur AS duration, cnt AS calls, sms"
    last = "" if limit is None else f"AND position <= {offset + limit}"
    return (
        _with(_CDR, _LINKS)
        + f"""SELECT CAST(owner AS VARCHAR) AS owner, count, position,
  CAST(peer AS VARCHAR) AS msisdn{weights} FROM (SELECT *,
  count(*) OVER (PARTITION BY owner) AS count,
  row_number() OVER (PARTITION BY owner ORDER BY {order}) AS position FROM links)
WHERE position > {offset} {last}"""
    )


# --- paths: six unrolled levels around every id, then the same turns per pair -----------------


def _path_parts() -> str:
    steps = ", ".join(str(k) for k in PAIR_STEPS)
    parts = [
        f"""
pairs AS (SELECT DISTINCT owner AS src, owner + k AS dst
  FROM (SELECT DISTINCT owner FROM links), (SELECT unnest([{steps}]) AS k)),
l0 AS (SELECT DISTINCT root, root AS node, CAST(root AS VARCHAR) AS route FROM
  (SELECT src AS root FROM pairs UNION ALL SELECT dst FROM pairs))"""
    ]
    for depth in range(1, MAX_HOPS + 1):
        seen = " UNION ALL ".join(f"SELECT root, node FROM l{i}" for i in range(depth))
        parts.append(f"""
l{depth} AS MATERIALIZED (SELECT l.root, e.peer AS node,
    min(l.route || ',' || CAST(e.peer AS VARCHAR)) AS route
  FROM l{depth - 1} l JOIN links e ON l.node = e.owner
  ANTI JOIN ({seen}) s ON s.root = l.root AND s.node = e.peer
  GROUP BY l.root, e.peer)""")
    levels = " UNION ALL ".join(
        f"SELECT root, node, route, {i} AS depth FROM l{i}" for i in range(MAX_HOPS + 1)
    )
    parts.append(f"""
levels AS MATERIALIZED ({levels}),
widths AS (SELECT root, depth, count(*) AS width FROM levels GROUP BY root, depth),
lengths AS (SELECT p.src, p.dst, l.depth AS hops FROM pairs p
  LEFT JOIN levels l ON l.root = p.src AND l.node = p.dst),
t0 AS (SELECT src, dst, hops, 0 AS a, 0 AS b, true AS on_a FROM lengths WHERE hops > 0)""")
    for turn in range(1, MAX_HOPS + 1):
        parts.append(f"""
t{turn} AS (SELECT t.src, t.dst, hops,
  CASE WHEN hops >= {turn} AND wa.width <= wb.width THEN a + 1 ELSE a END AS a,
  CASE WHEN hops >= {turn} AND wa.width > wb.width THEN b + 1 ELSE b END AS b,
  CASE WHEN hops >= {turn} THEN wa.width <= wb.width ELSE on_a END AS on_a
  FROM t{turn - 1} t JOIN widths wa ON wa.root = t.src AND wa.depth = t.a
  JOIN widths wb ON wb.root = t.dst AND wb.depth = t.b)""")
    parts.append(f"""
met AS (SELECT t.src, t.dst,
  arg_min(x.route, CASE WHEN on_a THEN x.route ELSE y.route END) AS head,
  arg_min(y.route, CASE WHEN on_a THEN x.route ELSE y.route END) AS tail
  FROM t{MAX_HOPS} t JOIN levels x ON x.root = t.src AND x.depth = t.a
  JOIN levels y ON y.root = t.dst AND y.depth = t.b AND y.node = x.node
  GROUP BY t.src, t.dst),
routes AS (SELECT src, dst, string_split(head, ',') ||
    list_reverse(string_split(tail, ','))[2:] AS route FROM met
  UNION ALL SELECT src, dst, [CAST(src AS VARCHAR)] FROM lengths WHERE hops = 0)""")
    return ",".join(parts)


# --- contact graphs -----------------------------------------------------------------------------


def _ego(limit: int, cap: int) -> str:
    def pulled(step: int, picks: str, before: str) -> str:
        return f"""
pulled{step} AS (SELECT p.seed, t.* FROM {picks} p JOIN top t ON t.owner = p.id),
before{step} AS (SELECT seed, id, bool_or(expanded) AS expanded, max(shown) AS shown,
  max(total) AS total FROM ({before}
  SELECT seed, owner AS id, true AS expanded, shown, total FROM pulled{step}
  WHERE position = 1) GROUP BY seed, id),
placed{step} AS (SELECT q.*, k.id IS NOT NULL AS known, z.size,
  sum(CASE WHEN k.id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY q.seed ORDER BY q.position)
    AS arrival
  FROM pulled{step} q LEFT JOIN before{step} k ON k.seed = q.seed AND k.id = q.peer
  JOIN (SELECT seed, count(*) AS size FROM before{step} GROUP BY seed) z ON z.seed = q.seed),
step{step} AS (SELECT *, known OR arrival + size <= {cap} AS kept FROM placed{step}),
nodes{step} AS (SELECT seed, id, bool_or(expanded) AS expanded, max(shown) AS shown,
  max(total) AS total FROM (SELECT * FROM before{step} UNION ALL
  SELECT seed, peer, false, 0, 0 FROM step{step} WHERE kept AND NOT known) GROUP BY seed, id)"""

    order = "dur DESC, sms DESC, CAST(peer AS VARCHAR)"
    return (
        _with(_CDR, _LINKS)
        + f""",
top AS (SELECT owner, peer, dur, sms, cnt, position, least(total, {limit}) AS shown, total FROM
  (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY {order}) AS position,
    count(*) OVER (PARTITION BY owner) AS total FROM links) WHERE position <= {limit}),
picks0 AS (SELECT DISTINCT owner AS seed, owner AS id FROM links),"""
        + pulled(0, "picks0", "")
        + f""",
picks1 AS (SELECT h.seed, h.id FROM (SELECT owner AS seed, peer AS id,
    row_number() OVER (PARTITION BY owner ORDER BY {order}) AS position
    FROM links WHERE owner <> peer) h
  JOIN (SELECT seed, count(*) AS size FROM nodes0 GROUP BY seed) z ON z.seed = h.seed
  WHERE h.position = 1 AND z.size < {cap}),"""
        + pulled(1, "picks1", "SELECT * FROM nodes0 UNION ALL")
        + """,
nodes AS (SELECT seed, CAST(id AS VARCHAR) AS id, bool_or(expanded) AS expanded,
  CAST(max(shown) AS BIGINT) AS shown, CAST(max(total) AS BIGINT) AS total
  FROM (SELECT * FROM nodes0 UNION ALL SELECT * FROM nodes1) GROUP BY seed, id),
edges AS (SELECT seed, least(CAST(owner AS VARCHAR), CAST(peer AS VARCHAR)) AS a,
  greatest(CAST(owner AS VARCHAR), CAST(peer AS VARCHAR)) AS b,
  max(dur) AS duration, max(cnt) AS calls, max(sms) AS sms
  FROM (SELECT * FROM step0 UNION ALL SELECT * FROM step1) WHERE kept GROUP BY ALL),
refused AS (SELECT seed, CAST(0 AS INTEGER) AS step, count(*) AS refused FROM step0
  WHERE NOT kept GROUP BY seed
  UNION ALL SELECT seed, 1, count(*) FROM step1 WHERE NOT kept GROUP BY seed)
"""
    ).replace("\n,\n", ",\n")


# --- damaged lines -------------------------------------------------------------------------------


def _line_fields(imsi: str = "imsi", usage: str = "usage", day: str = "") -> str:
    day = day or "strftime(call_time, '%d/%m/%Y')"

    def optional(name: str) -> str:
        return f"CASE WHEN {name} = 0 THEN '' ELSE CAST({name} AS VARCHAR) END"

    return (
        f"concat_ws('|', CAST(sequence AS VARCHAR), CAST({imsi} AS VARCHAR), '', {usage}, "
        f"CAST(msisdn AS VARCHAR), {day}, strftime(call_time, '%H:%M:%S'), "
        f"CAST(duration AS VARCHAR), {optional('bytes_rx')}, {optional('bytes_tx')}, '', "
        f"{optional('peer_msisdn')})"
    )


_KEPT = """
kept AS (SELECT * FROM cdr WHERE event_id % 29 > 3)"""

# --- samples ---------------------------------------------------------------------------------------

_SO_FAR = "OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_SAMPLES = f"""
timed AS (SELECT *, (CAST(floor(epoch(call_time) / 3600) AS BIGINT) + 1) * 3600 AS hour_end FROM cdr),
hourly AS (SELECT hour_end AS ts, {_TOTAL_COLUMNS} FROM timed GROUP BY hour_end),
arrived AS (SELECT ts, count(*) AS n FROM (SELECT msisdn, min(hour_end) AS ts FROM timed
  WHERE msisdn <> 0 GROUP BY msisdn) GROUP BY ts),
samples AS (SELECT h.ts, CAST(coalesce(sum(n) {_SO_FAR.replace('ts', 'h.ts')}, 0) AS BIGINT) AS keys,
  {', '.join(f"CAST(sum({c}) {_SO_FAR.replace('ts', 'h.ts')} AS BIGINT) AS {c}"
             for c in TOTAL_COUNTERS)}
  FROM hourly h LEFT JOIN arrived a ON a.ts = h.ts),
clock AS (SELECT max(ts) AS now FROM samples)"""
_WITH_SAMPLES = _with(_CDR, _SAMPLES)
_WEEK = RETENTION_DAYS * 86400
_DAY = 86400


def _points(value: str, seconds: int) -> str:
    return (
        _WITH_SAMPLES + f"SELECT ts, {value} AS value FROM samples "
        f"WHERE ts >= (SELECT now FROM clock) - {seconds}"
    )


def _rates(values: dict[str, str], seconds: int, lag: int) -> str:
    """CTEs up to ``rates(ts, <names>)``."""
    listed = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in values.items())
    changes = ", ".join(
        f"greatest(0.0, r.{n} - p.{n}) / CAST(r.ts - p.ts AS DOUBLE) AS {n}" for n in values
    )
    return (
        _WITH_SAMPLES
        + f""",
since AS (SELECT now - {seconds} AS since FROM clock),
fetched AS (SELECT ts, {listed} FROM samples WHERE ts >= coalesce(
  (SELECT max(ts) FROM samples WHERE ts < (SELECT since - {lag} FROM since)),
  (SELECT min(ts) FROM samples))),
based AS (SELECT r.ts, coalesce(max(o.ts), (SELECT min(ts) FROM fetched)) AS base
  FROM fetched r LEFT JOIN fetched o ON o.ts <= r.ts - {lag} GROUP BY r.ts),
rates AS (SELECT r.ts, {changes} FROM fetched r JOIN based b ON b.ts = r.ts
  JOIN fetched p ON p.ts = b.base
  WHERE r.ts > p.ts AND r.ts >= (SELECT since FROM since))
""".replace("\n,\n", ",\n")
    )


def _mix(values: dict[str, str], labels: dict[str, str], seconds: int, lag: int) -> str:
    total = " + ".join(values)
    rows = " UNION ALL ".join(
        f"SELECT ts, '{label}' AS label, m[{i + 1}] AS share FROM carried"
        for i, label in enumerate(labels.values())
    )
    return (
        _rates(values, seconds, lag)
        + f""",
mixes AS (SELECT ts, CASE WHEN {total} > 0 THEN
  [{', '.join(f'{n} / ({total})' for n in values)}] END AS m FROM rates),
carried AS (SELECT * FROM (SELECT ts, last_value(m IGNORE NULLS) OVER (ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM mixes) WHERE m IS NOT NULL)
SELECT ts, label, share FROM ({rows})""".replace("\n,\n", ",\n")
    )


_CALLS = {
    "calls": "moc_cnt + mtc_cnt", "noans-cnt": "noans_cnt", "busy-cnt": "busy_cnt",
    "failed-cnt": "failed_cnt",
}


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {
        "subscriber_usage": _with(_CDR, _SUB) + "SELECT * FROM sub",
        "operator_traffic": _with(_CDR, _OP) + "SELECT * FROM op",
        "links": _with(_CDR, _LINKS) + "SELECT * FROM links",
        "totals": _with(_CDR, _TOTALS) + "SELECT * FROM totals",
        "totals_document": _with(_CDR, _TOTALS) + "SELECT CAST(to_json({"
        + ", ".join(f"'{c.replace('_', '-')}': {c}" for c in TOTAL_COUNTERS)
        + "}) AS VARCHAR) AS document FROM totals",
        "merge_deltas": _with(_CDR, _SUB) + "SELECT * FROM sub",
        "board_positions": _ALL_BOARDS + "SELECT board, id, score, position FROM placed",
        "board_counts": _ALL_BOARDS + "SELECT board, count(*) AS count FROM boards GROUP BY board",
        "board_leader_share": _ALL_BOARDS
        + """SELECT position, id, score,
  CAST(score AS DOUBLE) / CAST(max(score) OVER () AS DOUBLE) AS of_leader
FROM placed WHERE board = 'voice' AND position > 5 AND position <= 25""",
        "suggestions": _with(_CDR, _SUB, _OP, _BOARDS, _PLACED, _LINKS)
        + """SELECT p.position, p.id, p.score, CAST(h.peer AS VARCHAR) AS peer FROM placed p
LEFT JOIN (SELECT owner, peer, row_number() OVER (PARTITION BY owner
  ORDER BY dur DESC, sms DESC, CAST(peer AS VARCHAR)) AS r FROM links) h
  ON CAST(h.owner AS VARCHAR) = p.id AND h.r = 1
WHERE p.board = 'voice' AND p.position <= 5""",
        "subscriber_lookup": _with(_CDR, _SUB, _LINKS)
        + """SELECT CAST(msisdn AS VARCHAR) AS msisdn, voice_out AS "voice-out",
  voice_in AS "voice-in", data_tx AS "data-out", data_rx AS "data-in", sms_out AS "sms-out",
  sms_in AS "sms-in", noans AS "no-answer", busy, failed
FROM sub WHERE msisdn IN (SELECT owner FROM links)""",
        "subscriber_missing": _with(_CDR, _SUB, _LINKS)
        + """SELECT DISTINCT owner AS msisdn FROM links
WHERE owner NOT IN (SELECT msisdn FROM sub)""",
        "operator_lookup": _with(_CDR, _OP)
        + """SELECT CAST(mccmnc AS VARCHAR) AS mccmnc, voice_out AS "voice-out",
  voice_in AS "voice-in", sms_out AS "sms-out", sms_in AS "sms-in" FROM op""",
        "link_lookup": _with(_CDR, _SUB, _LINKS)
        + """SELECT CAST(owner AS VARCHAR) AS "first-party", CAST(peer AS VARCHAR) AS "second-party",
  dur AS duration, cnt AS calls, sms FROM links JOIN sub ON owner = msisdn AND peer = msisdn + 1""",
        "peers": _peer_page(None, 0, 100),
        "peers_by_duration": _peer_page("dur", 0, 100),
        "peers_by_sms": _peer_page("sms", 1, 3),
        "peers_whole_list": _peer_page("dur", 0, None),
        "peer_counts": _with(_CDR, _LINKS)
        + "SELECT owner, count(*) AS count FROM links GROUP BY owner",
        "heaviest_peers": _with(_CDR, _LINKS)
        + """SELECT owner, position, peer, dur, sms, cnt FROM (SELECT *, row_number() OVER
  (PARTITION BY owner ORDER BY dur DESC, sms DESC, CAST(peer AS VARCHAR)) AS position FROM links)
WHERE position <= 3""",
        "dashboard_sums": _with(_CDR, _TOTALS)
        + """SELECT moc_cnt + mtc_cnt AS calls, sms_mo_cnt + sms_mt_cnt AS messages,
  data_rx + data_tx AS "data-vol", noans_cnt + busy_cnt + failed_cnt AS failures FROM totals""",
        "dashboard_ratios": _with(_CDR, _TOTALS)
        + """SELECT CAST(noans_cnt + busy_cnt + failed_cnt AS DOUBLE) / nullif(records, 0) AS "fail-share",
  CAST(moc_dur AS DOUBLE) / nullif(moc_cnt, 0) AS "avg-moc-dur",
  CAST(mtc_dur AS DOUBLE) / nullif(mtc_cnt, 0) AS "avg-mtc-dur",
  CAST(data_dur AS DOUBLE) / nullif(data_cnt, 0) AS "avg-data-dur" FROM totals""",
        "usage_mix": _with(_CDR, _TOTALS)
        + "SELECT usage, value, CAST(value AS DOUBLE) / CAST(sum(value) OVER () AS DOUBLE) AS share "
        + "FROM (" + " UNION ALL ".join(
            f"SELECT '{label}' AS usage, {name} AS value FROM totals"
            for name, label in USAGE_BANDS.items()
        ) + ")",
        "operator_share": _with(_CDR, _OP, _TOTALS)
        + """SELECT mccmnc, voice_out + voice_in AS voice,
  CAST(voice_out + voice_in AS DOUBLE) / nullif((SELECT moc_dur + mtc_dur FROM totals), 0) AS share
FROM op""",
        "link_average_call": _with(_CDR, _LINKS)
        + "SELECT owner, peer, dur, cnt, CAST(dur AS DOUBLE) / nullif(cnt, 0) AS average_call "
        + "FROM links",
        "voice_per_peer": _with(_CDR, _SUB, _LINKS)
        + """SELECT msisdn, voice_out + voice_in AS voice, peers,
  CAST(voice_out + voice_in AS DOUBLE) / peers AS voice_per_peer
FROM sub JOIN (SELECT owner, count(*) AS peers FROM links GROUP BY owner) ON owner = msisdn
WHERE voice_out + voice_in > 0""",
        "failure_against_store": _with(_CDR, _SUB, _TOTALS)
        + """SELECT msisdn, noans + busy + failed AS failures,
  (SELECT CAST(noans_cnt + busy_cnt + failed_cnt AS DOUBLE) / nullif(records, 0) FROM totals)
    AS store_failure_share, voice_out + voice_in AS voice FROM sub""",
        "cdr_lines": _with(_CDR) + f"SELECT {_line_fields()} AS value FROM cdr",
        "parse_records": _with(_CDR, _KEPT)
        + """SELECT 'events' AS source, sequence, imsi, '' AS imei, usage, msisdn,
  date_trunc('second', call_time) AS call_time, duration, bytes_rx, bytes_tx,
  CAST(0 AS BIGINT) AS peer_imsi, peer_msisdn FROM kept""",
        "parse_rejects": _with(_CDR)
        + f"""SELECT 'events' AS source, CASE event_id % 29
  WHEN 0 THEN {_line_fields(usage="'Q'")}
  WHEN 1 THEN regexp_replace({_line_fields()}, '[|][^|]*$', '')
  WHEN 2 THEN {_line_fields(day="'32/01/2024'")}
  ELSE {_line_fields(imsi="'4250205284090100'")} END AS line,
  CASE event_id % 29 WHEN 0 THEN 'bad_usage' WHEN 1 THEN 'field_count' WHEN 2 THEN 'bad_time'
  ELSE 'bad_imsi' END AS reject_reason
FROM cdr WHERE event_id % 29 <= 3""",
        "reconcile_totals": _with(_CDR, _KEPT, _TOTALS)
        + f""", read_back AS (SELECT {_TOTAL_COLUMNS} FROM kept)
"""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS field, t.{c} AS emitted, r.{c} AS consumed, t.{c} - r.{c} AS difference "
            "FROM totals t, read_back r"
            for c in TOTAL_COUNTERS
        ),
        "header_check": _with(_CDR)
        + """SELECT true AS ok, count(*) AS declared, count(*) FILTER (WHERE event_id % 29 > 3) AS parsed,
  count(*) FILTER (WHERE event_id % 29 <= 3) AS rejected FROM cdr
UNION ALL SELECT DISTINCT false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
FROM cdr WHERE event_type = 'error'""",
        "progress_marks": _with(_CDR)
        + "SELECT usage AS source, max(sequence) AS seq FROM cdr GROUP BY usage",
        "resume_filter": _with(_CDR)
        + """SELECT usage AS source, sequence, msisdn, usage FROM (SELECT *,
  CASE WHEN usage = 'X' THEN 0 ELSE max(sequence) OVER (PARTITION BY usage) // 2 END AS mark
  FROM cdr) WHERE sequence > mark""",
        "stream_totals": _with(_CDR, _TOTALS) + "SELECT * FROM totals",
        "stream_subscriber_usage": _with(_CDR, _SUB) + "SELECT * FROM sub",
        "ingested_links": _with(_CDR, _KEPT, _links("kept")) + "SELECT * FROM links",
        "merged_operators": _with(_CDR, _OP) + "SELECT * FROM op",
        "merged_totals": _with(_CDR, _TOTALS) + "SELECT * FROM totals",
        "run_totals": _with(_CDR) + f"SELECT {_TOTAL_COLUMNS} FROM cdr WHERE usage IN ('MOC', 'MTC')",
        "restarted_totals": _with(_CDR, _TOTALS) + "SELECT * FROM totals",
        "stream_bodies": _with(_CDR, _KEPT) + "SELECT count(*) AS parsed FROM kept",
        "file_outcomes": _with(_CDR, _KEPT)
        + """SELECT way, kind, kind = 'good' AS ok, kind = 'good' AS any_ok,
  (SELECT count(*) FROM kept) AS records
FROM (SELECT unnest(['good', 'headless', 'empty', 'unreadable']) AS kind), (SELECT unnest(['batch', 'stream']) AS way)""",
        "replayed_totals": _with(_CDR, _TOTALS)
        + "SELECT *, unnest(['files', 'messages']) AS feed FROM totals",
        "live_subscriber_usage": _with(_CDR, _SUB) + "SELECT * FROM sub",
        "written_files": _with(_CDR)
        + "SELECT count(*) AS declared, true AS headed, count(*) AS read_back FROM cdr",
        "board_deep_page": _ALL_BOARDS
        + "SELECT position, id, score FROM placed "
        "WHERE board = 'voice' AND position > 5 AND position <= 605",
        "export_read_back": _ALL_BOARDS
        + "SELECT position, id, score FROM placed WHERE board = 'voice'",
        "parse_other_separator": _with(_CDR, _TOTALS) + "SELECT * FROM totals",
        "parse_other_format": _with(_CDR, _TOTALS) + "SELECT * FROM totals",
    }
    for name in (*SUBSCRIBER_BOARDS, *OPERATOR_BOARDS):
        sql["top_" + name.replace("-", "_")] = (
            _ALL_BOARDS + "SELECT position, id, score FROM placed "
            f"WHERE board = '{name}' AND position <= 20"
        )

    sql["board_document"] = _ALL_BOARDS + """SELECT CAST(to_json({'board': 'data', 'count':
  (SELECT count(*) FROM placed WHERE board = 'data'), 'offset': 2, 'limit': 10,
  'entries': list({'id': id, 'score': score} ORDER BY position)}) AS VARCHAR) AS document
FROM placed WHERE board = 'data' AND position > 2 AND position <= 12"""
    sql["peer_documents"] = _with(_CDR, _LINKS) + """SELECT CAST(owner AS VARCHAR) AS owner,
  CAST(to_json({'msisdn': CAST(owner AS VARCHAR), 'count': count(*), 'offset': 2, 'limit': 2,
    'sort': 'dur', 'peers': coalesce(list({'msisdn': CAST(peer AS VARCHAR), 'duration': dur,
    'calls': cnt, 'sms': sms} ORDER BY position) FILTER (WHERE position IN (3, 4)), [])})
  AS VARCHAR) AS document
FROM (SELECT *, row_number() OVER (PARTITION BY owner
  ORDER BY dur DESC, sms DESC, CAST(peer AS VARCHAR)) AS position FROM links) GROUP BY owner"""

    keys = _with(_CDR, _SUB, _OP, _BOARDS, _LINKS) + """, keys AS (
SELECT 'subscribers' AS kind, count(*) AS keys FROM sub
UNION ALL SELECT 'operators', count(*) FROM op
UNION ALL SELECT 'links', count(DISTINCT owner) FROM links
UNION ALL SELECT 'boards', count(DISTINCT board) FROM boards
UNION ALL SELECT 'totals', least(count(*), 1) FROM cdr
UNION ALL SELECT 'progress', least(count(*), 1) FROM cdr)
"""
    sql["store_keys"] = keys + "SELECT kind, CAST(keys AS BIGINT) AS keys FROM keys"
    held = f"(SELECT CAST(sum(keys) AS BIGINT) FROM keys) AS keys, {_TOTAL_COLUMNS}"
    # Records that come in as files have the name of their file as source, so there is progress.
    sql["sampled_store"] = keys + f"SELECT CAST(1000 AS BIGINT) AS ts, {held} FROM cdr"
    sql["quiet_feed_samples"] = keys + f"SELECT {held}, CAST(0 AS DOUBLE) AS rate FROM cdr"
    sql["health"] = keys + f"""SELECT 'ok' AS status, 'up' AS store,
CAST(sum(keys) AS BIGINT) AS keys, {MAX_HOPS} AS "max-hops", {MAX_VISITED} AS "max-visited"
FROM keys"""

    searched = _with(_CDR, _LINKS, _path_parts())
    sql["path_lengths"] = (
        searched + "SELECT src, dst, hops IS NOT NULL AS found, hops FROM lengths"
    )
    sql["path_routes"] = (
        searched + "SELECT src, dst, array_to_string(route, ',') AS route FROM routes"
    )
    sql["path_hops"] = searched + """, steps AS (SELECT src, dst, unnest(range(len(route) - 1)) AS hop, route FROM routes)
SELECT src, dst, CAST(hop AS INTEGER) AS hop, route[hop + 1] AS "from", route[hop + 2] AS "to",
  coalesce(dur, 0) AS duration, coalesce(cnt, 0) AS calls, coalesce(sms, 0) AS sms
FROM steps LEFT JOIN links ON CAST(owner AS VARCHAR) = route[hop + 1]
  AND CAST(peer AS VARCHAR) = route[hop + 2]"""

    graph, small = _ego(50, 500), _ego(*SMALL_GRAPH)
    sql["ego_nodes"] = graph + "SELECT * FROM nodes"
    sql["ego_edges"] = graph + "SELECT * FROM edges"
    sql["ego_full_nodes"] = small + "SELECT * FROM nodes"
    sql["ego_full_edges"] = small + "SELECT * FROM edges"
    sql["ego_refused"] = small + "SELECT * FROM refused"
    sql["node_strength"] = graph + """SELECT seed, id, CAST(sum(duration) AS BIGINT) AS strength
FROM (SELECT seed, a AS id, duration FROM edges UNION ALL SELECT seed, b, duration FROM edges)
GROUP BY seed, id"""
    sql["remove_nodes"] = graph + """SELECT * FROM edges
WHERE a <> CAST(seed + 1 AS VARCHAR) AND b <> CAST(seed + 1 AS VARCHAR)"""

    names = ", ".join(("ts", "keys") + TOTAL_COUNTERS)
    sql["series_samples"] = _WITH_SAMPLES + f"SELECT {names} FROM samples"
    sql["series_counter"] = _points("CAST(records AS DOUBLE)", _WEEK)
    sql["series_sum"] = _points("CAST(data_rx + data_tx AS DOUBLE)", _DAY)
    sql["series_ratio"] = _points(
        "CAST(noans_cnt + busy_cnt + failed_cnt AS DOUBLE) / nullif(records, 0)", _WEEK
    )
    sql["series_rate"] = (
        _rates({"value": "moc_cnt + mtc_cnt"}, _WEEK, 60) + "SELECT ts, value FROM rates"
    )
    sql["series_rate_lagged"] = (
        _rates({"value": "records"}, _DAY, LONG_LAG) + "SELECT ts, value FROM rates"
    )
    sql["series_downsample"] = _WITH_SAMPLES + """, numbered AS (SELECT ts, keys, records,
  row_number() OVER (ORDER BY ts) - 1 AS spot, count(*) OVER () AS n FROM samples)
SELECT ts, keys, records FROM numbered WHERE n <= 100 OR spot IN (
  SELECT least(n - 1, CAST(floor((i + 1) * (n / 100.0::DOUBLE)) AS BIGINT) - 1)
  FROM (SELECT count(*) AS n FROM samples), (SELECT unnest(range(100)) AS i))"""
    sql["series_window_rows"] = _WITH_SAMPLES + """SELECT ts, records FROM samples WHERE ts >= coalesce(
  (SELECT max(ts) FROM samples WHERE ts < (SELECT now - 21600 FROM clock)),
  (SELECT now - 21600 FROM clock))"""
    sql["series_latest"] = (
        _WITH_SAMPLES + f"SELECT {names} FROM samples WHERE ts = (SELECT now FROM clock)"
    )
    sql["series_last_value"] = (
        _rates({"value": "sms_mo_cnt + sms_mt_cnt"}, _WEEK, 60)
        + "SELECT max(ts) AS ts, arg_max(value, ts) AS value FROM rates"
    )
    sql["series_retention"] = _WITH_SAMPLES + f"""SELECT count(*) AS rows, min(ts) AS oldest,
max(ts) AS newest FROM samples WHERE ts >= (SELECT now - {_WEEK} FROM clock)"""
    sql["usage_mix_over_time"] = _mix(
        {name: name for name in USAGE_BANDS}, USAGE_BANDS, _DAY, LONG_LAG
    )
    sql["outcome_mix_over_time"] = _mix(
        {n.replace("-", "_"): v for n, v in _CALLS.items()}, OUTCOME_BANDS, _WEEK, 60
    )
    return sql
