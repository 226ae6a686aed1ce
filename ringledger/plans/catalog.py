"""Registered queries over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.functions.columns import as_json
from ringledger.functions.workspace import cut, fresh_path
from ringledger.operators import (
    boards,
    contacts,
    counters,
    documents,
    ego,
    lookups,
    paths,
    series,
    summary,
)
from ringledger.plans.store import Store
from ringledger.schema import (
    MAX_HOPS,
    MAX_VISITED,
    OPERATOR_BOARDS,
    SUBSCRIBER_BOARDS,
    SUBSCRIBER_COUNTERS,
    SUGGESTIONS,
)
from ringledger.sources import exports, files, lines
from ringledger.sources.tables import event_records, events
from ringledger.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: Distances between the ids of the pairs whose paths are asked for, from every owner.
PAIR_STEPS = (0, 1, 4, 7, 12, 17, 18, 19, 40)
#: Seconds a rate looks back over hourly samples, beside the default.
LONG_LAG = 7200
#: A small expand limit and node cap, at which graphs of this data do fill up.
SMALL_GRAPH = (3, 5)

_queries: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_queries)


# --- counters --------------------------------------------------------------------------------


@query
def subscriber_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.subscriber_usage(event_records(spark, sf_dir))


@query
def operator_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.operator_traffic(event_records(spark, sf_dir))


@query
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.contact_links(event_records(spark, sf_dir))


@query
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.totals(event_records(spark, sf_dir))


@query
def totals_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(lookups.totals_report(totals(spark, sf_dir)))


@query
def merge_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of calls and of everything else, merged, are the counters of all."""
    records = event_records(spark, sf_dir)
    voice = F.col("usage").isin("MOC", "MTC")
    return counters.merge_subscribers(
        counters.subscriber_sums(records.filter(voice)),
        counters.subscriber_sums(records.filter(~voice)),
    )


def _voice_and_rest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = event_records(spark, sf_dir)
    voice = F.col("usage").isin("MOC", "MTC")
    return records.filter(voice), records.filter(~voice)


@query
def merged_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _voice_and_rest(spark, sf_dir)
    return counters.merge_operators(*(counters.operator_sums(p) for p in parts))


@query
def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.merge_totals(*(counters.totals(p) for p in _voice_and_rest(spark, sf_dir)))


# --- boards -----------------------------------------------------------------------------------


def _board(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return boards.board(name, subscriber_usage(spark, sf_dir), operator_traffic(spark, sf_dir))


def _register_top(name: str) -> None:
    def top(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boards.board_page(_board(spark, sf_dir, name))

    _queries["top_" + name.replace("-", "_")] = top


for _name in (*SUBSCRIBER_BOARDS, *OPERATOR_BOARDS):
    _register_top(_name)


def _all_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.all_boards(subscriber_usage(spark, sf_dir), operator_traffic(spark, sf_dir))


@query
def board_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.board_positions(_all_boards(spark, sf_dir))


@query
def board_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long page that starts below the first entries."""
    return boards.board_page(_board(spark, sf_dir, "voice"), 5, 600)


@query
def board_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_boards(spark, sf_dir).groupBy("board").agg(F.count("*").alias("count"))


@query
def board_leader_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.leader_share(boards.board_page(_board(spark, sf_dir, "voice"), 5, 20))


@query
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.suggestions(
        _board(spark, sf_dir, "voice"), links(spark, sf_dir), SUGGESTIONS
    )


# --- lookups and peers -----------------------------------------------------------------------


def _link_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select(F.col("owner").alias("msisdn")).distinct()


@query
def subscriber_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.subscriber_report(
        subscriber_usage(spark, sf_dir), _link_owners(spark, sf_dir)
    )


@query
def subscriber_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are in links but were never seen as subscriber."""
    return lookups.missing(
        subscriber_usage(spark, sf_dir), _link_owners(spark, sf_dir), ["msisdn"]
    )


@query
def operator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = event_records(spark, sf_dir).select(
        F.expr("imsi div 10000000000").cast("int").alias("mccmnc")
    )
    return lookups.operator_report(operator_traffic(spark, sf_dir), keys)


@query
def link_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of each subscriber and the next id, where there is one."""
    pairs = subscriber_usage(spark, sf_dir).select(
        F.col("msisdn").alias("owner"), (F.col("msisdn") + 1).alias("peer")
    )
    return lookups.link_report(links(spark, sf_dir), pairs)


@query
def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.peer_page(links(spark, sf_dir))


@query
def peers_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.peer_page(links(spark, sf_dir), sort="dur")


@query
def peers_by_sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.peer_page(links(spark, sf_dir), sort="sms", offset=1, limit=3)


@query
def peers_whole_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.peer_page(links(spark, sf_dir), sort="dur", limit=0)


@query
def peer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.peer_counts(links(spark, sf_dir))


@query
def heaviest_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.heaviest_peers(links(spark, sf_dir), 3).select(
        "owner", F.col("position").cast("bigint").alias("position"), "peer", "dur", "sms", "cnt"
    )


def _store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscribers, operators = subscriber_usage(spark, sf_dir), operator_traffic(spark, sf_dir)
    return lookups.store_keys(
        subscribers, operators, links(spark, sf_dir), totals(spark, sf_dir),
        files.progress_marks(event_records(spark, sf_dir)),
    )


@query
def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_keys(spark, sf_dir)


@query
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.health(_store_keys(spark, sf_dir), MAX_HOPS, MAX_VISITED)


@query
def board_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.board_document("data", _board(spark, sf_dir, "data"), 2, 10)


@query
def peer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of two peers of every owner, empty where there are no more."""
    return documents.peer_documents(links(spark, sf_dir), None, "dur", 2, 2)


# --- sums, ratios, shares ---------------------------------------------------------------------


@query
def dashboard_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dashboard_sums(totals(spark, sf_dir))


@query
def dashboard_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dashboard_ratios(totals(spark, sf_dir))


@query
def usage_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.usage_mix(totals(spark, sf_dir))


@query
def operator_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.operator_share(operator_traffic(spark, sf_dir), totals(spark, sf_dir))


@query
def link_average_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.average_call(links(spark, sf_dir))


@query
def voice_per_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.voice_per_peer(subscriber_usage(spark, sf_dir), links(spark, sf_dir))


@query
def failure_against_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.failure_against_store(subscriber_usage(spark, sf_dir), totals(spark, sf_dir))


# --- paths --------------------------------------------------------------------------------------


def _paths(contact: DataFrame) -> DataFrame:
    """Paths from every owner to the ids at the given distances, some of them unknown."""
    pairs = (
        contact.select(F.col("owner").alias("src"))
        .distinct()
        .withColumn("step", F.explode(F.array(*[F.lit(k) for k in PAIR_STEPS])))
        .select("src", (F.col("src") + F.col("step")).alias("dst"))
    )
    return paths.shortest_paths(contact, pairs)


def _contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(links(spark, sf_dir), "links")


@query
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_contact(spark, sf_dir)).select("src", "dst", "found", "hops")


@query
def path_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _paths(_contact(spark, sf_dir)).filter("found")
    return found.select("src", "dst", F.concat_ws(",", "route").alias("route"))


@query
def path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    contact = _contact(spark, sf_dir)
    return paths.path_hops(_paths(contact), contact)


# --- contact graphs -----------------------------------------------------------------------------


def _graphs(spark: SparkSession, sf_dir: str, limit: int, cap: int):
    """The graph around every owner, its heaviest other peer expanded too."""
    contact = _contact(spark, sf_dir)
    seeds = contact.select(F.col("owner").alias("seed")).distinct()
    first = seeds.select("seed", F.lit(0).alias("step"), F.col("seed").alias("id"))
    heaviest = contacts.heaviest_peers(contact.filter("owner != peer"), 1)
    second = heaviest.select(
        F.col("owner").alias("seed"), F.lit(1).alias("step"), F.col("peer").alias("id")
    )
    return ego.ego_network(contact, first.unionByName(second), 2, "dur", limit, cap)


@query
def ego_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir, 50, 500)[0]


@query
def ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir, 50, 500)[1]


@query
def ego_full_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir, *SMALL_GRAPH)[0]


@query
def ego_full_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir, *SMALL_GRAPH)[1]


@query
def ego_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graphs(spark, sf_dir, *SMALL_GRAPH)[2]


@query
def node_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.node_strength(_graphs(spark, sf_dir, 50, 500)[1])


@query
def remove_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left after each graph loses the id next to its seed."""
    nodes, edges, _ = _graphs(spark, sf_dir, 50, 500)
    gone = nodes.select("seed", (F.col("seed") + 1).cast("string").alias("id")).distinct()
    return ego.remove_nodes(nodes, edges, gone)[1]


# --- lines and files ------------------------------------------------------------------------------


@query
def cdr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.to_lines(event_records(spark, sf_dir))


def _damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all events, some of them broken in known ways, as a table of text."""
    intact = lines.to_lines(event_records(spark, sf_dir)).withColumn(
        "f", F.split("value", "\\|", -1)
    )
    kind = (F.col("f")[0].cast("bigint") - 1) % 29

    def put(i: int, text) -> Column:
        column = F.lit(text) if isinstance(text, str) else text
        return F.concat(F.slice("f", 1, i), F.array(column), F.slice("f", i + 2, 11 - i))

    fields = (
        F.when(kind == 0, put(3, "Q"))
        .when(kind == 1, F.slice("f", 1, 11))
        .when(kind == 2, put(5, "32/01/2024"))
        .when(kind == 3, put(1, "4250205284090100"))
        .otherwise(F.col("f"))
    )
    broken = intact.select(F.lit("events").alias("source"), F.concat_ws("|", fields).alias("value"))
    return cut(broken, "lines")


@query
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lines.records_of(lines.parse_lines(_damaged_lines(spark, sf_dir)))
    return good.withColumn("sequence", F.col("sequence").cast("bigint"))


@query
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.rejects_of(lines.parse_lines(_damaged_lines(spark, sf_dir)))


@query
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written against what could be read back of the damaged lines."""
    consumed = lines.records_of(lines.parse_lines(_damaged_lines(spark, sf_dir)))
    return counters.reconcile_totals(totals(spark, sf_dir), counters.totals(consumed))


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their usage code as source, so that there are several sources."""
    return event_records(spark, sf_dir).withColumn("source", F.col("usage"))


@query
def progress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = files.progress_marks(_feeds(spark, sf_dir))
    return marks.withColumn("seq", F.col("seq").cast("bigint"))


@query
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records left when each source but one was applied up to half its highest sequence."""
    feeds = _feeds(spark, sf_dir)
    applied = files.progress_marks(feeds.filter("source != 'X'")).select(
        "source", F.floor(F.col("seq") / 2).cast("decimal(20,0)").alias("seq")
    )
    return files.resume_filter(feeds, applied).select(
        "source", F.col("sequence").cast("bigint").alias("sequence"), "msisdn", "usage"
    )


def _record_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Files of all damaged lines with a header, and of all error events without one."""
    good, headless = fresh_path(spark, "feed"), fresh_path(spark, "headless")
    files.write_files(_damaged_lines(spark, sf_dir), good)
    failing = event_records(spark, sf_dir).join(
        events(spark, sf_dir)
        .filter("event_type = 'error'")
        .select((F.col("event_id") + 1).cast("decimal(20,0)").alias("sequence")),
        "sequence",
        "left_semi",
    )
    lines.to_lines(failing).write.option("lineSep", "\n").text(headless)
    return [good, headless]


@query
def header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per header outcome: what the headers declare, and the lines parsed and rejected."""
    staged = files.stage(files.scan_files(spark, _record_files(spark, sf_dir)))
    status = cut(files.with_marks(files.header_status(staged), None), "files")
    counted = files.accounting(files.admitted(staged, status))
    zero = F.lit(0).cast("bigint")
    return (
        status.join(counted, "source", "left")
        .groupBy("ok")
        .agg(
            F.coalesce(F.sum("declared_count").cast("bigint"), zero).alias("declared"),
            F.coalesce(F.sum("parsed"), zero).alias("parsed"),
            F.coalesce(F.sum("rejected"), zero).alias("rejected"),
        )
    )


# --- samples and series ---------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Hourly samples and the time of the last one, at which series are read."""
    held = cut(series.hourly_samples(event_records(spark, sf_dir)), "samples")
    return held, held.agg(F.max("ts")).first()[0] or 0


@query
def series_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hourly_samples(event_records(spark, sf_dir))


@query
def series_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.series(held, "records", "all", now)


@query
def series_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.series(held, "data-vol", "24h", now)


@query
def series_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.series(held, "fail-share", "all", now)


@query
def series_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.series(held, "calls:rate", "all", now)


@query
def series_rate_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.series(held, "records:rate", "24h", now, LONG_LAG)


@query
def series_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = _samples(spark, sf_dir)
    return series.downsample(held.select("ts", "keys", "records"), 100)


@query
def series_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.rows_since(held, series.window_start("6h", now)).select("ts", "records")


@query
def series_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest_sample(_samples(spark, sf_dir)[0])


@query
def series_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.last_value(series.series(held, "messages:rate", "all", now))


@query
def series_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.sample_stats(series.sweep(held, now))


@query
def usage_mix_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.usage_mix_over_time(held, "24h", now, LONG_LAG)


@query
def outcome_mix_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, now = _samples(spark, sf_dir)
    return series.outcome_mix_over_time(held, "all", now)


# --- ingest into a store ---------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str) -> Store:
    """A store filled by a file stream that runs until all files are folded."""
    store = Store(spark, fresh_path(spark, "store"))
    checkpoint = fresh_path(spark, "offsets")
    feeds = fresh_path(spark, "feed")
    files.write_files(lines.to_lines(event_records(spark, sf_dir)), feeds)
    ingest.ingest_file_stream(spark, feeds, store, checkpoint, max_files=100).awaitTermination()
    return store


@query
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).totals()


@query
def stream_subscriber_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).subscribers()


@query
def ingested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a store that took the damaged files and then the headless ones, compacted."""
    store = Store(spark, fresh_path(spark, "store"))
    for path in _record_files(spark, sf_dir):
        ingest.ingest_files(spark, path, store)
    store.compact()
    return store.links()


@query
def file_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of good, headless, empty and unreadable files, and the records that count, of a
    batch and of a stream."""
    feed = fresh_path(spark, "feeds")
    files.write_files(_damaged_lines(spark, sf_dir), f"{feed}/good")
    rows = lines.to_lines(event_records(spark, sf_dir))
    rows.write.option("lineSep", "\n").text(f"{feed}/headless")
    rows.limit(0).write.text(f"{feed}/empty")
    _damage(spark, f"{feed}/unreadable")
    found = None
    for way in ("batch", "stream"):
        store = Store(spark, fresh_path(spark, "store"))
        if way == "batch":
            ingest.ingest_files(spark, f"{feed}/*", store)
        else:
            checkpoint = fresh_path(spark, "offsets")
            ingest.ingest_file_stream(spark, f"{feed}/*", store, checkpoint).awaitTermination()
        kind = F.element_at(F.split("file_path", "/"), -2).alias("kind")
        one = store.files().groupBy(kind).agg(F.bool_and("ok").alias("ok"), F.bool_or("ok").alias("any_ok"))
        one = one.withColumns({"way": F.lit(way), "records": store.totals().select("records").scalar()})
        found = one if found is None else found.unionByName(one)
    return found


def _damage(spark: SparkSession, folder: str) -> None:
    """Put a file below ``folder`` that says it is compressed and is not."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/broken.gz")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(bytearray(b"CDR|csv|1 in plain text"))
    out.close()


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of one of two runs that one store took, after compaction."""
    store = Store(spark, fresh_path(spark, "store"))
    for run_id, records in zip(("voice", "rest"), _voice_and_rest(spark, sf_dir)):
        feed = fresh_path(spark, "feed")
        files.write_files(lines.to_lines(records), feed)
        ingest.ingest_files(spark, feed, store, run_id)
    store.compact()
    return store.totals("voice")


@query
def restarted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a stream that stopped after some files and went on with the rest."""
    store = Store(spark, fresh_path(spark, "store"))
    feed, checkpoint = fresh_path(spark, "feed"), fresh_path(spark, "offsets")
    for records in _voice_and_rest(spark, sf_dir):
        part = fresh_path(spark, "part")
        files.write_files(lines.to_lines(records), part)
        spark.read.option("lineSep", "\n").text(part).write.mode("append").option(
            "lineSep", "\n"
        ).text(feed)
        stream = spark.readStream.option("lineSep", "\n").text(feed)
        bodies = stream.filter("value NOT LIKE 'CDR|%'")
        ingest.ingest_stream(bodies, store, checkpoint).awaitTermination()
    return store.totals()


@query
def stream_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of one line each a store took, damaged ones among them."""
    store = Store(spark, fresh_path(spark, "store"))
    feed = fresh_path(spark, "feed")
    _damaged_lines(spark, sf_dir).select("value").write.option("lineSep", "\n").text(feed)
    stream = spark.readStream.option("lineSep", "\n").text(feed).withColumnRenamed("value", "body")
    query_ = ingest.ingest_stream(stream, store, fresh_path(spark, "offsets"), body="body")
    query_.awaitTermination()
    return store.accounts().select("parsed")


@query
def sampled_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a store's totals and inventory, taken twice in a second."""
    store = Store(spark, fresh_path(spark, "store"))
    feed = fresh_path(spark, "feed")
    files.write_files(lines.to_lines(event_records(spark, sf_dir)), feed)
    store.sample(1_000)
    ingest.ingest_files(spark, feed, store)
    store.sample(1_000)
    return store.samples()


@query
def quiet_feed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the clock while nothing is fed: what they all say, and the highest rate."""
    store = _streamed(spark, sf_dir)
    clock = ingest.sample_by_clock(store, fresh_path(spark, "clock"), 1)
    try:
        while store.samples().count() < 3 and clock.exception() is None:
            clock.awaitTermination(1)
    finally:
        clock.stop()
    held = cut(store.samples(), "samples")
    now = held.agg(F.max("ts")).first()[0]
    rates = series.series(held, "records:rate", "24h", now, 1)
    said = held.drop("ts").distinct()
    return said.withColumn("rate", rates.agg(F.max("value")).scalar())


class _Faulty(Store):
    """A store whose first manifest row is lost after the deltas were written."""

    failed = False

    def _commit(self, row: DataFrame, at: str) -> None:
        if not self.failed:
            self.failed = True
            raise OSError("the manifest could not be written")
        super()._commit(row, at)


@query
def replayed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of feeds whose batch failed between its deltas and its manifest row, and was
    replayed from the checkpoint; as files and as messages."""
    feed, bodies = fresh_path(spark, "feed"), fresh_path(spark, "bodies")
    rows = cut(lines.to_lines(event_records(spark, sf_dir)), "lines")
    files.write_files(rows, feed)
    rows.write.option("lineSep", "\n").text(bodies)
    found = None
    for kind in ("files", "messages"):
        store, checkpoint = _Faulty(spark, fresh_path(spark, "store")), fresh_path(spark, "offsets")

        def run() -> None:
            if kind == "files":
                stream = ingest.ingest_file_stream(spark, feed, store, checkpoint)  # noqa: B023
            else:
                messages = spark.readStream.option("lineSep", "\n").text(bodies)
                stream = ingest.ingest_stream(messages, store, checkpoint)  # noqa: B023
            stream.awaitTermination()

        try:
            run()
        except StreamingQueryException:
            run()
        one = store.totals().withColumn("feed", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return found


@query
def live_subscriber_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriber counters as a running aggregate that was stopped half-way and went on."""
    feed, out, checkpoint = (fresh_path(spark, x) for x in ("feed", "live", "offsets"))
    schema = ", ".join(["msisdn BIGINT", *(f"{c} BIGINT" for c in SUBSCRIBER_COUNTERS)])
    for records in _voice_and_rest(spark, sf_dir):
        lines.to_lines(records).write.mode("append").option("lineSep", "\n").text(feed)
        view = ingest.live_subscribers(spark.readStream.option("lineSep", "\n").text(feed))
        ingest.live_table(view, out, checkpoint).awaitTermination()
    return ingest.read_live(spark, out, schema, ["msisdn"])


# --- files and formats -------------------------------------------------------------------------


@query
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files read back: what their headers declare, the records, and whether every file
    has a header."""
    feed = fresh_path(spark, "feed")
    files.write_files(lines.to_lines(event_records(spark, sf_dir)), feed)
    status = files.header_status(files.scan_files(spark, feed))
    read = files.read_records(spark, feed).agg(F.count("*")).scalar()
    return status.agg(
        F.sum("declared_count").cast("bigint").alias("declared"), F.bool_and("ok").alias("headed")
    ).withColumn("read_back", read)


@query
def export_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole voice board through a CSV file."""
    path = fresh_path(spark, "export")
    page = boards.board_page(_board(spark, sf_dir, "voice"), 0, 0)
    exports.export_csv(page, path, exports.BOARD_EXPORT)
    return spark.read.option("header", True).schema("position bigint, id string, score bigint").csv(path)


@query
def parse_other_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.to_lines(event_records(spark, sf_dir))
    changed = rows.select(F.translate("value", "|", ";").alias("value"))
    return counters.totals(lines.records_of(lines.parse_lines(changed, separator=";")))


@query
def parse_other_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of lines in a format that was registered by name."""
    lines.register_format("tabs", lambda df, **options: lines.parse_lines(df, separator="\t"))
    rows = lines.to_lines(event_records(spark, sf_dir))
    changed = rows.select(F.translate("value", "|", "\t").alias("value"))
    return counters.totals(lines.records_of(lines.parse_format("tabs", changed)))
