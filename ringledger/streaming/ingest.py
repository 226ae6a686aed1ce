"""Record files and message bodies into a store, in batch or as a stream.

Both go through :func:`fold_paths` or :func:`fold_bodies`, so they give the same tables. A
stream writes each micro-batch under the identity kept in its checkpoint; repeated after a
failure it overwrites its own deltas, and once published it is skipped.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringledger.functions.workspace import cut, only, scratch
from ringledger.operators import counters
from ringledger.plans.store import Store
from ringledger.sources import files
from ringledger.sources.lines import parse_format, records_of, rejects_of


#: Record fields that any table of a store is made of.
_FIELDS = (
    "sequence", "imsi", "usage", "msisdn", "duration", "bytes_rx", "bytes_tx", "peer_msisdn",
)


def _tables(rows: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """All deltas of a batch from its parsed rows, ``counted`` where a record counts.

    The rows are read three times, each time only the columns needed: for subscribers, for
    links, and for all that is small.
    """
    records = rows.filter("counted")
    small = counters.summary_tables(cut(counters.batch_summary(rows), "summary"))
    small["totals"] = small["totals"].withColumn("run_id", F.lit(run_id))
    return small | {
        "subscribers": counters.subscriber_usage(records),
        "links": counters.contact_links(records).sortWithinPartitions("owner", "peer"),
        "rejects": rejects_of(rows),
    }


def fold_files(
    store: Store,
    lines: DataFrame,
    stream_id: str,
    batch_id: int,
    run_id: str = "",
    record_format: str = "csv",
    path: str | list[str] | None = None,
    **options,
) -> None:
    """Fold scanned files as one batch: counters, marks, accounting and rejects together.

    The text is read and parsed once into a staged table. A file delivered again, in this batch
    or a later one, continues above the mark of its name. Files below ``path`` without a line,
    which leave none in ``lines``, get their outcome too.
    """
    if store.is_published(stream_id, batch_id):
        return
    with scratch(store.spark):
        staged = files.stage(lines, record_format, _FIELDS, **options)
        lost = None if path is None else files.empty_files(store.spark, path, staged.select("file_path").distinct())
        _fold(store, staged, lost, stream_id, batch_id, run_id)


def fold_paths(
    store: Store,
    path: str | list[str],
    stream_id: str,
    batch_id: int,
    run_id: str = "",
    record_format: str = "csv",
    watched: tuple[str, str | None] | None = None,
    **options,
) -> None:
    """Fold the files below ``path`` as one batch. Every file gets its outcome: empty ones and
    ones that cannot be read fail alone, and the others count; see :func:`fold_files`.

    ``watched`` is the folder of a stream and its name filter, where ``path`` has the new files
    that are not empty; empty ones are looked for there, and those without an outcome so far get it.
    """
    if store.is_published(stream_id, batch_id):
        return
    spark = store.spark
    with scratch(spark):
        staged, lost = files.stage_files(spark, path, record_format, _FIELDS, **options)
        if watched is None:
            empty = files.empty_files(spark, path, files.listed(spark, path))
        else:
            empty = cut(files.empty_files(spark, watched[0], files.listed(spark, watched[0]), watched[1]), "empty")
            empty = empty.join(only(store.files(), empty, "file_path"), "file_path", "left_anti")
        _fold(store, staged, lost.unionByName(empty), stream_id, batch_id, run_id)


def _fold(
    store: Store, staged: DataFrame, lost: DataFrame | None, stream_id: str, batch_id: int, run_id: str
) -> None:
    status = cut(files.with_marks(files.header_status(staged), store.progress()), "files")
    status = files.running_marks(staged, status)
    rows = files.admitted(staged, status).withColumn(
        "counted", F.col("reject_reason").isNull() & files.not_applied()
    )
    outcomes = status.select("file_path", "source", "ok", "format", "declared_count")
    if lost is not None:
        outcomes = outcomes.unionByName(lost)
    store.publish(_tables(rows, run_id) | {"files": outcomes}, stream_id, batch_id, run_id)


def fold_bodies(
    store: Store,
    bodies: DataFrame,
    stream_id: str,
    batch_id: int,
    run_id: str = "",
    record_format: str = "csv",
    **options,
) -> None:
    """Fold messages of one record line each. They have no header, no source and no mark."""
    if store.is_published(stream_id, batch_id):
        return
    parsed = parse_format(record_format, bodies.select("value"), **options)
    good = F.col("reject_reason").isNull()
    with scratch(store.spark):
        rows = cut(
            parsed.select(
                F.lit("").alias("source"), good.alias("counted"), *_FIELDS,
                F.when(~good, F.col("value")).alias("value"), "reject_reason",
            ),
            "staged",
        )
        store.publish(_tables(rows, run_id), stream_id, batch_id, run_id)


def ingest_files(
    spark: SparkSession, path: str | list[str], store: Store, run_id: str = "", **options
) -> None:
    """Fold all files below ``path`` as one batch; see :func:`fold_paths`."""
    fold_paths(store, path, uuid.uuid4().hex, 0, run_id, **options)


# --- streams --------------------------------------------------------------------------------


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream, kept beside its offsets: a new checkpoint is a new stream."""
    path = f"{checkpoint.rstrip('/')}/identity"
    schema = "stream_id STRING"
    try:
        return spark.read.schema(schema).parquet(path).first().stream_id
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    made = uuid.uuid4().hex
    spark.range(1).select(F.lit(made).alias("stream_id")).coalesce(1).write.parquet(path)
    return made


def _start(
    stream: DataFrame, fold, checkpoint: str, every: str | None, name: str | None, mode: str = "append"
):
    writer = stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def ingest_file_stream(
    spark: SparkSession,
    path: str,
    store: Store,
    checkpoint: str,
    every: str | None = None,
    run_id: str = "",
    sample_seconds: float | None = None,
    max_files: int | None = None,
    glob: str | None = None,
    archive: str | None = None,
    name: str | None = None,
    **options,
) -> StreamingQuery:
    """Keep folding files as they arrive. Without ``every`` it stops when all present files
    are folded. ``sample_seconds`` takes a sample after a batch when that long has passed; see
    :func:`sample_by_clock` for samples that need no batch.

    What streams is the listing, so a file that cannot be read is a row like any other and does
    not hold up the rest; a new empty file, which is no row, still makes a micro-batch. The names of a micro-batch, at most ``max_files``, pass
    through the driver, which lists them for any read."""
    stream_id = stream_identity(spark, checkpoint)
    sampled = _Sampler(store, sample_seconds)

    def fold(batch: DataFrame, batch_id: int) -> None:
        names = [files.literal_path(r.path) for r in batch.select("path").collect()]
        fold_paths(store, names, stream_id, batch_id, run_id, watched=(path, glob), **options)
        sampled()

    stream = files.stream_listing(spark, path, max_files, glob, archive)
    return _start(stream, fold, checkpoint, every, name)


def ingest_stream(
    stream: DataFrame,
    store: Store,
    checkpoint: str,
    body: str = "value",
    every: str | None = None,
    run_id: str = "",
    sample_seconds: float | None = None,
    name: str | None = None,
    **options,
) -> StreamingQuery:
    """Keep folding message bodies of any streaming DataFrame, a Kafka source for one."""
    bodies = stream.select(F.col(body).cast("string").alias("value"))
    stream_id = stream_identity(store.spark, checkpoint)
    sampled = _Sampler(store, sample_seconds)

    def fold(batch: DataFrame, batch_id: int) -> None:
        fold_bodies(store, batch, stream_id, batch_id, run_id, **options)
        sampled()

    return _start(bodies, fold, checkpoint, every, name)


class _Sampler:
    """Takes a sample when the last one is old enough."""

    def __init__(self, store: Store, seconds: float | None):
        self.store, self.seconds, self.last = store, seconds, 0.0

    def __call__(self) -> None:
        if self.seconds is not None and time.time() - self.last >= self.seconds:
            self.store.sample()
            self.last = time.time()


def sample_by_clock(
    store: Store, checkpoint: str, seconds: float, name: str | None = None
) -> StreamingQuery:
    """Sample a store every so many seconds, whether or not anything is fed to it.

    A stream of its own: Spark's clock source ticks, and each trigger takes one sample. It runs
    beside any number of feeds, in this process or another one's checkpoint, until it is stopped.
    A tick repeated after a failure samples the moment at which it is repeated.
    """
    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, __: int) -> None:
        store.sample()

    return _start(clock, tick, checkpoint, f"{seconds} seconds", name)


def live_table(
    view: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep a running aggregate below ``path``: each micro-batch writes the rows that changed.

    Sums live in the state of the checkpoint, so a restart goes on from them. A micro-batch that
    is repeated overwrites its own rows.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/update={batch_id}")

    return _start(view, write, checkpoint, every, None, "update")


def read_live(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row written for each key of a live table."""
    rows = spark.read.schema(f"{schema}, update BIGINT").parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "update")]
    newest = F.max_by(F.struct(*values), "update").alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")


def live_totals(stream: DataFrame, body: str = "value", **options) -> DataFrame:
    """Totals of a stream of lines as a running aggregate, for a sink in complete mode."""
    lines = stream.select(F.col(body).cast("string").alias("value"))
    return counters.totals(records_of(parse_format("csv", lines, **options)))


def live_subscribers(stream: DataFrame, body: str = "value", **options) -> DataFrame:
    """Subscriber counters of a stream of lines, for a sink in update or complete mode."""
    lines = stream.select(F.col(body).cast("string").alias("value"))
    return counters.subscriber_usage(records_of(parse_format("csv", lines, **options)))
