"""Where intermediate tables go, and when a side may be broadcast."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was measured and found to hold at most this many bytes.
BROADCAST_BYTES = 32 << 20

#: Up to this many keys are named in a filter, which reaches the scan and skips row groups.
NAMED_KEYS = 1_000

_local_dirs: dict[str, str] = {}
_scratch = threading.local()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster must
    name one, since its executors share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ringledger-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan restarts from a plain scan with known file sizes, and a lost executor costs a
    re-read rather than a re-run of everything before. Inside :func:`scratch` the table goes
    when the block ends; otherwise it stays as long as the folder does, like a checkpoint.
    """
    path = fresh_path(df.sparkSession, label)
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are deleted at its end. Only for work whose results are
    written out before."""
    outer = getattr(_scratch, "paths", None)
    _scratch.paths = []
    try:
        yield
    finally:
        delete_paths(spark, _scratch.paths)
        _scratch.paths = outer


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build()`` gives, written out and read back; the tables that it has cut on the way are deleted."""
    with scratch(spark):
        found = build()
        path = fresh_path(spark, label)
        found.write.parquet(path)
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    return spark.read.schema(found.schema).parquet(path)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of this library by path, on whatever file system they are."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """True when the rows of ``df`` were added up and come to at most ``most`` bytes.

    Fixed-width columns count 8 bytes and 8 more for each row; texts count what they hold.
    """
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    held = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0))
    size = df.agg(F.coalesce(F.sum(held + 8 * (len(df.columns) + 1)), F.lit(0))).first()[0]
    return size <= most


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows, otherwise unchanged.

    Beyond the bound the join shuffles both sides and AQE splits skewed partitions; the rows are
    the same. ``df`` is read twice, so write it first where that costs.
    """
    return F.broadcast(df) if fits_broadcast(df, most) else df


def only(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` is among ``keys``.

    A few keys become a filter: it passes through the sums of a view down to the files, where
    row groups without these keys are skipped. More keys are a semi join, broadcast when
    small enough.
    """
    held = cut(keys.select(column).distinct(), "keys")
    named = held.limit(NAMED_KEYS + 1).collect()
    if len(named) <= NAMED_KEYS:
        return table.filter(F.col(column).isin([row[0] for row in named]))
    return table.join(small_side(held), column, "left_semi")
