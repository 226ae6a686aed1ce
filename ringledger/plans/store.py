"""Counters kept as Parquet tables: one set of deltas per batch, published by one manifest row.

A batch writes its deltas to paths of its own, overwriting what a failed attempt left there,
and its manifest row last. Readers add up the deltas of published batches only, so a batch is
seen whole or not at all, and one that is already published is never folded again. Zero
suppression happens on the sums. Boards are views and are not stored.
"""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringledger.functions.columns import plus, present, sums
from ringledger.functions.workspace import cut, delete_paths, only, scratch
from ringledger.operators.boards import all_boards
from ringledger.operators.counters import merge_totals
from ringledger.operators.lookups import store_keys
from ringledger.schema import (
    LINK_COUNTERS,
    OPERATOR_BOARDS,
    OPERATOR_COUNTERS,
    RETENTION_DAYS,
    SAMPLE_COLUMNS,
    SUBSCRIBER_BOARDS,
    SUBSCRIBER_COUNTERS,
    TOTAL_COUNTERS,
)

#: Up to this many live batches are read by naming their directories; more by a join.
NAMED_BATCHES = 2_000


def _schema(keys: dict[str, str], counters: tuple[str, ...]) -> str:
    return ", ".join([f"{k} {t}" for k, t in keys.items()] + [f"{c} BIGINT" for c in counters])


_BATCH = "stream_id STRING, batch_id BIGINT"
_KINDS = {
    "subscribers": _schema({"msisdn": "BIGINT"}, SUBSCRIBER_COUNTERS),
    "operators": _schema({"mccmnc": "INT"}, OPERATOR_COUNTERS),
    "links": _schema({"owner": "BIGINT", "peer": "BIGINT"}, LINK_COUNTERS),
    "totals": _schema({"run_id": "STRING"}, TOTAL_COUNTERS),
    "progress": "source STRING, seq DECIMAL(20,0)",
    "accounts": "source STRING, parsed BIGINT, rejected BIGINT",
    "rejects": "source STRING, line STRING, reject_reason STRING",
    "files": "file_path STRING, source STRING, ok BOOLEAN, format STRING, "
    "declared_count DECIMAL(20,0)",
}
_SAMPLES = _schema({"ts": "BIGINT", "taken_at": "BIGINT"}, SAMPLE_COLUMNS)
_DAY = 86400
#: Kinds that compaction adds up. Rejects and files are rows, not sums: they stay where they are.
_COUNTED = ("subscribers", "operators", "links", "totals", "progress", "accounts")
_MANIFEST = (
    "run_id STRING, replaces ARRAY<STRUCT<stream_id: STRING, batch_id: BIGINT>>, " + _BATCH
)

#: How the stream ids of compactions begin.
COMPACTED = "compact-"


def _column(board: str) -> str:
    return "board_" + board.replace("-", "_")


#: Kinds whose keys the inventory counts: the key, the counters that make it present, its boards.
_KEYED = {
    "subscribers": ("msisdn", SUBSCRIBER_COUNTERS, SUBSCRIBER_BOARDS),
    "operators": ("mccmnc", OPERATOR_COUNTERS, OPERATOR_BOARDS),
    "links": ("owner", LINK_COUNTERS, {}),
}
_BOARD_COLUMNS = tuple(_column(b) for b in (*SUBSCRIBER_BOARDS, *OPERATOR_BOARDS))
_STEPS = _schema({"step": "BIGINT"}, (*TOTAL_COUNTERS, *_KEYED, *_BOARD_COLUMNS, "progress"))


class Store:
    """The tables below one root folder, which every executor must reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._advancing = threading.RLock()

    # --- writing -----------------------------------------------------------------------

    def publish(
        self,
        frames: dict[str, DataFrame],
        stream_id: str,
        batch_id: int,
        run_id: str = "",
        replaces: DataFrame | None = None,
    ) -> None:
        """Write the deltas of one batch, then the row that makes them count."""
        if self.is_published(stream_id, batch_id):
            return
        at = f"stream_id={stream_id}/batch_id={batch_id}"

        def write(kind: str) -> None:
            frames[kind].write.mode("overwrite").parquet(f"{self.root}/deltas/{kind}/{at}")

        # The small tables leave most of a cluster idle, so all are written side by side.
        with ThreadPoolExecutor(max_workers=len(frames)) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), frames))
        row = self.spark.range(1).select(F.lit(run_id).alias("run_id"))
        if replaces is None:
            retired = F.array().cast("array<struct<stream_id:string,batch_id:bigint>>")
        else:
            retired = replaces.agg(F.collect_list(F.struct("stream_id", "batch_id"))).scalar()
        self._commit(row.select("run_id", retired.alias("replaces")), at)

    def _commit(self, row: DataFrame, at: str) -> None:
        """Write the manifest row that makes a batch count."""
        row.write.mode("overwrite").parquet(f"{self.root}/manifest/{at}")

    def compact(self) -> None:
        """Fold the counters of all live batches into one. The new manifest row retires them in
        the same write that publishes their sum. Totals stay apart by run. Rejects and file
        outcomes are not touched, and samples have their own :meth:`sweep_samples`. Running
        totals take in what is new first, so they never need a retired batch.

        Subscribers and links are laid out in ranges of their keys, so a lookup skips row
        groups and an owner with many links is spread over several files.
        """
        self.advance()
        with scratch(self.spark):
            live = cut(self._live(), "live")
            frames = {
                "subscribers": self._summed("subscribers", ["msisdn"], SUBSCRIBER_COUNTERS, live)
                .repartitionByRange("msisdn")
                .sortWithinPartitions("msisdn"),
                "operators": self._summed("operators", ["mccmnc"], OPERATOR_COUNTERS, live),
                "links": self._summed("links", ["owner", "peer"], LINK_COUNTERS, live)
                .repartitionByRange("owner", "peer")
                .sortWithinPartitions("owner", "peer"),
                "totals": self._summed("totals", ["run_id"], TOTAL_COUNTERS, live),
                "progress": self._progress(live),
                "accounts": self._summed("accounts", ["source"], ("parsed", "rejected"), live),
            }
            self.publish(frames, f"{COMPACTED}{uuid.uuid4().hex}", 0, replaces=live)

    # --- published batches ---------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], T.StructType.fromDDL(schema))

    def _manifest(self) -> DataFrame:
        return self._read("manifest", _MANIFEST)

    def _live(self) -> DataFrame:
        """Batches whose counters count: published, and not folded into a later one."""
        rows = self._manifest()
        retired = rows.select(F.explode("replaces").alias("r")).select("r.*")
        return self._published().join(retired, ["stream_id", "batch_id"], "left_anti")

    def _published(self) -> DataFrame:
        return self._manifest().select("stream_id", "batch_id")

    def is_published(self, stream_id: str, batch_id: int) -> bool:
        """True also for batches folded into a later one."""
        return not (
            self._manifest()
            .filter((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id))
            .isEmpty()
        )

    def _deltas(self, kind: str, live: DataFrame | None = None) -> DataFrame:
        """Rows of live batches, of all published ones for rows that are never added up. A few
        batches prune to their directories; many are joined."""
        rows = self._read(f"deltas/{kind}", f"{_KINDS[kind]}, {_BATCH}")
        if live is None:
            live = self._live() if kind in _COUNTED else self._published()
        named = live.limit(NAMED_BATCHES + 1).collect()
        if len(named) > NAMED_BATCHES:
            return rows.join(live, ["stream_id", "batch_id"], "left_semi")
        streams: dict[str, list[int]] = {}
        for batch in named:
            streams.setdefault(batch.stream_id, []).append(batch.batch_id)
        wanted = F.lit(False)
        for stream_id, batches in streams.items():
            wanted = wanted | (
                (F.col("stream_id") == stream_id) & F.col("batch_id").isin(batches)
            )
        return rows.filter(wanted)

    # --- views -----------------------------------------------------------------------------

    def _summed(
        self, kind: str, keys: list[str], counters: tuple[str, ...], live: DataFrame | None = None
    ) -> DataFrame:
        return self._deltas(kind, live).groupBy(*keys).agg(*sums(counters))

    def _progress(self, live: DataFrame | None = None) -> DataFrame:
        return self._deltas("progress", live).groupBy("source").agg(F.max("seq").alias("seq"))

    def _samples(self) -> DataFrame:
        newest = F.max_by(F.struct("taken_at", *SAMPLE_COLUMNS), "taken_at")
        rows = self._read("samples", f"{_SAMPLES}, day INT")
        return rows.groupBy("ts").agg(newest.alias("s")).select("ts", "s.*")

    def subscribers(self) -> DataFrame:
        return present(
            self._summed("subscribers", ["msisdn"], SUBSCRIBER_COUNTERS), SUBSCRIBER_COUNTERS
        )

    def operators(self) -> DataFrame:
        return present(self._summed("operators", ["mccmnc"], OPERATOR_COUNTERS), OPERATOR_COUNTERS)

    def links(self) -> DataFrame:
        return present(self._summed("links", ["owner", "peer"], LINK_COUNTERS), LINK_COUNTERS)

    def totals(self, run_id: str | None = None) -> DataFrame:
        """Lifetime totals, or those of one run. Always one row."""
        rows = self._deltas("totals")
        if run_id is not None:
            rows = rows.filter(F.col("run_id") == run_id)
        return merge_totals(rows.select(*TOTAL_COUNTERS))

    def boards(self) -> DataFrame:
        return all_boards(self.subscribers(), self.operators())

    def progress(self) -> DataFrame:
        return self._progress()

    def accounts(self) -> DataFrame:
        return self._summed("accounts", ["source"], ("parsed", "rejected"))

    def rejects(self) -> DataFrame:
        return self._deltas("rejects").drop("stream_id", "batch_id")

    def files(self) -> DataFrame:
        return self._deltas("files").drop("stream_id", "batch_id")

    def samples(self) -> DataFrame:
        return self._samples().drop("taken_at")

    def keys(self) -> DataFrame:
        """Inventory by kind."""
        return store_keys(
            self.subscribers(), self.operators(), self.links(), self.totals(), self.progress()
        )

    # --- running totals ----------------------------------------------------------------------

    def _new_batches(self) -> DataFrame:
        """Published batches that no step of the running totals has taken in. A compaction
        brings nothing new."""
        done = self._read("running/steps", _STEPS).select("step")
        covered = self._read("running/covered", f"{_BATCH}, step BIGINT").join(done, "step", "left_semi")
        fed = self._manifest().filter(~F.col("stream_id").startswith(COMPACTED))
        return fed.select("stream_id", "batch_id").join(covered, ["stream_id", "batch_id"], "left_anti")

    def _last_step(self) -> dict[str, int]:
        rows = self._read("running/steps", _STEPS)
        row = rows.orderBy(F.desc("step")).limit(1).collect()
        return row[0].asDict() if row else dict.fromkeys(rows.columns, 0)

    def _fresh_keys(self, kind: str, key: str, counters: tuple[str, ...], new: DataFrame, step: int) -> DataFrame:
        """Keys with something counted in the new batches and in none before. What a lost attempt at ``step`` left is not read, as it is overwritten."""
        rows = present(self._deltas(kind, new), counters)
        held = cut(rows.select(F.col(key).cast("bigint").alias("key")).distinct(), "keys")
        known = self._read(f"running/known/{kind}", "key BIGINT, step BIGINT").filter(F.col("step") < step)
        done = self._read("running/steps", _STEPS).select("step")
        seen = only(known.join(done, "step", "left_semi"), held, "key").select("key")
        return held.join(seen, "key", "left_anti")

    def advance(self) -> dict[str, int]:
        """Running totals and inventory after taking in all batches published since the last
        step; nothing is read again of the others but their keys.

        A step is a prefix sum: its row holds the sums so far, so the last row answers. Counters
        never fall, so a key or board that counts once counts for ever. The keys first seen in a
        step and the batches that it took in are tables by step, written before its row; without
        that row they do not count, and the next attempt overwrites them. One process at a time
        may advance a store; its threads wait for each other.
        """
        with self._advancing, scratch(self.spark):
            last = self._last_step()
            new = cut(self._new_batches(), "new-batches")
            if new.isEmpty():
                return last
            step = last["step"] + 1
            state = {"step": step}
            sums_of = merge_totals(self._deltas("totals", new).select(*TOTAL_COUNTERS)).first()
            for name in TOTAL_COUNTERS:
                state[name] = last[name] + sums_of[name]
            for kind, (key, counters, boards) in _KEYED.items():
                at = f"{self.root}/running/known/{kind}/step={step}"
                self._fresh_keys(kind, key, counters, new, step).write.mode("overwrite").parquet(at)
                state[kind] = last[kind] + self.spark.read.schema("key BIGINT").parquet(at).count()
                if boards:
                    filled = [F.coalesce(F.max(plus(c) > 0), F.lit(False)).cast("bigint").alias(_column(b)) for b, c in boards.items()]
                    found = self._deltas(kind, new).agg(*filled).first()
                    state |= {_column(b): max(last[_column(b)], found[_column(b)]) for b in boards}
            state["progress"] = max(last["progress"], int(not self._deltas("progress", new).isEmpty()))
            new.write.mode("overwrite").parquet(f"{self.root}/running/covered/step={step}")
            row = self.spark.range(1).select(*[F.lit(state[c]).cast("bigint").alias(c) for c in state if c != "step"])
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/running/steps/step={step}")
            return state

    def sample(self, ts: int | None = None) -> None:
        """Take a sample of the totals now. The later one of the same second stays.

        Samples are rows of a table of their own, by day: they are no batches, and reading
        counters never lists them. A sample reads the batches since the last one only.
        """
        state = self.advance()
        taken_at = time.time_ns()
        ts = taken_at // 1_000_000_000 if ts is None else ts
        keys = sum(state[c] for c in (*_KEYED, *_BOARD_COLUMNS, "progress")) + int(state["records"] > 0)
        values = {"ts": ts, "taken_at": taken_at, "keys": keys} | {c: state[c] for c in TOTAL_COUNTERS}
        row = self.spark.range(1).select(*[F.lit(v).cast("bigint").alias(c) for c, v in values.items()])
        row.withColumn("day", F.floor(F.col("ts") / _DAY).cast("int")).coalesce(1).write.mode(
            "append"
        ).partitionBy("day").parquet(f"{self.root}/samples")

    def sweep_samples(self, now: int | None = None, days: int = RETENTION_DAYS) -> None:
        """Delete the days of samples that lie wholly past retention."""
        now = int(time.time()) if now is None else now
        past = F.col("day") < (now - days * _DAY) // _DAY
        rows = self._read("samples", f"{_SAMPLES}, day INT")
        delete_paths(
            self.spark,
            [f"{self.root}/samples/day={r.day}" for r in rows.filter(past).select("day").distinct().collect()],
        )
