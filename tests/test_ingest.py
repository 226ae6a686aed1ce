"""Stores: batch against stream, restart, replay, redelivery, runs, compaction, samples."""

import pytest
from helpers import DATA, DATA_FIELDS, SUB, VOICE, VOICE_FIELDS, line
from pyspark.sql import functions as F

from ringledger.functions import workspace
from ringledger.operators import counters
from ringledger.plans.store import Store
from ringledger.sources import files, lines, tables
from ringledger.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def write(folder, name, sequences, header=True):
    folder.mkdir(parents=True, exist_ok=True)
    rows = [line(VOICE_FIELDS if n % 2 else DATA_FIELDS, sequence=n) for n in sequences]
    top = [f"CDR|csv|{len(rows)}"] if header else []
    (folder / name).write_text("\n".join(top + rows) + "\n")
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def state(store):
    return {
        "subscribers": rows(store.subscribers()),
        "operators": rows(store.operators()),
        "links": rows(store.links()),
        "totals": rows(store.totals()),
        "boards": rows(store.boards()),
    }


def drain(spark, path, store, checkpoint, **options):
    query = ingest.ingest_file_stream(spark, path, store, str(checkpoint), **options)
    query.awaitTermination()
    assert query.exception() is None


def test_empty_store_answers(store):
    assert store.totals().first().records == 0
    assert store.subscribers().count() == 0 and store.links().count() == 0
    assert sum(r["keys"] for r in store.keys().collect()) == 0


def test_batch_ingest(spark, store, tmp_path):
    path = write(tmp_path / "in", "a.cdr", [1, 2, 3])
    write(tmp_path / "in", "b.cdr", [4], header=False)
    (tmp_path / "in" / "c.cdr").write_text("CDR|csv|1\njunk\n" + VOICE + "\n")
    ingest.ingest_files(spark, path, store)
    assert store.totals().first().records == 4
    assert {r.source: int(r.seq) for r in store.progress().collect()} == {"a.cdr": 3, "c.cdr": 71}
    assert {r.source: (r.parsed, r.rejected) for r in store.accounts().collect()} == {
        "a.cdr": (3, 0), "c.cdr": (1, 1)
    }
    assert [(r.source, r.line) for r in store.rejects().collect()] == [("c.cdr", "junk")]
    assert {r.source: r.ok for r in store.files().collect()} == {
        "a.cdr": True, "b.cdr": False, "c.cdr": True
    }


def test_stream_equals_batch_on_events(spark, store, tmp_path):
    records = tables.event_records(spark, SF)
    path = str(tmp_path / "in")
    files.write_files(lines.to_lines(records.repartition(4)), path)
    drain(spark, path, store, tmp_path / "ck", max_files=1)
    assert rows(store.subscribers()) == rows(counters.subscriber_usage(records))
    assert rows(store.operators()) == rows(counters.operator_traffic(records))
    assert rows(store.links()) == rows(counters.contact_links(records))
    assert rows(store.totals()) == rows(counters.totals(records))


def test_restart_goes_on_where_it_stopped(spark, store, tmp_path):
    path = write(tmp_path / "in", "a.cdr", [1, 2])
    drain(spark, path, store, tmp_path / "ck")
    before = state(store)
    drain(spark, path, store, tmp_path / "ck")
    assert state(store) == before
    write(tmp_path / "in", "b.cdr", [3, 4])
    drain(spark, path, store, tmp_path / "ck")
    assert store.totals().first().records == 4


def test_failure_between_deltas_and_manifest_counts_once(spark, store, tmp_path, monkeypatch):
    path = write(tmp_path / "in", "a.cdr", [1, 2, 3])
    publish = Store.publish

    def torn(self, frames, stream_id, batch_id, run_id="", replaces=None):
        for kind in ("subscribers", "totals"):
            frames[kind].write.mode("overwrite").parquet(
                f"{self.root}/deltas/{kind}/stream_id={stream_id}/batch_id={batch_id}"
            )
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "publish", torn)
    query = ingest.ingest_file_stream(spark, path, store, str(tmp_path / "ck"))
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert store.totals().first().records == 0 and store.subscribers().count() == 0
    monkeypatch.setattr(Store, "publish", publish)
    drain(spark, path, store, tmp_path / "ck")
    assert store.totals().first().records == 3


def test_replay_of_a_published_batch_changes_nothing(spark, store, tmp_path):
    path = write(tmp_path / "in", "a.cdr", [1, 2, 3])
    scanned = files.scan_files(spark, path)
    ingest.fold_files(store, scanned, "s", 0)
    before = state(store)
    ingest.fold_files(store, scanned, "s", 0)
    assert state(store) == before
    store.compact()
    ingest.fold_files(store, scanned, "s", 0)
    assert state(store) == before


def test_file_delivered_again_continues_above_its_mark(spark, store, tmp_path):
    drain(spark, write(tmp_path / "one", "a.cdr", [1, 2, 3]), store, tmp_path / "ck1")
    drain(spark, write(tmp_path / "two", "a.cdr", [1, 2, 3, 4, 5]), store, tmp_path / "ck2")
    assert store.totals().first().records == 5
    assert int(store.progress().first().seq) == 5
    assert store.accounts().first().parsed == 5


def test_new_checkpoint_does_not_overwrite_older_batches(spark, store, tmp_path):
    drain(spark, write(tmp_path / "one", "a.cdr", [1, 2]), store, tmp_path / "ck1")
    drain(spark, write(tmp_path / "two", "b.cdr", [1, 2]), store, tmp_path / "ck2")
    assert store.totals().first().records == 4


def test_bodies_have_no_mark_and_keep_sequence_zero(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    text = "\n".join([line(sequence=0), DATA, "junk"]) + "\n"
    (tmp_path / "in" / "m").write_text(text)
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    query = ingest.ingest_stream(stream, store, str(tmp_path / "ck"), body="body")
    query.awaitTermination()
    assert store.totals().first().records == 2
    assert store.progress().count() == 0
    assert tuple(store.accounts().first()) == ("", 2, 1)


def test_run_and_lifetime_totals(spark, store, tmp_path):
    ingest.ingest_files(spark, write(tmp_path / "one", "a.cdr", [1, 2]), store, "run-1")
    ingest.ingest_files(spark, write(tmp_path / "two", "b.cdr", [1]), store, "run-2")
    store.compact()
    assert store.totals().first().records == 3
    assert store.totals("run-1").first().records == 2
    assert store.totals("run-3").first().records == 0


def test_compaction_keeps_every_answer(spark, store, tmp_path):
    for i, name in enumerate(["a.cdr", "b.cdr", "c.cdr"]):
        ingest.ingest_files(spark, write(tmp_path / name, name, [1, 2, i + 3]), store)
    store.sample(1_000)
    before, marks = state(store), rows(store.progress())
    store.compact()
    assert state(store) == before and rows(store.progress()) == marks
    assert store._live().count() == 1
    assert [r.ts for r in store.samples().collect()] == [1_000]
    ingest.ingest_files(spark, write(tmp_path / "d.cdr", "d.cdr", [7]), store)
    store.compact()
    assert store.samples().count() == 1
    store.sweep_samples(1_000 + 6 * 86400)
    assert store.samples().count() == 1
    store.sweep_samples(1_000 + 9 * 86400)
    assert store.samples().count() == 0
    assert store.totals().first().records == 10


def test_many_batches_are_joined_instead_of_named(spark, store, tmp_path, monkeypatch):
    for name in ("a.cdr", "b.cdr"):
        ingest.ingest_files(spark, write(tmp_path / name, name, [1, 2]), store)
    before = state(store)
    monkeypatch.setattr("ringledger.plans.store.NAMED_BATCHES", 1)
    assert state(store) == before


def test_samples_of_a_stream(spark, store, tmp_path):
    path = write(tmp_path / "in", "a.cdr", [1, 2, 3])
    drain(spark, path, store, tmp_path / "ck", sample_seconds=0)
    (sample,) = store.samples().collect()
    assert sample.records == 3 and sample["keys"] == sum(r["keys"] for r in store.keys().collect())
    store.sample(sample.ts)
    assert store.samples().count() == 1


def test_live_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m").write_text("\n".join([VOICE, DATA, "junk"]) + "\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    query = (
        ingest.live_totals(stream).writeStream.outputMode("complete")
        .format("memory").queryName("live").start()
    )
    query.processAllAvailable()
    query.stop()
    row = spark.table("live").first()
    assert (row.records, row.moc_dur, row.data_rx) == (2, 615, 5005)


def test_overflowing_counter_fails_the_batch(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    big = [line(sequence=n, duration=2**63 - 1) for n in (1, 2)]
    (tmp_path / "in" / "a.cdr").write_text("CDR|csv|2\n" + "\n".join(big) + "\n")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        ingest.ingest_files(spark, str(tmp_path / "in"), store)
    assert store.totals().first().records == 0


def test_work_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = workspace.fresh_path(spark, "x")
    assert path.startswith(named) if named else path.startswith(workspace.work_dir(spark))


def test_broadcast_only_after_counting(spark):
    few, many = spark.range(10), spark.range(11)
    assert workspace.fits_broadcast(few, 160) and not workspace.fits_broadcast(many, 160)
    long = spark.range(1).select(F.repeat(F.lit("x"), 200).alias("t"))
    assert not workspace.fits_broadcast(long, 160)
    left = spark.range(5)

    def hinted(side):
        return "broadcast" in left.join(side, "id")._jdf.queryExecution().logical().toString()

    assert hinted(workspace.small_side(few, 160)) and not hinted(workspace.small_side(many, 160))


def test_scratch_tables_go_after_the_batch(spark, store, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(workspace, "work_dir", lambda spark: str(shared))
    shared.mkdir()
    ingest.ingest_files(spark, write(tmp_path / "in", "a.cdr", [1, 2]), store)
    store.compact()
    assert list(shared.iterdir()) == []
    assert store.totals().first().records == 2


def test_few_keys_reach_the_files(spark, store, tmp_path, monkeypatch):
    """A lookup filters the scan below the sums; many keys are joined with the same answer."""
    from ringledger.operators import contacts

    ingest.ingest_files(spark, write(tmp_path / "in", "a.cdr", [1, 2, 3]), store)
    owners = spark.createDataFrame([(SUB,)], "owner bigint")
    page = contacts.peer_page(store.links(), owners, "dur")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [IsNotNull(owner), EqualTo(owner,{SUB})" in plan.replace(
        "IsNotNull(stream_id), ", ""
    )
    monkeypatch.setattr(workspace, "NAMED_KEYS", 0)
    joined = contacts.peer_page(store.links(), owners, "dur")
    assert "isin" not in str(joined) and rows(joined) == rows(page) and len(rows(page)) == 1


def test_folded_files_are_archived(spark, store, tmp_path):
    """A committed file moves to the archive when a later batch comes, and counts once."""
    path, archive = write(tmp_path / "in", "a.cdr", [1, 2]), tmp_path / "archive"
    write(tmp_path / "in", "skip.tmp", [7, 8, 9])
    options = {"archive": str(archive), "glob": "*.cdr"}
    drain(spark, path, store, tmp_path / "ck", **options)
    for name, sequence in (("b.cdr", 3), ("c.cdr", 4)):
        write(tmp_path / "in", name, [sequence])
        drain(spark, path, store, tmp_path / "ck", **options)
    assert store.totals().first().records == 4
    assert [p.name for p in archive.rglob("a.cdr")] == ["a.cdr"]
    assert not (tmp_path / "in" / "a.cdr").exists()


def test_same_names_in_one_batch_are_as_in_two(spark, store, tmp_path):
    for folder, sequences in (("d1", [1, 2, 3]), ("d2", [2, 3, 4]), ("d3", [1, 9])):
        write(tmp_path / "in" / folder, "a.cdr", sequences)
    write(tmp_path / "in" / "d1", "b.cdr", [1, 2])
    ingest.ingest_files(spark, [str(tmp_path / "in" / d) for d in ("d1", "d2", "d3")], store)
    assert store.totals().first().records == 7
    assert {r.source: int(r.seq) for r in store.progress().collect()} == {"a.cdr": 9, "b.cdr": 2}


def test_empty_files_have_an_outcome(spark, store, tmp_path):
    path = write(tmp_path / "in", "a.cdr", [1])
    (tmp_path / "in" / "e.cdr").write_text("")
    ingest.ingest_files(spark, path, store)
    assert {r.source: r.ok for r in store.files().collect()} == {"a.cdr": True, "e.cdr": False}
    assert store.totals().first().records == 1


def test_a_sample_reads_new_batches_only(spark, store, tmp_path):
    """Running totals go on when the deltas of earlier batches are gone."""
    ingest.ingest_files(spark, write(tmp_path / "a", "a.cdr", [1, 2, 3]), store)
    store.sample(1_000)
    first = [str(p) for kind in ("subscribers", "operators", "links", "totals") for p in (tmp_path / "store" / "deltas" / kind).glob("stream_id=*")]
    other = line(VOICE_FIELDS, sequence=9, msisdn=SUB + 5, peer_msisdn=SUB + 6)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.cdr").write_text(f"CDR|csv|2\n{other}\n{line(VOICE_FIELDS, sequence=10)}\n")
    ingest.ingest_files(spark, str(tmp_path / "b"), store)
    every = sum(r["keys"] for r in store.keys().collect())
    assert len(first) == 4
    workspace.delete_paths(spark, first)
    store.sample(2_000)
    samples = {r.ts: r for r in store.samples().collect()}
    assert (samples[1_000].records, samples[2_000].records) == (3, 5)
    assert samples[2_000]["keys"] == every > samples[1_000]["keys"]


def test_running_totals_survive_compaction_and_a_lost_step(spark, store, tmp_path):
    assert store.advance()["records"] == 0
    ingest.ingest_files(spark, write(tmp_path / "a", "a.cdr", [1, 2, 3]), store)
    # What an attempt without its last row has left does not count and is overwritten.
    left = f"{store.root}/running"
    spark.sql(f"SELECT {SUB} AS key").write.parquet(f"{left}/known/subscribers/step=1")
    spark.sql("SELECT 'x' AS stream_id, 0L AS batch_id").write.parquet(f"{left}/covered/step=1")
    store.compact()
    assert store.advance() == store.advance()
    ingest.ingest_files(spark, write(tmp_path / "b", "b.cdr", [4, 5]), store)
    state = store.advance()
    assert state["step"] == 2 and {c: state[c] for c in ("records", "data_rx")} == {c: store.totals().first()[c] for c in ("records", "data_rx")}
    kinds = {r["kind"]: r["keys"] for r in store.keys().collect()}
    assert [state[k] for k in ("subscribers", "operators", "links")] == [kinds[k] for k in ("subscribers", "operators", "links")]
    store.sample(3)
    assert store.samples().first()["keys"] == sum(kinds.values())
