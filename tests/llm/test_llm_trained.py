import numpy as np
import pytest

import corpus_pipeline
from ringledger.llm import linear, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out_rows(spark, name, label):
    found = queries.queries()[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return [(r["predicted"], r["score"], r[label]) for r in found.filter("held_out").join(labels, "doc_id").collect()]


def test_toxicity_held_out(spark):
    rows = held_out_rows(spark, "op3_toxicity", "toxic")
    assert sum(p == y for p, _, y in rows) / len(rows) > 0.93
    assert sum(p == 1 for p, _, y in rows if y == 0) <= 0.02 * len(rows)


def test_quality_held_out(spark):
    rows = held_out_rows(spark, "op7_quality", "quality")
    assert sum(p == y for p, _, y in rows) / len(rows) > 0.96


@pytest.mark.parametrize("build", [toxicity.scored, quality.scored])
def test_odd_rows(spark, odd, nothing, build):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (5, 1, 0), (None, 1, 1), (6, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.filter("doc_id = 1")):
        rows = build(odd, marks).collect()
        assert len(rows) == odd.count() and all(r["predicted"] in (0, 1) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert build(nothing, labels).count() == 0


@pytest.mark.parametrize("build", [toxicity.keep_clean, quality.keep_good])
def test_kept_rows_are_whole(spark, odd, nothing, build):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    kept = build(odd, labels)
    assert kept.columns == odd.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}
    assert build(nothing, labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(map(tuple, toxicity.scored(docs, labels).collect())) == sorted(map(tuple, toxicity.scored(docs, turned).collect()))


def test_label_model_finds_the_good_voter():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    n = toxicity.LEXICONS + 1 + len(toxicity.PATTERNS)
    votes = (rng.random((4000, n)) < 0.05).astype(np.int8)
    votes[:, 0] = np.where(rng.random(4000) < 0.95, y, ~y)
    votes[:, 1] = votes[:, 0]
    model, posterior = toxicity.label_model(votes, np.ones(4000), np.where(np.arange(4000) < 400, y, -1))
    assert model.parent[1] == 0 and model.strength[1] == max(model.strength)
    assert model.accuracies()[0] > 0.85
    assert np.mean((posterior > 0.5) == y) > 0.93


def test_linear_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    found = linear.fit(x, (x[:, 0] > 0).astype(float), np.ones(500))
    assert np.mean((linear.decide(x, found) > 0) == (x[:, 0] > 0)) > 0.98


def test_pipeline_keeps_its_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "PII", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, SF), f"stage-{k}")
        if k < 4:
            assert docs.columns == before.columns
        if k in (0, 1, 2):
            assert docs.exceptAll(before).count() == 0
        predicted = {0: "op7", 1: "op3"}.get(k)
        if predicted:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores = quality.scored(before, labels).filter("predicted = 1") if k == 0 else toxicity.scored(before, labels).filter("predicted = 0")
            assert sorted(r[0] for r in scores.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
        if k == 3:
            assert docs.count() == before.count()
    assert docs.select("doc_id").distinct().count() == before.count()


def test_shapes_are_of_whole_words():
    """Before, only the first 64 characters of a word and 12 of its shape were read."""
    assert quality.shape("Hello!!") == "Aa!" and quality.shape("") == "" and quality.shape("\u00c4\u6f22\u5b57\u0663\n\n") == "Aa0\n"
    assert quality.shape("a" * 70 + "9") == "a0" and quality.shape("a1" * 20) == "a0" * 20
    view = quality.ContentView()
    assert (view.read("\u6f22" * 5000) != view.read("\u6f22" * 5000 + "A9!" * 5000)).any()


def test_good_rows_without_metadata_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = sorted(r[0] for r in quality.keep_good(docs, labels).select("doc_id").collect())
    assert kept == sorted(r["doc_id"] for r in quality.scored(docs, labels).collect() if r["predicted"] == 1) and kept
