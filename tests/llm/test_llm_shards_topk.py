import math
import zlib

import numpy as np
import pytest

from ringledger.llm import shards, topk


def test_shards(odd, nothing, documents):
    for docs in (odd, documents):
        rows = [tuple(r) for r in shards.balanced(docs).collect()]
        want = sorted((r["doc_id"] is not None, r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((r[0] is not None, *r[:3]) for r in rows) == want
        total, largest = sum(r[1] for r in rows), max(r[1] for r in rows)
        for k in range(8):
            own = [r for r in rows if r[4] == k]
            assert sorted(r[5] for r in own) == list(range(len(own)))
            assert abs(sum(r[1] for r in own) - total / 8) <= largest + 1
        ids = [r[0] for r in sorted(rows, key=lambda r: (r[4], r[5]))]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert shards.balanced(nothing).count() == 0


def brute(vectors, k=20):
    x = {i: [math.floor(64 * float(v)) for v in e] for i, e in vectors if i is not None and e and all(v is not None and math.isfinite(v) for v in e)}
    out = []
    for q, a in x.items():
        if q % 20 == 0:
            best = sorted((-sum(s * t for s, t in zip(a, b, strict=True)), i) for i, b in x.items() if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("n", "rows", "block"), [(300, 64, 5), (300, 4096, 1024), (12, 4096, 1024)])
def test_top_k(spark, n, rows, block):
    rng = np.random.default_rng(n)
    vectors = [(int(i), [float(v) for v in rng.normal(size=6).round(1)]) for i in rng.permutation(n)]
    vectors += [(n, None), (n + 20 - n % 20, [float("nan")] * 6), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 2, [float("inf")] * 6), (n + 3, []), (n + 4, [1.0, 2.0]), (None, [1.0] * 6)]
    frame = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), 20, rows, block).collect()
    assert sorted(tuple(r) for r in got) == brute([(i, None if e is None else [None if v is None else float(np.float32(v)) for v in e]) for i, e in vectors])


def test_bounds_hold():
    rng = np.random.default_rng(5)
    block = topk.Block(np.arange(50), rng.integers(-30, 30, (50, 8)).astype(float))
    q = rng.integers(-30, 30, (9, 8)).astype(float)
    true = q @ block.x.T
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    for depth in (1, 10, 49):
        a, b, c, d = block.read(depth)
        assert (up @ a.T + down @ c.T <= true).all() and (up @ b.T + down @ d.T >= true).all()


def test_reading_stops_where_outsiders_cannot_qualify():
    rng = np.random.default_rng(7)
    # A few vectors stand out in every list, so half a list settles the question.
    x = rng.integers(0, 10, (400, 8)).astype(float)
    x[:5] += 100
    block, left = topk.Block(np.arange(400), x), np.ones((3, 400), bool)
    depths = block.survivors(left, rng.integers(1, 9, (3, 8)).astype(float), 5, np.full(3, -np.inf))
    assert (depths == 200).all() and (np.flatnonzero(left.any(axis=0)) == np.arange(5)).all() and left.sum() == 15
    # Ties at the edge of the k best are read to the end, and none of them is lost.
    flat, left = topk.Block(np.arange(40), np.ones((40, 3))), np.ones((1, 40), bool)
    assert flat.survivors(left, np.ones((1, 3)), 5, np.full(1, -np.inf)) == 40 and left.all()


def test_no_answer_is_pruned(monkeypatch):
    rng = np.random.default_rng(11)
    x, q = rng.integers(-40, 40, (500, 12)).astype(float), rng.integers(-40, 40, (30, 12)).astype(float)
    for dense in (0.0, 0.125, 2.0):
        monkeypatch.setattr(topk, "DENSE", dense)
        block, left = topk.Block(np.arange(500), x), np.ones((30, 500), bool)
        depths = block.survivors(left, q, 20, np.full(30, -np.inf))
        scores = q @ x.T
        for row, own in zip(left, scores, strict=True):
            assert row[own >= np.sort(own)[-20]].all()
        assert (left.sum(axis=1) <= 25).all() and (depths < 500).any()


def test_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    frame = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 20 = 0")).collect())
    # Two queries: the repeated row once, the other vector of the id for itself.
    assert got == sorted([(20, 1, 1, 4096), (20, 2, 2, 0), (20, 3, 20, 0), (20, 1, 2, 4096), (20, 2, 1, 0), (20, 3, 20, 0)])


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, block int, span string")
    assert topk.every_twentieth(none).count() == 0
