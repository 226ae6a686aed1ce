import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ringledger.llm import components, simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, close):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and close(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def check(docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    root = roots({b for _, b in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, b in rows:
        if i is not None:
            least[root[b]] = min(i, least.get(root[b], i))
    got = [tuple(r) for r in simhash.digest(docs).collect()]
    key = lambda r: (r[0] is not None, *(x if x is not None else -1 for x in r))
    assert sorted(got, key=key) == sorted(((i, f"{b:016x}", least.get(root[b])) for i, b in rows), key=key)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, nothing):
    check(odd)
    assert simhash.digest(nothing).count() == 0


def test_one_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 5, 6, 7]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 63), max_size=3)), min_size=1, max_size=80), st.integers(0, 3))
def test_index_finds_all_close_pairs(rows, bits):
    base = np.random.default_rng(3).integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.array([int(base[k]) ^ sum(1 << b for b in set(flips)) for k, flips in rows], np.uint64))
    left, right = simhash.close_pairs(values, bits)
    got = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= bits}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_every_close_pair_shares_a_block_choice(bits):
    masks = simhash.block_masks(bits)
    assert all(64 - m.bit_count() <= simhash.FREE for m in masks)
    rng = np.random.default_rng(bits)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
        assert any(not flips & m for m in masks)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
