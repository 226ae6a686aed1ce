import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringledger.llm import bpe, packing
from ringledger.llm.tokens import ChunkIds, default_vocabulary, library_ids, open_library, packed

TEXTS = ["", " ", "Don't STOP; we'll see <|endoftext|>\n a\x1cb\x85c", "ΣΑΣ İ ½² ٣", "é ñ 漢字 \U0001f642\U0001f3fd", "a" * 50 + "!" * 50, "re, re., (re) _re_ 's"]


@pytest.fixture(scope="module")
def library():
    return open_library(default_vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(default_vocabulary())


def test_texts_as_the_library_does(library, codec, texts_by_id):
    found = [*TEXTS, *texts_by_id.values()]
    wanted = [library.encode(x, add_special_tokens=False).ids for x in found]
    assert codec.encode(found) == [packed(x) for x in wanted]
    assert library_ids(default_vocabulary()).texts(found) == [packed(x) for x in wanted]
    assert [codec.decode(packed(x)).decode() for x in wanted] == [library.decode(x, skip_special_tokens=False) for x in wanted]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library, codec = _shared()
    assert codec.encode([text])[0] == packed(library.encode(text, add_special_tokens=False).ids)


_held = []


def _shared():
    if not _held:
        _held.extend([open_library(default_vocabulary()), bpe.Codec(default_vocabulary())])
    return _held


def test_digests(library, odd, nothing):
    got = bpe.digests(odd).collect()
    assert len(got) == odd.count() and bpe.digests(nothing).count() == 0
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.encoded(odd).count() == len(got)


def check_packing(library, docs, limit):
    rows = packing.packed_documents(docs, limit).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), limit):
            part = ids[k : k + limit]
            want[(r["doc_id"], k // limit, k, len(part), zlib.crc32(packed(part)))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence), -(-sum(r["length"] for r in rows) // limit)


def test_packing(library, odd, nothing, documents):
    check_packing(library, odd, 2048)
    check_packing(library, odd, 7)
    used, least = check_packing(library, documents, 2048)
    assert used <= least * 1.02 + 1
    assert packing.packed_documents(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_best_fit_is_that_of_one_piece_at_a_time(runs):
    bins = {}
    seen = Counter()
    for length, first, until, sequence, each, base in packing.best_fit(runs, 40):
        for k in range(until - first):
            bins.setdefault(sequence + k // each, []).append((base + k % each * length, length))
        assert seen[length] == first
        seen[length] = until
    assert dict(seen) == runs
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 40
    gaps = []
    for length in sorted(runs, reverse=True):
        for _ in range(runs[length]):
            fitting = [g for g in gaps if g >= length]
            if fitting:
                gaps.remove(min(fitting))
                gaps.append(min(fitting) - length)
            else:
                gaps.append(40 - length)
    assert len(bins) == len(gaps)


def test_pair_index_merges_overlaps_from_the_left(codec, library):
    words = ["aaaa", "aaaaa", "ababab", "thethe"]
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.index.words([x.encode() for x in words])]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in words]


def test_codecs_are_kept_and_bounded(tmp_path):
    """A file that has changed is opened again; only so many files are kept; what was learned changes no ids."""
    data = open(default_vocabulary(), encoding="utf-8").read()
    paths = [str(tmp_path / f"{k}.json") for k in range(bpe.CODECS + 1)]
    for path in paths:
        with open(path, "w", encoding="utf-8") as file:
            file.write(data)
    first = bpe.worker_codec(paths[0])
    assert bpe.worker_codec(paths[0]) is first
    assert first.encode(TEXTS) == first.encode(TEXTS[::-1])[::-1] == bpe.Codec(paths[0]).encode(TEXTS)
    with open(paths[0], "a", encoding="utf-8") as file:
        file.write("\n")
    again = bpe.worker_codec(paths[0])
    assert again is not first
    for path in paths[1:]:
        bpe.worker_codec(path)
    assert bpe.worker_codec(paths[0]) is not again


def test_a_worker_remembers_few_chunks():
    """What a codec holds for the life of a Python worker; 300,000 chunks stayed before."""
    ids = ChunkIds([], lambda words: [b"\0\0\0\0"] * len(words), lambda text: b"")
    for k in range(0, 300_000, 10_000):
        ids.texts([" ".join(f"w{n}" for n in range(k, k + 10_000))])
    assert len(ids.known) <= 160_000


def test_frequent_chunks_are_encoded_once():
    """They were forgotten with the rare ones whenever the memory was full, and encoded again."""
    encoded = Counter()
    ids = ChunkIds([], lambda words: encoded.update(words) or [packed([len(x)]) for x in words], lambda text: b"")
    for k in range(0, 400_000, 50_000):
        rare = [f"w{n}" for n in range(k, k + 50_000)]
        assert ids.texts([" ".join(["the", *rare, "of"])]) == [packed([3, *map(len, rare), 2])]
        assert len(ids.known) <= 150_000 + 3
    assert max(encoded.values()) == 1


def test_texts_between_odd_blank_and_padded_ones(library, codec):
    """Chunks of all plain texts are looked up at once: each text gets its own back, blank and odd ones too."""
    for found in ([], [""], ["漢字"], ["漢字", " \t", " a  b\r\n", "", "it's 2nd", "漢 a", "b'll b'll "], ["\n", "x"]):
        assert codec.encode(found) == [packed(library.encode(x, add_special_tokens=False).ids) for x in found]


def test_known_ids_take_little_memory():
    """Known chunks and words were Python objects, about 200 bytes each, and Arrow's spare memory stayed between batches."""
    chunks = [f"w{n}x" for n in range(100_000)]
    ids = ChunkIds([], lambda words: [packed([len(x), 7]) for x in words], lambda text: b"")
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    assert ids.texts([" ".join(chunks), "w1x  w5x "]) == [packed([y for x in chunks for y in (len(x), 7)]), packed([3, 7] * 2)]
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(ids.known) == 100_001 and held < 6 << 20


def test_forgetting_chunks_keeps_blank_and_odd_ones_right(library, codec, monkeypatch):
    monkeypatch.setattr("ringledger.llm.tokens.REMEMBERED", 3)
    fresh = bpe.Codec(default_vocabulary())
    for found in ([" a b "], ["c, d e's", "\n f "], [""], ["a b c d", "漢字 a"], ["a, a b,\n"], ["b"]):
        assert fresh.encode(found) == codec.encode(found) == [packed(library.encode(x, add_special_tokens=False).ids) for x in found]
