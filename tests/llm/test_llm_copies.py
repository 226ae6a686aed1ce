import itertools
"""The pipeline's near copies against brute-force Jaccard."""

import os
import random

import pytest
from test_llm_simhash import roots

import corpus_pipeline
from ringledger.functions.workspace import work_dir
from ringledger.llm import copies, gray

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def check(docs):
    """The ids and texts that stay are the smallest of each group."""
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    root = roots(range(len(sets)), lambda a, b: near(sets[a], sets[b]))
    at = {s: root[k] for k, s in enumerate(sets)}
    group = {}
    for i, t in rows:
        group.setdefault(at[plain_set(t)], []).append((i is None, i or 0, t))
    kept = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates_stage(docs.sparkSession, docs, "").collect()]
    assert len(kept) == len(group)
    for found in group.values():
        (own,) = [x for x in kept if x in found]
        assert own[:2] == min(x[:2] for x in found)


def edited(words, places, rng):
    return " ".join("".join(rng.choices("abcdefgh", k=9)) if k in places else w for k, w in enumerate(words))


def made():
    """Bases with copies at all distances around the bound, short texts, and a group around one text."""
    rng = random.Random(7)
    out = []
    for n in (5, 7, 9, 12, 30, 60, 200, 900):
        words = ["".join(rng.choices("stuvwxyz", k=7)) for _ in range(n)]
        out.append(" ".join(words))
        out.append(" ".join(words[: n - max(1, n // 9)]))
        out.append("  ".join(words).upper())
        out += [edited(words, set(rng.sample(range(n), k)), rng) for k in (1, max(1, n // 60), max(1, n // 45), max(1, n // 30), n // 5)]
    words = ["".join(rng.choices("klmnopqr", k=6)) for _ in range(120)]
    return out + [edited(words, {k}, rng) for k in range(0, 120, 4)]


def test_made_pairs(spark):
    check(spark.createDataFrame(list(enumerate(made()))[::-1], SCHEMA))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_documents(name, request):
    check(request.getfixturevalue(name).select("doc_id", "text"))


def test_empty(nothing):
    assert copies.keep_one(nothing).count() == 0


def test_similar_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        other = [w if rng.random() < 0.9 else "d" for w in words]
        a, b = " ".join(words), " ".join(other)
        assert copies.similar(copies.shingles(a), copies.shingles(b)) == near(plain_set(a), plain_set(b))


def test_null_and_repeated_ids_keep_their_own_texts(spark):
    """Before, one row of all null ids stayed, and one of each repeated id."""
    texts = [f"{w} walks along the {w} river and sings a song of {w}" for w in ("one", "two", "three", "four", "five")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3]), (2, texts[3]), (3, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, map(tuple, copies.keep_one(docs).collect()))) == sorted(map(str, [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (3, texts[4])]))
    check(docs)


def hub(n, rng):
    """A text and ``n`` copies of it with two changed words each: near to it, not to one another."""
    words = ["".join(rng.choices("mnopqrst", k=7)) for _ in range(150)]
    return [" ".join(words)] + [edited(words, {*rng.sample(range(8, 142), 2)}, rng) for _ in range(n)]


def planned(docs, monkeypatch):
    """The pairs that each round compares."""
    counts, plain = [], copies.confirmed
    monkeypatch.setattr(copies, "confirmed", lambda pairs, texts: counts.append(pairs.count()) or plain(pairs, texts))
    check(docs)
    return counts


def test_a_large_group_costs_a_pair_for_each_text(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(hub(300, random.Random(11)))), SCHEMA)
    assert sum(planned(docs, monkeypatch)) < 4 * 300


def test_sweeps_meet_all_that_no_centre_joins(spark, monkeypatch):
    """Without the text that they were made from, most copies are near to no other: a sweep sets each member of a key against its centres only, no link is lost."""
    monkeypatch.setattr(copies, "FIRST", 2)
    docs = spark.createDataFrame(list(enumerate(hub(60, random.Random(12))[1:])), SCHEMA)
    counts = planned(docs, monkeypatch)
    swept = counts[copies.STARS :]
    assert swept and all(n <= 2 * 4**k * 60 * copies.BANDS for k, n in enumerate(swept)) and sum(swept) < 60 * 59 // 2


def test_clashing_names(spark):
    """Columns named like those that the operator makes stay as they are."""
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "x", 2.0), (2, "a b c d e f", 8, "y", 3.0)], SCHEMA + ", none int, own string, root double")
    (kept,) = copies.keep_one(docs).collect()
    assert tuple(kept) == (1, "a b c d e f", 7, "x", 2.0)


def test_rare_keys_lose_no_pair(spark):
    """Variants of one base with shared edits, many just under or over 0.8: near copies meet at a key, the smaller one short there."""
    rng = random.Random(9)
    base = [f"w{n}" for n in range(90)]
    edits = [(rng.randrange(90), f"e{n}") for n in range(25)]
    texts = set()
    for _ in range(120):
        words = list(base)
        for at, word in rng.sample(edits, rng.randrange(6)):
            words[at] = word
        texts.add(" ".join(words[: rng.randrange(75, 91)]))
    found = [(n.to_bytes(2, "big"), t) for n, t in enumerate(sorted(texts))] + [(b"blank", " "), (b"alone", "quite another text of few words")]
    frame = spark.createDataFrame(found, "node binary, text string")
    keys = {}
    for r in copies.rare_keys(frame, frame.select("node")).collect():
        keys.setdefault(bytes(r["node"]), {})[r["key"]] = r["short"]
    sets = {n: copies.shingles(t) for n, t in found if t.strip()}
    near = met = 0
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items(), key=lambda p: len(p[1])), 2):
        if copies.similar(x, y):
            near += 1
            both = keys[a].keys() & keys[b].keys()
            met += any(keys[a][k] and (keys[b][k] or len(x) < len(y)) for k in both)
    assert near == met > 100 and b"alone" not in keys and b"blank" not in keys


def test_the_first_round_meets_by_simhash(spark, monkeypatch):
    """Texts whose five-word fingerprints lie within the index's bits meet there, and no others do."""
    rng = random.Random(21)
    bases = [["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)] for _ in range(30)]
    texts = [" ".join(x) for x in bases] + [edited(x, {*rng.sample(range(400), 1 + k % 4)}, rng) for k, x in enumerate(bases)]
    value = {t: gray.majority(copies.shingles(t)) for t in texts}
    close = {frozenset(p) for p in itertools.combinations(texts, 2) if (value[p[0]] ^ value[p[1]]).bit_count() <= copies.BITS}
    rounds, plain = [], copies.confirmed

    def spy(pairs, found):
        names = {r["node"]: r["text"] for r in found.select("node", "text").collect()}
        rounds.append({frozenset((names[r["left"]], names[r["right"]])) for r in pairs.collect()})
        return plain(pairs, found)

    monkeypatch.setattr(copies, "confirmed", spy)
    check(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert 3 < len(close) < 30 and rounds[0] == close



def with_edits(words, edits):
    own = list(words)
    for at, word in edits:
        own[at] = word
    return " ".join(own)


def test_marks_drop_pairs_that_are_no_near_copies(spark, monkeypatch):
    """Most pairs of these variants of one text are just no near copies; the sweeps compared 1,578 pairs of them before."""
    rng = random.Random(22)
    words = ["".join(rng.choices("mnopqrst", k=7)) for _ in range(300)]
    edits = [(k, f"x{k}") for k in rng.sample(range(300), 24)]
    texts = {with_edits(words, rng.sample(edits, 6)) for _ in range(80)}
    counts = planned(spark.createDataFrame(list(enumerate(sorted(texts))), SCHEMA), monkeypatch)
    assert sum(counts[copies.STARS :]) < 500


def test_rounds_without_links_and_used_tables_leave_nothing(spark, monkeypatch):
    """Components were worked out anew after each round, links or not, and every table of every round stayed until the end."""
    rng = random.Random(23)
    bases = [["".join(rng.choices("mnopqrst", k=7)) for _ in range(200)] for _ in range(4)]
    texts = [" ".join(x) for x in bases] + [with_edits(x, [(k, f"x{k}") for k in range(9, 200, 28)]) for x in bases]
    rounds, linked, plain, found = [], [], copies.confirmed, copies.components
    monkeypatch.setattr(copies, "confirmed", lambda pairs, texts: rounds.append(plain(pairs, texts).count()) or plain(pairs, texts))
    monkeypatch.setattr(copies, "components", lambda *a: linked.append(1) or found(*a))
    before = {*os.listdir(work_dir(spark).removeprefix("file:"))}
    check(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    left = {x.rsplit("-", 1)[0] for x in {*os.listdir(work_dir(spark).removeprefix("file:"))} - before}
    # One for the index, one for the first round, one for each later round with links.
    assert 0 in rounds[1:] and len(linked) == 2 + sum(n > 0 for n in rounds[1:])
    assert left == {"near-copy-groups", "kept"}


def test_shared_keys_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """The same rows, whether the shared keys fit a broadcast or not."""
    keyed = spark.createDataFrame([(b"a", 1), (b"b", 1), (b"b", 2), (b"c", 3), (b"d", 3), (b"e", 3), (b"f", None), (b"g", None)], "node binary, key long")
    wanted = [(b"a", 1), (b"b", 1), (b"c", 3), (b"d", 3), (b"e", 3)]
    assert sorted((bytes(r["node"]), r["key"]) for r in copies.shared(keyed).collect()) == wanted
    monkeypatch.setattr(copies, "small_side", lambda df: df)
    assert sorted((bytes(r["node"]), r["key"]) for r in copies.shared(keyed).collect()) == wanted
