"""Token counts, collocations and spelling variants against plain versions."""

import re
import sys
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ringledger.llm import collocations, tokencounts, variants

# --- token counts ---------------------------------------------------------------------------

TEXTS = ["", " ", "  ", "\n", " \n ", "a\n\nb <s> </s>\t x  ", "▁a ▁▁ b▁", "漢字 かな\r\n混じり\n", "\U0001f642\x00ﬁ½ <unk><0x0A>", "word," * 300, "  " * 50 + "end"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokencounts.default_model())


def check_counts(library, docs, limit=tokencounts.LIMIT):
    want = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text))
        want[(r["doc_id"], len(text.encode()), n, n > limit)] += 1
    got = tokencounts.counted(docs, limit=limit)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_counts_as_the_library_does(library, name, request):
    check_counts(library, request.getfixturevalue(name))


def test_counts_with_few_frequent_pre_tokens(library, spark, documents, monkeypatch):
    """Nearly all pre-tokens go through the join."""
    monkeypatch.setattr(tokencounts.frequent, "__defaults__", (20,))
    rows = [(k, x) for k, x in enumerate(TEXTS)]
    check_counts(library, spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text")), 60)


def test_each_pre_token_is_counted_once(documents):
    counts = tokencounts.piece_counts(documents).collect()
    plain = Counter(x for r in documents.collect() for x in tokencounts.pre_tokens(r["text"] or "") if r["text"])
    assert {r["part"]: r["n"] for r in counts} == plain and len(counts) == len(plain)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=" \n▁ab.é漢\t\r", max_size=40))
def test_any_text_is_the_sum_of_its_pre_tokens(text):
    pieces = _pieces()
    parts = tokencounts.pre_tokens(text) if text else []
    assert sum(pieces.counts(parts)) + text.count("\n") == len(pieces.library.encode(text))


_held = []


def _pieces():
    if not _held:
        _held.append(tokencounts.Pieces(tokencounts.default_model()))
    return _held[0]


# --- collocations ---------------------------------------------------------------------------


def plain_collocations(rows, least=10, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for size in (1, 2, 3):
                counts.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in often.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def check_collocations(docs, **options):
    got = collocations.collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    keep = {k: v for k, v in options.items() if k in ("least", "top")}
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], **keep)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_collocations_small(spark, odd, nothing):
    assert check_collocations(odd) and not check_collocations(nothing)
    text = "New York is big. new york, New\tYork  city: red-hot chili\x0cpeppers; a b c a b c a b c. " + "x " * 700
    rows = [(None, text), ("und", text), ("", text), ("en", text * 30), ("en", None), ("en", " .,;\t"), ("de", "É é ß \x85 \xa0 y é ß \x85"), ("en", "b a. " * 12)]
    docs = spark.createDataFrame([(k, lang, t, "x", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, f string, chunk int")
    for trigger, most in ((1, 128), (3, 2), (12, 128), (10**9, 10**9)):
        assert check_collocations(docs, least=2, top=7, trigger=trigger, most=most)


def test_collocations_of_documents(documents):
    assert check_collocations(documents, least=3)


def test_chunks_hold_every_phrase_once():
    words = [f"w{k * k % 37}" for k in range(300)]
    for trigger, most in ((1, 9), (4, 128), (12, 5)):
        got = Counter()
        found = collocations.chunks_of(words, collocations.Triggers(trigger), most)
        assert sum(own for own, _ in found) == len(words)
        for own, chunk in found:
            part = chunk.split(" ")
            got.update(tuple(part[k : k + 3]) for k in range(min(own, len(part) - 2)))
        assert got == Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBÉé .,\t\n\r\x0b\x85\xa0漢\U0001f600", max_size=30), min_size=1, max_size=8))
def test_words_of_many_texts_at_once(found):
    words, begins, ends = collocations.words_of(pa.array(["x. y", *found], pa.large_string()).slice(1))
    plain = [[re.findall("[^ \t]+", x.replace("B", "b")) for x in re.split("[.,;:!?\x0a-\x0d]", text)] for text in found]
    assert words.to_pylist() == [w for text in plain for piece in text for w in piece]
    assert begins.tolist() == [not k for text in plain for piece in text for k in range(len(piece))]
    assert ends.tolist() == [sum(len(piece) for text in plain[: k + 1] for piece in text) for k in range(len(plain))]


def test_chunks_take_no_python_call_for_each_word():
    """Each distinct word and each piece took calls before, a third of the query's CPU seconds."""
    calls = Counter()
    words = [f"w{k}" for k in range(3000)]
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        found = collocations.chunks_of(words, collocations.Triggers(4), 9)
    finally:
        sys.setprofile(None)
    assert sum(own for own, _ in found) == 3000 and len(found) > 500
    assert calls["call"] < 100 and not collocations.chunks_of([], collocations.Triggers(4))


def test_scores_past_64_bits(spark):
    big = 10**14
    parts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", 3 * big)], "lang string, phrase string, f long")
    found = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    assert collocations._scored(found, parts, (1,)).first()["score"] == 10**6 * big * big // ((big + 1) * 3 * big)


# --- spelling variants ----------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def edits(word, letters):
    """All texts one edit away."""
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    out |= {word[:k] + c + word[k + cut :] for k in range(len(word) + 1) for c in letters for cut in (0, 1)}
    return out - {word}


def plain_variants(rows, length=6, least=5, times=5, damaged=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    letters = sorted(set("".join(words)))
    near = {w: [x for x in edits(w, letters) if x in words] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def check_variants(docs, **options):
    got = variants.grouped(docs, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()], **options)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_variants(spark, odd, nothing, documents):
    assert check_variants(odd, length=3) and not check_variants(odd) and not check_variants(nothing)
    found = check_variants(documents, length=4, least=1, times=2, damaged=7)
    assert any(r[1] and r[2] != r[1] for r in found) and any(r[4] > 3 for r in found)
    check_variants(documents, damaged=3)


def test_variants_of_made_words(spark):
    words = {"aaaaaa": 100, "aaaaa": 20, "aaaa": 4, "aaaaaaa": 20, "aabaaa": 20, "abaaaa": 4, "bäaaaa": 4, "Äbaaaa": 2, "×÷ÿÀaa": 3, "×÷ÿÀab": 15}
    text = " ".join(" ".join([w] * n) for w, n in words.items())
    docs = spark.createDataFrame([(None, text), (1, text.replace(" ", "-")), (1, None), (2, "")], "doc_id long, text string")
    for damaged in (10**9, 1, 2):
        assert check_variants(docs, length=1, least=1, times=3, damaged=damaged)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="ab", min_size=1, max_size=6), max_size=40))
def test_groups_meet_every_near_pair_once(words):
    groups = {}
    for n, word in enumerate(sorted(words)):
        for key, whole, first in variants.rotations(word):
            groups.setdefault(key, []).append((whole, first, word, n))
    near = Counter()
    for group in groups.values():
        assert sum(x[0] for x in group) <= 1
        for word, count, _, _ in variants.met(group) if len(group) > 1 else ():
            near[word] += count
    assert {w: near[w] for w in words} == {w: sum(one_edit(w, x) for x in words) for w in words}


def test_more_languages_than_a_run_numbers():
    """A run with too many languages is halved, and counts stay whole."""
    n = 40_000
    run = pa.table({"lang": pa.array([str(k % (n - 1)) for k in range(n)]), "own": pa.array([2] * n, pa.int32()), "chunk": ["a b"] * n, "times": pa.array([3] * n, pa.int64())})
    got = Counter()
    for batch in collocations._counted(run, None):
        for row in batch.to_pylist():
            got[(row["lang"], row["phrase"])] += row["f"]
    assert got == Counter({(str(k), phrase): 6 if not k else 3 for k in range(n - 1) for phrase in ("a", "b", "a b")})
