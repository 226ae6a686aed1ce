"""Licences, personal data and spot signatures against plain versions, and that their plans hold no Python."""

import hashlib
import re

import duckdb
import pytest
import regex

from ringledger.llm import licenses, pii, spotsigs

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
    return True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


HARD = [
    "x a@b.c_d@e.f 1.2.3.4.5.6.7.8 00001.02.003.0255 256.1.1.1 4532015112830366 4532-0151 1283-0366 4532015112830367",
    "+49 30 1234567 +1 +12 (34)5+6789012345 +1234567890123456 é\U0001f600@a.b c@d.e. f@g..h @i.j k@l.m-n.o-",
    "9" * 20000 + " " + "1 2 " * 9000, "a" * 30000 + "@", "1." * 9000, ".".join(["1"] * 4001), "a@b" + ".c" * 9000, "", None,
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")


def test_base_spans(documents, hard, odd, nothing):
    for docs in (documents, hard, odd):
        want = sorted((r["doc_id"] or 0, *base_spans(r["text"])) for r in docs.collect())
        got = sorted((r["doc_id"] or 0, *(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in BASE)) for r in pii.found_spans(docs).collect())
        assert got == want
    for r in pii.digest(odd).collect():
        own = [x for x in r["spans"].split(",") if x.split(":")[0] in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert r["n_email"] == sum(x.startswith("email:") for x in own)
    assert pii.digest(nothing).count() == 0 and pii.redacted(nothing).count() == 0


def test_redaction(odd, texts_by_id, documents):
    after = pii.redacted(odd)
    assert after.columns == odd.columns
    rows = {r["doc_id"]: r for r in after.collect()}
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[5]["text"] == {r["doc_id"]: r["text"] for r in odd.collect()}[5]
    assert rows[7]["text"] == "Write to [EMAIL] or call [PHONE]. é\U0001f600 <|endoftext|>" and rows[7]["n_chars"] == len(rows[7]["text"])
    for r in pii.redacted(documents).collect():
        assert not base_spans(r["text"])
        assert base_spans(texts_by_id[r["doc_id"]]) or r["text"] == texts_by_id[r["doc_id"]] or "[" in r["text"]


def test_long_secrets_leave_nothing(spark, documents):
    """Before, a span of 64 characters left the rest of a longer secret in the text."""
    jwt = ".".join(("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV-adQssw5c="))
    secrets = ["aB3dE5gH7j" * 20, "aB3dE5gH7jaB3dE5gH7j" + "x" * 180, jwt, "Zm9vYmFyMTIzNDU2Nzg5MA==", "aB3dE5gH" + ".c1" * 9000, "abcdefgh" * 9 + "1"]
    rows = [(10_000_000 + k, f"Here is it: {name}{secret}. The rest stays.") for k, secret in enumerate(secrets) for name in ("password=",)]
    after = {r["doc_id"]: r["text"] for r in pii.redacted(documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [after[i] for i, _ in rows] == ["Here is it: [SECRET]. The rest stays."] * len(rows)


def plain_signatures(text):
    words, out = regex.split(r"[^\p{L}\p{N}]+", text.lower()), set()
    for k, word in enumerate(words):
        following = [x for x in words[k + 1 : k + 1 + spotsigs.REACH] if x and x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if word in spotsigs.ANCHORS and len(following) == spotsigs.CHAIN:
            out.add((word, *following))
    return out or {text}


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_spot_signatures(name, request):
    docs = request.getfixturevalue(name)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_signatures, (text, edited, following))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b), len(a & c) / len(a | c), len(a)))
    got = [(r[0], r[1], r[2], r[5], r[6], int(r[3].split(":")[1])) for r in spotsigs.digest(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    prints = {}
    for r in spotsigs.digest(docs).collect():
        prints.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    texts = {}
    for i, text in rows:
        texts.setdefault(frozenset(plain_signatures(text)), set()).add(i)
    assert sorted(map(sorted, prints.values()), key=str) == sorted(map(sorted, texts.values()), key=str) or name == "odd"


def test_pruned_likeness(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 2, 3, 4, 6]), ([1], [1, 2, 3, 4, 5, 6, 7, 8]), ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5])], "a array<long>, b array<long>")
    got = rows.select(spotsigs.likeness(rows.a, rows.b).alias("x"), spotsigs.likeness(rows.a, rows.b, 0.8).alias("y")).collect()
    assert [tuple(r) for r in got] == [(4 / 6, 0.0), (1 / 8, 0.0), (1.0, 1.0)]


def test_spot_signatures_of_few_rows(nothing, odd):
    assert spotsigs.digest(nothing).count() == 0
    (only,) = spotsigs.digest(odd.filter("doc_id = 7")).collect()
    assert only["near_next"] == 1.0


def test_licenses(spark, documents, odd, nothing):
    for docs in (documents, odd):
        con = duckdb.connect()
        con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
        want = con.sql(f"select doc_id, n_sentences, sentences, licenses from ({licenses.digest_sql()})").fetchall()
        assert sorted(map(str, map(tuple, licenses.digest(docs).collect()))) == sorted(map(str, want))
    assert licenses.digest(nothing).count() == 0


def test_each_rule(spark):
    rules = [(name, sequence) for found in licenses.RULES.values() for name, sequence in found]
    rows = [(k, "Intro!\n" + "\nAn unknown line.\n".join(licenses.SENTENCES[x][0].capitalize() + "." for x in sequence.split())) for k, (_, sequence) in enumerate(rules)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        name, sequence = rules[r["doc_id"]]
        assert r["sentences"] == sequence.split() and name in r["licenses"]


@pytest.mark.parametrize("build", [pii.digest, spotsigs.digest, licenses.digest, pii.redacted])
def test_no_python_in_the_plan(build, documents):
    plan = build(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
