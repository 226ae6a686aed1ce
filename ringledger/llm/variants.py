"""Spelling variants of words by permuterm rotations.

A word of L characters and a terminator has L + 1 rotations. A rotation without its last character is the word with
that character skipped, seen from behind the gap. So words that share such a prefix differ by a replaced character at
that place, and a word one of whose own rotations is that prefix lacks the character. All rotations and prefixes are
sorted together; rows with one key are a group, which holds at most one whole rotation and one row for each
letter that can be skipped. A scan over the groups gives every member the number of its neighbours there and the
best of them; a group's pairs are never written out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut
from ringledger.llm.rows import batches, map_arrow, texts

#: Code points and occurrences of a word at least, how much more often its form occurs, and the share of runs that lose a code point.
LENGTH, LEAST, TIMES, DAMAGED = 6, 5, 5, 199

#: The end of a word; no letter.
END = "$"

#: Words that a task adds up before it hands them on.
HELD = 300_000

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc: int | None, text: str, damaged: int = DAMAGED) -> Counter[str]:
    """The words of a text with their numbers, those of damaged runs without the lost code point."""
    # Bytes know the case of A to Z alone.
    out: Counter[str] = Counter()
    base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(_RUNS.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), base)
        if h % damaged == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = LEAST, damaged: int = DAMAGED) -> DataFrame:
    """``word`` and ``n`` of all words with at least ``length`` code points and ``least`` occurrences in all texts."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch, values in batches(found):
            for doc, text in zip(batch.column("doc_id").to_pylist(), values, strict=True):
                for word, n in words_of(doc, text, damaged).items():
                    if len(word) >= length:
                        held[word] += n
            if len(held) > HELD:
                yield _table(held)
                held = Counter()
        yield _table(held)

    found = map_arrow(texts(docs), lambda: task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _table(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], ["word", "n"])


def rotations(word: str) -> list[tuple[str, bool, bool]]:
    """The keys under which a word meets its neighbours: ``(key, whole, first)``.

    Whole rotations are met by words with a character more, prefixes by words with another character there or, if
    ``first``, without it. Of equal characters in a row only the first counts as the lacking one, so that no two words
    meet twice.
    """
    whole = word + END
    out = []
    for k in range(len(word)):
        turned = whole[k + 1 :] + whole[:k]
        first = not k or word[k - 1] != word[k]
        out.append((turned, False, first))
    # A whole rotation may start at any place: wherever the longer word can have its character, its end too.
    out += [(whole[k:] + whole[:k], True, True) for k in range(len(whole))]
    return out


def keyed(words: DataFrame) -> DataFrame:
    """``key``, ``whole``, ``first``, ``word`` and ``n`` of all rotations and prefixes of ``words``."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for batch, values in batches(iter([whole]), limit=1 << 18, text="word"):
                rows = [(*x, word, n) for word, n in zip(values, batch.column("n").to_pylist(), strict=True) for x in rotations(word)]
                kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "whole", "first", "word", "n"])

    return map_arrow(words, lambda: task, "key string, whole boolean, first boolean, word string, n long")


def met(group: list[tuple[bool, bool, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """``(word, near, best, best n)`` for each member of a group that has a neighbour in it.

    Members that skip a character are neighbours of one another; a whole rotation is one of the members that are first.
    """
    skipping = sorted((x for x in group if not x[0]), key=lambda x: (-x[3], x[2]))
    wholes = [x for x in group if x[0]]
    firsts = [x for x in skipping if x[1]]
    for _, _, word, _ in wholes:
        if firsts:
            yield word, len(firsts), firsts[0][2], firsts[0][3]
    for place, (_, first, word, _) in enumerate(skipping):
        near = len(skipping) - 1 + len(wholes) * first
        # Wholes are one at most; of the others the best is the first, or the second for the first itself.
        others = [*skipping[place == 0 :][:1], *(wholes if first else [])]
        if near:
            best = min(others, key=lambda x: (-x[3], x[2]))
            yield word, near, best[2], best[3]


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``n`` and ``word`` of the most frequent near word, ties to the smaller) of every word that has a near one."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in found:
            out: list[tuple[str, int, str, int]] = []
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "whole", "first", "word", "n")), strict=True):
                if own != key:
                    if len(group) > 1:
                        out += met(group)
                    key, group = own, []
                group.append(tuple(row))
            yield _met(out)
        yield _met([*met(group)] if len(group) > 1 else [])

    # Equal keys lie in one range and, sorted, next to each other.
    ordered = keyed(words).repartitionByRange("key").sortWithinPartitions("key")
    rows = map_arrow(ordered, lambda: task, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return rows.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), "best.word").alias("best"))


def _met(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "near", "best", "best_n"])


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every word of ``forms`` (word, form): the last word that forms lead to.

    A form is more frequent than its word, so chains end. Each round doubles the steps taken, as far as the longest chain needs.
    """
    state = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        state = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return state


def grouped(docs: DataFrame, length: int = LENGTH, least: int = LEAST, times: int = TIMES, damaged: int = DAMAGED) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of the vocabulary.

    Words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word with the
    largest ``n``, ties to the smaller by code points, if that is at least ``times`` the word's; else null. ``root`` follows forms to the
    last word. Null and empty texts have no words; a null ``doc_id`` is written as nothing where runs are picked for
    damage. Repeated rows count as often as they are. No words give no rows. Only ``doc_id`` and ``text`` are read.
    """
    words = cut(vocabulary(docs, length, least, damaged), "words")
    near = cut(words.join(neighbours(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best")), "near-words")
    rooted = roots(near.filter("best IS NOT NULL").select("word", F.col("best.word").alias("form")))
    return near.join(rooted, "word", "left").select("word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), F.col("best.n").alias("form_n"))
