"""Quality by co-training.

Two classifiers see different views of a document: its content (shapes of its words, repetition) and its
page metadata (source, lang, length, lines and the kinds of characters on the page). Over some rounds each
labels the unlabelled rows that it is surest of and hands them to the other. Both views are then
calibrated on labelled rows kept aside, and combined to score every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut
from ringledger.llm import linear
from ringledger.llm.rows import batches, map_arrow

#: Training rows of each kind (good, bad, unlabelled) at most.
SAMPLE = 8_000

#: Rounds, and the share of the unlabelled rows that a view hands over in each.
ROUNDS, HANDED = 5, 0.08

#: Buckets of word shapes, sources and languages.
SHAPES, SOURCES, LANGS = 96, 16, 8

CONTENT, METADATA = SHAPES + 5, SOURCES + LANGS + 14


class _Kinds(dict[int, str]):
    """Each character's kind: upper case, other letters and digits, or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[code]


_KIND_OF, _RUN = _Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """A word's kinds of characters in order, each run once, over the whole word: ``Hello!!`` is ``Aa!``."""
    return _RUN.sub(r"\1", word.translate(_KIND_OF))


class ContentView:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def read(self, text: str) -> np.ndarray:
        """Shares of word shapes; neighbouring repeats, distinct words, the commonest word, distinct lines, word length."""
        words = text.split()
        out = np.zeros(CONTENT)
        if not words:
            out[-1] = 1
            return out
        if len(self.known) > 400_000:
            self.known = {}
        for word in set(words).difference(self.known):
            self.known[word] = zlib.crc32(shape(word).encode()) % SHAPES
        n = len(words)
        out[:SHAPES] = np.sqrt(np.bincount(np.fromiter(map(self.known.__getitem__, words), np.int64, n), minlength=SHAPES) / n)
        distinct = len(set(words))
        lines = text.split("\n")
        out[SHAPES:] = sum(a == b for a, b in zip(words, words[1:])) / n, distinct / n, np.log1p(n / distinct), len(set(lines)) / len(lines), min(len(text) / n / 10, 3) - 0.6  # noqa: B905
        return out


_KINDS = np.zeros(256, np.uint8)
for _byte in range(256):
    _KINDS[_byte] = 6 if _byte >= 128 else 0 if 97 <= _byte <= 122 else 1 if 65 <= _byte <= 90 else 2 if 48 <= _byte <= 57 else 3 if _byte in (9, 11, 12, 13, 32) else 4 if _byte == 10 else 5
_BLANK = re.compile(r"\n\s*\n")


def metadata_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Source and lang by bucket, length, lines, and shares of the kinds of characters. Nulls have their own bucket."""
    out = np.zeros(METADATA)
    out[zlib.crc32((source or "").encode()) % (SOURCES - 1) if source is not None else SOURCES - 1] = 1
    out[SOURCES + (zlib.crc32(lang.encode()) % (LANGS - 1) if lang is not None else LANGS - 1)] = 1
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KINDS[data], minlength=7) / max(1, len(data))
    length = len(text) if n_chars is None else n_chars
    lines = text.count("\n") + 1
    out[SOURCES + LANGS :] = *np.sqrt(kinds), np.log1p(max(0, length)) / 10, np.log1p(lines) / 5, np.log1p(len(text) / lines) / 8, np.log1p(len(_BLANK.findall(text))) / 4, kinds[1] / (kinds[0] + kinds[1] + 0.01), kinds[5] / (kinds[3] + 0.01), float(not len(data))
    return out


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are not read, so that accuracy can be measured on them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Coefficients of both views, and of their combination: log-odds by content, by metadata, intercept."""

    content: np.ndarray
    metadata: np.ndarray
    calibration: np.ndarray
    joint: np.ndarray

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.column_stack([linear.decide(content, self.content), linear.decide(metadata, self.metadata)])
        each = z * self.calibration[:, 0] + self.calibration[:, 1]
        return linear.sigmoid(each[:, 0]), linear.sigmoid(each[:, 1]), linear.sigmoid(linear.decide(np.clip(each, -12, 12), self.joint))


def co_train(views: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``label`` is 1, 0, or -1 where unknown. A fifth of the labelled rows is kept aside for calibration."""
    known = np.flatnonzero(label >= 0)
    aside = known[::5] if len(known) >= 50 else known
    used = np.setdiff1d(known, aside) if len(known) >= 50 else known
    free = np.flatnonzero(label < 0)
    good_share = float((weight[used] * label[used]).sum() / weight[used].sum())
    handed: list[dict[int, float]] = [{}, {}]
    fitted: list[np.ndarray] = []

    def fit(k: int) -> np.ndarray:
        rows = np.append(used, np.fromiter(handed[k], int, len(handed[k])))
        y = np.append(label[used].astype(float), np.fromiter(handed[k].values(), float, len(handed[k])))
        w = np.append(weight[used], np.full(len(handed[k]), 0.5 * weight[used].mean()))
        return linear.fit(views[k][rows], y, w, penalty=0.3)

    for _ in range(rounds):
        fitted = [fit(0), fit(1)]
        for k in (0, 1):
            other = 1 - k
            rest = free[~np.isin(free, np.fromiter(handed[other], int, len(handed[other])))]
            if not len(rest):
                continue
            p = linear.sigmoid(linear.decide(views[k][rest], fitted[k]))
            order = np.argsort(p)
            most = max(1, int(len(free) * HANDED))
            bad, good = max(1, int(most * (1 - good_share))), max(1, int(most * good_share))
            handed[other].update({int(rest[i]): 0.0 for i in order[:bad] if p[i] < 0.1})
            handed[other].update({int(rest[i]): 1.0 for i in order[-good:] if p[i] > 0.9})
    fitted = [fit(0), fit(1)]
    z = np.column_stack([linear.decide(v[aside], c) for v, c in zip(views, fitted, strict=True)])
    y, w = label[aside].astype(float), weight[aside]
    calibration = np.stack([linear.fit(z[:, [k]], y, w, penalty=0.1) for k in (0, 1)])
    joint = linear.fit(np.clip(z * calibration[:, 0] + calibration[:, 1], -12, 12), y, w, penalty=0.1)
    return Model(fitted[0], fitted[1], calibration, joint)


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))))


def _views(batch: pa.RecordBatch, values: list[str], content: ContentView) -> tuple[np.ndarray, np.ndarray]:
    about = zip(values, batch.column("source").to_pylist(), batch.column("lang").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)
    return np.stack([content.read(x) for x in values]), np.stack([metadata_view(*x) for x in about])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit both views on at most ``SAMPLE`` good, ``SAMPLE`` bad and ``SAMPLE`` unlabelled rows; None without labels of both kinds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("kind")).filter(F.col("doc_id").isNotNull() & F.col("kind").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("kind").alias("kind"))
    rows = _columns(docs).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    kinds = rows.select("doc_id").dropDuplicates(["doc_id"]).join(marks, "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit(-1)))
    picked, counts = linear.sampled(kinds, "kind", SAMPLE)

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = ContentView()
        for batch, values in batches(found):
            packed = [pa.array([x.astype("<f4").tobytes() for x in view], pa.binary()) for view in _views(batch, values, content)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), *packed], ["doc_id", "kind", "content", "metadata"])

    # At most 3 * SAMPLE rows of two numbers.
    sample = rows.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    found = cut(map_arrow(sample, lambda: task, "doc_id long, kind int, content binary, metadata binary"), "quality-sample").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    label = np.array([r["kind"] for r in found], int)
    if not (label == 1).any() or not (label == 0).any():
        return None
    sizes = {k: int((label == k).sum()) for k in (-1, 0, 1)}
    weight = np.array([counts[k] / sizes[k] for k in label.tolist()])
    views = [np.stack([np.frombuffer(r[name], "<f4") for r in found]).astype(float) for name in ("content", "metadata")]
    return co_train(views, label, weight * len(weight) / weight.sum())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``content_score``, ``metadata_score``, ``score`` (chance of good quality) and ``predicted`` (1: good).

    Null texts count as empty, and empty ones are scored like any other. Null metadata has a bucket of
    its own; columns that are missing count as null. Without labels of both kinds every score is null and
    every row is predicted good. Rows map one to one; a null ``doc_id`` takes no part in training.
    """
    model = train(docs, labels)

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = ContentView()
        for batch, values in batches(found):
            each = model.scores(*_views(batch, values, content)) if model else [pa.nulls(len(values), pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.round(x, 9)) if model else x for x in each)], ["doc_id", "content_score", "metadata_score", "score"])

    found = map_arrow(_columns(docs), lambda: task, "doc_id long, content_score double, metadata_score double, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", F.coalesce((F.col("score") >= 0.5).cast("int"), F.lit(1)).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns and whole texts.

    Nulls, empty texts and missing metadata columns are as in :func:`scored`; repeated rows are judged alike. Without
    labels of both kinds every row stays.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    lacking = [c for c in ("source", "lang", "n_chars") if c not in docs.columns]

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = ContentView()
        for batch, values in batches(found):
            known = batch
            for name in lacking:
                known = known.append_column(name, pa.nulls(len(values)))
            keep = pa.array(model.scores(*_views(known, values, content))[2] >= 0.5)
            yield batch.filter(keep)

    return map_arrow(docs, lambda: task, docs.schema)
