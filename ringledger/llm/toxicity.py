"""Toxicity by weak supervision.

Voters are lexicons and patterns. Lexicons beyond the fixed one are entries (words and word beginnings)
that training rows show to be telling, dealt over several voters. A generative model of the votes,
in which every voter depends on the label and on the one voter that it is most correlated with, finds
accuracies and correlations by expectation maximisation over labelled and unlabelled rows. Its posteriors
are the labels on which a linear classifier is trained, and the classifier scores every whole text.

Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are read. Labels, lang, source and doc_id
are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut
from ringledger.llm import linear
from ringledger.llm.rows import batches, map_arrow, texts

#: Training rows of each kind (toxic, other, unlabelled) at most.
SAMPLE = 8_000

#: Lexicon entries at most, and the voters that they are dealt over.
ENTRIES, LEXICONS = 192, 8

#: Entries are words and their beginnings of these lengths.
SHORTEST, LONGEST = 3, 8

#: How sure the model is that a label is right.
LABEL_ACCURACY = 0.999

#: Weight of a row whose label is only inferred.
INFERRED = 0.25

#: Insults of the fixed lexicon.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "clown", "pathetic", "worthless",
    "disgusting", "filth", "filthy", "vermin", "imbecile", "retard", "bastard", "bitch", "asshole", "crap", "shit", "fuck", "fucking",
    "whore", "slut", "pig", "ugly", "hate", "kill", "die",
)

#: Patterns, one voter each.
PATTERNS = (
    r"\byou(?:'re| are)? (?:such |all |just )?(?:an? )?(?:idiot|moron|loser|clown|stupid|pathetic|disgusting|worthless)",
    r"\b(?:shut up|go away|go to hell|drop dead|nobody likes you|kill yourself)\b",
    r"\b[a-z][*@#$]{2,}[a-z]*\b",
    r"!{3,}",
)


def stem_keys(word: str) -> list[str]:
    """The entries that a lower-case word may match: its beginnings (with ``~``) and itself."""
    return [word, *(f"{word[:n]}~" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Reader:
    """Counts of entries, words and patterns in texts, for given entries."""

    def __init__(self, entries: list[str]):
        self.at = {x: i for i, x in enumerate(entries)}
        self.fixed = set(INSULTS)
        self.patterns = [re.compile(x) for x in PATTERNS]
        self.known: dict[str, tuple[int, ...]] = {}

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        word = _EDGE.sub("", chunk)
        found = tuple(self.at[x] for x in stem_keys(word) if x in self.at) if word else ()
        if word in self.fixed:
            found += (-1,)
        if len(self.known) > 500_000:
            self.known = {}
        self.known[chunk] = found
        return found

    def read(self, text: str) -> tuple[int, Counter, list[int]]:
        """Words, how often each entry occurs (-1: the fixed lexicon), and how often each pattern does."""
        lower = text.lower()
        words, hits = lower.split(), Counter()
        known = self.known
        for chunk in words:
            found = known.get(chunk)
            if found is None:
                found = self._chunk(chunk)
            if found:
                hits.update(found)
        return len(words), hits, [len(p.findall(lower)) if i < 2 or hits else bool(p.search(lower)) for i, p in enumerate(self.patterns)]


def features(words: int, hits: Counter, patterns: list[int], n: int) -> np.ndarray:
    """A text's inputs: for each entry, and for all together, how often it occurs in a text of this length."""
    out = np.zeros(n + 4 + len(PATTERNS))
    fixed, rest = hits.get(-1, 0), sum(v for k, v in hits.items() if k >= 0)
    scale = 1 + words / 250
    for k, v in hits.items():
        if k >= 0:
            out[k] = min(v / scale, 2)
    out[n : n + 4] = min(fixed / scale, 3), float(fixed > 0), min(rest / scale, 5), min((fixed + rest) / (words + 10) * 40, 3)
    out[n + 4 :] = [min(x / scale, 1) for x in patterns]
    return out


def votes(hits: Counter, patterns: list[int], lexicon_of: np.ndarray) -> np.ndarray:
    """1 for each voter that speaks up: the lexicons, the fixed one, the patterns."""
    out = np.zeros(LEXICONS + 1 + len(PATTERNS), np.int8)
    for k in hits:
        out[LEXICONS if k < 0 else lexicon_of[k]] = 1
    out[LEXICONS + 1 :] = [x > 0 for x in patterns]
    return out


@dataclass
class LabelModel:
    """What the votes say of the label: ``p[y, j, parent's vote]`` is the chance that voter j speaks up.

    ``parent`` is the voter that j depends on besides the label (-1: none), ``strength`` the information
    that they share given the label.
    """

    prior: float
    parent: np.ndarray
    strength: np.ndarray
    p: np.ndarray

    def log_odds(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), np.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parent):
            given = found[:, parent].astype(int) if parent >= 0 else np.zeros(len(found), int)
            yes, no = self.p[1, j, given], self.p[0, j, given]
            out += np.where(found[:, j] > 0, np.log(yes / no), np.log((1 - yes) / (1 - no)))
        return out

    def accuracies(self) -> np.ndarray:
        """For each voter, how likely its vote is right, without regard to its parent's."""
        return self.prior * self.p[1].mean(axis=1) + (1 - self.prior) * (1 - self.p[0].mean(axis=1))


def label_model(found: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int = 12) -> tuple[LabelModel, np.ndarray]:
    """The model and the posterior of each row; ``label`` is 1, 0, or -1 where unknown."""
    n = found.shape[1]
    sure = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    said = np.where(label < 0, 0.0, np.where(label == 1, sure, -sure))
    known = label >= 0
    share = float((weight * (label == 1)).sum() + 0.5) / float((weight * known).sum() + 5) if known.any() else 0.1
    q = np.where(known, linear.sigmoid(said), np.where(found[:, : LEXICONS + 1].sum(axis=1) > 0, 0.6, 0.5 * share))
    v = found.astype(float)
    model = None
    for _ in range(rounds):
        mass = [weight * (1 - q), weight * q]
        shared = np.zeros((n, n))
        for w in mass:
            total = w.sum() + 4
            both = (v * w[:, None]).T @ v + 1
            one = (v * w[:, None]).sum(axis=0) + 2
            for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, total - one[:, None] - one[None, :] + both)):
                pa_, pb = (one if a else total - one)[:, None], (one if b else total - one)[None, :]
                joint = np.maximum(joint, 1e-3)
                shared += joint / sum(x.sum() for x in mass) * np.log(joint * total / (pa_ * pb))
        np.fill_diagonal(shared, 0)
        parent, strength, inside = np.full(n, -1), np.zeros(n), [0]
        while len(inside) < n:  # the tree that keeps most of the correlation
            rest = [j for j in range(n) if j not in inside]
            a, b = max(((i, j) for i in inside for j in rest), key=lambda x: shared[x])
            parent[b], strength[b] = a, shared[a, b]
            inside.append(b)
        p = np.zeros((2, n, 2))
        for y, w in enumerate(mass):
            for j in range(n):
                for g in (0, 1):
                    own = w * (v[:, parent[j]] == g) if parent[j] >= 0 else w
                    p[y, j, g] = (own @ v[:, j] + 0.5) / (own.sum() + 1 + (0 if y else 1))
        model = LabelModel(float(np.clip(mass[1].sum() / weight.sum(), 1e-3, 0.999)), parent, strength, np.clip(p, 1e-4, 1 - 1e-4))
        q = linear.sigmoid(model.log_odds(found) + said)
    return model, q


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are not read."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class Scorer:
    entries: list[str]
    coefficients: np.ndarray
    model: LabelModel | None = None

    def scores(self, found: list[str], reader: Reader) -> np.ndarray:
        n = len(self.entries)
        if not found:
            return np.zeros(0)
        return linear.sigmoid(linear.decide(np.stack([features(*reader.read(x), n) for x in found]), self.coefficients))


#: An entry is dense in a text from so many hits and this share of its words on.
DENSE_HITS, DENSE_SHARE = 2, 0.005


def _entry_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and other training texts each possible entry occurs, and in how many it is dense."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["other", "toxic", "other_dense", "toxic_dense"]
        counts = [Counter() for _ in names]

        def out() -> pa.RecordBatch:
            keys = [*counts[0].keys() | counts[1].keys()]
            found = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[x] for x in keys], pa.int64()) for c in counts)], ["entry", *names])
            for c in counts:
                c.clear()
            return found

        for batch, values in batches(found):
            for text, kind in zip(values, batch.column("kind").to_pylist(), strict=True):
                words = text.lower().split()
                hits: Counter = Counter()
                for chunk, n in Counter(words).items():
                    word = _EDGE.sub("", chunk)
                    for key in stem_keys(word) if word else ():
                        hits[key] += n
                counts[kind].update(hits.keys())
                least = max(DENSE_HITS, DENSE_SHARE * len(words))
                counts[2 + kind].update(x for x, n in hits.items() if n >= least)
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        if counts[0] or counts[1]:
            yield out()

    parts = map_arrow(sample, lambda: task, "entry string, other long, toxic long, other_dense long, toxic_dense long")
    return parts.groupBy("entry").agg(*(F.sum(x).alias(x) for x in ("other", "toxic", "other_dense", "toxic_dense")))


def choose_entries(sample: DataFrame, toxic: int, other: int) -> list[str]:
    """The entries that speak most clearly for toxic texts; of nested beginnings only the clearest."""
    if not toxic or not other:
        return []

    def clarity(t: Column, o: Column) -> Column:
        rate_t, rate_o = (t + 0.0) / toxic, (o + 0.5) / (other + 1)
        pooled = (t + o + 0.5) / (toxic + other + 1)
        z = (rate_t - rate_o) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / other))
        return F.when((t >= 3) & (rate_t > 6 * rate_o), z).otherwise(F.lit(0.0))

    z = F.greatest(clarity(F.col("toxic"), F.col("other")), clarity(F.col("toxic_dense"), F.col("other_dense")))
    clear = _entry_counts(sample).withColumn("z", z).filter(F.col("z") > 3.5)
    kept: list[str] = []
    for row in clear.orderBy(F.desc("z"), F.length("entry"), "entry").limit(20 * ENTRIES).collect():
        entry = row["entry"]
        stem = entry.removesuffix("~")
        if not any((x.endswith("~") and stem.startswith(x[:-1])) or (entry.endswith("~") and x.startswith(stem)) for x in kept):
            kept.append(entry)
            if len(kept) == ENTRIES:
                break
    return kept


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit everything on at most ``SAMPLE`` toxic, ``SAMPLE`` other and ``SAMPLE`` unlabelled rows.

    Without training labels the fixed lexicon alone decides.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("kind")).filter(F.col("doc_id").isNotNull() & F.col("kind").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("kind").alias("kind"))
    # A label of a held-out row is not read; such rows may not stand in for unlabelled ones either.
    kinds = texts(docs).select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).join(marks.filter(~held_out(F.col("doc_id"))), "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit(-1)))
    picked, counts = linear.sampled(kinds, "kind", SAMPLE)
    # At most 3 * SAMPLE rows of two numbers.
    sample = cut(texts(docs).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample")
    sizes = {x[0]: x[1] for x in sample.groupBy("kind").count().collect()}
    entries = choose_entries(sample.filter("kind >= 0"), sizes.get(1, 0), sizes.get(0, 0))
    lexicon_of = np.array([zlib.crc32(x.encode()) % LEXICONS for x in entries], int)
    n = len(entries)

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(entries)
        for batch, values in batches(found):
            read = [reader.read(x) for x in values]
            x = [features(*r, n).astype("<f4").tobytes() for r in read]
            v = [votes(r[1], r[2], lexicon_of).tobytes() for r in read]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array(x, pa.binary()), pa.array(v, pa.binary())], ["doc_id", "kind", "x", "votes"])

    rows = map_arrow(sample, lambda: task, "doc_id long, kind int, x binary, votes binary").orderBy("doc_id").collect()
    label = np.array([r["kind"] for r in rows], int)
    if not (label == 1).any() or not (label == 0).any():
        found = np.zeros(n + 5 + len(PATTERNS))
        found[n : n + 2], found[-1] = 2.0, -3.0
        return Scorer(entries, found)
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in rows]).astype(float)
    v = np.stack([np.frombuffer(r["votes"], np.int8) for r in rows])
    weight = np.array([counts[k] / sizes[k] for k in label.tolist()])
    weight *= np.where(label < 0, INFERRED, 1.0)
    weight *= len(weight) / weight.sum()
    model, posterior = label_model(v, weight, label)
    return Scorer(entries, linear.fit(x, posterior, weight, penalty=0.1), model)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every row.

    Null and empty texts are scored like texts without a word. A null ``doc_id`` is not held out and
    takes no part in training. Repeated rows come back as often as they are; tables without rows or
    without labels are scored by the fixed lexicon.
    """
    scorer = train(docs, labels)

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(scorer.entries)
        for batch, values in batches(found):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(scorer.scores(values, reader), 9))], ["doc_id", "score"])

    found = map_arrow(texts(docs), lambda: task, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns and whole texts."""
    scorer = train(docs, labels)
    names = docs.columns

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(scorer.entries)
        for batch, values in batches(found):
            yield batch.filter(pa.array(scorer.scores(values, reader) < 0.5))

    return map_arrow(docs.select(*names), lambda: task, docs.schema)
