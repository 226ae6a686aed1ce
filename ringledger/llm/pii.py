"""Personal data by boosted candidates.

Generators with high recall propose spans, which may overlap: the four base kinds and looser ones. Every
candidate has a few whole-number features of its format and context. Boosted trees learn, from
candidates whose structure can be checked (a check digit, an address range, a length), what real ones look
like; the checks themselves are no feature. A threshold calibrated on candidates kept aside selects
the looser spans. Base spans always stay.

All of it is columns: candidates are arrays within a row, training sees one row for each combination of
features (a number that does not grow with the data), and the trees are a column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.llm.rows import once, texts

#: The base kinds. No text makes these expressions step back over what they have taken, so that
#: neither long runs nor deep nesting slow them; where a match may start is given by what precedes it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser generators, in one expression, and what tells their kinds apart.
LOOSE = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9_/+-]{8}[A-Za-z0-9_/+=-]*+(?:\.[A-Za-z0-9_/+=-]++)*+)",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local_phone": r"(?:\([0-9]{3}\)\x20?|\b[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}\b",
    "masked_email": r"\b[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{2,63}){1,4}",
}

KINDS = (*BASE, *LOOSE)

#: Words before a candidate that speak for or against it.
FOR = r"(?i)(?:mail|phone|tel|call|mobile|fax|card|visa|iban|account|ssn|social|ip|host|address|contact|password|passwd|pwd|secret|token|key)\W{0,3}$"
AGAINST = r"(?i)(?:version|ver|v|page|pages|isbn|section|no|number|id|line|fig|figure|order|issue)\W{0,3}$"

#: Characters of context on either side.
CONTEXT = 16

#: Features and how many values each has; their product bounds the rows that training sees.
FEATURES = {"length": 5, "digits": 5, "letters": 4, "marks": 4, "groups": 4, "before": 3, "after": 3, "words": 3}

#: Boosting: trees, depth, learning rate, least weight of a leaf, and the precision asked of the threshold.
TREES, DEPTH, RATE, LEAF, PRECISION = 24, 3, 0.3, 5.0, 0.95

#: Matches whose positions are summed at a time.
BLOCK = 256


def lengths(found: Column, gaps: Column) -> Column:
    """For each match, the characters from the end of the one before to its own end."""
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))


def positions(found: Column, steps: Column) -> Column:
    """``start``, ``end`` (exclusive) and ``match`` of every match, in characters.

    Positions are sums of steps, taken in blocks so that the work stays far below the square of the
    number of matches.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: total(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK))))

    def placed(sums: Column) -> Column:
        before = F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))

        def place(bases: Column) -> Column:
            def one(match: Column, i: Column) -> Column:
                end = F.element_at(bases, F.floor(i / BLOCK).cast("int") + 1) + total(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
                return F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"))

            return F.transform(found, one)

        return once(before, place)

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.size(found) > 0, once(blocks, placed)).otherwise(none)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the last digit is the check digit of the rest."""

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a candidate of a kind passes the kind's check."""
    digits = digits_of(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: once(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))))
    if kind == "card":
        return once(digits, lambda x: F.length(x).between(13, 19) & F.when(F.length(x).between(13, 19), luhn(x)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        value = F.regexp_replace(match, r"^[^=:]*[=:]\s?[\"']?", "")
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "local_phone":
        return digits.rlike("^[2-9][0-9]{2}[2-9]")
    return F.lit(True)


def proposed(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text`` not null) and an array of candidates for each kind: ``start``, ``end``, ``match``.

    Texts without a digit, an @ or a bracketed "at" hold no candidate and are not searched further.
    """
    text = F.col("text")
    gate = {"email": F.contains(text, F.lit("@")), "ip": F.col("__digit"), "card": F.col("__digit"), "phone": F.col("__digit") & F.contains(text, F.lit("+"))}
    found = docs.withColumn("__digit", text.rlike("[0-9]"))
    found = found.withColumn("__loose", F.col("__digit") | text.rlike(r"[(\[{]at[)\]}]|AKIA|(?i:password|passwd|pwd|secret|token|api[_-]?key)"))
    gate["loose"] = F.col("__loose")
    patterns = {**BASE, "loose": "|".join(LOOSE.values())}
    nothing = F.array().cast("array<string>")
    for name, pattern in patterns.items():
        found = found.withColumn(f"__{name}_match", F.when(gate[name], F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing))
    for name, pattern in patterns.items():
        some = F.size(F.col(f"__{name}_match")) > 0
        found = found.withColumn(f"__{name}_step", F.when(some, lengths(F.col(f"__{name}_match"), F.split(text, pattern, -1))))
    for name in patterns:
        found = found.withColumn(f"__{name}", positions(F.col(f"__{name}_match"), F.col(f"__{name}_step")))
    kind_of = F.lit(None).cast("string")

    def loose_kind(match: Column) -> Column:
        out = kind_of
        for kind, pattern in reversed(LOOSE.items()):
            out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
        return F.coalesce(out, F.lit("secret"))

    found = found.withColumn("__loose", F.transform("__loose", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), loose_kind(x["match"]).alias("kind"))))
    return found.drop("__digit", *(f"__{name}_{part}" for name in patterns for part in ("match", "step")))


def features(text: Column, start: Column, end: Column, match: Column) -> dict[str, Column]:
    """Each feature as a whole number from 0 up to its number of values."""
    before = F.substr(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substr(text, end + 1, F.lit(1))
    n, digits = F.length(match), F.length(digits_of(match))
    letters = F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
    groups = F.length(F.regexp_replace(F.regexp_replace(match, "[A-Za-z0-9]+", "x"), "[^x]", ""))
    step = lambda value, edges: sum(((value >= x).cast("int") for x in edges), F.lit(0))

    def beside(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"[\s,;:!?()\"']"), F.lit(0)).when(c.rlike("[A-Za-z0-9]"), F.lit(1)).otherwise(F.lit(2))

    return {
        "length": step(n, (8, 13, 17, 24)), "digits": step(digits, (1, 7, 10, 13)), "letters": step(letters / n, (0.01, 0.4, 0.8)),
        "marks": step(n - digits - letters, (1, 3, 6)), "groups": step(groups, (2, 4, 6)), "before": beside(F.substr(before, F.length(before), F.lit(1))),
        "after": beside(after), "words": F.when(before.rlike(FOR), F.lit(2)).when(before.rlike(AGAINST), F.lit(0)).otherwise(F.lit(1)),
    }


def candidates(found: DataFrame) -> DataFrame:
    """One array ``__all`` of every candidate with ``kind``, ``start``, ``end``, ``ok`` (its kind's check) and its features."""
    text = F.col("text")

    def full(kind: Column, ok: Column, x: Column) -> Column:
        each = features(text, x["start"], x["end"], x["match"])
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), ok.alias("ok"), *(v.alias(k) for k, v in each.items()))

    def of_kind(kind: str) -> Column:
        return F.transform(F.col(f"__{kind}"), lambda x: full(F.lit(kind), valid(kind, x["match"]), x))

    arrays = [of_kind(kind) for kind in BASE]

    def loose_ok(x: Column) -> Column:
        out = F.lit(True)
        for kind in LOOSE:
            out = F.when(x["kind"] == kind, valid(kind, x["match"])).otherwise(out)
        return out

    arrays.append(F.transform("__loose", lambda x: full(x["kind"], loose_ok(x), x)))
    return found.withColumn("__all", F.concat(*arrays)).drop(*(f"__{kind}" for kind in (*BASE, "loose")))


@dataclass
class Node:
    value: float = 0.0
    feature: str = ""
    most: int = 0
    low: Node | None = None
    high: Node | None = None

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] <= self.most, self.low.of(x), self.high.of(x))

    def column(self, x: Callable[[str], Column]) -> Column:
        if self.low is None or self.high is None:
            return F.lit(self.value)
        return F.when(x(self.feature) <= self.most, self.low.column(x)).otherwise(self.high.column(x))


def grow(x: dict[str, np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int) -> Node:
    """The tree that best follows the loss; each split is a feature's value."""
    leaf = Node(RATE * float(slope.sum() / (curve.sum() + 1)))
    if not depth:
        return leaf
    best, at = 1e-6, None
    base = slope.sum() ** 2 / (curve.sum() + 1)
    for name, values in x.items():
        for most in range(FEATURES[name] - 1):
            low = values <= most
            if curve[low].sum() * 4 < LEAF or curve[~low].sum() * 4 < LEAF:
                continue
            gain = slope[low].sum() ** 2 / (curve[low].sum() + 1) + slope[~low].sum() ** 2 / (curve[~low].sum() + 1) - base
            if gain > best:
                best, at = gain, (name, most, low)
    if at is None:
        return leaf
    name, most, low = at
    parts = [grow({k: v[side] for k, v in x.items()}, slope[side], curve[side], depth - 1) for side in (low, ~low)]
    return Node(feature=name, most=most, low=parts[0], high=parts[1])


@dataclass
class Selector:
    """The trees' sum from ``base`` on, and the sum from which a loose candidate counts as personal data."""

    base: float
    trees: list[Node]
    threshold: float

    def column(self, x: Callable[[str], Column]) -> Column:
        return sum((t.column(x) for t in self.trees), F.lit(self.base))


def train(found: DataFrame) -> Selector:
    """Boost on the counts of all candidates of ``found`` by features, fold and check.

    Without candidates that fail a check, or none that pass, every loose candidate that passes its check
    is selected.
    """
    names = [*FEATURES]
    # The outer form: before the other, Spark would put a filter that finds all candidates once more.
    each = found.select("doc_id", F.explode_outer("__all").alias("c")).filter("c IS NOT NULL")
    each = each.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.col("c.start")), F.lit(4)))
    cells = each.groupBy(*(F.col(f"c.{x}").alias(x) for x in names), (F.col("fold") == 0).alias("aside"), F.col("c.ok").alias("ok")).count().collect()
    x = {k: np.array([r[k] for r in cells], int) for k in names}
    n, ok, aside = (np.array([r[k] for r in cells], float) for k in ("count", "ok", "aside"))
    fit_yes, fit_no = float(n[(ok > 0) & (aside == 0)].sum()), float(n[(ok == 0) & (aside == 0)].sum())
    if not fit_yes or not fit_no:
        return Selector(0.0, [], 0.0)
    used = aside == 0
    own = {k: v[used] for k, v in x.items()}
    weight, y = n[used], ok[used]
    base = float(np.log(fit_yes / fit_no))
    score, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(own, weight * (y - p), weight * p * (1 - p), DEPTH)
        trees.append(tree)
        score = score + tree.of(own)
    test = base + sum(t.of(x) for t in trees)
    order = np.argsort(-test[~used], kind="stable")
    right, all_ = np.cumsum((n * ok)[~used][order]), np.cumsum(n[~used][order])
    good = np.flatnonzero(right >= PRECISION * all_) if len(order) else []
    threshold = float(test[~used][order][good[-1]]) if len(good) else float("inf")
    return Selector(base, trees, threshold)


def spans(found: DataFrame, selector: Selector) -> DataFrame:
    """``found`` with ``spans`` in the order of kinds and starts: checked base matches and selected loose ones."""

    def keep(c: Column) -> Column:
        return c["ok"] & (c["kind"].isin([*BASE]) | (selector.column(lambda k: c[k]) >= F.lit(selector.threshold)))

    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    kept = F.filter("__all", keep)
    listed = F.array_sort(F.transform(kept, lambda c: F.struct(F.element_at(rank, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return found.withColumn("spans", F.transform(listed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).drop("__all")


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (``kind``, ``start``, ``end``; code points, end exclusive) of every text.

    Null and empty texts have none. Rows map one to one, repeated ones too. Spans of different kinds may
    overlap. The trees see every candidate of every text.
    """
    whole = candidates(proposed(texts(docs).withColumn("text", F.coalesce("text", F.lit(""))))).select("doc_id", "__all")
    return spans(whole, train(whole))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    found = found_spans(docs)
    count = lambda kind: F.size(F.filter("spans", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda c: c["kind"].isin([*BASE]))
    return found.select("doc_id", *(count(kind) for kind in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, made to fit.

    Of overlapping spans the first gives the name and all are covered. Texts without a span, null ones
    too, stay as they are, as do all other columns.
    """
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    selector = train(candidates(proposed(own)).select("doc_id", "__all"))
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(F.col("text").cast("string").alias("__text"), F.struct(*others).alias("__others"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = spans(candidates(proposed(held)), selector)
    ordered = F.array_sort(F.transform("spans", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("last"), c["kind"].alias("kind"))))

    def add(state: Column, c: Column) -> Column:
        fresh = c["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1, c["start"] - state["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], -c["last"]).alias("at"))

    rest = lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1, F.length(F.col("text"))))
    changed = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add, rest)
    found = found.withColumn("__new", F.when(F.size("spans") > 0, changed).otherwise(F.col("__text")))
    columns = {c: F.col("__others")[c] for c in others} | {"text": F.col("__new")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.size("spans") > 0, F.length("__new").cast("long")).otherwise(F.col("__others")["n_chars"].cast("long"))
    return found.select(*(columns[c].alias(c) for c in docs.columns))
