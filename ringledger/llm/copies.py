"""Near copies by SimHash, confirmed by the exact Jaccard of five-word shingles.

Texts whose shingle sets agree in at least ``LEAST`` of their union are near copies. Each text has a SimHash of its
shingle set; an index in Gray order gathers the texts whose fingerprints lie within ``BITS`` bits, and each text meets
one of those gathered with it. Texts at the least Jaccard lie up to some 20 bits apart, where no index of 64 bits is
selective, so an exact search follows for what this has not joined: candidates agree in all minima of a band of hash
orders. Each candidate link is confirmed on the two shingle sets. Equal texts are one node before that. Links go from
each text to the one that shares most keys with others, as the text that copies were made from does, so that a large
group of copies costs one pair for each text. What no link has joined by then is keyed anew, by the rarest shingles of
each text among the texts still open: two near copies share one of these for certain, while texts that only share a
common passage do not. Then the new keys are swept: each sets all its members against a few centres, which then leave
the key, until no key holds two groups. A sweep drops pairs whose marks, 1024 bits of parity, show too many shingles
that only one of them has.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut, settled, small_side
from ringledger.llm.components import components
from ringledger.llm.gray import links as close_links
from ringledger.llm.gray import majority
from ringledger.llm.rows import batches, map_arrow

#: Words of a shingle, the seed of its hash, and the least Jaccard of near copies.
WORDS, SEED, LEAST = 5, 42, Fraction(4, 5)

#: Bands, and minima in each: a pair at the least Jaccard meets in no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, 1.3e-7.
BANDS, ROWS = 40, 5

#: Bits in which the fingerprints of texts gathered by the index may differ, and bits that its groups leave free at most.
BITS, FREE = 3, 24

#: Rounds of one link for each text, before the sweeps; the first is by SimHash.
STARS = 3

#: Longs that hold the marks of a shingle set, 64 in each.
MARKS = 16

#: Centres of a key in the first sweep; each sweep takes ``MORE`` times as many as the one before, ``CENTRES`` at most.
FIRST, MORE, CENTRES = 4, 4, 512

#: Shingle hashes handled at once, and shingle sets kept at hand.
BLOCK, HELD = 1 << 11, 64

_BLANK = r"[^ \t\n\r\x0B\f]"


def shingles(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, a blank one has none."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x, seed) for x in parts], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: Fraction = LEAST) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard of at least ``least``; two empty ones have."""
    small, large = sorted((len(a), len(b)))
    if small * least.denominator < large * least.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (small + large - both) * least.numerator


def multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(found: np.ndarray, factors: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; equal sets have equal keys."""
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        np.minimum(least, np.multiply.outer(factors, found[at : at + BLOCK]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def checksum(text: Column) -> Column:
    """What names a text: its 128-bit checksum; null and blank texts are one."""
    text = text.cast("string")
    return F.unhex(F.md5(F.when(text.rlike(_BLANK), text).otherwise(F.lit(""))))


def noded(docs: DataFrame) -> DataFrame:
    """``node`` (checksum) and ``text`` of every row."""
    return docs.select(checksum(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fresh(batch: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
    """The rows of a batch whose node the task has not met before."""
    keep = []
    for k, node in enumerate(batch.column("node").to_pylist()):
        if node not in seen:
            seen.add(node)
            keep.append(k)
    return batch.take(pa.array(keep, pa.int64()))


def sketches(docs: DataFrame) -> DataFrame:
    """``node``, ``size`` (of its shingle set), ``bits`` (its SimHash as a signed long) and ``keys`` of every text that is not blank, once for each task that reads it."""

    def build():  # noqa: ANN202
        seen: set[bytes] = set()
        factors = multipliers()

        def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in found:
                for batch, values in batches(iter([fresh(whole, seen)])):
                    sets = [shingles(x) for x in values]
                    keep = [k for k, x in enumerate(sets) if len(x)]
                    node = batch.column("node").take(pa.array(keep, pa.int64()))
                    bits = pa.array(np.array([majority(sets[k]) for k in keep], np.uint64).view(np.int64))
                    keys = pa.array([band_keys(sets[k], factors) for k in keep], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([node, pa.array([len(sets[k]) for k in keep], pa.int64()), bits, keys], ["node", "size", "bits", "keys"])

        return task

    return map_arrow(noded(docs), build, "node binary, size long, bits long, keys array<long>")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``text`` of ``nodes`` (distinct), each once. Copies leave a task once, so that none fills another."""

    def build():  # noqa: ANN202
        seen: set[bytes] = set()
        return lambda found: (fresh(x, seen) for x in found)

    return map_arrow(noded(docs), build, "node binary, text string").join(small_side(nodes), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (left, right) that are near copies."""

    def build():  # noqa: ANN202
        held: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def own(node: bytes, text: str) -> np.ndarray:
            if node not in held:
                held[node] = shingles(text)
                if len(held) > HELD:
                    held.popitem(last=False)
            held.move_to_end(node)
            return held[node]

        def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                columns = (batch.column(c) for c in ("left", "right", "left_text", "right_text"))
                near = [similar(own(a.as_py(), x.as_py()), own(b.as_py(), y.as_py())) for a, b, x, y in zip(*columns, strict=True)]
                yield batch.select(["left", "right"]).filter(pa.array(near, pa.bool_()))

        return task

    # Only the texts of these pairs are dealt out, not all.
    own_texts = texts.join(small_side(pairs.select("left").union(pairs.select("right")).distinct().toDF("node")), "node", "left_semi")
    one = pairs.join(own_texts.select(F.col("node").alias("left"), F.col("text").alias("left_text")), "left")
    both = one.join(own_texts.select(F.col("node").alias("right"), F.col("text").alias("right_text")), "right")
    return map_arrow(both.select("left", "right", "left_text", "right_text"), build, "left binary, right binary")


def gathered(found: DataFrame) -> DataFrame:
    """``node``, ``size``, ``short`` and ``key``: what links of at most ``BITS`` bits between the fingerprints of ``found`` (node, size, bits) connect has one key."""
    values = cut(found.select("bits").distinct(), "values")
    # A small file that the index spreads over its block choices: dealt to all tasks first.
    dealt = values.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bits")
    roots = settled(found.sparkSession, "simhash-roots", partial(components, close_links(dealt, "bits", BITS, FREE), "left", "right"))
    rooted = found.join(roots.select(F.col("node").alias("bits"), "root"), "bits", "left")
    return rooted.select("node", "size", F.lit(True).alias("short"), F.coalesce("root", "bits").alias("key"))


def shared(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (key, node; each once) whose key another node has too. Few keys are shared: they are broadcast where they fit, so that only keys and counts are dealt out."""
    some = cut(keyed.groupBy("key").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("key"), "shared-keys")
    return keyed.join(small_side(some), "key", "left_semi")


def rare_keys(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key`` (a shingle), ``node``, ``size``, ``short`` and ``marks``: for each of ``nodes`` (distinct) the rarest of its shingles that others have too.

    A set of n shingles that has a Jaccard of at least ``LEAST`` with another shares one of its n - ceil(LEAST * n) + 1
    rarest shingles with that one's, in whatever order all sets agree on; here by the number of ``nodes`` that hold it,
    then by its hash. The smaller set of the two (either, if equal) shares 2 * LEAST / (1 + LEAST) of its own, so there
    fewer places do: these are ``short``. Shingles of one node alone fill the places first and need no row. Texts
    without shingles have none.
    """

    def build():  # noqa: ANN202
        def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in found:
                for batch, values in batches(iter([whole])):
                    sets = [shingles(x) for x in values]
                    sizes = np.array([len(x) for x in sets], np.int64)
                    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                    node = batch.column("node").take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
                    yield pa.RecordBatch.from_arrays([node, pa.array(np.repeat(sizes, sizes)), pa.array(every.view(np.int64))], ["node", "size", "key"])

        return task

    each = cut(map_arrow(texts.join(nodes, "node", "left_semi").select("node", "text"), build, "node binary, size long, key long"), "shingles")
    held = cut(each.groupBy("key").agg(F.count("*").alias("holders")).filter("holders > 1"), "holders")
    own = Window.partitionBy("node")
    nth = F.row_number().over(own.orderBy("holders", "key")) + F.col("size") - F.count("*").over(own)

    def within(share: Fraction) -> Column:
        # nth <= size - ceil(share * size) + 1, in whole numbers
        return (F.col("size") + 1 - F.col("nth")) * share.denominator >= F.col("size") * share.numerator

    ordered = each.join(small_side(held), "key").withColumn("nth", nth).filter(within(LEAST))
    short = ordered.select("key", "node", "size", within(2 * LEAST / (1 + LEAST)).alias("short"))
    return short.join(marked(each), "node").select("key", "node", "size", "short", "marks")


def marked(each: DataFrame) -> DataFrame:
    """``node`` and ``marks`` of shingle sets (node, key): 64 * ``MARKS`` bits, each the parity of the shingles that fall on it."""
    bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    at = F.shiftright("key", 6).bitwiseAND(F.lit(MARKS - 1))
    return each.groupBy("node").agg(F.array(*(F.coalesce(F.bit_xor(F.when(at == k, bit)), F.lit(0)).cast("long") for k in range(MARKS))).alias("marks"))


def within_marks(size: Column, marks: Column, other_size: Column, other_marks: Column) -> Column:
    """Whether sets of such sizes and marks can be near copies. A shingle that only one of them has changes one bit,
    so bits that differ are no more than those shingles, of which near copies have (1 - LEAST) / (1 + LEAST) of both sizes at most."""
    differ = sum((F.bit_count(marks[k].bitwiseXOR(other_marks[k])) for k in range(MARKS)), F.lit(0))
    return differ * (LEAST.denominator + LEAST.numerator) <= (size + other_size) * (LEAST.denominator - LEAST.numerator)


def alike(a: Column, b: Column) -> Column:
    """Whether sets of such sizes can be near copies."""
    return F.least(a, b) * LEAST.denominator >= F.greatest(a, b) * LEAST.numerator


def groups(docs: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every text that has a near copy: links of near copies connect all nodes of a root.

    Null and blank texts, which have no shingles, are in no group here; equal texts are one node. An empty
    table has no groups.
    """
    found = cut(sketches(docs).dropDuplicates(["node"]), "sketches")
    keyed = found.select("node", "size", F.lit(True).alias("short"), F.explode("keys").alias("key"))
    banded = cut(weighed(cut(shared(keyed), "banded")), "weighed")
    near = shared(gathered(found)).join(banded.select("node", "weight").distinct(), "node", "left")
    members = cut(near.withColumn("weight", F.coalesce("weight", F.lit(0))), "gathered")
    texts = cut(texts_of(docs, banded.select("node").union(members.select("node")).distinct()), "texts")
    links, roots, centres, done = None, None, FIRST, 0
    while True:
        if done == 1:
            members = banded
        own = cut(still_open(members, roots), "open")
        if done and own.isEmpty():
            return roots
        if done == STARS:
            members = cut(rare_keys(texts, own.select("node").distinct()), "rare")
            members = cut(weighed(members), "weighed")
            own = cut(still_open(members, roots), "open")
            if own.isEmpty():
                return roots
        if done < STARS:
            pairs = cut(star(own), "pairs")
        else:
            middle = cut(centres_of(own, centres), "centres")
            pairs = cut(sweep(own, middle), "pairs")
            members = cut(own.drop("root").join(middle.select("key", "node"), ["key", "node"], "left_anti"), "members")
            centres = min(CENTRES, centres * MORE)
        new = cut(confirmed(pairs, texts), "near-copies")
        links = new if links is None else links.union(new)
        if roots is None or not new.isEmpty():
            roots = settled(docs.sparkSession, "roots", partial(components, links, "left", "right"))
        done += 1


def weighed(members: DataFrame) -> DataFrame:
    """``members`` (key, node, size, short and more) with ``weight``: how often a node meets others, over all its keys."""
    counts = members.groupBy("key").agg((F.count("*") - 1).alias("others"))
    weights = members.join(counts, "key").groupBy("node").agg(F.sum("others").alias("weight"))
    return members.join(weights, "node").select(*members.columns, "weight")


def still_open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with their ``root``, of the keys that hold more than one root and a short one; without ``roots`` each node is its own."""
    if roots is None:
        own = members.withColumn("root", F.col("node"))
    else:
        own = members.join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("short").alias("some")).filter("some AND low < high").select("key")
    return own.join(still, "key", "left_semi").select(*members.columns, "root")


def star(own: DataFrame) -> DataFrame:
    """``left`` and ``right``: each node with the heaviest one, over its keys, that is heaviest at a key and in another group."""
    first = own.groupBy("key").agg(F.max(F.struct("weight", "root", "node", "size")).alias("first"))
    met = own.join(first, "key").filter((F.col("root") != F.col("first.root")) & alike(F.col("size"), F.col("first.size")))
    return met.groupBy(F.col("node").alias("left")).agg(F.max(F.struct("first.weight", "first.node")).alias("x")).select("left", F.col("x.node").alias("right"))


def centres_of(own: DataFrame, most: int) -> DataFrame:
    """The ``most`` heaviest short members of each key, as the smaller one of a pair is short. The rank filter limits a key's rows before they are shuffled."""
    order = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    return own.filter("short").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")


def sweep(own: DataFrame, middle: DataFrame) -> DataFrame:
    """``left`` and ``right``: every member of a key with each of its centres that is in another group and that sizes and marks allow; a member smaller than the centre if short.

    A key's centres have then met all that it holds, and may leave it: no pair is lost, and a sweep makes at most
    as many rows for each member as there are centres. Members that no link joins meet in later sweeps.
    """
    b = middle.select("key", *(F.col(c).alias(f"c_{c}") for c in ("node", "size", "root", "marks")))
    fits = alike(F.col("size"), F.col("c_size")) & (F.col("short") | (F.col("size") >= F.col("c_size")))
    fits = fits & within_marks(F.col("size"), F.col("marks"), F.col("c_size"), F.col("c_marks"))
    met = own.join(b, "key").filter((F.col("root") != F.col("c_root")) & fits)
    return met.select(F.least("node", "c_node").alias("left"), F.greatest("node", "c_node").alias("right")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group of near copies, with all its columns: the smallest ``doc_id``, then the smallest checksum.

    Rows are told apart by ``doc_id`` and text, so that rows without an id, or with one id and texts that are
    no near copies, each keep their own. A row without an id stays only if its group has no other.
    """
    named = docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), checksum(F.col("text")).alias("own"),
    )
    row = ["none", "id", "own"]
    rows = named.groupBy("own").agg(F.min(F.struct("none", "id")).alias("least"))
    rooted = settled(docs.sparkSession, "near-copy-groups", partial(groups, docs))
    rows = rows.join(rooted, F.col("own") == F.col("node"), "left").withColumn("root", F.coalesce("root", "own"))
    keep = cut(rows.groupBy("root").agg(F.min(F.struct("least.none", "least.id", "own")).alias("least")).select("least.*"), "kept")
    # Repeated rows fold within tasks first, and whole rows move once for both steps.
    return named.dropDuplicates(row).join(keep, row, "left_semi").select("doc.*")
