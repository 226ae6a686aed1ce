"""Document fingerprints from spot signatures.

A signature is a common word (the anchor) and the content words that follow it. A text's signatures form
a set. Sets fall into partitions by length, chosen so that sets whose partitions are further apart than
neighbours cannot reach a given Jaccard similarity; such pairs, and pairs whose lengths alone rule it out,
are pruned before their sets are met. Everything is columns of one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.llm.rows import once, texts

#: Content words of a chain, and how many words after the anchor it may end.
CHAIN, REACH = 2, 10

#: Similarity for which sets are partitioned by length.
SIMILAR = 0.8

#: Anchors, common words of four languages.
ANCHORS = (
    "the", "a", "an", "of", "and", "to", "in", "is", "are", "was", "were", "be", "that", "this", "it", "for", "on", "with", "as", "at", "by", "from", "or", "have", "has",
    "der", "die", "das", "und", "den", "dem", "des", "ein", "eine", "zu", "im", "mit", "von", "auf", "für", "ist", "nicht", "sich", "als",
    "le", "la", "les", "un", "une", "du", "et", "en", "que", "qui", "dans", "pour", "par", "sur", "au", "aux", "est", "pas", "avec", "elle", "il",
    "el", "los", "las", "y", "del", "se", "con", "no", "su", "para", "al", "lo", "como", "es", "de",
)


def words(text: Column) -> Column:
    """A text's lower-case words: runs of letters and digits."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def signatures(found: Column, whole: Column) -> Column:
    """The sorted set of a text's signatures as longs, from its words.

    A text without any has one of its own: a checksum of the whole text, so that it is only like its
    equals. An empty text has that of the empty string.
    """
    anchors = list(ANCHORS)

    def signature(word: Column, at: Column) -> Column:
        following = F.slice(F.filter(F.slice(found, at + 2, F.lit(REACH)), lambda w: ~w.isin(anchors) & (w != "")), 1, CHAIN)
        return F.when(word.isin(anchors), once(following, lambda x: F.when(F.size(x) == CHAIN, F.xxhash64(word, F.array_join(x, " ")))))

    # Words that are no anchor, or have too few words after them, give nulls.
    chains = F.sort_array(F.array_distinct(F.array_compact(F.transform(found, signature))))
    return once(chains, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.xxhash64(F.lit("whole"), whole))))


def length_partition(size: Column, similar: float = SIMILAR) -> Column:
    """The partition of a set of this size: each spans sizes up to 1 / ``similar`` times its smallest."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(similar)) + 1e-9).cast("int")


def fingerprint(found: Column) -> Column:
    """A set's length partition, size and checksum; equal sets, and only they, have equal ones."""
    return F.concat_ws(":", length_partition(F.size(found)).cast("string"), F.size(found).cast("string"), F.md5(F.array_join(F.transform(found, F.hex), "").cast("binary")))


def likeness(left: Column, right: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 0 where it is under ``at_least``.

    Pairs from partitions further apart than neighbours, or whose sizes bound it below ``at_least``,
    are 0 without a look at their members.
    """
    a, b = F.size(left), F.size(right)
    shared = F.size(F.array_intersect(left, right))
    value = shared / (a + b - shared)
    if not at_least:
        return value
    apart = F.abs(length_partition(a, at_least) - length_partition(b, at_least)) > 1
    bound = F.least(a, b) / F.greatest(a, b)
    return F.when(apart | (bound < at_least), F.lit(0.0)).otherwise(F.when(value >= at_least, value).otherwise(F.lit(0.0)))


def with_next(docs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, Window]:
    """Every row with ``range``, and the window in which the row after it is the next document.

    Documents go by ``doc_id`` (nulls first) and text, dealt into ranges of nearly equal counts, so whole
    texts move once. A range ends with a copy of the next range's first document (``copied``); after the
    last document comes the first.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    # At most one number for each range.
    cuts = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))[: ranges - 1]
    step = max(1, math.isqrt(len(cuts)))
    coarse, fine = cuts[::step], [cuts[k : k + step] for k in range(0, len(cuts), step)]

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))

    if cuts:
        block = below(F.array(*map(F.lit, coarse)))
        inner = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in fine)), F.greatest(block, F.lit(1)))
        place = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + below(inner))
    else:
        place = F.lit(0)
    rows = rows.withColumn("range", F.coalesce(place, F.lit(0)).cast("int"))
    firsts = sorted((x["range"], x["least"]["doc_id"]) for x in rows.groupBy("range").agg(F.min(F.struct("doc_id")).alias("least")).collect())
    first = F.lit(False)
    before = F.lit(0)
    if firsts:
        before = F.element_at(F.create_map(*(F.lit(x) for k, (own, _) in enumerate(firsts) for x in (own, firsts[k - 1][0]))), F.col("range"))
    ids = [x for _, x in firsts if x is not None]
    if ids:
        first = F.col("doc_id").isin(ids)
    if len(ids) < len(firsts):
        first = first | F.col("doc_id").isNull()
    copies = rows.filter(F.coalesce(first, F.lit(False))).withColumn("range", before)
    dealt = rows.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True))).repartitionByRange(ranges, "range")
    return dealt, Window.partitionBy("range").orderBy("copied", "doc_id", "text")


def compared(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited``, the signature sets of the text and of ``edited``, and their likeness.

    ``edited`` is the text with its last floor(n_chars / 2) characters replaced by the first as many (or
    all) of the next document. ``near_edited`` is its likeness to the text, ``near_next`` that of the next
    document. Null texts count as empty. Rows map one to one; of repeated ids the one with the smaller text
    comes first. A table of one row is its own next document; an empty one gives no rows.
    """
    dealt, order = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    found = dealt.withColumn("n_chars", F.length("text").cast("long")).withColumn("next", F.lead("text").over(order))
    found = found.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next").substr(F.lit(1), half))).drop("next")
    found = found.withColumn("own_words", words(F.col("text"))).withColumn("edited_words", words(F.col("edited")))
    found = found.withColumn("own", signatures(F.col("own_words"), F.col("text"))).drop("own_words")
    found = found.withColumn("changed", signatures(F.col("edited_words"), F.col("edited"))).drop("edited_words")
    found = found.withColumn("next_own", F.lead("own").over(order)).filter(~F.col("copied"))
    return found.select("doc_id", "n_chars", "edited", F.col("own").alias("signatures"), F.col("changed").alias("edited_signatures"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def digest(docs: DataFrame) -> DataFrame:
    return compared(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"), "near_edited", "near_next")
