"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are linked by the index of :mod:`ringledger.llm.gray`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut
from ringledger.llm.components import components
from ringledger.llm.copies import keep_one as keep_one  # the pipeline's stage, with its own bound
from ringledger.llm.gray import BITS, links, majority
from ringledger.llm.gray import FREE as FREE
from ringledger.llm.gray import block_masks as block_masks
from ringledger.llm.gray import close_pairs as close_pairs
from ringledger.llm.rows import batches, map_arrow, texts

#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 3, 42


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64 bits that are set in over half of the hashes of a text's shingles; 0 without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles], "<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``bits`` (the fingerprint as a signed long) of every text; null and blank texts have 0."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in batches(found):
            bits = np.array([fingerprint(x, words, seed) for x in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], ["doc_id", "bits"])

    return map_arrow(texts(docs), lambda: task, "doc_id long, bits long")


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Every row's ``bits`` (fingerprint) and ``component_id``, the smallest ``doc_id`` that links of at most ``bits`` bits reach.

    Texts are read once. Equal fingerprints are one value from there on, however many rows have it.
    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows come back as
    often as they are; a null ``doc_id`` is never the smallest unless a component has no other.
    """
    found = cut(fingerprints(docs, words, seed), "fingerprints")
    values = cut(found.groupBy(F.col("bits").alias("value")).agg(F.min("doc_id").alias("first_doc")), "values")
    roots = cut(components(links(values, "value", bits), "left", "right"), "roots")
    rooted = values.join(roots, F.col("value") == F.col("node"), "left").withColumn("root", F.coalesce("root", "value"))
    ids = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = cut(rooted.join(ids, "root").select(F.col("value").alias("bits"), "component_id"), "components")
    return found.join(named, "bits").select("doc_id", "bits", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
