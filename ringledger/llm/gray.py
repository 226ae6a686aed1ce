"""An index of 64-bit fingerprints in Gray order.

Fingerprints that differ in at most ``bits`` bits agree in all but ``bits`` of some equal blocks. For
every choice of the blocks that agree, fingerprints are grouped by those bits, which leaves few enough
free bits that a group is bounded whatever the data hold. Within a group they are sorted by Gray rank,
so that neighbours share bits; nodes above them factor out the bits that all below share, and a walk
over pairs of nodes drops a pair as soon as the shared bits differ too often.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.rows import map_arrow

#: Bits in which linked fingerprints may differ.
BITS = 2

#: Children of an index node.
FAN = 8

#: Bits that groups leave free at most: a group holds no more than 2 to this power.
FREE = 16


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``hashes`` (unsigned); 0 without any."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each number in the reflected Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def close_pairs(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of distinct ``values`` (unsigned) that differ in at most ``bits`` bits."""
    order = np.argsort(gray_rank(values), kind="stable")
    patterns, masks = [values[order]], [np.full(len(values), ~np.uint64(0))]
    while len(patterns[-1]) > FAN:
        below, known = patterns[-1], masks[-1]
        starts = np.arange(0, len(below), FAN)
        first = np.repeat(below[starts], np.diff(np.append(starts, len(below))))
        varies = np.bitwise_or.reduceat((below ^ first) | ~known, starts)
        masks.append(~varies)
        patterns.append(below[starts] & ~varies)
    top = np.arange(len(patterns[-1]))
    left, right = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    left, right = left[left <= right], right[left <= right]
    for level in range(len(patterns) - 1, -1, -1):
        shared = masks[level][left] & masks[level][right]
        near = np.bitwise_count((patterns[level][left] ^ patterns[level][right]) & shared) <= bits
        left, right = left[near], right[near]
        if level:
            size = len(patterns[level - 1])
            steps = np.arange(FAN)
            a = np.repeat(left * FAN, FAN * FAN) + np.tile(np.repeat(steps, FAN), len(left))
            b = np.repeat(right * FAN, FAN * FAN) + np.tile(steps, FAN * len(left))
            inside = (a < size) & (b < size) & (a <= b)
            left, right = a[inside], b[inside]
    apart = left < right
    return order[left[apart]], order[right[apart]]


def stars(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A spanning set of links: every value that is linked, with the first of its component."""
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(root != np.arange(len(values)))
    return np.stack([values[linked], values[root[linked]]])


def block_masks(bits: int = BITS, free: int = FREE) -> list[int]:
    """Masks of the bits that may be taken as equal: enough blocks that all but ``bits`` of them leave ``free`` bits."""
    blocks = next(n for n in range(bits + 1, 65) if not bits or -(-64 // n) * bits <= free)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - bits)]


def links(values: DataFrame, column: str, bits: int = BITS, free: int = FREE) -> DataFrame:
    """``left`` and ``right``: links that connect all values of ``column`` (signed longs, distinct) as far as pairs within ``bits`` bits do."""
    masks = [x - (1 << 64) if x >> 63 else x for x in block_masks(bits, free)]
    keyed = values.select(F.col(column).alias("value"), F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col(column).bitwiseAND(F.lit(mask)).alias("key")) for k, mask in enumerate(masks)))).alias("at"))
    groups = keyed.groupBy("at.choice", "at.key").agg(F.collect_list("value").alias("found")).filter(F.size("found") > 1).select("found")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("found")
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.append(0, ends[:-1]).astype(np.int64)
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= bits]
            out = [np.stack([flat[two], flat[two + 1]])]
            for start, end in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                own = flat[start:end]
                out.append(stars(own, *close_pairs(own, bits)))
            found = np.unique(np.concatenate(out, axis=1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["left", "right"])

    return map_arrow(groups, lambda: task, "left long, right long")
