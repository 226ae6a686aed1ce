"""BPE encoding and decoding by an index of pair occurrences.

A task takes the words that it has not met yet, all at once, as one row of symbols. An index maps
each adjacent pair that has a merge to all its places in that row. The lowest active rank is taken
next: its places are merged together, and the lists of the pairs that this makes are extended. Words
do not meet, so every word gets what it would get alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import sys
import types
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ringledger.llm.rows import batches, map_arrow, texts
from ringledger.llm.tokens import ChunkIds, Remembered, default_vocabulary, joined, open_library

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The visible character for each byte value: itself where it has one, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return [chr(x) if x in shown else chr(256 + hidden.index(x)) for x in range(256)]


#: Bytes of words that meet the merges at once, which bounds the arrays over them.
MERGED_BYTES = 1 << 20


class PairIndex:
    """Merges of a vocabulary file, applied to many words at once."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.width = max(ids.values()) + 1
        codes = self.left * np.int64(self.width) + self.right
        self.rank_at = np.argsort(codes, kind="stable").astype(np.int32)
        self.codes = codes[self.rank_at]
        shown = byte_symbols()
        self.inner = np.array([ids[x] for x in shown], np.int32)
        self.last = np.array([ids[x + end] for x in shown], np.int32)
        # A rank whose product takes part in a lower rank must go one place at a time.
        first_use = np.full(self.width, len(merges), np.int64)
        np.minimum.at(first_use, self.left, np.arange(len(merges)))
        np.minimum.at(first_use, self.right, np.arange(len(merges)))
        self.single = set(np.flatnonzero(first_use[self.made] < np.arange(len(merges))).tolist())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        codes = left * np.int64(self.width) + right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes) & (left >= 0) & (right >= 0), self.rank_at[at], -1)

    def words(self, found: list[bytes]) -> list[bytes]:
        """Ids of each word, given as its bytes, as little-endian unsigned 32-bit integers; no word is empty."""
        if not found:
            return []
        ends = np.cumsum([len(x) for x in found])
        if ends[-1] > MERGED_BYTES and len(found) > 1:
            half = len(found) // 2
            return self.words(found[:half]) + self.words(found[half:])
        data = np.frombuffer(b"".join(found), np.uint8)
        n = len(data)
        symbol = np.append(self.inner[data], np.int32(-1))
        symbol[ends - 1] = self.last[data[ends - 1]]
        place = np.int32 if n < 1 << 30 else np.int64
        after, before = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
        after[ends - 1] = n
        before[0], before[ends[:-1]] = n, n
        held: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            some = ranks >= 0
            ranks, places = ranks[some], places[some]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            for rank, start, stop in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)], strict=True):
                if rank in held:
                    held[rank].append(places[start:stop])
                else:
                    held[rank] = [places[start:stop]]
                    heapq.heappush(active, rank)

        add(self.ranks(symbol[:n], symbol[after[:n]]), np.arange(n, dtype=place))
        while active:
            rank = heapq.heappop(active)
            lists = held.pop(rank)
            a, b, c = int(self.left[rank]), int(self.right[rank]), int(self.made[rank])
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            places = places[(symbol[places] == a) & (symbol[after[places]] == b)]
            if not len(places):
                continue
            if a == b:
                kept, taken = [], -1
                for p in places.tolist():
                    if p != taken:
                        kept.append(p)
                        taken = int(after[p])
                places = np.array(kept, place)
            if rank in self.single and len(places) > 1:
                held[rank] = [places[1:]]
                heapq.heappush(active, rank)
                places = places[:1]
            gone = after[places]
            following = after[gone]
            symbol[places], symbol[gone] = c, -2
            after[places] = following
            before[following] = places
            previous = before[places]
            made = np.full(len(places), c, np.int32)
            add(self.ranks(np.concatenate([symbol[previous], made]), np.concatenate([made, symbol[following]])), np.concatenate([previous, places]))
        alive = symbol[:n] >= 0
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        out = symbol[:n][alive].astype("<u4").tobytes()
        return [out[start:stop] for start, stop in zip([0, *stops[:-1]], stops, strict=True)]


class Codec:
    """Encoding and decoding of whole texts, as the library does with the same file."""

    def __init__(self, vocabulary: str):
        self.library, self.index = open_library(vocabulary), PairIndex(vocabulary)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        self.specials = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.bytes_of = {x: i for i, x in enumerate(byte_symbols())}
        self.words = Remembered(lambda words: self.index.words([x.encode() for x in words]), "\n")
        self.ids = ChunkIds([*self.specials], self._chunks, self._odd)
        names = self.library.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name.encode()

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        # All at once, with a line feed between chunks, which none of them holds: lists for each would keep the garbage collector busy.
        split = pa.array(self.pieces.findall("\n".join(chunks)), pa.large_string()).dictionary_encode()
        ends = np.flatnonzero(split.indices.to_numpy() == split.dictionary.index("\n").as_py())
        data, starts = joined(self.words.listed(split.dictionary), split.indices)
        edges = [0, *starts[ends].tolist(), len(data)]
        return [data[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]

    def _odd(self, text: str) -> bytes:
        out = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
            elif part:
                words = [bytes(map(self.bytes_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                listed = [*dict.fromkeys(words)]
                ids = dict(zip(listed, self.index.words(listed), strict=True))
                out += map(ids.__getitem__, words)
        return b"".join(out)

    def encode(self, found: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return self.ids.texts(found)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8, special tokens included. The file names no decoder, so it is the tokens with a space between."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Vocabulary files whose codecs a Python worker keeps; the one used longest ago goes first.
CODECS = 2


def worker_codec(vocabulary: str) -> Codec:
    """The codec of a vocabulary file, opened once in each Python worker and kept, with the words it knows, for later tasks.

    This package's functions come with each task anew, so its own globals would last for one task only;
    what is kept lies in a module of the interpreter. A file that has changed is opened again. At most
    ``CODECS`` files are kept, and each codec bounds what it remembers.
    """
    kept = sys.modules.setdefault("_worker_codecs", types.ModuleType("_worker_codecs"))
    held: OrderedDict = vars(kept).setdefault("held", OrderedDict())
    state = os.stat(vocabulary)
    key = (os.path.realpath(vocabulary), state.st_size, state.st_mtime_ns)
    if key not in held:
        held[key] = Codec(vocabulary)
        if len(held) > CODECS:
            held.popitem(last=False)
    held.move_to_end(key)
    return held[key]


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of every text; null counts as empty.

    An empty text has no ids and decodes to an empty string. Rows map one to one: repeated rows and
    ids, null ids too, come back as often as they are. Columns other than ``doc_id`` and ``text``
    are not read.
    """
    path = vocabulary or default_vocabulary()

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch, values in batches(found):
            ids = codec.encode(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([codec.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(texts(docs), lambda: task, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Counts and checksums of :func:`encoded`, made in the same task so that no ids leave it."""
    path = vocabulary or default_vocabulary()

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch, values in batches(found):
            ids = codec.encode(values)
            columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts(docs), lambda: task, SCHEMA)
