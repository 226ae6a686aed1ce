"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library.

The pre-tokenizer of such a file splits at white space and looks at no neighbours, so a text's ids
are those of its white-space chunks, one after the other. A task keeps the ids of the chunks that it
has met; only new chunks are encoded. Texts with characters outside a plain range (where the
library's rules for white space, case and normal form could differ from Python's) and texts that
hold a special token go through the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a Python worker remembers, or as many as the texts in hand hold; beyond that it keeps those of them.
REMEMBERED = 150_000

#: Of these characters, case and white space are the same everywhere and NFC changes none.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def open_library(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("this platform has no 32-bit unsigned int")
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Remembered:
    """Ids of strings as bytes. ``encode`` gives those of new strings; ``blank`` has none.

    Both lie in Arrow arrays, ``blank`` first: as Python objects they would take several times as much.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], blank: str = ""):
        self.encode = encode
        self.known, self.ids = pa.array([blank], pa.large_string()), pa.array([b""], pa.large_binary())

    def listed(self, found: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each of these strings (distinct). Where new ones are too many, only what is met again stays: frequent ones always are."""
        at = pc.index_in(found, value_set=self.known)
        new = found.filter(at.is_null())
        if len(self.known) + len(new) > REMEMBERED:
            # ``blank`` stays first.
            met = pa.array(np.union1d([0], at.drop_null().to_numpy()))
            self.known, self.ids = self.known.take(met), self.ids.take(met)
            at = pc.index_in(found, value_set=self.known)
        if len(new):
            ids = pa.array(self.encode(new.to_pylist()), pa.large_binary())
            places = at.fill_null(-1).to_numpy().copy()
            places[places < 0] = np.arange(len(self.known), len(self.known) + len(new))
            at = pa.array(places)
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, ids])
        return self.ids.take(at)


def joined(ids: pa.LargeBinaryArray, indices: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The ids at ``indices``, one after the other, and where each of them begins, with the end of the last."""
    taken = ids.take(indices)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
    return memoryview(taken.buffers()[2] or b""), ends


class ChunkIds:
    """Ids of texts as bytes. ``encode_chunks`` gives the ids of new chunks, ``encode_odd`` of an odd text."""

    def __init__(self, specials: list[str], encode_chunks: Callable[[list[str]], list[bytes]], encode_odd: Callable[[str], bytes]):
        self.chunks, self.encode_odd = Remembered(encode_chunks), encode_odd
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    @property
    def known(self) -> pa.LargeStringArray:
        return self.chunks.known

    def plain(self, text: str) -> bool:
        return not (_ODD.search(text) or (self.special and self.special.search(text)))

    def texts(self, found: list[str]) -> list[bytes]:
        plain = [*map(self.plain, found)]
        # White space at an end of a text leaves an empty chunk.
        split = pc.ascii_split_whitespace(pa.array([x.lower() for x, own in zip(found, plain, strict=True) if own], pa.large_string()))
        offsets, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del split
        # The ids of every word, one after the other.
        data, starts = joined(self.chunks.listed(words.dictionary), words.indices)
        edges = starts[offsets].tolist()
        out = (data[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False))
        ids = [next(out) if own else self.encode_odd(x) for x, own in zip(found, plain, strict=True)]
        # What Arrow keeps for later would be twice what is remembered.
        del words, data, starts, out
        pa.default_memory_pool().release_unused()
        return ids


def library_ids(vocabulary: str) -> ChunkIds:
    """Ids by the library itself."""
    library = open_library(vocabulary)
    specials = [x.content for x in library.get_added_tokens_decoder().values()]

    def chunks(words: list[str]) -> list[bytes]:
        return [packed(x.ids) for x in library.encode_batch(words, add_special_tokens=False)]

    return ChunkIds(specials, chunks, lambda text: packed(library.encode(text, add_special_tokens=False).ids))
