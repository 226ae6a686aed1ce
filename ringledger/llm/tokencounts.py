"""Token counts of whole texts by a sentencepiece model, without their ids.

The library writes a space as a mark, puts one mark before a text, and merges pieces of the vocabulary. No piece
reaches over a line feed, nor holds a mark behind another character; so a text cut before each run of marks and around
line feeds has the pieces of its parts, whatever lies beside them. Such parts are the pre-tokens. Each distinct one is
counted once; a text's count is the sum over its pre-token frequencies.

Frequent pre-tokens, a bounded number of them, are met inside the tasks that read the texts. The others, none of which
is frequent, join the table of counts by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.workspace import cut, small_side
from ringledger.llm.rows import batches, map_arrow, texts

#: The library's mark for a space.
MARK = "▁"

#: Pre-tokens that a task adds up before it hands them on, and their characters.
HELD, HELD_CHARS = 600_000, 16 << 20

#: Frequent pre-tokens at most, and characters of one at most: what reaches every task is below 30 MB.
FREQUENT, FREQUENT_CHARS = 200_000, 32

#: Texts with more tokens than this are over the limit.
LIMIT = 4096

_PARTS = re.compile(" +[^ \n]*|[^ \n]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens, the library's leading space with them; its line feeds, one token each, are left out."""
    return _PARTS.findall(" " + text.replace(MARK, " "))


class Pieces:
    """Numbers of pieces by a model file whose pieces keep to pre-tokens; another model is refused."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = [x for x in names if "\n" in x or re.search(f"[^{MARK}]{MARK}", x)]
        probes = {"\n": [MARK, "<0x0A>"], "": []}
        spaced = self.library.normalize(" a  b\t ") == f"{MARK}{MARK}a{MARK}{MARK}b\t{MARK}"
        if crossing or not spaced or any(self.library.encode(x, out_type=str) != y for x, y in probes.items()):
            raise ValueError("pieces of this model do not keep to pre-tokens")

    def counts(self, found: list[str]) -> list[int]:
        """Pieces of each pre-token. Behind a line feed it stands as inside a text; the mark and the line feed are two."""
        return [len(x) - 2 for x in self.library.encode(["\n" + x for x in found], num_threads=1)]


def distinct_pre_tokens(docs: DataFrame) -> DataFrame:
    """``part`` (a pre-token) and ``n``, how often it occurs in all texts."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for _, values in batches(found):
            for text in values:
                if text:
                    held.update(pre_tokens(text))
            if len(held) > HELD or sum(map(len, held)) > HELD_CHARS:
                yield _table(held)
                held = Counter()
        yield _table(held)

    return map_arrow(texts(docs), lambda: task, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def _table(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], ["part", "n"])


def piece_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``part``, ``n`` and ``pieces`` of every distinct pre-token of the texts, each encoded once."""
    path = model or default_model()

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for whole in found:
            for batch, values in batches(iter([whole]), text="part"):
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("n"), pa.array(pieces.counts(values), pa.int64())], ["part", "n", "pieces"])

    return map_arrow(distinct_pre_tokens(docs), lambda: task, "part string, n long, pieces long")


def frequent(counts: DataFrame, most: int = FREQUENT) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, ``most`` of them at most, none longer than FREQUENT_CHARS.

    They are cut off at a step of the logarithm of ``n``, so that the driver sees a few numbers and then the rows that
    it keeps. Where a step would pass the bound, its pre-tokens are all left to the shuffle: more than ``most`` of them
    are then about as frequent, so none is hot.
    """
    short = counts.filter(F.length("part") <= FREQUENT_CHARS).withColumn("step", F.floor(4 * F.log2("n")).cast("int"))
    least, rows = None, 0
    for step, n in sorted(map(tuple, short.groupBy("step").count().collect()), reverse=True):
        rows += n
        if rows > most:
            break
        least = step
    if least is None:
        return {}
    return dict(map(tuple, short.filter(F.col("step") >= least).select("part", "pieces").collect()))


def counted(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every text.

    Counts are those of the library without begin, end or other added tokens; special strings in a text are text.
    A null text counts as empty: no bytes, no tokens. Every row comes back once, repeated rows and ids, null ids and
    very long texts like any other; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not
    read. Rows are told apart by where they were read, written down before they are used.
    """
    counts = cut(piece_counts(docs, model), "piece-counts")
    known = docs.sparkSession.sparkContext.broadcast(frequent(counts))

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch, values in batches(found):
            sizes, sums, rest = [], [], []
            for text in values:
                total, left = text.count("\n"), []
                for part, n in Counter(pre_tokens(text)).items() if text else ():
                    pieces = get(part)
                    if pieces is None:
                        left.append({"part": part, "times": n})
                    else:
                        total += pieces * n
                sizes.append(len(text.encode()))
                sums.append(total)
                rest.append(left)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("part", pa.string()), ("times", pa.int64())])))
            columns = [pa.array(x, t) for x, t in zip((sizes, sums, rest), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "known", "rest"])

    schema = "doc_id long, n_bytes long, known long, rest array<struct<part: string, times: long>>"
    held = cut(map_arrow(texts(docs), lambda: task, schema).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    asked = held.select("row", F.explode("rest").alias("at")).select("row", "at.part", "at.times")
    # What frequent() holds is not asked for, so of the table of counts only the others can meet.
    sums = asked.join(small_side(counts.select("part", "pieces")), "part").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return held.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
