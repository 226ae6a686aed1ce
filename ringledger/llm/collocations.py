"""Phrases whose words occur together more often than apart, counted by prefix-free parsing.

A run of words without punctuation is a piece. Trigger words, which a hash of the word alone picks, cut pieces into
chunks; each chunk reaches two words into the next one, so every phrase lies whole in the chunk that holds its first
word, and counts there only. Passages that repeat are cut alike, so the dictionary of distinct chunks with their parse
frequencies is smaller than the texts, and phrases are counted inside distinct chunks, times the frequency.

A phrase of three words is a candidate only if both phrases of two words in it occur as often. Those are known first,
as bits of a hash in a table of fixed size; phrases of three words with a missing bit are not counted at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions.ranking import ranked
from ringledger.functions.workspace import cut, fits_broadcast, small_side
from ringledger.llm.rows import batches, map_arrow

#: Words of the longest phrases, the least count of a candidate, and phrases reported for each language.
WORDS, LEAST, TOP = 3, 10, 2000

#: One word in so many is a trigger; a chunk with no trigger ends after MOST words.
TRIGGER, MOST = 12, 128

#: A candidate goes when a longer one around it has at least this share of its count, in hundredths.
COVERED = 50

#: Chunks that a task adds up before it hands them on, and bytes of chunks that it counts at once.
HELD, RUN_BYTES = 400_000, 12 << 20

#: Bits of the hash of a frequent phrase: the table of bits has 2 to this power, 16 MB. More phrases than that would
#: only make it pass more.
BITS = 27

#: Scores are in millionths.
FACTOR = 1_000_000

#: Of each byte: 0 in words, 1 for blanks, 2 where a piece ends; and the byte with A to Z in lower case.
_KIND, _LOWER = np.zeros(256, np.uint8), np.frombuffer(bytes(range(256)).lower(), np.uint8)
_KIND[[*b" \t"]], _KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 1, 2


class Triggers:
    """Which words are triggers: one in ``trigger`` of them, by a checksum of the word."""

    def __init__(self, trigger: int = TRIGGER):
        self.trigger = trigger

    def among(self, words: pa.LargeStringArray) -> np.ndarray:
        return _checksums(words) % self.trigger == 0


def words_of(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The words of all texts, in lower case, whether each begins a piece, and how many words come before each text's end."""
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]]
    edges = edges - edges[0]
    kind = _KIND[data]
    inside = kind == 0
    # A text begins anew whatever the one before ends with.
    first = np.zeros(len(data) + 1, bool)
    first[edges[:-1]] = True
    first = first[:-1]
    starts = np.flatnonzero(inside & (first | np.append(True, ~inside[:-1])[: len(data)]))
    breaks = np.flatnonzero(first | (kind == 2))
    held = np.append(0, np.cumsum(inside, dtype=np.int64))
    offsets = np.append(held[starts], held[-1])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    piece = np.searchsorted(breaks, starts, "right")
    begins = np.append(True, piece[1:] != piece[:-1])[: len(starts)]
    return words, begins, np.searchsorted(starts, edges[1:])


def _chunked(words: pa.LargeStringArray, begins: np.ndarray, triggers: Triggers, most: int) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Where each chunk of these words starts, how many words are its ``own``, and the chunk."""
    n = len(words)
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    cutting = triggers.among(coded.dictionary)[at] | begins
    runs = np.flatnonzero(cutting)
    sizes = np.diff(np.append(runs, n))
    parts = -(-sizes // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(runs, parts) + nth * most
    own = np.diff(np.append(starts, n))
    # Up to two words more, as far as the piece goes.
    pieces = np.append(np.flatnonzero(begins), n)
    ends = np.minimum(starts + own + WORDS - 1, pieces[np.searchsorted(pieces[:-1], starts, "right")])
    wide = ends - starts
    places = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide - starts, wide)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wide)).astype(np.int32)), coded.dictionary.take(pa.array(at[places])))
    return starts, own, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def chunks_of(words: list[str], triggers: Triggers, most: int = MOST) -> list[tuple[int, str]]:
    """``own`` and the chunk: its words with up to two that follow; phrases that start in the first ``own`` count here."""
    _, own, chunks = _chunked(pa.array(words, pa.large_string()), np.arange(len(words)) == 0, triggers, most)
    return [*zip(own.tolist(), chunks.to_pylist(), strict=True)]


def dictionary(docs: DataFrame, trigger: int = TRIGGER, most: int = MOST) -> DataFrame:
    """``lang``, ``own``, ``chunk`` and ``times``: the distinct chunks of all texts with their parse frequencies."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers, held, size = Triggers(trigger), [], 0
        for batch, values in batches(found):
            words, begins, ends = words_of(pa.array(values, pa.large_string()))
            starts, own, chunks = _chunked(words, begins, triggers, most)
            langs = batch.column("lang").cast(pa.large_string()).take(pa.array(np.searchsorted(ends, starts, "right")))
            held.append(pa.table({"lang": langs, "own": own, "chunk": chunks}))
            size += len(own)
            if size > HELD:
                yield _dictionary(held)
                held, size = [], 0
        if held:
            yield _dictionary(held)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parsed = map_arrow(rows, lambda: task, "lang string, own int, chunk string, times long")
    return parsed.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


def _dictionary(held: list[pa.Table]) -> pa.RecordBatch:
    """The distinct rows of these tables, and how often each occurs as ``times``."""
    found = pa.concat_tables(held)
    langs, chunks = (found[x].combine_chunks().dictionary_encode() for x in ("lang", "chunk"))
    own = found["own"].to_numpy()
    wide, tongues = own.max(initial=0) + 1, len(langs.dictionary)
    codes, times = _tally((chunks.indices.to_numpy().astype(np.int64) * tongues + langs.indices.to_numpy()) * wide + own, np.ones(len(own), np.int64))
    first = codes // wide
    columns = [langs.dictionary.take(pa.array(first % tongues)).cast(pa.string()), pa.array(codes % wide, pa.int32()), chunks.dictionary.take(pa.array(first // tongues)).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(times)], ["lang", "own", "chunk", "times"])


def _tally(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the sums of their weights."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes)
    codes = codes[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[starts], np.add.reduceat(weights[order], starts)


def _joined(names: pa.Array, *ids: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in ids), " ") if len(ids) > 1 else names.take(pa.array(ids[0]))


def _checksums(names: pa.Array) -> np.ndarray:
    kind = pa.large_binary() if pa.types.is_large_string(names.type) else pa.binary()
    return np.fromiter(map(zlib.crc32, names.cast(kind).to_pylist()), np.int64, len(names))


def _counted(run: pa.Table, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of a run of chunks with their sums. Words are numbers here, at most 24 bits of them in a run; so are languages, 15 bits."""
    tongue = run["lang"].combine_chunks().dictionary_encode()
    if len(tongue.dictionary) > 1 << 15:
        half = run.num_rows // 2
        yield from _counted(run.slice(0, half), bits)
        yield from _counted(run.slice(half), bits)
        return
    split = pc.split_pattern(run["chunk"].combine_chunks(), " ")
    sizes = split.value_lengths().to_numpy()
    words = split.flatten().dictionary_encode()
    ids, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    inside = place < np.repeat(run["own"].to_numpy(), sizes)
    times = np.repeat(run["times"].to_numpy(), sizes)
    langs = np.repeat(tongue.indices.to_numpy().astype(np.int64), sizes)
    low = (1 << 24) - 1

    def batch(lang: np.ndarray, phrase: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([tongue.dictionary.take(pa.array(lang)), phrase, pa.array(sums)], ["lang", "phrase", "f"])

    if bits is None:
        at = np.flatnonzero(inside)
        codes, sums = _tally(langs[at] << 48 | ids[at], times[at])
        yield batch(codes >> 48, _joined(names, codes & low), sums)
        at = np.flatnonzero(inside & (left > 1))
        codes, sums = _tally(langs[at] << 48 | ids[at] << 24 | ids[at + 1], times[at])
        yield batch(codes >> 48, _joined(names, codes >> 24 & low, codes & low), sums)
        return
    at = np.flatnonzero(left > 1)
    sums_of = _checksums(names)
    slot = _slot(_checksums(tongue.dictionary)[langs[at]], sums_of[ids[at]], sums_of[ids[at + 1]]) & ((1 << BITS) - 1)
    often = np.zeros(len(ids) + 1, bool)
    often[at] = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
    at = np.flatnonzero(inside & (left > 2) & often[:-1] & often[1:])
    pairs, which = np.unique(langs[at] << 48 | ids[at] << 24 | ids[at + 1], return_inverse=True)
    codes, sums = _tally(which.astype(np.int64) << 24 | ids[at + 2], times[at])
    first = pairs[codes >> 24]
    yield batch(first >> 48, _joined(names, first >> 24 & low, first & low, codes & low), sums)


def _slot(lang, first, second):  # noqa: ANN001, ANN202
    """The place of a two-word phrase in the table of bits, from checksums, before it is cut to BITS; for numbers and columns."""
    mixed = lang * 506952113 + first * 367774315 + second * 472591075
    return F.shiftright(mixed, 24) if isinstance(mixed, Column) else mixed >> 24


def phrases(chunks: DataFrame, bits: Broadcast | None = None) -> DataFrame:
    """``lang``, ``phrase`` and ``f``: how often phrases occur, from distinct chunks: those of one and two words or,
    with ``bits``, those of three whose first and last two words are in that table."""

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        held, size = [], 0
        for batch in found:
            held.append(batch)
            size += batch.nbytes
            if size > RUN_BYTES:
                yield from _counted(pa.Table.from_batches(held), table)
                held, size = [], 0
        if held:
            yield from _counted(pa.Table.from_batches(held), table)

    counted = map_arrow(chunks, lambda: task, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_table(pairs: DataFrame) -> Broadcast:
    """The table of bits of ``pairs`` (lang, phrase), 16 MB at every size of the input, for all tasks."""
    crc = [F.crc32(x.cast("binary")) for x in (F.col("lang"), F.split("phrase", " ")[0], F.split("phrase", " ")[1])]
    slots = pairs.select(_slot(*crc).bitwiseAND(F.lit((1 << BITS) - 1)).alias("slot"))
    words = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("word"))
    found = words.toArrow()
    table = np.zeros((1 << BITS) // 64, "<i8")
    table[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(table.tobytes())


def _scored(found: DataFrame, parts: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """``found`` (lang, phrase, a) with the counts ``l`` and ``r`` of its lowest-scoring cut and that score.

    A phrase's parts occur at least as often as the phrase, so they are among ``parts`` whenever the phrase is a candidate.
    """
    from_left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    from_right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    if fits_broadcast(parts):
        from_left, from_right = F.broadcast(from_left), F.broadcast(from_right)
    words = F.split("phrase", " ")
    scores = None
    for k in cuts:
        size = F.size(words)
        cutting = found.select("*", F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("right"))
        # As decimals: products of counts may pass 64 bits; ``div`` floors, both sides are positive.
        score = F.expr(f"cast({FACTOR} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
        one = cutting.join(from_left, ["lang", "left"]).join(from_right, ["lang", "right"]).select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("at"))
        scores = one if scores is None else scores.union(one)
    best = scores.groupBy("lang", "phrase", "a").agg(F.min("at").alias("at")) if len(cuts) > 1 else scores
    return best.select("lang", "phrase", "a", "at.l", "at.r", "at.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, trigger: int = TRIGGER, most: int = MOST) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``: each language's first ``top`` phrases of two or three words.

    ``a`` is the phrase's count (``least`` or more), ``l`` and ``r`` those of the two parts of its lowest-scoring cut
    (ties: the shorter first part), ``score`` floor(1000000 * a * a / (l * r)), ``n`` all words of the language. Two-word phrases that a
    three-word one covers are left out. Order: score, count, both descending, then the phrase by bytes, which settles ties.
    A null language is ``und``, an empty one its own. Null and blank texts have no words; repeated rows count as often as they are, ids are not
    read. Chunks without a trigger are cut after ``most`` words, so very long texts make no long chunk; where
    the cuts fall changes no count. An empty table gives no rows.
    """
    chunks = cut(dictionary(docs, trigger, most), "chunks")
    often = phrases(chunks).filter(F.col("f") >= least)
    parts = cut(often.withColumn("size", F.size(F.split("phrase", " "))), "parts")
    pairs = parts.filter("size = 2").select("lang", "phrase")
    two = _scored(parts.filter("size = 2").select("lang", "phrase", F.col("f").alias("a")), parts, (1,))
    three = phrases(chunks, bit_table(pairs)).filter(F.col("f") >= least)
    three = cut(three.select("lang", "phrase", F.col("f").alias("a")), "triples")
    words = F.split("phrase", " ")
    around = three.select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
    covers = small_side(cut(around.groupBy("lang", "phrase").agg(F.max("a").alias("longer")), "covers"))
    two = two.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a"))).drop("longer")
    found = two.unionByName(_scored(three, parts, (1, 2)))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    placed = ranked(found, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank").filter(F.col("rank") <= top)
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same over whole tables in DuckDB, by windows over the words.
SQL = f"""
with t as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as parts
  from documents
), p as (
  select lang, doc, unnest(parts) as part, generate_subscripts(parts, 1) as piece from t
), s as (
  select lang, doc, piece, list_filter(string_split_regex(part, '[ \\t]+'), lambda x: x <> '') as words from p
), w as (
  select lang, doc, piece, unnest(words) as a, generate_subscripts(words, 1) as place from s
), x as (
  select lang, a, lead(a) over q as b, lead(a, 2) over q as c from w window q as (partition by doc, piece order by place)
), g as materialized (
  select lang, a as phrase, null as head, null as tail, count(*)::hugeint as f from x group by lang, a
  union all select lang, a || ' ' || b, a, b, count(*)::hugeint from x where b is not null group by lang, a, b
), g3 as materialized (
  select lang, a || ' ' || b || ' ' || c as phrase, a, c, a || ' ' || b as ab, b || ' ' || c as bc, count(*)::hugeint as f
  from x where c is not null group by lang, a, b, c having count(*) >= {LEAST}
), covers as materialized (
  select lang, phrase, max(f) as longer from (select lang, ab as phrase, f from g3 union all select lang, bc, f from g3) group by all
), g2 as materialized (
  select lang, phrase, head, tail, f, longer from g left join covers using (lang, phrase) where head is not null and f >= {LEAST}
), two as (
  select k.lang, k.phrase, k.f as a, l.f as l, r.f as r, {FACTOR}::hugeint * k.f * k.f // (l.f * r.f) as score
  from g2 k join g l on l.lang = k.lang and l.phrase = k.head join g r on r.lang = k.lang and r.phrase = k.tail
  where longer is null or 100 * longer < {COVERED} * k.f
), cut3 as (
  select k.lang, k.phrase, k.f as a,
    [{{'score': {FACTOR}::hugeint * k.f * k.f // (l1.f * r1.f), 'k': 1, 'l': l1.f, 'r': r1.f}},
     {{'score': {FACTOR}::hugeint * k.f * k.f // (l2.f * r2.f), 'k': 2, 'l': l2.f, 'r': r2.f}}] as cuts
  from g3 k join g l1 on l1.lang = k.lang and l1.phrase = k.a join g r1 on r1.lang = k.lang and r1.phrase = k.bc
    join g l2 on l2.lang = k.lang and l2.phrase = k.ab join g r2 on r2.lang = k.lang and r2.phrase = k.c
), three as (
  select lang, phrase, a, list_min(cuts).l as l, list_min(cuts).r as r, list_min(cuts).score as score from cut3
), found as (from two union all from three)
, n as (select lang, sum(f) as n from g where head is null group by lang)
, placed as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from found join n using (lang)
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from placed where rank <= {TOP}
"""
