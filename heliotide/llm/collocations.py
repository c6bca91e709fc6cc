"""Phrases whose words belong together, counted by prefix-free parsing.

Each piece of text is cut into chunks before words where the hash of the last two
words says so, so equal passages are cut alike wherever they stand. A chunk runs
``longest - 1`` words into the next one; an n-gram belongs to the chunk its first
word lies in, so overlaps count once. Equal chunks become one dictionary entry
with its frequency in the parse, and n-grams are counted inside dictionary
entries only, times that frequency.

A frequent phrase has frequent parts. So words are counted first, then pairs of
words that may be frequent, then longer phrases of such pairs. "May be" is asked
of a bit filter of fixed size, which never denies a frequent part. Those counts
go by 64-bit hashes; at the end the phrases the hashes point to are counted once
more by their text, so hashes never decide a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotide.llm.bloom import filter_of, may_hold
from heliotide.llm.settle import settled
from heliotide.llm.words import Words, mix, slices, span_hashes, split

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
NO_LANG = "und"
#: One word in so many starts a chunk.
TRIGGER = 8
_BREAK = tuple(b".,;:!?\n\x0b\x0c\r")
_BLANK = (0x20, 0x09)
SLICE_BYTES = 1 << 21
FLUSH_ENTRIES = 3_000_000
#: Phrases are spelled anew after so many words, so a task holds the text of few.
SPELL_WORDS = 150_000
#: A row of the packed dictionary is as large as thousands of others.
FEW_BLOCKS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
_GRAM_BASE = np.uint64(0xD1342543DE82EF95)
#: Dictionary entries as one Arrow stream, and the words they stand for by language.
_BLOCK = "langs array<string>, words array<bigint>, block binary"


def words_and_pieces(data: np.ndarray, texts: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of the texts, and whether each is the first of its piece."""
    w = split(data, texts, _BLANK + _BREAK, lower=True)
    kind = np.zeros(256, dtype=bool)
    kind[list(_BREAK)] = True
    breaks = np.concatenate([[0], np.cumsum(kind[w.data])])
    first = np.ones(len(w.starts), dtype=bool)
    first[1:] = breaks[w.starts[1:]] != breaks[w.ends[:-1]]
    heads = w.first[:-1][np.diff(w.first) > 0]
    first[heads] = True
    return w, first


def chunks(hashes: np.ndarray, first: np.ndarray, overlap: int, every: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of the own words, and end with the overlap of each chunk (word positions)."""
    n = len(hashes)
    start = first.copy()
    start[1:] |= mix(hashes[1:] + np.uint64(3) * hashes[:-1]) % np.uint64(every) == 0
    begin = np.flatnonzero(start)
    own = np.append(begin[1:], n)
    pieces = np.append(np.flatnonzero(first), n)
    end = pieces[np.searchsorted(pieces, begin, side="right")]
    return begin, own, np.minimum(own + overlap, end)


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``hashes`` that brings equal ones together, and where in it each distinct one begins."""
    order = np.argsort(hashes)
    run = hashes[order]
    edge = np.ones(len(run), dtype=bool)
    edge[1:] = run[1:] != run[:-1]
    return order, np.flatnonzero(edge)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts ``data[starts[i]:ends[i]]``."""
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths)
    at += np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data[at])).cast(pa.string())


def _strings(w: Words, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words ``begin[i]:end[i]`` joined by one space."""
    sizes = w.ends - w.starts + 1
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    inside = np.repeat(w.starts - at[:-1], sizes)
    inside += np.arange(at[-1])
    line = np.append(w.data, np.uint8(0x20))[inside]
    line[at[1:] - 1] = 0x20
    return _cut(line, at[begin], at[end] - 1)


def _chop(longest: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch.column("lang"), NO_LANG).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for row, last, data, texts in slices(batch.column("text"), SLICE_BYTES):
                w, first = words_and_pieces(data, texts)
                if not len(w.starts):
                    continue
                begin, own, end = chunks(w.hashes, first, longest - 1, every)
                lang = code[row:last][w.text_of()[begin]]
                whole = span_hashes(w.hashes, begin, end) + mix((own - begin).astype(np.uint64)) * np.uint64(2 * len(langs.dictionary) + 1) + lang.astype(np.uint64)
                order, edge = _runs(whole)
                place, times = order[edge], np.diff(edge, append=len(order))
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(lang[place])), _strings(w, begin[place], end[place]), pa.array((own - begin)[place].astype(np.int32)), pa.array(times)],
                    names=["lang", "chunk", "own", "times"],
                )

    return run


def dictionary(docs: DataFrame, longest: int = LONGEST, every: int = TRIGGER) -> DataFrame:
    """``lang, chunk, own, times``: distinct chunks, how many words are their own, and how often the parse has them."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    met = texts.mapInArrow(_chop(longest, every), "lang string, chunk string, own int, times bigint")
    return met.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.table({"lang": batch.column("lang"), "n": pc.multiply(batch.column("own").cast(pa.int64()), batch.column("times"))})
        total = words.group_by("lang").aggregate([("n", "sum")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        lists = [pa.array([total.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("lang", pa.string()), ("n_sum", pa.int64()))]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["langs", "words", "block"])


def packed(entries: DataFrame) -> DataFrame:
    """``langs, words, block``: a row per Arrow batch of entries, as every level reads all of them; rows of their own cost more than counting."""
    return entries.select("lang", "chunk", "own", "times").mapInArrow(_packed, _BLOCK)


def _key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Entries:
    """Words of dictionary entries of one slice."""

    def __init__(self, batch: pa.RecordBatch, row: int, last: int, data: np.ndarray, texts: np.ndarray):
        self.words = split(data, texts, (0x20,))
        entry = self.words.text_of()
        part = batch.slice(row, last - row)
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[entry]
        keys = np.array([_key(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
        self.key = keys[self.lang] if len(keys) else np.empty(0, np.uint64)
        self.times = part.column("times").to_numpy()[entry]
        at = np.arange(len(entry))
        self.own = at - self.words.first[:-1][entry] < part.column("own").to_numpy()[entry]
        self.room = self.words.first[1:][entry] - at
        self.sums = [self.words.hashes]

    def grams(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n-gram that starts at each word (of ``at``); only those with room are real."""
        while len(self.sums) < size:
            more = self.sums[-1] * _GRAM_BASE
            k = len(self.sums)
            more[: max(0, len(more) - k)] += self.words.hashes[k:]
            self.sums.append(more)
        sums = self.sums[size - 1]
        return mix(sums ^ self.key if at is None else sums[at] ^ self.key[at])

    def starts(self, size: int) -> np.ndarray:
        return self.own & (self.room >= size)


def _entries(blocks: pa.RecordBatch) -> Iterator[_Entries]:
    for block in blocks.column("block"):
        for batch in pa.ipc.open_stream(block.as_buffer()):
            for part in slices(batch.column("chunk"), SLICE_BYTES):
                yield _Entries(batch, *part)


class _Tally:
    """Weighted counts of hashes within a task, given out when there are many.

    The first hash of each place, named by a hash's top bits, is counted there;
    what else has that place is kept, then sorted and summed.
    """

    PLACE_BITS = 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.held = np.zeros(1 << self.PLACE_BITS, np.uint64)
        # A hash that belongs elsewhere: place 0 would else seem to hold the hash 0.
        self.held[0] = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.sums = np.zeros(1 << self.PLACE_BITS, np.int64)
        self.hashes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0
        self.empty = True

    def add(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Counts ``hashes`` and gives the positions of those that had no place before."""
        self.empty &= not len(hashes)
        place = (hashes >> np.uint64(64 - self.PLACE_BITS)).view(np.int64)
        fresh = np.flatnonzero(self.held[place] != hashes)
        free = fresh[self.held[place[fresh]] == 0]
        self.held[place[free]] = hashes[free]
        other = fresh[self.held[place[fresh]] != hashes[fresh]]
        if len(other):
            self.hashes.append(hashes[other])
            self.times.append(times[other])
            self.size += len(other)
            here = np.ones(len(hashes), dtype=bool)
            here[other] = False
            place, times = place[here], times[here]
        np.add.at(self.sums, place, times)
        return fresh

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and their counts; the tally is empty then."""
        place = np.flatnonzero(self.sums)
        hashes, times = [self.held[place]], [self.sums[place]]
        if self.hashes:
            some, weights = np.concatenate(self.hashes), np.concatenate(self.times)
            order, edge = _runs(some)
            hashes.append(some[order[edge]])
            times.append(np.add.reduceat(weights[order], edge))
        self.clear()
        return np.concatenate(hashes), np.concatenate(times)


def _counted(batches: Iterator[pa.RecordBatch], select: Callable[[_Entries], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()

    def out() -> pa.RecordBatch:
        hashes, times = tally.rows()
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], names=["h", "n"])

    for batch in batches:
        for entries in _entries(batch):
            for hashes, at in select(entries):
                tally.add(hashes, entries.times[at])
            if tally.size > FLUSH_ENTRIES:
                yield out()
    if not tally.empty:
        yield out()


def _words():
    def select(e: _Entries):
        at = np.flatnonzero(e.starts(1))
        yield e.grams(1, at), at

    return lambda batches: _counted(batches, select)


def _pairs(known: Broadcast):
    """Pairs of words that may be frequent."""

    def select(e: _Entries):
        ok = np.append(may_hold(known.value, e.grams(1)), False)
        at = np.flatnonzero(e.starts(2) & ok[:-1] & ok[1:])
        yield e.grams(2, at), at

    return lambda batches: _counted(batches, select)


def _longer(known: Broadcast, longest: int):
    """Phrases of three words and more, all of whose pairs may be frequent."""

    def select(e: _Entries):
        pair = np.concatenate([may_hold(known.value, e.grams(2)), np.zeros(longest, dtype=bool)])
        at = np.flatnonzero(e.starts(2) & pair[: len(e.key)])
        for size in range(3, longest + 1):
            at = at[pair[at + size - 2] & (e.room[at] >= size)]
            yield e.grams(size, at), at

    return lambda batches: _counted(batches, select)


class _Spelling:
    """Text of the phrases a task has counted, by hash."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []
        self.words = 0

    def add(self, e: _Entries, hashes: np.ndarray, at: np.ndarray, size: int) -> None:
        order, edge = _runs(hashes)
        hashes, at = hashes[order[edge]], at[order[edge]]
        # The words of an entry lie one space apart.
        phrases = _cut(e.words.data, e.words.starts[at], e.words.ends[at + size - 1])
        self.hashes.append(hashes)
        self.rows.append(pa.RecordBatch.from_arrays([e.langs.take(pa.array(e.lang[at])), phrases, pa.array(np.full(len(at), size, np.int32))], names=["lang", "phrase", "size"]))

    def of(self, hashes: np.ndarray) -> pa.Table:
        """Rows of ``hashes``, all of which were added; the rest is forgotten."""
        some, rows = np.concatenate(self.hashes), pa.Table.from_batches(self.rows)
        self.clear()
        order = np.argsort(some)
        return rows.take(pa.array(order[np.searchsorted(some[order], hashes)]))


def _spelled(known: Broadcast, longest: int):
    """Text and count of the phrases the filter points to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, spelling = _Tally(), _Spelling()

        def out() -> Iterator[pa.RecordBatch]:
            hashes, times = tally.rows()
            yield from spelling.of(hashes).append_column("a", pa.array(times)).to_batches()

        for batch in batches:
            for e in _entries(batch):
                # A longer phrase may be frequent only if both of one word less may be.
                at, may = np.arange(len(e.key)), np.ones(len(e.key) + 1, dtype=bool)
                for size in range(1, longest + 1):
                    at = at[(e.room[at] >= size) & may[at + (size > 1)]]
                    hashes = e.grams(size, at)
                    here = may_hold(known.value, hashes)
                    hashes, at = hashes[here], at[here]
                    may[:] = False
                    may[at] = True
                    own = e.own[at]
                    hashes, begin = hashes[own], at[own]
                    fresh = tally.add(hashes, e.times[begin])
                    if len(fresh):
                        spelling.add(e, hashes[fresh], begin[fresh], size)
                spelling.words += len(e.key)
                if spelling.words > SPELL_WORDS and not tally.empty:
                    yield from out()
        if not tally.empty:
            yield from out()

    return run


def frequent_phrases(blocks: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, size, a`` of all phrases of 1 to ``longest`` words that occur ``least`` times, from the packed dictionary."""
    spark, blocks = blocks.sparkSession, blocks.select("block")
    schema = "h bigint, n bigint"

    def counted(run) -> DataFrame:
        return settled(blocks.mapInArrow(run, schema).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), settings=FEW_BLOCKS)

    levels = [counted(_words())]
    levels.append(counted(_pairs(spark.sparkContext.broadcast(filter_of(levels[0], "h")))))
    if longest > 2:
        levels.append(counted(_longer(spark.sparkContext.broadcast(filter_of(levels[1], "h")), longest)))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    spelled = blocks.mapInArrow(_spelled(spark.sparkContext.broadcast(filter_of(every, "h")), longest), "lang string, phrase string, size int, a bigint")
    return spelled.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _total(blocks: DataFrame) -> DataFrame:
    """``lang, n``: word occurrences per language."""
    return blocks.select(F.inline(F.arrays_zip("langs", "words"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("words").alias("n"))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def mined(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n``
    all words of the language; score is floor(1000 a n / (l r)). A phrase with a
    longer frequent one around it that occurs as often is left out. Null lang is
    ``und``; null and empty texts have no words; repeated rows count as often as
    they occur; ties go by higher count, then byte order of the phrase; an empty
    table gives no rows. Only lang and text are read, so other columns do not
    matter. Texts of any length are cut into chunks and counted whole.
    """
    # Few blocks per row group, so that a reader holds few at once.
    blocks = settled(packed(dictionary(docs, longest)), {"parquet.block.row.count.limit": "4"})
    known = settled(frequent_phrases(blocks, least, longest), settings=FEW_BLOCKS)
    words = F.split("phrase", " ")
    part = lambda start, n: F.concat_ws(" ", F.slice("words", start, n))
    phrases = known.where("size > 1").select("lang", "phrase", "size", "a", words.alias("words"))
    cuts = phrases.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(_total(blocks), "lang")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * _wide("a") * _wide("n"), _wide("l") * _wide("r"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # A phrase inside a longer one that is as frequent lies in one that is longer by one word and as frequent.
    longer = phrases.where("size > 2")
    inner = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    rest = weakest.join(inner, ["lang", "phrase", "a"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return rest.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
