"""Collocation mining: the best-scoring phrases of each language by best-first growth with branch and bound.

A phrase of two to ``longest`` words with at least ``least`` occurrences is a candidate; its score is the smallest
floor(1000 * a * n / (l * r)) over the cuts into a first part (l occurrences) and a rest (r). A rest occurs at least as often
as the phrase, so no phrase that grows from a prefix scores more than 1000 * n / (the count of the prefix' first word); the
same holds for its last word. So growth starts at the rarest first words, whose bounds are highest: a round takes in all
words of less than a limit of occurrences, counts every phrase that begins or ends with one (parts and extensions of its
candidates among them), and scores the candidates between such words. A language is settled when its ``top``-th surviving
score lies above the bound of all phrases outside, so that none of them can even tie; the others' limit grows
``growth`` times, and what is counted already isn't counted again.

Counting is by levels: words, then pairs of frequent words, then phrases all whose counted pairs are frequent. What is
frequent reaches the tasks as bit tables of a fixed size (2^``bits`` cells, 8 MB each at 26); a cell shared by two phrases
only lets a phrase be counted in vain. A task adds up its phrases before they are shuffled, told apart by 64-bit hashes within at
most ``hold`` of them (a chance of 1e-8 for two to fall together); shuffled counts are by the phrases' text. A phrase has a row
per task at most, so a frequent one lands in no task whole.

Cases: null texts count as empty and give no words; a null lang is ``und``; rows that repeat are counted as often as they
stand there; doc_id and extra columns, whatever their names, aren't read; ties in score and count go by the phrase in UTF-8
byte order; an empty table, or one without frequent phrases, gives an empty result; a language with fewer survivors than
``top`` gives them all. Very long texts are taken whole, in memory of about 40 bytes for each of a text's bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
COUNTED = "lang string, phrase string, a long"
_FROM = bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r"
_FOLD = bytes.maketrans(_FROM, bytes(range(97, 123)) + b" " + b"\n" * 9)
_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True


def fold(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in which words of a piece stand one space apart and pieces (texts, too) a line end; where each text begins in them."""
    out = np.frombuffer(b"\n" + b"\n".join(t or b"" for t in texts).translate(_FOLD) + b"\n", np.uint8)
    edges = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    keep = np.concatenate([[True], ~((out[1:] == 32) & (out[:-1] == 32))])
    return (out, edges) if keep.all() else (out[keep], np.concatenate([[0], np.cumsum(keep)])[edges])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data``, apart by the seeds of their languages."""
    down = common._powers(len(data) + 1)[1]
    return common.mix((sums[ends] - sums[starts]) * down[starts] ^ seeds)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up = common._powers(len(data) + 1)[0]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(common._BYTE[data] * up[: len(data)])])


def lang_seeds(langs: list[str]) -> np.ndarray:
    """A number for each language's name."""
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def whole_hashes(phrases: list[str], langs: list[str]) -> np.ndarray:
    """The same hashes for phrases that stand alone."""
    raw = [p.encode() for p in phrases]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(np.concatenate([[1], sizes[:-1] + 1]))
    return span_hashes(data, starts, starts + sizes, prefix_sums(data), lang_seeds(langs))


class Sums:
    """Adds up phrases of a task: at most about ``hold`` of them, told apart by their hashes, with their texts."""

    def __init__(self, hold: int):
        self.hold = hold
        self.clear()

    def clear(self) -> None:
        self.data, self.size, self.parts, self.rows = [], 0, [], 0

    def add(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> None:
        if not self.data or self.data[-1] is not data:
            self.data.append(data)
        before = sum(map(len, self.data)) - len(data)
        keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((keys, counts, starts[at] + before, ends[at] - starts[at], langs[at]))
        self.rows += len(keys)
        self.size = before + len(data)

    def merge(self) -> None:
        """Leaves one row of each phrase, and of the data only its text."""
        keys, counts, starts, sizes, langs = (np.concatenate(c) for c in zip(*self.parts))
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        counts, starts, sizes, langs, data = np.bincount(back, counts).astype(np.int64), starts[at], sizes[at], langs[at], np.concatenate(self.data)
        places = np.concatenate([[0], np.cumsum(sizes)])
        texts = np.empty(places[-1], np.uint8)
        for a in range(0, len(keys), 1 << 16):
            part = slice(a, a + (1 << 16))
            first, last = places[a], places[min(a + (1 << 16), len(keys))]
            texts[first:last] = data[np.arange(first, last) - np.repeat(places[:-1][part] - starts[part], sizes[part])]
        self.data, self.size, self.parts, self.rows = [texts], len(texts), [(keys, counts, places[:-1], sizes, langs)], len(keys)

    def full(self) -> bool:
        """Whether they are still too many, or their texts too long, after merging."""
        if self.rows < self.hold and self.size < 1 << 25:
            return False
        self.merge()
        return self.rows > self.hold // 2 or self.size > 1 << 24

    def flush(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self.merge()
            ((_, counts, starts, _, langs),), (texts,), names_ = self.parts, self.data, pa.array(names, pa.string())
            offsets = np.append(starts, len(texts)).astype(np.int64)
            for a in range(0, len(counts), 1 << 16):
                n = min(1 << 16, len(counts) - a)
                own = offsets[a : a + n + 1]
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(own - own[0]), pa.py_buffer(texts[own[0] : own[-1]])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names_.take(pa.array(langs[a : a + n])), text, pa.array(counts[a : a + n])], ["lang", "phrase", "a"])
        self.clear()


def bit_table(cells: DataFrame, bits: int) -> bytes:
    """Packed bits of the hashes in ``cells`` (h), compressed: 2^bits of them, whatever the number of rows."""
    wide = 15
    own = cells.select(F.expr(f"h & {(1 << bits) - 1}").alias("c")).distinct().groupBy(F.expr(f"c >> {wide}").alias("block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for offsets in b.column("offsets"):
                row = np.zeros(1 << wide, np.uint8)
                row[np.asarray(offsets.values)] = 1
                out.append(np.packbits(row, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], ["block", "bits"])

    table = np.zeros(1 << (bits - 3), np.uint8)
    packed = own.agg(F.collect_list(F.expr(f"cast(c & {(1 << wide) - 1} as int)")).alias("offsets")).mapInArrow(pack, "block long, bits binary")
    for row in packed.collect():  # 4 KB a row, 2^(bits - 15) rows at most
        table[row.block << (wide - 3) : (row.block + 1) << (wide - 3)] = np.frombuffer(row.bits, np.uint8)
    return zlib.compress(table.tobytes(), 1)


def look(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys & np.uint64((1 << bits) - 1)
    return table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0


def hashed(phrases: DataFrame) -> DataFrame:
    """h: the hash of each row's lang and phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = whole_hashes(b.column("phrase").to_pylist(), b.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def count(docs: DataFrame, lengths: range, tables: dict | None, bits: int, hold: int) -> DataFrame:
    """lang, phrase, a: occurrences of the phrases of ``lengths`` words in ``docs`` (lang, text) that ``tables`` let through.

    Tables: ``old`` and ``new`` words, whose phrases were counted in earlier rounds and are to be in this one; ``far`` words, frequent but
    beyond the limit; ``pairs``, the frequent ones of those counted so far.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tables) if tables else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, names = sent and {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in sent.value.items()}, Sums(hold), {}
        for b in common.blocks(batches, "text", 2 << 20):
            data, edges = fold(b.column("text").cast(pa.binary()).to_pylist())
            gap = _GAP[data]
            starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
            langs, words = b.column("lang").to_pylist(), np.diff(np.searchsorted(starts, edges))
            code = np.array([names.setdefault(x, len(names)) for x in langs], np.int32)
            of, seeds = np.repeat(code, words), np.repeat(lang_seeds(langs), words)
            sums_of = prefix_sums(data)
            h = span_hashes(data, starts, ends, sums_of, seeds)
            joined = np.concatenate([data[ends[:-1]] == 32, [False]]) if len(starts) else np.zeros(0, bool)  # to the next word
            if own is None:
                sums.add(data, h, starts, ends, of)
            else:
                old, new = look(own["old"], h, bits), look(own["new"], h, bits)
                near, known = old | new, old | new | look(own["far"], h, bits)
                link = joined.copy()
                link[:-1] &= known[:-1] & known[1:]
                if "pairs" in own and len(h) > 1:
                    at = np.flatnonzero(link)
                    at = at[near[at] | near[at + 1]]
                    link[at] = look(own["pairs"], span_hashes(data, starts[at], ends[at + 1], sums_of, seeds[at]), bits)
                for m in lengths:
                    if len(h) < m:
                        continue
                    ok = new[: len(h) - m + 1] | new[m - 1 :]
                    ok &= ~(old[: len(h) - m + 1] | old[m - 1 :])
                    for k in range(m - 1):
                        ok &= link[k : len(h) - m + 1 + k]
                    at = np.flatnonzero(ok)
                    if len(at):
                        sums.add(data, span_hashes(data, starts[at], ends[at + m - 1], sums_of, seeds[at]), starts[at], ends[at + m - 1], of[at])
            if sums.full():
                yield from sums.flush(list(names))
        yield from sums.flush(list(names))

    return docs.mapInArrow(run, COUNTED).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def scored(phrases: DataFrame, counts: DataFrame, limits: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the survivors among ``phrases`` whose end words are rarer than their language's limit."""
    big = lambda c: F.col(c).cast("decimal(17,0)")  # noqa: E731  1000 * a * n needs 37 digits at most
    words = F.split("phrase", " ")
    part = lambda name, a, b: F.array_join(F.slice(F.col("w"), a, b), " ").alias(name)
    k, m = F.col("k"), F.size("w")
    cuts = phrases.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", m.alias("m"), part("left", F.lit(1), k), part("right", k + 1, m - k))
    known = counts.select("lang", F.col("phrase").alias("p"), F.col("a").alias("f"))
    cuts = cuts.join(known.select("lang", F.col("p").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("p").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(limits.select("lang", "n", "high"), "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * big_a * big_n) div (big_l * big_r)")
    cuts = cuts.withColumns({f"big_{c}": big(c) for c in "anlr"}).withColumn("score", score)
    ends = F.max(F.when(k == 1, F.col("l"))), F.max(F.when(k == F.col("m") - 1, F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.first("high").alias("high"), F.min(F.struct("score", "k", "l", "r")).alias("best"), ends[0].alias("first"), ends[1].alias("last"))
    best = best.where("first < high and last < high").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    # A candidate inside a longer one of as many occurrences is also inside one that is longer by a word.
    longer = phrases.withColumn("w", words).where(m > 2)
    longer = longer.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), m - 1), " "), F.array_join(F.slice("w", F.lit(2), m - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    return best.join(longer, ["lang", "phrase"], "left").where(f"within is null or 100 * within < {share} * a").drop("within")


def mine(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, start: float = 1 / 1024, growth: int = 64, bits: int = 26, hold: int = 1 << 19) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language in ``docs`` (lang, text)."""
    spark = docs.sparkSession
    common.ready(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = common.saved(count(common.spread(rows), range(1, 2), None, bits, hold), "words")
    langs = words.groupBy("lang").agg(F.sum("a").alias("n"), F.max("a").alias("most"), F.lit(0).cast("long").alias("low"))
    words, open_langs = words.where(F.col("a") >= least), common.saved(langs.where(F.col("most") >= least), "langs")
    grown, found, high = [], [], start
    while not open_langs.isEmpty():
        limits = open_langs.withColumn("high", F.greatest(F.floor(F.col("n") * high), F.lit(4 * least)))
        placed = words.join(limits, "lang")
        tables = {name: bit_table(hashed(placed.where(which)), bits) for name, which in (("old", "a < low"), ("new", "a >= low and a < high"), ("far", "a >= high"))}
        texts = common.spread(rows.join(open_langs.select("lang"), "lang", "left_semi") if found else rows)
        grown.append(common.saved(count(texts, range(2, 3), tables, bits, hold).where(F.col("a") >= least), "pairs"))
        if longest > 2:
            pairs = reduce(DataFrame.unionByName, grown).where("size(split(phrase, ' ')) = 2")
            tables = tables | {"pairs": bit_table(hashed(pairs), bits)}
            grown.append(common.saved(count(texts, range(3, longest + 1), tables, bits, hold).where(F.col("a") >= least), "longer"))
        phrases = reduce(DataFrame.unionByName, grown).groupBy("lang", "phrase").agg(F.max("a").alias("a"))  # shared cells can count one in two rounds
        survivors = common.saved(scored(phrases.join(open_langs.select("lang"), "lang", "left_semi"), words.unionByName(phrases), limits), "survivors")
        above = survivors.join(limits, ["lang", "n"]).where("score > (1000 * n) div high").groupBy("lang").count()
        settled = common.saved(limits.join(above, "lang", "left").where(f"high > most or count >= {top}").select("lang"), "settled")
        found.append(survivors.join(settled, "lang", "left_semi"))
        open_langs = common.saved(limits.join(settled, "lang", "left_anti").select("lang", "n", "most", F.col("high").alias("low")), "open")
        high *= growth
    if not found:
        return spark.createDataFrame([], RESULT)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= top)  # each task passes on at most top rows of a language
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
