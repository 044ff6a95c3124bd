"""Phrase collocations by hashed pre-counting (Park, Chen and Yu; DHP) with Apriori pruning.

The texts are read once for each phrase length. The pass for length n counts two things:

* exactly, by their words, those phrases of n words that can be frequent: their bucket was full when the pass
  before counted buckets, and both of their parts of n - 1 words are frequent;
* by bucket, the phrases of n + 1 words both of whose parts of n words may still be frequent (all pairs at first).

Both filters are bitmaps over the same hash, broadcast to the workers; their size follows the size of the texts, up to
2^27 buckets (16 MB). A bit set by chance only lets a phrase be counted that then turns out to be rare: counts are of the words
themselves, so results are exact at any size, whatever the bitmaps let through.

A task adds up what it sees before anything moves: phrases in a dictionary of words, buckets as sorted arrays that
leave as blocks of 2^16 buckets (three bytes for each that is in use). Blocks are dealt by number and added one
after another, so a bucket that every task has, or a phrase that a third of all texts repeat, is a row for each task.
A bucket's count stops at the support: a sum of such counts reaches the support if, and only if, the true sum does.

Defined cases: null text has no words; a null language is ``und``, as is the language of that name; empty pieces and
repeated separators make no words; repeated rows count as often as they occur; phrases that tie in score and count are
ranked by their UTF-8 bytes; an empty table gives no rows; other columns are not read. A text of any length
is read whole, in pieces that end at separators, where no phrase goes on; only a stretch without any is held as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..plans.runtime import spill
from .textbytes import U64, mix64, row_groups, text_buffers
from .wordspans import Words, pieces

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
WORD = bytes(b for b in range(256) if b not in b" \t" + SEPARATORS)
#: Buckets of a block, and the largest number of buckets: their bits, broadcast, are 16 MB.
BLOCK, MOST_BUCKETS = 1 << 16, 1 << 27
#: Buckets and phrases that a task holds before it sends them on.
HELD_BUCKETS, HELD_PHRASES = 1 << 22, 1 << 19
#: Bytes of texts whose phrases are counted together.
CHUNK = 1 << 22

_NEXT = U64(0x9E3779B97F4A7C15)


def _longer(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    return mix64(first * _NEXT + last)


def _word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], U64)


def phrase_hash(lang: str, phrase: str) -> int:
    h = _word_hash(lang, phrase.encode().split(b" "))
    total = h[:1]
    for i in range(1, len(h)):
        total = _longer(total, h[i : i + 1])
    return int(total[0])


class Bitmap:
    """Which buckets of a power of two are full; with no content, all of them."""

    def __init__(self, buckets: int, blocks: dict[int, bytes] | None):
        self.mask = U64(buckets - 1)
        self.bits = None
        if blocks is not None:
            self.bits = np.zeros(max(buckets, BLOCK) // 8, np.uint8)
            for block, content in blocks.items():
                self.bits[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(content, np.uint8)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & self.mask).astype(np.uint32)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(hashes), bool)
        b = self.bucket(hashes)
        return (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


class _Buckets:
    """A task's counts of buckets, as sorted arrays."""

    def __init__(self, support: int):
        self.support, self.kind = support, np.min_scalar_type(support)
        self.waiting: list[np.ndarray] = []
        self.held, self.ids, self.counts = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, buckets: np.ndarray) -> None:
        self.waiting.append(buckets)
        self.held += len(buckets)
        if self.held >= HELD_BUCKETS:
            self.merge()

    def merge(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *self.waiting]), return_counts=True)
        self.waiting, self.held = [], 0
        ids = np.concatenate([self.ids, new])
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], np.concatenate([self.counts, n])[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
        self.ids, self.counts = ids[starts], np.minimum(np.add.reduceat(n, starts), self.support) if len(starts) else n

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        self.merge()
        if not len(self.ids):
            return
        numbers, starts = np.unique(self.ids >> 16, return_index=True)
        ends = [*starts[1:].tolist(), len(self.ids)]
        for number, a, b in zip(numbers.tolist(), starts.tolist(), ends, strict=True):
            yield number, (self.ids[a:b] & (BLOCK - 1)).astype(np.uint16).tobytes() + self.counts[a:b].astype(self.kind).tobytes()
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)


class _Texts:
    """The words of one language's texts as numbers, with the hashes and the pieces they lie in."""

    def __init__(self, finder: Words, texts: pa.Array, lang: str):
        offsets, data = text_buffers(texts)
        found = [finder.spans(offsets[a : b + 1], data) for a, b in row_groups(offsets)]
        starts, ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        lo, hi = int(offsets[0]), int(offsets[-1])
        own = data[lo:hi]
        breaks = np.sort(np.concatenate([np.flatnonzero(_IS_SEPARATOR[own]) + lo, offsets]))
        self.piece = np.searchsorted(breaks, starts, "right")
        ends_at = np.concatenate([[0], np.cumsum(ends - starts)])
        compact = finder.folded[own[finder.is_word[own]]]
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(compact)])
        coded = column.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.hash = _word_hash(lang, self.words)[self.ids]

    def whole(self, n: int) -> np.ndarray:
        """Of each place where n words could begin, whether they lie in one piece."""
        m = max(0, len(self.ids) - n + 1)
        return self.piece[:m] == self.piece[n - 1 :] if m else np.zeros(0, bool)

    def hashes(self, n: int) -> np.ndarray:
        h = self.hash
        for k in range(1, n):
            h = _longer(h[:-1], self.hash[k:]) if len(h) else h
        return h

    def counted(self, at: np.ndarray, n: int) -> Iterator[tuple[bytes, int]]:
        """The distinct phrases of n words that begin at the places ``at``, and how often each does."""
        if not len(at):
            return
        key, width = self.ids[at], len(self.words)
        for k in range(1, n):
            _, key = np.unique(key * width + self.ids[at + k], return_inverse=True)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        words = [[self.words[i] for i in self.ids[at[first] + k].tolist()] for k in range(n)]
        yield from zip(map(b" ".join, zip(*words, strict=True)), count.tolist(), strict=True)


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def _scan(docs: DataFrame, n: int, last: bool, buckets: int, support: int, full: Broadcast | None, frequent: Broadcast | None) -> DataFrame:
    """One pass: rows (lang, phrase, n) of phrases that may be frequent, by task, and rows (block, content) of counts of buckets."""
    schema = "lang string, phrase string, n long, block int, content binary"

    def rows(lang: list, phrase: list, count: list, block: list, content: list) -> pa.RecordBatch:
        text = lambda x: pa.array(x, pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([text(lang), text(phrase), pa.array(count, pa.int64()), pa.array(block, pa.int32()), pa.array(content, pa.binary())], names=["lang", "phrase", "n", "block", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = Bitmap(buckets, full.value if full else None)
        parts = Bitmap(buckets, frequent.value if frequent else None)
        finder, seen, held = Words(WORD), {}, 0
        longer = _Buckets(support)

        def phrases() -> Iterator[pa.RecordBatch]:
            for lang, own in seen.items():
                keys = list(own)
                for at in range(0, len(keys), 100_000):
                    some = keys[at : at + 100_000]
                    blank = [None] * len(some)
                    yield rows([lang.encode()] * len(some), some, [own[k] for k in some], blank, blank)

        def blocks() -> Iterator[pa.RecordBatch]:
            some = list(longer.blocks())
            for at in range(0, len(some), 64):
                number, content = zip(*some[at : at + 64], strict=True)
                blank = [None] * len(number)
                yield rows(blank, blank, blank, list(number), list(content))

        for lang, texts in _by_language(batches):
            words = _Texts(finder, texts, lang)
            own = seen.setdefault(lang, {})
            whole, h = words.whole(n), words.hashes(n)
            able = whole.copy()
            if n > 1:
                shorter = parts.has(words.hashes(n - 1))
                able &= shorter[:-1] & shorter[1:] if len(able) else able
                at = np.flatnonzero(able)
                able[at] = fits.has(h[at])
            before = len(own)
            for phrase, count in words.counted(np.flatnonzero(able), n):
                own[phrase] = own.get(phrase, 0) + count
            held += len(own) - before
            if not last and len(able) > 1:
                at = np.flatnonzero(able[:-1] & able[1:] & words.whole(n + 1))
                longer.add(fits.bucket(_longer(h[at], words.hash[at + n])))
            if held >= HELD_PHRASES:
                yield from phrases()
                seen, held = {}, 0
            if len(longer.ids) >= 2 * HELD_BUCKETS:
                yield from blocks()
        yield from phrases()
        if not last:
            yield from blocks()

    return docs.mapInArrow(run, schema)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language together, in chunks; those left at the end of a task come last."""
    waiting: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        lang, text = batch.column(0).dictionary_encode(), batch.column(1)
        for code, name in enumerate(lang.dictionary.to_pylist()):
            own = text.filter(pc.equal(lang.indices, code)) if len(lang.dictionary) > 1 else text
            waiting.setdefault(name, []).append(own)
            size[name] = size.get(name, 0) + own.nbytes
            if size[name] >= CHUNK or sum(size.values()) >= 4 * CHUNK:
                size.pop(name)
                for chunk in _chunks(pa.concat_arrays(waiting.pop(name))):
                    yield name, chunk
    for name, texts in waiting.items():
        for chunk in _chunks(pa.concat_arrays(texts)):
            yield name, chunk


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` as they are, but for those longer than a chunk: they come in pieces that end at separators."""
    offsets, data = text_buffers(texts)
    long = np.flatnonzero(np.diff(offsets) > CHUNK)
    at = 0
    for row in long.tolist():
        if row > at:
            yield texts.slice(at, row - at)
        for start, end in pieces(data, int(offsets[row]), int(offsets[row + 1]), _IS_SEPARATOR, CHUNK):
            yield pa.array([data[start:end].tobytes()], pa.large_binary()).view(pa.large_string())
        at = row + 1
    if at < len(texts):
        yield texts.slice(at)


def _add_blocks(blocks: DataFrame, support: int) -> dict[int, bytes]:
    """The bits of full buckets by block: at most 2^27 bits reach the driver."""
    kind = np.min_scalar_type(support)
    width = 2 + kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= support, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bits], pa.binary())], names=["block", "content"])

        for batch in batches:
            for block, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != number:
                    if number is not None:
                        yield done()
                    number, total = block, np.zeros(BLOCK, np.int64)
                raw = content.as_buffer()
                n = raw.size // width
                total[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, kind, n, 2 * n)
        if number is not None:
            yield done()

    dealt = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, content binary")
    return {r["block"]: bytes(r["content"]) for r in dealt.collect()}


def _bits_of(phrases: DataFrame, buckets: int) -> dict[int, bytes]:
    """The bits of the buckets of ``phrases`` (lang, phrase), as ``_add_blocks`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Buckets(1)
        for batch in batches:
            own.add(np.array([phrase_hash(a, b) & (buckets - 1) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.uint32))
        for number, content in own.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([content], pa.binary())], names=["block", "content"])

    return _add_blocks(phrases.select("lang", "phrase").mapInArrow(run, "block int, content binary"), 1)


def _buckets_for(docs: DataFrame) -> int:
    """A power of two: about a bucket for three words of the whole texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MOST_BUCKETS, max(BLOCK, 1 << max(0, (int(size) // 12).bit_length())))


def frequent_phrases(docs: DataFrame, support: int = 30, most: int = 4, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``most`` words with f >= support, and (lang, n) with the number of words.

    ``docs`` has lang and text. ``buckets`` (a power of two) is found from the size of the texts unless given.
    """
    if support < 1 or most < 1:
        raise ValueError("support and the number of words begin at 1")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    buckets = buckets or _buckets_for(docs)
    found, totals, full, frequent = [], None, None, None
    for n in range(1, most + 1):
        kept = spill(_scan(docs, n, n == most, buckets, support, full, frequent), f"phrases-{n}")
        counts = kept.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            totals = kept.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        counts = spill(counts.where(F.col("f") >= support), f"frequent-{n}")
        found.append(counts.select("lang", "phrase", F.lit(n).alias("words"), "f"))
        if n < most:
            for old in (full, frequent):
                if old is not None:
                    old.unpersist()
            full = spark.sparkContext.broadcast(_add_blocks(kept.where("block IS NOT NULL").select("block", "content"), support))
            frequent = spark.sparkContext.broadcast(_bits_of(counts, buckets))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return everything, totals


def _ratio(over, under, scale: int):
    """floor(scale * over / under), exactly: products of up to 38 digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(9,0)") * wide(over), wide(under))


def collocations(docs: DataFrame, support: int = 30, most: int = 4, top: int = 2000, share: int = 80, scale: int = 2_000_000, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``most`` words.

    A phrase is cut in two after each of its words; its score is floor(scale * a / (l + r)) at the cut where that is
    least, ties to the first cut. A phrase goes if a longer one that holds it has ``share`` percent of its count or more.
    """
    phrases, totals = frequent_phrases(docs, support, most, buckets)
    candidates = phrases.where("words > 1")
    w = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    # every part of a frequent phrase is frequent, so no cut is lost
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", _ratio(F.col("a"), F.col("l") + F.col("r"), scale))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what a longer phrase holds: its runs of 2 words or more, with the largest count of such a longer phrase
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: part(at, n))))
    inside = candidates.where("words > 2").select("lang", F.explode(runs).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left")
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(9,0)")
    kept = kept.where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", share)))
    # a language's phrases are ranked by ranges of their scores, so that one language is many tasks' work
    ranked = ordered.numbered(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "place")
    ranked = ranked.where(F.col("place") < top).withColumn("rank", F.col("place") + 1)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
