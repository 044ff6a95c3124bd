"""Remove bytes covered by long strings that occur again, by merging shard BWTs.

A byte goes if some ``length``-byte string over it also starts at another place of the
corpus. Strings never cross documents.

1. Anchors. In every ``length``-byte string the GRAM-byte substring with the smallest
   hash is its anchor (leftmost on ties), so equal strings have equal anchors. Strings
   whose anchor occurs once in the corpus cannot repeat; this sieve loses nothing, and
   it leaves the texts in place: only hashes and positions move.
2. Contexts. An anchor that occurs again sends the bytes of the strings it stands for,
   aligned at the anchor. Equal contexts are counted once. Contexts of one anchor meet
   in one partition.
3. Merge. The contexts of a block, those of exact copies included, are dealt into two
   shards or more, one after the other in turn, so that contexts of one anchor lie in different shards and meet
   only in the merge. Each shard's BWT is built over the aligned contexts: for each column, the
   bytes before the sorted suffixes, and the order of the shard's rows. The shards are
   merged by refining their interleave column by column with stable bucket passes over
   the BWT bytes; suffixes are never sorted again, and rows are not moved. The passes
   also refine the common prefixes of neighbours, and where these reach ``length`` the
   neighbours form a repeated interval.
4. Spans come back to their documents, are united, and cut out.

Memory: a worker holds one block of at most BLOCK contexts (under 400 bytes each) and
the rest of the anchor's group at its end; a group's size is the number of its distinct
contexts, since equal ones are counted before.

Defined cases: null text is empty; a text shorter than ``length`` keeps all bytes; equal
rows are separate documents, so both lose what they share; a null doc_id is an id like
any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import spill
from .textbytes import PIECE, U64, mix64, row_groups, text_buffers

GRAM = 32
#: Contexts of a shard at most, and of a block, which ends with the anchor that fills it.
SHARD, BLOCK = 8192, 32768
_RNG = np.random.Generator(np.random.PCG64(2718))
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = int(_RNG.integers(1 << 61, 1 << 62)) * 4 + 5
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _owners(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, for each start of a string the place of its anchor)."""
    n = len(data)
    up, down = _powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_VALUE[data] * up, out=total[1:])
    m = n - GRAM + 1
    h = mix64((total[GRAM:] - total[:m]) * down[:m])
    low = (h & ~U64((1 << 21) - 1)) | np.arange(m, dtype=U64)
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if span > have:
        rest = span - have
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return h, (low & U64((1 << 21) - 1)).astype(np.int64)


def anchors(offsets: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (row, hash, place, first start, last start), places counted from the text's begin."""
    for a, b in row_groups(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        for at in range(lo, max(lo + 1, hi - length + 1), PIECE - length + 1):
            end = min(hi, at + PIECE)
            if end - at < length:
                continue
            h, owner = _owners(data[at:end], length)
            start = np.arange(len(owner))
            row = np.searchsorted(offsets[a : b + 1], start + at, "right") - 1 + a
            whole = start + at + length <= offsets[row + 1]
            start, row, owner = start[whole], row[whole], owner[whole]
            if not len(start):
                continue
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])]))
            last = np.append(new[1:], len(start)) - 1
            r, base = row[new], offsets[row[new]] - at
            yield r, h[owner[new]].view(np.int64), owner[new] - base, start[new] - base, start[last] - base


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            for row, h, place, _, _ in anchors(offsets, data, length):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h), pa.array(place)], names=["doc_id", "mark", "anchor", "place"])

    return docs.mapInArrow(run, "doc_id long, mark long, anchor long, place long")


def _contexts(held: DataFrame, length: int, whole: bool) -> DataFrame:
    """Contexts of repeated anchors: with ``whole`` their bytes and counts, else who has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            places = batch.column(3)
            wanted = places.flatten().to_numpy(zero_copy_only=False)
            sizes = places.value_lengths().to_numpy(zero_copy_only=False)
            keys = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 40) | wanted)
            seen: dict[bytes, int] = {}
            rows: list[tuple] = []
            for row, h, place, first, last in anchors(offsets, data, length):
                key = (row << 40) | place
                near = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                for i in np.flatnonzero(keys[near] == key) if len(keys) else ():
                    o, p, f, e = int(offsets[row[i]]), int(place[i]), int(first[i]), int(last[i])
                    text = data[o + f : o + e + length].tobytes()
                    digest = hashlib.blake2b(text + (p - f).to_bytes(4, "big"), digest_size=16).digest()
                    if not whole:
                        rows.append((digest, int(row[i]), p))
                    elif digest in seen:
                        rows[seen[digest]][-1][0] += 1
                    else:
                        seen[digest] = len(rows)
                        rows.append((int(h[i]), digest, p - f, text, [1]))
                    if len(rows) >= 20_000:
                        yield pack(rows, batch)
                        rows, seen = [], {}
            if rows:
                yield pack(rows, batch)

    def pack(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        if whole:
            return pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array([x[0] for x in c[4]], pa.int64())],
                names=["anchor", "context", "before", "bytes", "n"],
            )
        at = pa.array(c[1])
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(c[2], pa.int64())], names=["context", "doc_id", "mark", "place"])

    schema = "anchor long, context binary, before int, bytes binary, n long" if whole else "context binary, doc_id long, mark long, place long"
    return held.select("doc_id", "mark", "text", "places").mapInArrow(run, schema)


class ShardBwt:
    """The positional BWT of a shard: per column the bytes that precede its sorted suffixes, and the order of its rows."""

    def __init__(self, matrix: np.ndarray):
        n, width = matrix.shape
        self.columns, self.orders = np.empty((width, n), np.uint8), np.empty((width, n), np.uint16)
        order = np.arange(n)
        by_column = np.ascontiguousarray(matrix.T)
        for j in range(width - 1, -1, -1):
            before = by_column[j][order]
            self.columns[j] = before
            order = order[np.argsort(before, kind="stable")]
            self.orders[j] = order


def _common(prefix: np.ndarray, symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours after a stable pass by symbol, from those before it."""
    out = np.empty_like(prefix)
    ordered = symbols[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(ordered)).tolist(), strict=True):
        at = order[a:b]
        out[a] = 0
        if b - a > 1:
            last = int(at[-1]) + 1
            out[a + 1 : b] = np.minimum.reduceat(prefix[:last], at[:-1] + 1) + 1
    return out


def merge_shards(shards: list[ShardBwt], length: int, width: int, weight: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context (rows of the shards in turn) the least and greatest start of a repeated string.

    ``first`` and ``last`` bound the starts a context stands for; -1, -1 where none repeats. Only the
    interleave (which shard each merged suffix comes from) and the common prefixes are refined;
    which row a merged suffix is of, its own shard's order tells.
    """
    sizes = [s.columns.shape[1] for s in shards]
    n = sum(sizes)
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    slots = np.arange(n)  # merged places of the shards' suffixes, shard by shard
    prefix = np.zeros(n, np.int16)
    low, high = np.full(n, -1), np.full(n, -1)
    for j in range(width - 1, -1, -1):
        symbols = np.empty(n, np.uint8)
        symbols[slots] = np.concatenate([s.columns[j] for s in shards])
        order = np.argsort(symbols, kind="stable")
        prefix = np.minimum(_common(prefix, symbols, order), np.int16(16000))
        if len(shards) > 1:
            source = source[order]
            slots = np.argsort(source, kind="stable")
        if j + length > width:
            continue
        row = np.empty(n, np.int64)
        row[slots] = np.concatenate([s.orders[j] + b for s, b in zip(shards, begin, strict=True)])
        valid = (first[row] <= j) & (j <= last[row])
        interval = np.cumsum(prefix < length) - 1
        many = np.bincount(interval, np.where(valid, weight[row], 0)) >= 2
        hit = row[valid & many[interval]]
        low[hit] = j
        high[hit] = np.maximum(high[hit], j)
    return low, high


def shards_of(n: int) -> list[np.ndarray]:
    """The contexts of each shard of a block of ``n``: dealt in turn, to two shards or more unless there is one context."""
    k = max(2, -(-n // SHARD)) if n > 1 else 1
    return [np.arange(i, n, k) for i in range(k)]


def solve_block(rows: list[list], length: int) -> list[tuple[bytes, int, int]]:
    """(context, back, ahead) of the contexts that hold a repeated string; rows: [context, before, bytes, n]."""
    wide = length - GRAM
    matrix = np.zeros((len(rows), wide + length), np.uint8)
    first = np.array([wide - r[1] for r in rows])
    last = first + np.array([len(r[2]) for r in rows]) - length
    for i, r in enumerate(rows):
        matrix[i, first[i] : first[i] + len(r[2])] = np.frombuffer(r[2], np.uint8)
    dealt = shards_of(len(rows))
    at = np.concatenate(dealt)
    low, high = merge_shards([ShardBwt(matrix[d]) for d in dealt], length, wide + length, np.array([r[3] for r in rows])[at], first[at], last[at])
    return [(rows[at[i]][0], int(wide - low[i]), int(high[i] + length - wide)) for i in np.flatnonzero(low >= 0)]


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(context, back, ahead): repeated strings reach from ``back`` before the anchor to ``ahead`` after it."""

    def solve(rows: list[list]) -> pa.RecordBatch:
        """rows in order of anchors."""
        c = list(zip(*solve_block(rows, length), strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], names=["context", "back", "ahead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[list] = []  # whole groups
        group: list[list] = []
        anchor = None
        for batch in batches:
            for a, context, before, text, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if a != anchor:
                    block += group
                    group, anchor = [], a
                    if len(block) >= BLOCK:
                        yield solve(block)
                        block = []
                if group and group[-1][0] == context:
                    group[-1][3] += n
                else:
                    group.append([context, before, text, n])
        block += group
        if block:
            yield solve(block)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "context")
    return dealt.mapInArrow(run, "context binary, back long, ahead long")


def remove_repeats(docs: DataFrame, length: int = 200, keep_bytes: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, spans (removed, start and end), kept_sha256 and, if asked, kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = spill(_anchor_rows(source, length), "anchors-found")
    # written, so that both sides of the join are plain shuffles and a hot anchor's rows can be split
    again = spill(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    places = found.join(again, "anchor").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
    p = places.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "places")
    held = source.join(p, source["doc_id"].eqNullSafe(p["_id"]) & (source["mark"] == p["_mark"]), "left").select(
        "doc_id",
        "mark",
        "places",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(F.col("places").isNull(), F.sha2("text", 256)).alias("sha"),
        (F.col("text") if keep_bytes else F.when(F.col("places").isNotNull(), F.col("text"))).alias("text"),
    )
    held = spill(held, "repeats")
    touched = held.where("places is not null")
    repeats = _repeats(_contexts(touched, length, True), length)
    spans = (
        _contexts(touched, length, False)
        .join(repeats, "context")
        .groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(F.collect_set(F.struct((F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"))).alias("found"))
    )
    joined = touched.join(spans, touched["doc_id"].eqNullSafe(spans["_id"]) & (touched["mark"] == spans["_mark"]), "left")
    done = _cut_out(joined.select("doc_id", "n_bytes", "text", "found"), keep_bytes)
    none = F.array().cast("array<struct<start:long,end:long>>").alias("spans")
    rest = held.where("places is null").select("doc_id", "n_bytes", none, F.col("sha").alias("kept_sha256"), *[F.encode("text", "UTF-8").alias("kept")] * keep_bytes)
    return done.unionByName(rest)


def _cut_out(joined: DataFrame, keep_bytes: bool) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            spans, digests, kept = [], [], []
            for i, found in enumerate(batch.column(3).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                runs: list[dict] = []
                for start, end in sorted((x["start"], x["end"]) for x in found or ()):
                    if runs and start <= runs[-1]["end"]:
                        runs[-1]["end"] = max(end, runs[-1]["end"])
                    else:
                        runs.append({"start": start, "end": end})
                edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(text)]
                rest = b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                spans.append(runs)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept += [rest] * keep_bytes
            columns = [batch.column(0), batch.column(1), pa.array(spans, span), pa.array(digests, pa.string())] + [pa.array(kept, pa.binary())] * keep_bytes
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept_sha256"] + ["kept"] * keep_bytes)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * keep_bytes)
