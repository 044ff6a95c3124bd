"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items (an
item with fewer words is one shorter window). For each pattern length there are
tables over blocks of words: a shift table that tells how far the search may jump
because no pattern holds the block nearer to its end, and suffix buckets that list the
patterns ending with a block; those are compared word by word.

Words: A-Z lowered, then runs of digits, letters and code points from U+0080 on.
The benchmark is sized by an aggregate and dealt into blocks of at most
``block_bytes`` of text; each block is broadcast and searched in one pass over the
documents, and a worker holds the tables of one block, made once. With more than one
block the documents are written once with a row key, every further pass gives only the
rows it hits, and these are merged by key.

Defined cases: null or wordless texts have 0 words and no hits; null or wordless items
have no windows; a null item_id is named ``null``; repeated items count once per id;
extra columns pass through, and results take the names ``n_words``, ``hit_spans`` and
``hit_items`` with a suffix where a column clashes; empty tables work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import free_name, spill
from .textbytes import text_buffers

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))
#: Texts are split into words in slices of about this many bytes.
SLICE = 1 << 20
#: Benchmark text of one block: the tables of a worker take some hundred times as much memory.
BLOCK_BYTES = 4 << 20
_TABLES: dict[str, "Matcher"] = {}


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            tail = text[at:end].translate(_FOLD).rfind(b" ")
            while tail < 0 and end < len(text):  # one word longer than a slice
                end += SLICE
                tail = text[at:end].translate(_FOLD).rfind(b" ")
            end = at + tail + 1 if tail >= 0 and end < len(text) else end
        yield text[at:end].translate(_FOLD).split()
        at = end


class WuManber:
    """Search for patterns of one length over sequences of word numbers."""

    def __init__(self, patterns: dict[tuple[int, ...], frozenset[str]], base: int):
        self.length = len(next(iter(patterns)))
        self.block = 2 if self.length > 1 else 1
        self.base = base
        self.default = self.length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[list[int], frozenset[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
            self.bucket.setdefault(self._key(pattern, self.length), []).append((list(pattern), items))

    def _key(self, ids, end: int) -> int:
        return ids[end - 2] * self.base + ids[end - 1] if self.block == 2 else ids[end - 1]

    def search(self, ids: list[int]) -> Iterator[tuple[int, frozenset[str]]]:
        """(start, items) of each occurrence, by start."""
        n, length, base, default, two = len(ids), self.length, self.base, self.default, self.block == 2
        shift, bucket = self.shift.get, self.bucket
        end = length
        while end <= n:
            key = ids[end - 2] * base + ids[end - 1] if two else ids[end - 1]
            step = shift(key, default)
            if step:
                end += step
                continue
            window = ids[end - length : end]
            for pattern, items in bucket[key]:
                if pattern == window:
                    yield end - length, items
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], frozenset[str]]] = {}
        for item, text in items:
            own = frozenset([item])
            ids = [self.number.setdefault(w, len(self.number) + 1) for part in words_of(text) for w in part]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                table, window_ids = by_length.setdefault(size, {}), tuple(ids[k : k + size])
                table[window_ids] = table[window_ids] | own if window_ids in table else own
        self.tables = [WuManber(p, len(self.number) + 1) for _, p in sorted(by_length.items())]
        self.overlap = max((t.length for t in self.tables), default=1) - 1

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, hit spans of words, items) of a text."""
        get = self.number.get
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        n, kept = 0, []  # words before the slice; the last of them
        for part in words_of(text):
            ids = kept + [get(w, 0) for w in part]
            first = n - len(kept)
            for table in self.tables:
                for start, names in table.search(ids):
                    found.append((first + start, first + start + table.length))
                    items |= names
            n += len(part)
            kept = ids[max(0, len(ids) - self.overlap) :]
        return n, merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with n_words, hit_spans (start and end words) and hit_items."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.encode(F.col("text"), "UTF-8").alias("body")).where("body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    kept = docs.columns if keep is None else keep
    names = n_words, spans, hits = tuple(free_name(x, docs.columns) for x in ("n_words", "hit_spans", "hit_items"))
    source = docs.select(*dict.fromkeys([*kept, text]))

    def block(k: int, rows: DataFrame, columns: list[str]) -> DataFrame:
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)) == k)
        return _pass(rows, spark.sparkContext.broadcast([(r["item"], bytes(r["body"])) for r in part.collect()]), window, text, columns, names)

    if n_blocks == 1:
        return block(0, source, kept)
    key = free_name("row_key", [*docs.columns, *names])
    keyed = spill(source.withColumn(key, F.monotonically_increasing_id()), "decontam")
    found = block(0, keyed.select(key, text), [key])  # every row, for its words
    for k in range(1, n_blocks):
        found = found.unionByName(block(k, keyed.select(key, text), [key]).where(F.size(spans) > 0))
    both = found.groupBy(key).agg(F.max(n_words).alias(n_words), F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(hits)))).alias(hits))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            united = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in row])] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(united, _SPANS), batch.column(3)], names=batch.schema.names)

    return keyed.join(both.mapInArrow(unite, both.schema), key).select(*kept, *names)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, held, window: int, text: str, kept: list[str], names: tuple[str, str, str]) -> DataFrame:
    """One block's search. Only texts go to Python; words, spans and items come back."""
    tables = uuid.uuid4().hex

    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if tables not in _TABLES:  # a worker that runs many tasks makes them once
            _TABLES.clear()
            _TABLES[tables] = Matcher(held.value, window)
        matcher = _TABLES[tables]
        for column in columns:
            offsets, data = text_buffers(column)
            rows = [matcher.scan(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPANS),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                ],
                names=["n", "spans", "items"],
            )

    found = F.arrow_udf(search, "n long, spans array<struct<start:long,end:long>>, items array<string>", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    own = free_name("found", [*docs.columns, *names])
    return docs.withColumn(own, found(F.col(text).cast("string"))).select(*kept, *[F.col(own)[f].alias(c) for f, c in zip(("n", "spans", "items"), names, strict=True)])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The documents without any window of a benchmark item, with their own columns."""
    found = scan(docs, benchmark, window, text)
    return found.where(F.size(found.columns[-2]) == 0).select(*docs.columns)
