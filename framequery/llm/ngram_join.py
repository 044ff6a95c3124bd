"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

A document's set is its distinct word shingles. Two documents link when
100 * |A & B| >= percent * |A | B|. Every link's two ends are in one component, and
components hold nothing else. Shingles are compared by 64-bit hashes, equal sets by 128.

1. Documents with equal sets form a class; classes are joined.
2. Shingle frequencies over all documents go into a table of counters, one for some ten
   shingles as long as 2^25 counters are enough for that, which gives the global rare-first
   order: (frequency level, hash).
3. Each class sends the rarest n - ceil(t n) + 1 shingles of its set, each with its
   position and a signature of the suffix after it (counts over 8 ranges of the hash).
   Shingles met in one class only are dropped. Where a bucket turns out to be large all the
   same (on large inputs many shingles share a counter), its shingle is counted among the
   most frequent ones, and prefixes are taken once more. Shingles far more frequent than the mean
   are dealt into parts, so no task sorts a bucket that grows with a third of all rows.
4. Within a bucket every member meets the one of smallest position, which has the fewest
   shingles of its own: in a group of near copies that is the text nearest to all. A pair
   is made only where it passes the length, positional and suffix filters; pairs are
   distinct over all buckets and verified once on whole texts.
5. Buckets that still hold several components are open. The component with most rows in
   a bucket is its major one, and only the other rows look for partners: first with a
   member of the major component, as long as that halves the work that is left; then
   with all rows of other components that the three filters let pass.

Words: A-Z lowered, runs of anything but blank and U+0009-U+000D. A text with fewer
words than a shingle is one shingle; without words, or null, it is linked with nothing.
Defined cases: repeated rows are exact copies; a null doc_id takes part, and names a
component only where no other id does; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut, free_name, spill
from .components import components, contracted
from .textbytes import U64, WordHasher, mix64, row_groups, text_buffers

_WORD = bytes(b for b in range(256) if b not in b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of text for a counter of the frequency table, the table's least and largest size (as powers of two; 32 MB
#: are broadcast at most), and how many counters travel in one row.
SLOT_BYTES, LEAST_BITS, MOST_BITS, CHUNK = 64, 16, 25, 1 << 16
#: Rows of a part of a frequent shingle's bucket, and how often a counter has to exceed the mean for that.
BUCKET, FREQUENT = 1 << 16, 64
#: Bound on the shingles (8 bytes each) that are counted as frequent by the size of their buckets.
COMMON = 1 << 20
#: Pairs left per open row up to which no further stars are tried.
STARS_ABOVE = 64
#: Members of a star that meet their pivot in one block.
BLOCK = 128
#: Rows up to which the side that asks for texts is broadcast (about 50 bytes each); a shuffle join beyond.
WANTED = 400_000


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int, seed: int):
        self.k = words
        self.hasher = WordHasher(_WORD, True, seed)
        rng = np.random.Generator(np.random.PCG64(99 + seed))
        self.factor = rng.integers(0, 1 << 63, words, dtype=U64) * U64(2) + U64(1)

    def sets(self, offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        h, bounds = self.hasher.words(offsets, data)
        k, n = self.k, max(0, len(h) - self.k + 1)
        rolled = np.zeros(n, U64)
        for j in range(k):
            rolled += h[j : j + n] * self.factor[j]
        rolled = mix64(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                out.append(mix64(np.array([(h[a:b] * self.factor[: b - a]).sum(dtype=U64) + U64(b - a)], U64)))
            else:
                out.append(h[:0])
        return out


def identity(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """(class, check hash) of a set; the class has the given number of bits."""
    one = int(mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)) >> (64 - bits)
    two = int(mix64(s + U64(0x14057B7EF767814F)).sum(dtype=U64))
    return one - (1 << 64) if one >= 1 << 63 else one, two - (1 << 64) if two >= 1 << 63 else two


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def slot_bits(source: DataFrame) -> int:
    """The size of the frequency table, from that of the texts."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, (int(size) // SLOT_BYTES).bit_length()))


def _packed(counts: np.ndarray) -> bytes:
    """A chunk of counters: a byte for each, then places and counts of those of 255 and more."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.uint16).tobytes() + counts[large].astype(np.uint32).tobytes()


def _unpacked(content: bytes) -> np.ndarray:
    if len(content) == 8 * CHUNK:
        return np.frombuffer(content, np.int64)
    counts = np.frombuffer(content, np.uint8, CHUNK).astype(np.int64)
    n = (len(content) - CHUNK) // 6
    counts[np.frombuffer(content, np.uint16, n, CHUNK)] = np.frombuffer(content[CHUNK + 2 * n :], np.uint32)
    return counts


def _profile(docs: DataFrame, k: int, seed: int, bits: int, slots: int) -> DataFrame:
    """A row per document (doc_id, mark, cls, alt, n) and rows of 2^slots counters (part, chunk, counts)."""
    names = ["doc_id", "mark", "cls", "alt", "n", "part", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, counts = Shingler(k, seed), np.zeros(1 << slots, np.uint32)
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            for a, b in row_groups(offsets):
                sets = shingler.sets(offsets[a : b + 1], data)
                own, n = np.unique((np.concatenate([np.zeros(0, U64), *sets]) >> U64(64 - slots)).astype(np.int64), return_counts=True)
                counts[own] += n.astype(np.uint32)
                cls, alt = zip(*(identity(s, bits) for s in sets), strict=True)
                yield pack(b - a, doc_id=batch.column(0).slice(a, b - a), mark=batch.column(1).slice(a, b - a), cls=pa.array(cls, pa.int64()), alt=pa.array(alt, pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()))
        for chunk, row in enumerate(counts.reshape(-1, CHUNK)):
            if row.any():
                yield pack(1, part=pa.array([TaskContext.get().partitionId()], pa.int64()), chunk=pa.array([chunk], pa.int64()), counts=pa.array([_packed(row)], pa.binary()))

    def pack(rows: int, **known: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known.get(c, pa.nulls(rows, pa.binary() if c == "counts" else pa.int64())) for c in names], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'counts' else 'long'}" for c in names))


def _levels(counters: DataFrame, slots: int) -> np.ndarray:
    """The frequency table: a level (about 4 log2 of the count) per counter, a byte each.

    Partial tables are added in a tree of groups of at most 32, never all in one task.
    """
    width = counters.agg(F.max("part")).first()[0]
    level = counters.select("part", "chunk", "counts")

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for x in frame["counts"]:
            total += _unpacked(x)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // 32], "chunk": [int(frame["chunk"].iloc[0])], "counts": [total.tobytes()]})

    out = np.zeros(1 << slots, np.uint8)
    if width is None:
        return out
    while True:
        level = level.groupBy("chunk", F.floor(F.col("part") / 32)).applyInPandas(add, "part long, chunk long, counts binary")
        width //= 32
        if not width:
            break
    log = lambda frames: (pd.DataFrame({"chunk": f["chunk"], "counts": [np.minimum(255, np.log2(1 + np.frombuffer(x, np.int64)) * 4).astype(np.uint8).tobytes() for x in f["counts"]]}) for f in frames)
    for r in level.mapInPandas(log, "chunk long, counts binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return out


def _suffixes(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each shingle of the prefix the counts of those after it over 8 ranges of the hash, 255 at most, in 8 bytes."""
    part = (s & U64(7)).astype(np.int64)
    seen = np.zeros((len(first), 8), np.int64)
    seen[np.arange(len(first)), part[first]] = 1
    left = np.bincount(part, minlength=8) - np.cumsum(seen, axis=0)
    return np.minimum(left, 255).astype(np.uint8).view(np.int64).ravel()


def _postings(source: DataFrame, levels: np.ndarray, common: np.ndarray, k: int, percent: int, seed: int, bits: int) -> DataFrame:
    """(token, part, cls, n, pos, suffix) of the rarest shingles, once per class and task.

    ``common``: sorted shingles that come after all others, whatever their counter says.
    """
    counts = np.exp2(np.arange(256) / 4)
    mean = max(1.0, float(counts[levels[levels > 0]].mean())) if levels.any() else 1.0
    parts = np.where(counts > max(BUCKET, FREQUENT * mean), np.ceil(counts / BUCKET), 1)  # by level
    parts[255] = 64  # the common ones, whose buckets are known to be large
    held = source.sparkSession.sparkContext.broadcast((np.minimum(levels, 254), common, np.minimum(parts, 1 << 30).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (level, last, parts), sent = Shingler(k, seed), held.value, set()
        slots = len(level).bit_length() - 1
        for batch in batches:
            offsets, data = text_buffers(batch.column(0))
            for a, b in row_groups(offsets):
                tokens, ranks, classes, sizes, places, suffixes = [], [], [], [], [], []
                for s in shingler.sets(offsets[a : b + 1], data):
                    if not len(s) or (cls := identity(s, bits)[0]) in sent:
                        continue
                    sent.add(cls)
                    order = level[(s >> U64(64 - slots)).astype(np.int64)]
                    if len(last):
                        order[last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s] = 255
                    rank = (order.astype(U64) << U64(56)) | (s >> U64(8))
                    p = prefix_length(len(s), percent)
                    first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    first = first[np.lexsort((s[first], rank[first]))]
                    tokens.append(s[first].view(np.int64))
                    ranks.append(rank[first])
                    classes.append(np.full(p, cls, np.int64))
                    sizes.append(np.full(p, len(s), np.int32))
                    places.append(np.arange(1, p + 1, dtype=np.int32))
                    suffixes.append(_suffixes(s, first))
                if tokens:
                    c = np.concatenate(classes)
                    many = parts[(np.concatenate(ranks) >> U64(56)).astype(np.int64)]
                    part = np.where(many > 1, 1 + (mix64(c.view(U64)) >> U64(33)).astype(np.int64) % many, 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(tokens), part, c, np.concatenate(sizes), np.concatenate(places), np.concatenate(suffixes))], names=["token", "part", "cls", "n", "pos", "suffix"])

    return source.select("text").mapInArrow(run, "token long, part int, cls long, n int, pos int, suffix long")


def _near(n, pos, suffix, m, qos, suffix2, percent: int) -> np.ndarray:
    """Length, positional and suffix filters for pairs of postings of one token."""
    need = -(-(n + m) * percent // (100 + percent))
    fits = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - pos, m - qos) + 1 >= need)
    ends = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).astype(np.int64) for x in (suffix, suffix2)]
    return fits & (np.abs(ends[0] - ends[1]).sum(1) <= n + m - 2 * need - (pos - 1) - (qos - 1))


def _passes(left: str, right: str, percent: int) -> Column:
    """The same filters on columns <left>n, <left>pos, <left>suffix and those of ``right``."""
    n, pos, suffix, m, qos, suffix2 = (F.col(side + c) for side in (left, right) for c in ("n", "pos", "suffix"))
    need = F.ceil((n + m) * percent / F.lit(float(100 + percent)) - 1e-9)
    byte = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte(suffix, i) - byte(suffix2, i)) for i in range(8)), F.lit(0))
    fits = (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - pos, m - qos) + 1 >= need)
    return fits & (apart <= n + m - 2 * need - (pos - 1) - (qos - 1))


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of tokens met in several classes, each with its bucket's first class and whether the filters pass them.

    The sorted partition is streamed: a bucket of any size is never held. Rows of one
    class in one bucket (sent by several tasks) are neighbours and become one.
    """
    names = ["token", "part", "cls", "n", "pos", "suffix"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # the row that opened the bucket at hand; the last row seen
        sent = False  # whether the opening row has gone out
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(rows[0]):
                continue
            lead = 0
            if first is not None:  # the opening row goes first again, to be met by the rest of its bucket
                lead = 1 if first == last else 2
                rows = [np.concatenate([np.array([f, x][:lead], r.dtype), r]) for f, x, r in zip(first, last, rows, strict=True)]
            token, part, cls = rows[:3]
            same = np.zeros(len(token), bool)
            same[1:] = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
            opens = np.flatnonzero(~same)
            head = np.repeat(opens, np.diff(np.append(opens, len(token))))
            again = same.copy()
            again[1:] &= cls[1:] == cls[:-1]
            other = same & (cls != cls[head]) & ~again
            keep = other.copy()
            keep[head[other]] = True  # opening rows with company
            keep |= (part > 0) & ~again  # parts of one token meet later
            had = keep[head[-1]] or (sent and head[-1] == 0)
            if lead:
                if sent:
                    keep[0] = False
                if lead == 2:
                    keep[1] = False  # went out with its batch
            first, last, sent = tuple(r[head[-1]] for r in rows), tuple(r[-1] for r in rows), bool(had)
            at = np.flatnonzero(keep)
            if len(at):
                h = head[at]
                n, pos, suffix = (r.astype(np.int64) for r in rows[3:])
                near = _near(n[at], pos[at], suffix[at], n[h], pos[h], suffix[h], percent) & (cls[at] != cls[h])
                yield pa.RecordBatch.from_arrays([*[pa.array(r[at], t) for r, t in zip(rows, kinds, strict=True)], pa.array(cls[h]), pa.array(near)], names=[*names, "pivot", "near"])

    dealt = postings.repartition("token", "part").sortWithinPartitions("token", "part", "pos", "cls").select(*names)
    return dealt.mapInArrow(run, "token long, part int, cls long, n int, pos int, suffix long, pivot long, near boolean")


def _verify(pairs: DataFrame, classes: DataFrame, source: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """(ca, cb) of the linked ones of distinct pairs (a, b, ca, cb), met on whole texts.

    Blocks are stars: a pivot b and at most about BLOCK of its partners. A worker holds
    the pivot's set and streams the partners.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    keyed = cut(pairs.join(parts, "b").select("a", "b", "ca", "cb", F.pmod(F.xxhash64("a"), "parts").alias("block")))
    wanted = keyed.select(F.col("a").alias("cls"), "b", "block", "ca", "cb").unionByName(
        keyed.select(F.col("b").alias("cls"), "b", "block", F.lit(None).cast("long").alias("ca"), F.lit(None).cast("long").alias("cb")).distinct()
    )
    wanted = cut(wanted.join(classes.select("cls", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")), "cls").drop("cls"))
    if wanted.count() <= WANTED:
        wanted = F.broadcast(wanted)
    sent = source.join(wanted, source["doc_id"].eqNullSafe(wanted["_id"]) & (source["mark"] == wanted["_mark"])).select("b", "block", "ca", "cb", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, pivot = Shingler(k, seed), None
        for batch in batches:
            offsets, data = text_buffers(batch.column(4))
            ca, cb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in row_groups(offsets):
                found = []
                for i, s in enumerate(shingler.sets(offsets[lo : hi + 1], data), lo):
                    if ca[i] is None:  # sorted before its partners
                        pivot = s
                        continue
                    both = np.sort(np.concatenate([pivot, s]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(pivot) + len(s) - common):
                        found.append((ca[i], cb[i]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    dealt = sent.repartition("b", "block").sortWithinPartitions("b", "block", F.col("ca").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _open(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with ``component`` and the bucket's ``major`` one."""
    labelled = shared.select("token", "cls", "n", "pos", "suffix").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    per_group = labelled.groupBy("token", "component").agg(F.count("*").alias("m"))
    buckets = per_group.groupBy("token").agg(F.count("*").alias("c"), F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m")).where("c > 1")
    return cut(labelled.join(buckets.select("token", F.col("top.component").alias("major"), (F.col("m") - F.col("top.m")).alias("minor_rows"), F.col("m").alias("bucket_rows")), "token"))


def link_classes(docs: DataFrame, words: int = 5, percent: int = 80, seed: int = 0, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has doc_id, cls, n of every document; groups has cls, class_id and component (smallest doc_ids)."""
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))
    slots = slot_bits(source)
    while True:
        profile = spill(_profile(source, words, seed, bits, slots), "profile")
        rows = profile.where("part is null").select("doc_id", "mark", "cls", "alt", "n")
        # a class stands for one row of it, told by id and text; ids of null come last
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
        classes = cut(rows.where("n > 0").groupBy("cls").agg(first.alias("first"), F.min("alt").alias("low"), F.max("alt").alias("high")))
        if classes.where("low <> high").limit(1).count() == 0:
            break
        seed, bits = seed + 1, 64  # two sets met in one class id: hash anew
    levels = _levels(profile.where("part is not null"), slots)
    common = np.zeros(0, U64)
    for _ in range(2):
        shared = spill(_shared(_postings(source, levels, common, words, percent, seed, bits), percent), "postings")
        large = max(BUCKET, shared.count() // COMMON)
        sizes = shared.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > large).select("token")
        found = [r["token"] for r in sizes.collect()]  # at most COMMON of them
        if not found or len(common):
            break
        common = np.sort(np.array(found, np.int64).view(U64))

    verify = lambda pairs: _verify(pairs, classes, source, words, percent, seed)
    tried = cut(shared.where("near").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct())
    groups = components(verify(tried.withColumns({"ca": F.col("a"), "cb": F.col("b")})))
    left = None
    while True:
        open_ = _open(shared, groups)
        size = open_.agg(F.sum((F.col("component") != F.col("major")).cast("double") * F.col("bucket_rows")).alias("pairs"), F.count("*").alias("rows")).first()
        if not size["rows"]:
            break
        last = size["pairs"] <= STARS_ABOVE * size["rows"] or (left is not None and 2 * size["pairs"] > left)
        left = size["pairs"]
        minor = open_.where(F.col("component") != F.col("major"))
        met = open_ if last else _pivots(open_)
        x = met.select(F.col("token").alias("x_token"), *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "pos", "suffix", "component")])
        pairs = minor.join(x, (F.col("token") == F.col("x_token")) & (F.col("component") != F.col("x_component")) & _passes("", "x_", percent))
        # pairs of two minor rows come from both sides; stars keep their pivots as b
        ends = [F.col("cls"), F.col("x_cls"), F.col("component"), F.col("x_component")]
        turn = F.lit(last) & (F.col("cls") > F.col("x_cls"))
        picked = [F.when(turn, ends[i ^ 1]).otherwise(ends[i]).alias(name) for i, name in enumerate(("a", "b", "ca", "cb"))]
        pairs = pairs.select(*picked).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
        groups = contracted(groups, verify(pairs))
        if last:
            break
        tried = cut(tried.unionByName(pairs.select("a", "b")))
    return rows, _named(classes, groups)


def _pivots(open_: DataFrame) -> DataFrame:
    """One row of each bucket's major component: that of the smallest position."""
    first = F.min(F.struct("pos", "cls", "n", "suffix", "component"))
    best = open_.where(F.col("component") == F.col("major")).groupBy("token").agg(first.alias("x"))
    return best.select("token", *[F.col(f"x.{c}").alias(c) for c in ("cls", "n", "pos", "suffix", "component")])


def _named(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(cls, class_id, component): the smallest doc_id of each class, and of its component."""
    member = classes.select("cls", F.col("first.doc_id").alias("doc_id")).join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = member.groupBy("component").agg(F.min("doc_id").alias("first_id"))
    return cut(member.join(smallest, "component").select("cls", F.col("doc_id").alias("class_id"), F.col("first_id").alias("component")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, class_id (the smallest id of an equal set) and component_id."""
    rows, groups = link_classes(docs, words, percent)
    return rows.join(groups, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class_id",
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null ids last.

    Where ids are null or repeat, rows are told apart by a key written with them. Rows without
    any word are no copies; those that share id and text stay once, those of null ids all.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count() == 0:
        found = near_duplicates(docs, words, percent)
        gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    key = free_name("row_key", docs.columns)
    keyed = spill(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent)
    groups = found.select(F.col("doc_id").alias(key), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    ids = keyed.select(key, F.col("doc_id").alias("id"), F.xxhash64("text").alias("same"), F.xxhash64(*docs.columns).alias("turn"))
    wordless = F.when(F.col("group").isNull(), F.struct("id", "same", F.when(F.col("id").isNull(), F.col(key)).alias("own")))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "turn", F.col(key).alias("key")))
    kept = ids.join(groups, key).groupBy("group", wordless.alias("wordless")).agg(first.alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)
