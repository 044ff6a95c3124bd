"""Importance resampling towards a target distribution, with an exact distributed selection.

Two hashed bag-of-words models, of the corpus and of the target texts, give each bucket a
gain: the scaled logarithm of the ratio of its smoothed probabilities. The gains are an array
of one number a bucket, whose size the caller sets and no table changes; a document's weight is
the mean of the gains of its features, looked up in that array (words and their checksums are found
with NumPy in Arrow batches, since expressions took several times as long). Adding Gumbel noise drawn from
the id's hash turns "the k largest scores" into sampling without replacement by weight.

The k-th score is found by radix selection, with no sort: the key of a row (score
descending, id ascending, row number) is read as digits of 16 bits; each pass counts the rows
that share the digits found so far by their next digit, a table of at most 65,536 rows, and fixes
that digit. Digits that no two rows differ in are passed over, and a pass that leaves a whole
bucket to be taken is the last. Only the selected rows are then range-sorted and ranked.

Defined cases: null and empty texts have no features, weight 0 and, if texts of any length may be
drawn, take part like others; a null id is hashed as the text ``null`` and comes after all others in
ties; rows that repeat id and text have equal scores, and as many of them are drawn as places are left;
an empty corpus gives no rows, an empty target a model of nothing but smoothing; a fraction
that leaves less than one row draws none; other columns of the corpus are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..plans.runtime import cut, spill
from .textbytes import row_groups, text_buffers
from .wordspans import Words, pieces, space_after

#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII.
WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)])
#: Bytes of a long text that are worked on at once.
LONG = 1 << 22
#: Bits of a digit: a pass sends at most 2^16 counts to the driver.
DIGIT = 16


def feature_buckets(words: Words, texts: pa.Array, buckets: int, runs: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts (from, to): words of each text, buckets of all features, and the text of each.

    Where features are single words, a long text comes in pieces that end between words, one after the other.
    """
    offsets, data = text_buffers(texts)
    for row, end, own in _groups(words, offsets, data, runs):
        starts, ends = words.spans(own, data)
        text = np.searchsorted(own, starts, "right") - 1
        crc, found, whose = None, [], []
        for n in range(1, runs[1] + 1):
            m = len(starts) - n + 1
            if m <= 0:
                break
            crc = words.crc32(data, starts[n - 1 :], ends[n - 1 :], None if crc is None else space_after(crc[:m]))
            if n >= runs[0]:
                inside = text[:m] == text[n - 1 :]
                found.append((crc[inside] % np.uint32(buckets)).astype(np.int64))
                whose.append(text[:m][inside])
        gathered = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, whose)]
        yield row, end, np.bincount(text, minlength=end - row), *gathered


def _groups(words: Words, offsets: np.ndarray, data: np.ndarray, runs: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    for row, end in row_groups(offsets):
        if end == row + 1 and runs == (1, 1):
            for start, stop in pieces(data, int(offsets[row]), int(offsets[end]), ~words.is_word, LONG):
                yield row, end, np.array([start, stop])
        else:
            yield row, end, offsets[row : end + 1]


def bucket_counts(texts: DataFrame, text: str, buckets: int, runs: tuple[int, int]) -> DataFrame:
    """(bucket, n) over all texts; every task adds up its own buckets first and sends a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(WORD), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found, _ in feature_buckets(words, batch.column(0), buckets, runs):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    each = texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> list[int]:
    """The gain of each bucket, from tables of at most ``buckets`` rows."""
    corpus, target = cut(corpus), cut(target)
    total = [float(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) for t in (corpus, target)]
    each = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = each.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * F.lit(total[0] + buckets) / ((s + 1) * F.lit(total[1] + buckets))
    return [r[0] for r in both.select("bucket", F.floor(scale * F.log(ratio)).alias("gain")).sort("bucket").select("gain").collect()]


def floored(a: Column, b: Column) -> Column:
    """The floor of a / b for whole numbers, exactly; 0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a - F.pmod(a, F.nullif(b, F.lit(0))), b))


def weighted(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", runs: tuple[int, int] = (1, 1), seed: str = "2024", scale: int = 1000) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, in one pass."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(WORD)
        for batch in batches:
            figures = np.zeros((3, batch.num_rows), np.int64)
            for row, end, n_words, found, whose in feature_buckets(words, batch.column(1), len(table), runs):
                total = np.zeros(end - row, np.int64)
                np.add.at(total, whose, table[found])
                figures[:, row:end] += np.stack([n_words, np.bincount(whose, minlength=end - row), total])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, figures)], names=["doc_id", "n_words", "n_features", "total"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    made = own.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, total long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weight = floored(F.col("total"), F.col("n_features"))
    return made.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def _digits(key: Column, descending: bool = False) -> list[Column]:
    """A 64-bit whole number as digits of DIGIT bits, highest first, whose order is the number's; null comes last."""
    flipped = key.bitwiseXOR(F.lit(-(1 << 63)))
    flipped = F.bitwise_not(flipped) if descending else flipped
    mask = F.lit((1 << DIGIT) - 1)
    parts = [F.coalesce(F.shiftrightunsigned(flipped, at).bitwiseAND(mask).cast("int"), F.lit(0)) for at in range(64 - DIGIT, -1, -DIGIT)]
    return [key.isNull().cast("int"), *parts]


def below_kth(rows: DataFrame, keys: list[tuple[str, bool]], k: int) -> tuple[Column, int]:
    """The condition that holds for the ``k`` first rows of ``rows`` by ``keys`` (column, descending), and the passes it took.

    Keys are whole numbers of 64 bits and must tell all rows apart, or more than k may be taken. ``rows`` should be
    materialised: it is read once a pass, and only its key columns are.
    """
    digits = [d for name, descending in keys for d in _digits(F.col(name), descending)]
    if k <= 0:
        return F.lit(False), 0
    span = rows.agg(*[f(d).alias(f"{n}{i}") for i, d in enumerate(digits) for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("rows")).first()
    if k >= span["rows"]:
        return F.lit(True), 0
    same, taken, left, passes = F.lit(True), F.lit(False), k, 0
    for i, digit in enumerate(digits):
        if span[f"low{i}"] == span[f"high{i}"]:
            continue
        counts = rows.where(same).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()  # 65,536 rows at most
        passes += 1
        for found, n in sorted((r["digit"], r["n"]) for r in counts):
            if left <= n:
                break
            left -= n
        taken = taken | (same & (digit < found))
        same = same & (digit == found)
        if left == n:
            break
    return taken | same, passes


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    buckets: int = 10000,
    runs: tuple[int, int] = (1, 1),
    least_words: int = 20,
    seed: str = "2024",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents of ``least_words`` words or more, floor(percent * N / 100) are drawn.
    """
    gain = gains(*[bucket_counts(t, text, buckets, runs) for t in (docs, target)], buckets)
    scored = weighted(docs, gain, doc_id, text, runs, seed)
    kept = spill(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= least_words
    k = kept.where(enough).count() * percent // 100
    drawn, _ = below_kth(kept.where(enough), [("score", True), ("doc_id", False), ("row", False)], k)
    drawn = enough & drawn
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ordered.numbered(kept.where(drawn), [], order, "place").select(*columns, (F.col("place") + 1).alias("rank"))
    return ranked.unionByName(kept.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
