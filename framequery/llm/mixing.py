"""Mix sources to target weights.

Sizes are summed per source (partial aggregation on the map side, so a hot source
costs one row per task), targets are found on that small table, and every document
is then emitted floor(rate) times plus one Bernoulli copy whose probability is the
fraction of the rate, drawn from a hash of the document's id and a seed. Nothing
but DataFrame expressions runs.

Defined cases: null text has size 0; a null source is a source of its own and comes
last; a source without words has target 0 and none of its documents is emitted; a
null doc_id is hashed as the text ``null``; repeated rows are separate documents
that draw the same number; an empty table gives an empty mix; other columns pass
through, and helper columns avoid clashing names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut, free_name

WORDS = r"[^\x20\x09-\x0D]+"
#: Up to so many sources, the table of rates is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Number of whitespace-separated words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_sizes(sized: DataFrame, source: str, size: str) -> DataFrame:
    return sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: sources in code point order, null last, take the cycle in turn.

    The rank is made without a single-task sort: a range-partitioned sort, a count
    per partition, and the running sum of those counts (one row per partition).
    """
    ordered = cut(
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("*", F.monotonically_increasing_id().alias("_at"))
    ).select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition, so this window is small at any size
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    turn = F.pmod(F.col("_before") + F.col("_in"), F.lit(len(cycle)))
    weight = F.element_at(F.array(*map(F.lit, cycle)), (turn + 1).cast("int"))
    return ordered.join(before, "_part").select("source", "source_size", weight.cast("long").alias("weight"))


def targets(weighted: DataFrame, max_rate: int = 3, share: float = 1.0) -> DataFrame:
    """Adds ``target``: ``share`` of all words split by weight, at most ``max_rate`` x size.

    What a capped source leaves over is shared again by weight among the others until
    no target is above its cap. Each round is one aggregate that returns one row; a
    source once capped stays capped, so the rounds end.
    """
    weighted = cut(weighted)
    cap = F.col("source_size") * max_rate
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    budget = total if share == 1.0 else total * share
    level, capped = None, None
    while True:
        open_ = F.lit(True) if level is None else cap > F.col("weight") * F.lit(level)
        row = weighted.agg(
            F.sum(F.when(open_, F.col("weight"))).alias("w"),
            F.sum(F.when(~open_, cap)).alias("capped"),
            F.count(F.when(~open_, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        capped = row["n"]
        level = float(budget - (row["capped"] or 0)) / float(row["w"])
    level = level or 0.0
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return weighted.withColumn("target", target)


def plan(
    docs: DataFrame,
    cycle: tuple[int, ...] = (5, 2, 1),
    max_rate: int = 3,
    seed: str = "mix-1",
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Documents with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_rate`` and ``mix_copies``.

    These five come last; each takes a suffix where a column of the documents has its name.
    """
    added = [free_name(x, docs.columns) for x in ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")]
    size, source_size, target, rate, copies = added
    own = free_name("mix_source", [*docs.columns, *added])
    sized = docs.withColumn(size, size_of(F.col(text)))
    rated = cut(targets(cyclic_weights(source_sizes(sized.select(source, size), source, size), cycle), max_rate))
    rates = rated.select(
        F.col("source").alias(own),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
        F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias(rate),
    )
    if rated.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, F.col(source).eqNullSafe(F.col(own))).drop(own)
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    taken = whole + F.when(draw < F.col(rate) - whole, 1).otherwise(0)
    return joined.withColumn(copies, taken.cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as the plan says, numbered in ``mix_copy``."""
    planned = plan(docs, **options)
    copies = F.col(planned.columns[-1])
    copy = F.explode(F.sequence(F.lit(1), copies))
    return planned.where(copies > 0).select(*docs.columns, copy.alias(free_name("mix_copy", docs.columns)))
