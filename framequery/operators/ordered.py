"""Places, running values and recent rows of ordered series of any length.

A window over a whole series puts it in one task. Here rows are range-partitioned by
key and order, numbered inside their partition, and moved up by the counts of the
partitions before, a table with a row per key and partition. Running values and frames
of recent rows then work on blocks of BLOCK places, which hash to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut, free_name, is_scan

#: Places of one key that one task works on.
BLOCK = 1 << 16


def numbered(df: DataFrame, keys: list[str], order: list[Column], place: str = "n", total: str | None = None) -> DataFrame:
    """``df`` with the 0-based ``place`` of each row in its key's order and, if named, the key's ``total`` rows.

    Null keys form a group; rows that tie in ``order`` are numbered in any order. The bounds of the ranges are
    sampled from ``df``, which is materialised first where it is more than a scan, so that it runs once.
    """
    df = df if is_scan(df) else cut(df)
    at, part, first, moved = (free_name(x, df.columns) for x in ("_at", "_part", "_first", "_moved"))
    ours = [free_name(f"_key{i}", df.columns) for i in range(len(keys))]
    by = [F.col(k) for k in keys] + order
    low = F.lit((1 << 33) - 1)
    sorted_rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    sorted_rows = sorted_rows.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(low)})
    counts = sorted_rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, ours, strict=True)], F.col(part).alias("part")).agg(F.min(at).alias(first), F.count("*").alias("rows"))
    own = Window.partitionBy(*ours) if ours else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*ours, F.col("part").alias("_p"), (before - F.col(first)).alias(moved), F.sum("rows").over(own).alias("_all"))
    same = F.col(part) == F.col("_p")
    for k, o in zip(keys, ours, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    joined = sorted_rows.join(counts, same)
    extra = [] if total is None else [F.col("_all").alias(total)]
    return joined.select(*df.columns, (F.col(at) + F.col(moved)).alias(place), *extra)


def running(df: DataFrame, keys: list[str], place: str, values: dict[str, Column], combine: dict[str, str], before: bool = False) -> DataFrame:
    """``df`` with running values by ``place``: each of ``values`` under its name, combined by sum, product, max or min.

    With ``before`` a row's own value is left out, and the first row of a key has null.
    """
    two = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "product": lambda a, b: F.coalesce(a * b, a, b), "max": F.greatest, "min": F.least}
    block, earlier = free_name("_block", df.columns), {name: free_name(f"_before_{name}", df.columns) for name in values}
    ours = [free_name(f"_key{i}", df.columns) for i in range(len(keys))]
    blocked = df.withColumn(block, F.floor(F.col(place) / BLOCK))
    inside = Window.partitionBy(*keys, block).orderBy(place).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = blocked.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, ours, strict=True)], F.col(block).alias("_b")).agg(*[getattr(F, combine[n])(v).alias(n) for n, v in values.items()])
    up_to = (Window.partitionBy(*ours) if ours else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*ours, "_b", *[getattr(F, combine[n])(n).over(up_to).alias(earlier[n]) for n in values])
    local = blocked.select("*", *[getattr(F, combine[n])(v).over(inside).alias(n) for n, v in values.items()])
    same = F.col(block) == F.col("_b")
    for k, o in zip(keys, ours, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return local.join(totals, same).select(*df.columns, *[two[combine[n]](F.col(earlier[n]), F.col(n)).alias(n) for n in values])


def recent(df: DataFrame, keys: list[str], place: str, size: int, values: dict[str, object]) -> DataFrame:
    """``df`` with each of ``values`` (window -> Column) over the last ``size`` rows, the row itself included.

    The last size - 1 rows of a block go to the next one as well, where they only serve as context.
    """
    if size > BLOCK:
        raise ValueError("a frame must fit in a block")
    block, context = (free_name(x, df.columns) for x in ("_block", "_context"))
    own = df.select("*", F.floor(F.col(place) / BLOCK).alias(block), F.lit(False).alias(context))
    tail = own.where(F.col(place) % BLOCK > BLOCK - size).withColumns({block: F.col(block) + 1, context: F.lit(True)})
    w = Window.partitionBy(*keys, block).orderBy(place).rowsBetween(1 - size, 0)
    out = own.unionByName(tail).select("*", *[v(w).alias(name) for name, v in values.items()])
    return out.where(~F.col(context)).drop(block, context)
