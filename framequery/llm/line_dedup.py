"""Remove boilerplate lines that spread over many sites.

1. Lines are hashed (two independent 64-bit hashes) and grouped with fixed-width
   aggregates. A line whose smallest and largest site hash agree was seen on one site
   only and cannot be boilerplate; that test is exact and drops nearly all lines.
2. The others get a HyperLogLog sketch of their sites, built per (line, salt) and
   merged per line by aggregation, so a line found in a third of all rows is never
   gathered in one task.
3. Lines whose estimate is near the threshold get an exact distinct count; the rest
   are decided by the sketch.
4. Documents lose their boilerplate lines; each line may stay in one document.

Lines are compared after trimming blanks; lines with fewer than ``min_chars``
characters are never removed. Defined cases: null text stays null; a null site counts
as a site of its own; repeated rows count once per site; a text whose lines all go
becomes empty; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut, free_name

#: Boilerplate lines become one hash set in the plan up to so many (about 1 MB), else they are joined by shuffle.
BROADCAST_LINES = 10_000


def normal(line: Column) -> Column:
    return F.trim(line)


def line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def boilerplate_lines(docs: DataFrame, min_sites: int, min_chars: int = 1, lg_k: int = 12, salts: int = 16, site: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Lines seen on at least ``min_sites`` distinct sites: h1, h2, n_sites, keeper (smallest id)."""
    site_key = F.when(F.col(site).isNull(), F.lit(-1)).otherwise(F.xxhash64(F.col(site).cast("string"))).alias("site")
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), site_key, F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.withColumn("line", normal(F.col("line"))).where(F.length("line") >= min_chars)
    seen = lines.select("doc", "site", *line_hashes(F.col("line")))
    spread = cut(
        seen.groupBy("h1", "h2")
        .agg(F.min("site").alias("low"), F.max("site").alias("high"), F.min("doc").alias("keeper"))
        .where("low <> high")
        .select("h1", "h2", "keeper")
    )
    candidates = seen.join(_bounded(spread.select("h1", "h2")), ["h1", "h2"], "left_semi")
    sketched = (
        candidates.groupBy("h1", "h2", F.pmod("site", F.lit(salts)).alias("salt"))
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("estimate"))
    )
    # Three standard errors of the sketch, and never less than one site, either way.
    band = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << lg_k) * min_sites))
    sketched = cut(sketched.where(F.col("estimate") >= min_sites - band))
    sure = sketched.where(F.col("estimate") > min_sites + band)
    near = sketched.where(F.col("estimate") <= min_sites + band).select("h1", "h2")
    exact = (
        candidates.join(_bounded(near), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.sum("one").alias("n_sites"))
        .where(F.col("n_sites") >= min_sites)
    )
    found = sure.select("h1", "h2", F.col("estimate").alias("n_sites")).unionByName(exact)
    return cut(found.join(spread, ["h1", "h2"]))


def _bounded(hashes: DataFrame) -> DataFrame:
    """Broadcast hint only where a count shows the table to be small."""
    return F.broadcast(hashes) if hashes.count() <= 20 * BROADCAST_LINES else hashes


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, min_chars: int = 1, keep_first: bool = True, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``; adds ``n_lines`` and ``n_removed`` at the end.

    These two take a suffix where a column of ``docs`` has their name.

    With ``keep_first`` a line stays in the document of the smallest id that has it, so
    that groups of copies spread over many sites keep one whole member. Up to
    BROADCAST_LINES boilerplate lines become one hash set inside the scan's projection
    and the texts never move; beyond, lines are joined by shuffle.
    """
    bad = boilerplate_lines(docs, min_sites, min_chars, site=site, text=text, doc_id=doc_id)
    keys = bad.select(_key(F.col("h1"), F.col("h2")).alias("k"), F.concat_ws("@", _key(F.col("h1"), F.col("h2")), F.col("keeper").cast("string")).alias("at"))
    held = keys.limit(BROADCAST_LINES + 1).collect()
    lines = F.split(F.col(text), "\n")
    if len(held) <= BROADCAST_LINES:
        line_key = lambda x: _key(*line_hashes(normal(x)))
        drop = lambda x: (F.length(normal(x)) >= min_chars) & line_key(x).isin([r["k"] for r in held])
        if keep_first:
            at_home = lambda x: F.concat_ws("@", line_key(x), F.col(doc_id).cast("string")).isin([r["at"] for r in held])
            kept = F.filter(lines, lambda x: ~(drop(x) & ~at_home(x)))
        else:
            kept = F.filter(lines, lambda x: ~drop(x))
        new = docs.select("*", kept.alias(free_name("_kept", docs.columns))) if held else docs.select("*", lines.alias(free_name("_kept", docs.columns)))
    else:
        new = _kept_by_join(docs, bad, min_chars, keep_first, text, doc_id)
    kept = F.col(new.columns[-1])
    n_lines = F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0))
    n_kept = F.coalesce(F.size(kept), F.lit(0))
    return new.select(
        *[F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in docs.columns],
        F.greatest(n_lines, F.lit(0)).cast("long").alias(free_name("n_lines", docs.columns)),
        F.greatest(n_lines - n_kept, F.lit(0)).cast("long").alias(free_name("n_removed", docs.columns)),
    )


def _key(h1: Column, h2: Column) -> Column:
    return F.concat_ws(":", F.hex(h1), F.hex(h2))


def _kept_by_join(docs: DataFrame, bad: DataFrame, min_chars: int, keep_first: bool, text: str, doc_id: str) -> DataFrame:
    """As the hash set does it, for any number of boilerplate lines: positions to drop
    are found by a join on the line hash, gathered per row, and joined to the texts."""
    row, doc, pos, line, drops, kept, h1, h2, home = (free_name(x, docs.columns) for x in ("_row", "_doc", "_pos", "_line", "_drops", "_kept", "_h1", "_h2", "_home"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    lines = numbered.select(row, F.col(doc_id).alias(doc), F.posexplode(F.split(F.col(text), "\n")).alias(pos, line))
    hashes = [h.alias(name) for h, name in zip(line_hashes(normal(F.col(line))), (h1, h2), strict=True)]
    lines = lines.where(F.length(normal(F.col(line))) >= min_chars).select(row, doc, pos, *hashes)
    hit = lines.join(bad.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("keeper").alias(home)), [h1, h2])
    if keep_first:
        hit = hit.where(~F.col(doc).eqNullSafe(F.col(home)))
    gone = hit.groupBy(row).agg(F.collect_set(pos).alias(drops))
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.coalesce(F.array_contains(drops, i), F.lit(False)))
    return numbered.join(gone, row, "left").select(*docs.columns, left.alias(kept))
