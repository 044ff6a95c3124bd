"""Sampling of feature maps at places between their pixels, as a gather join.

A place has four taps, the pixels around it, each with its share. Maps of up to WHOLE pixels are a row each, and a place
adds up its taps where it meets its map. Of larger ones a tap is a row that meets its pixel by (map, y, x), so that nothing is a whole map in memory.
Shares and attention weights are multiplied before the sums, which every task adds up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import broadcast_small, free_name

#: Pixels of a map that may travel in one row.
WHOLE = 1 << 12


def as_pixels(maps: DataFrame, map_id: str, values: str, width: int) -> DataFrame:
    """(map, y, x, value) of maps that are arrays of ``width`` values a line."""
    each = maps.select(F.col(map_id).alias("map"), F.posexplode(values).alias("_at", "value"))
    return each.select("map", F.floor(F.col("_at") / width).cast("int").alias("y"), (F.col("_at") % width).cast("int").alias("x"), F.col("value").cast("double").alias("value"))


def taps(x: Column, y: Column, width: Column, height: Column, method: str = "bilinear") -> Column:
    """The taps (x, y, share) of a place in 0..1 of a map whose pixel centres lie at (i + 0.5) / size; none outside the map.

    ``discrete`` takes the one pixel int(place * size + 0.5), kept inside the map.
    """
    if method == "discrete":
        inside = lambda v, n: F.least(F.greatest((v * n + 0.5).cast("int"), F.lit(0)), n - 1).cast("int")
        nearest = F.array(F.struct(inside(x, width).alias("x"), inside(y, height).alias("y"), F.lit(1.0).alias("share")))
        return F.when(x.isNotNull() & y.isNotNull(), nearest)
    px, py = x * width - 0.5, y * height - 0.5
    left, top = F.floor(px), F.floor(py)
    part = lambda at, low, d: F.lit(1.0) - (at - low) if d == 0 else at - low
    four = [F.struct((left + dx).cast("int").alias("x"), (top + dy).cast("int").alias("y"), (part(px, left, dx) * part(py, top, dy)).alias("share")) for dy in (0, 1) for dx in (0, 1)]
    return F.filter(F.array(*four), lambda t: (t["x"] >= 0) & (t["x"] < width) & (t["y"] >= 0) & (t["y"] < height))


def sampled(places: DataFrame, pixels: DataFrame, keys: list[str], width: int, height: int, method: str = "bilinear", weight: str | None = None) -> DataFrame:
    """``keys`` and ``value``: the sum over the key's places (map, x, y) of weight x sampled value; 0 outside and for maps or pixels that lack.

    Null places and weights add nothing; ``weight`` None counts each place once. A pixel that comes twice counts twice.
    """
    names = [free_name(n, keys) for n in ("_map", "_tap", "_weight")]
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    if width * height <= WHOLE:
        return _of_whole_maps(places, pixels, keys, width, height, method, w)
    own = places.select(*keys, F.col("map").alias(names[0]), taps(F.col("x"), F.col("y"), F.lit(width), F.lit(height), method).alias(names[1]), w.alias(names[2]))
    each = own.select(*keys, names[0], F.explode_outer(names[1]).alias(names[1]), names[2])
    each = each.select(*keys, names[0], F.col(f"{names[1]}.x").alias("_x"), F.col(f"{names[1]}.y").alias("_y"), (F.col(f"{names[1]}.share") * F.col(names[2])).alias(names[2]))
    right = pixels.select(F.col("map").alias("_pm"), F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("value").alias("_value"))
    joined = each.join(right, (F.col(names[0]) == F.col("_pm")) & (F.col("_y") == F.col("_py")) & (F.col("_x") == F.col("_px")), "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.sum(F.col(names[2]) * F.col("_value")), F.lit(0.0)).alias(free_name("value", keys)))


def _of_whole_maps(places: DataFrame, pixels: DataFrame, keys: list[str], width: int, height: int, method: str, weight: Column) -> DataFrame:
    """``sampled`` for small maps, each of them a row: a place stays one row and adds its taps up before the sums."""
    mine, pixel, value, add = (free_name(n, [*places.columns, "_pm", "_pixels"]) for n in ("_map", "_pixel", "_value", "_add"))
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    each = pixels.where(inside).groupBy(F.col("map").alias("_pm"), (F.col("y") * width + F.col("x")).cast("int").alias(pixel)).agg(F.sum(F.col("value").cast("double")).alias(value))
    maps = each.groupBy("_pm").agg(F.map_from_entries(F.collect_list(F.struct(pixel, value))).alias("_found"))
    line = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: F.coalesce(F.try_element_at("_found", k), F.lit(0.0)))
    maps = broadcast_small(maps.select("_pm", line.alias("_pixels")), max(1, (1 << 22) // (width * height)))
    of = lambda t: t["share"] * F.get("_pixels", t["y"] * width + t["x"])
    own = taps(F.col("x"), F.col("y"), F.lit(width), F.lit(height), method)
    joined = places.withColumn(mine, F.col("map")).withColumn(add, own).join(maps, F.col(mine) == F.col("_pm"), "left")
    found = weight * F.aggregate(F.transform(add, of), F.lit(0.0), lambda a, b: a + b)
    return joined.select(*keys, found.alias(add)).groupBy(*keys).agg(F.coalesce(F.sum(add), F.lit(0.0)).alias(free_name("value", keys)))
