"""Training augmentations of ground truth, drawn by hashes: a run that is repeated draws the same.

Boxes are corners in pixels with the image's ``width`` and ``height``. The pixels themselves are
changed by whoever loads them, with the same parameters (columns of the result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import let
from ..plans.runtime import cut, free_name
from . import ordered


def draw(seed: int, name: str, *key: str) -> Column:
    """A number in [0, 1) of a key, for one purpose."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def flipped(truths: DataFrame, seed: int, image: str = "image_id", probability: float = 0.5) -> DataFrame:
    """Images mirrored left to right with a probability; adds ``flip``."""
    turn = draw(seed, "flip", image) < probability
    x1, x2 = F.col("width") - F.col("x2"), F.col("width") - F.col("x1")
    return truths.withColumns({"flip": turn, "x1": F.when(turn, x1).otherwise(F.col("x1")), "x2": F.when(turn, x2).otherwise(F.col("x2"))})


# The ranges of the photometric factors, and of the turn of the hue (in turns).
BRIGHTNESS, CONTRAST, SATURATION, HUE = (0.875, 1.125), (0.5, 1.5), (0.5, 1.5), (-0.05, 0.05)


def photometric(images: DataFrame, seed: int, image: str = "image_id", probability: float = 0.5) -> DataFrame:
    """Images with drawn ``brightness``, ``contrast``, ``saturation`` and ``hue``, each null (left alone) with 1 - probability,
    and ``contrast_first``: whether contrast comes before the colours or after them. ``pixels.distorted`` applies them."""

    def drawn(name: str, span: tuple[float, float]) -> Column:
        return F.when(draw(seed, f"{name}-use", image) < probability, span[0] + (span[1] - span[0]) * draw(seed, name, image))

    spans = {"brightness": BRIGHTNESS, "contrast": CONTRAST, "saturation": SATURATION, "hue": HUE}
    added = {name: drawn(name, span) for name, span in spans.items()}
    return images.withColumns({**added, "contrast_first": draw(seed, "contrast-first", image) < 0.5})


def zoomed_out(truths: DataFrame, seed: int, image: str = "image_id", probability: float = 0.5, most: float = 4.0) -> DataFrame:
    """Images put at a random place of a canvas 1 to ``most`` times as large; adds ``zoom``, ``left`` and ``top``."""
    zoom = F.when(draw(seed, "zoom", image) < probability, 1 + draw(seed, "ratio", image) * (most - 1)).otherwise(1.0)
    out = truths.withColumn("zoom", zoom)
    w, h = F.floor(F.col("width") * F.col("zoom")).cast("int"), F.floor(F.col("height") * F.col("zoom")).cast("int")
    out = out.withColumns({"left": F.floor(draw(seed, "left", image) * (w - F.col("width") + 1)).cast("int"), "top": F.floor(draw(seed, "top", image) * (h - F.col("height") + 1)).cast("int")})
    moved = {"x1": F.col("x1") + F.col("left"), "x2": F.col("x2") + F.col("left"), "y1": F.col("y1") + F.col("top"), "y2": F.col("y2") + F.col("top")}
    return out.withColumns({**moved, "width": w, "height": h})


def mosaic(truths: DataFrame, images: DataFrame, seed: int, side: int, image: str = "image_id") -> DataFrame:
    """Four images, each fitted into a quarter of a square of ``side`` pixels; the last one to three images are left alone.

    Images (a row each in ``images``) are taken in a seeded order, four at a time: ``mosaic`` and ``quarter`` say where one went.
    """
    placed = ordered.numbered(images.select(image), [], [draw(seed, "mosaic", image), F.col(image)], "_n", "_all")
    whole = placed.where(F.floor(F.col("_n") / 4) * 4 + 4 <= F.col("_all")).select(image, F.floor(F.col("_n") / 4).alias("mosaic"), (F.col("_n") % 4).cast("int").alias("quarter"))
    half = side / 2
    sx, sy = F.lit(half) / F.col("width"), F.lit(half) / F.col("height")
    dx, dy = (F.col("quarter") % 2) * half, F.floor(F.col("quarter") / 2) * half
    moved = {"x1": F.col("x1") * sx + dx, "x2": F.col("x2") * sx + dx, "y1": F.col("y1") * sy + dy, "y2": F.col("y2") * sy + dy}
    return truths.join(whole, image).withColumns({**moved, "width": F.lit(side), "height": F.lit(side)})


# The least overlaps that a crop is drawn from (1 leaves the image alone), the range of its sides and of its shape.
LEAST_OVERLAPS = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
SIDES, SHAPES, TRIALS = (0.3, 1.0), (0.5, 2.0), 40


def overlap_cropped(truths: DataFrame, seed: int, image: str = "image_id", probability: float = 0.8, trials: int = TRIALS) -> DataFrame:
    """Images cropped to a random window that some box overlaps enough: rejection sampling, in expressions.

    An image draws the least overlap and then up to ``trials`` windows; the first one is taken that has a box's centre inside
    and, among such boxes, an IoU with the window of the least overlap or more. Boxes whose centre is outside go; the others
    are cut and moved. Where no window will do, or 1 is drawn, the image stays as it is. An IoU is never more than the box's area by the
    window's, so windows too large for the image's largest box are passed over before their place is drawn. Adds ``left``, ``top`` and ``trial`` (from 0; null
    for images left alone). Images without boxes have no rows here and need no window.
    """
    names = [c for c in truths.columns if c != image]
    boxes = truths.groupBy(image).agg(F.collect_list(F.struct(*names)).alias("_boxes"), F.first("width").alias("_w"), F.first("height").alias("_h"))
    least = F.get(F.array(*map(F.lit, LEAST_OVERLAPS)), F.floor(draw(seed, "overlap", image) * len(LEAST_OVERLAPS)).cast("int"))
    of = lambda name, t: _drawn_for(seed, name, image, t)

    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    shape = lambda w, h: F.coalesce((w / F.nullif(h, F.lit(0))).between(*SHAPES), F.lit(False)) & (w > 0)
    may_fit = lambda w, h: F.coalesce((F.col("_least") <= 0) | (F.col("_least") * w * h <= F.col("_most") * (1 + 1e-9)), F.lit(True))
    smallest = lambda c: F.floor(F.col(c) * SIDES[0])

    def window(t: Column) -> Column:
        side = lambda size, name: F.floor(size * (SIDES[0] + (SIDES[1] - SIDES[0]) * of(name, t))).cast("int")
        place = lambda size, own, name: F.floor((size - own) * of(name, t)).cast("int")

        def placed(s: Column) -> Column:
            return F.when(shape(s["w"], s["h"]) & may_fit(s["w"], s["h"]), F.struct(place(F.col("_w"), s["w"], "crop-x").alias("left"), place(F.col("_h"), s["h"], "crop-y").alias("top"), s["w"].alias("w"), s["h"].alias("h"), t.alias("trial")))

        sized = lambda w: F.struct(w.alias("w"), side(F.col("_h"), "crop-h").alias("h"))
        return let(side(F.col("_w"), "crop-w"), lambda w: F.when(may_fit(w, smallest("_h")), let(sized(w), placed)))

    def iou(b: Column, s: Column) -> Column:
        wide = F.least(b["x2"], s["left"] + s["w"]) - F.greatest(b["x1"], s["left"])
        high = F.least(b["y2"], s["top"] + s["h"]) - F.greatest(b["y1"], s["top"])
        inter = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
        together = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) + s["w"] * s["h"] - inter
        return F.coalesce(inter / F.nullif(together, F.lit(0.0)), F.lit(0.0))

    def fits(s: Column) -> Column:
        return s.isNotNull() & F.exists("_boxes", lambda b: _centre_in(b, s) & (iou(b, s) >= F.col("_least")))

    wanted = boxes.withColumn("_least", F.when(draw(seed, "crop", image) < probability, least).otherwise(1.0)).withColumn("_most", F.array_max(F.transform("_boxes", area)))
    # a few windows first: most images that take one take an early one
    first = [F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), window), fits), F.lit(0)) for low, high in _pieces(trials)]
    found = F.when((F.col("_least") < 1.0) & may_fit(smallest("_w"), smallest("_h")), F.coalesce(*first))
    picked = wanted.withColumn("_window", found).select(image, "_window", F.explode("_boxes").alias("_box"))
    s, b = F.col("_window"), F.col("_box")
    kept = picked.where(s.isNull() | _centre_in(b, s))
    moved = lambda c, low, size: F.when(s.isNull(), b[c]).otherwise(F.least(F.greatest(b[c], s[low]), s[low] + s[size]) - s[low])
    new = {"x1": moved("x1", "left", "w"), "x2": moved("x2", "left", "w"), "y1": moved("y1", "top", "h"), "y2": moved("y2", "top", "h"), "width": F.coalesce(s["w"], b["width"]), "height": F.coalesce(s["h"], b["height"])}
    added = [F.coalesce(s["left"], F.lit(0)).alias("left"), F.coalesce(s["top"], F.lit(0)).alias("top"), s["trial"].alias("trial")]
    return kept.select(image, *[new.get(c, b[c]).alias(c) for c in names], *added)


def _pieces(trials: int) -> list[tuple[int, int]]:
    ends = [0, *[e for e in (4, 12) if e < trials], trials]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _centre_in(b: Column, s: Column) -> Column:
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return (cx > s["left"]) & (cx < s["left"] + s["w"]) & (cy > s["top"]) & (cy < s["top"] + s["h"])


def _drawn_for(seed: int, name: str, image: str, trial: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(image), trial.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def dense_places(ids: DataFrame, id_: str, place: str, per_bucket: int = 1 << 16) -> tuple[DataFrame, int]:
    """``ids`` (distinct whole numbers) with 0-based places in their order, and how many there are; no sort of all rows.

    Ids are dealt by arithmetic into ranges of equal width, about ``per_bucket`` rows each if they lie evenly; a
    range is ranked by itself and moved up by the counts of the ranges before it, a small table.
    """
    low, high, n = ids.agg(F.min(id_), F.max(id_), F.count("*")).first()
    if not n:
        return ids.withColumn(place, F.lit(0).cast("long")), 0
    width = max(1, -(-(high - low + 1) // max(1, -(-n // per_bucket))))
    bucket, before = free_name("_bucket", ids.columns), free_name("_before", ids.columns)
    dealt = ids.withColumn(bucket, F.floor((F.col(id_) - F.lit(low)) / F.lit(width)))
    counts = cut(dealt.groupBy(bucket).agg(F.count("*").alias("n")))
    up_to = ordered.Window.orderBy("_b").rowsBetween(ordered.Window.unboundedPreceding, -1)  # a row for each range
    moved = counts.select(F.col(bucket).alias("_b"), "n").select("_b", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias(before))
    inside = F.row_number().over(ordered.Window.partitionBy(bucket).orderBy(id_)) - 1
    ranked = dealt.withColumn(place, inside).join(moved, F.col(bucket) == F.col("_b"))
    return ranked.withColumn(place, F.col(place) + F.col(before)).drop(bucket, "_b", before), n


class Permutation:
    """A seeded permutation of 0..n-1 and its inverse, as expressions: Feistel rounds on pairs of digits, walked past the end.

    The numbers are pairs of digits of radix a and b with a x b a little over n; a round adds a hash of one digit to the
    other. A result of n or more goes through the rounds again; as few results are out of range, so few walks there are, and
    none is longer than their number.
    """

    def __init__(self, n: int, seed: int, rounds: int = 4):
        root = max(1, int(n**0.5))
        self.b = min(range(root, root + 64), key=lambda b: (-(-n // b) * b, b))
        self.a = max(1, -(-n // self.b))
        self.n, self.seed, self.rounds = n, seed, rounds

    def _hash(self, turn: int, digit: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.lit(str(turn)), digit.cast("string"))), 1, 8), 16, 10).cast("long")

    def _once(self, value: Column, back: bool) -> Column:
        state = F.struct(F.floor(value / F.lit(self.b)).alias("l"), (value % self.b).alias("r"))
        for turn in reversed(range(self.rounds)) if back else range(self.rounds):
            state = let(state, self._round(turn, -1 if back else 1))
        return let(state, lambda s: s["l"] * self.b + s["r"])

    def _round(self, turn: int, sign: int):
        def run(s: Column) -> Column:
            if turn % 2 == 0:
                return F.struct(F.pmod(s["l"] + self._hash(turn, s["r"]) * sign, F.lit(self.a)).alias("l"), s["r"].alias("r"))
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + self._hash(turn, s["l"]) * sign, F.lit(self.b)).alias("r"))

        return run

    def of(self, value: Column, back: bool = False) -> Column:
        """Where ``value`` goes, or with ``back`` what comes to it."""
        first = self._once(value.cast("long"), back)
        outside = self.a * self.b - self.n
        if not outside:
            return first
        walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), v, lambda x, _: F.when(x < self.n, x).otherwise(self._once(x, back)))
        return let(first, lambda v: F.when(v < self.n, v).otherwise(walk(v)))


def mixed_up(truths: DataFrame, images: DataFrame, seed: int, image: str = "image_id", low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Boxes of images blended in pairs: ``base`` (the blend's first image), the box's own columns, and its image's ``weight``.

    A seeded permutation puts the images (a row each in ``images``, distinct whole numbers) in a circle; each is blended with the next
    one, so that each comes once as base and once as partner. The partner's place is worked out, not sorted for, and
    looked up by an equi-join. One image alone is blended with itself. Weights add up to 1.
    """
    own = cut(images.select(F.col(image).alias("_id")))
    placed, n = dense_places(own, "_id", "_place")
    if not n:
        return truths.limit(0).withColumns({"base": F.lit(0).cast("long"), "weight": F.lit(1.0)})
    placed, turn = cut(placed), Permutation(n, seed)
    next_ = turn.of((turn.of(F.col("_place")) + 1) % n, back=True)
    first = low + (high - low) * draw(seed, "blend", "_id")
    pairs = placed.select(F.col("_id").alias("base"), next_.alias("_next"), first.alias("_share")).join(placed.select(F.col("_place").alias("_next"), F.col("_id").alias("_partner")), "_next")
    parts = F.array(F.struct(F.col("base").alias("id"), F.col("_share").alias("weight")), F.struct(F.col("_partner").alias("id"), (1 - F.col("_share")).alias("weight")))
    each = pairs.select("base", F.explode(parts).alias("_part")).select("base", F.col("_part.id").alias("_id"), F.col("_part.weight").alias("weight"))
    return truths.join(each, F.col(image) == F.col("_id")).drop("_id")
