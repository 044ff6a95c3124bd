"""Box geometry as Column expressions: everything stays inside whole-stage codegen.

A box is a tuple of four Columns. Spark's ANSI mode raises on 0/0, so quotients over a
possibly empty area give NULL instead of NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def clip_to_image(b: Box, width, height) -> Box:
    """Integer corners: truncated toward zero, low corner kept >= 0, high corner <= size."""
    whole = lambda c: c.cast("int")
    size = lambda v: v if isinstance(v, Column) else F.lit(v)
    x1, y1, x2, y2 = map(whole, b)
    return F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0)), F.least(x2, size(width)), F.least(y2, size(height))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side(0, 2) * side(1, 3)


def union(a: Box, b: Box) -> Column:
    return area(a) + area(b) - overlap(a, b)


def iou(a: Box, b: Box) -> Column:
    return ratio(overlap(a, b), union(a, b))


def giou(a: Box, b: Box) -> Column:
    """IoU less the share of the enclosing box that neither covers."""
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return iou(a, b) - ratio(hull - union(a, b), hull)


def centre_to_corners(b: Box) -> Box:
    cx, cy = b[0], b[1]
    half_w, half_h = F.greatest(b[2], F.lit(0.0)) / 2, F.greatest(b[3], F.lit(0.0)) / 2
    return cx - half_w, cy - half_h, cx + half_w, cy + half_h


def corners_to_centre(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def scale(b: Box, sx, sy) -> Box:
    return b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy


def edge_distances(x: Column, y: Column, b: Box) -> Box:
    """Distances of a point to a box's left, top, right and bottom; negative outside."""
    return x - b[0], y - b[1], b[2] - x, b[3] - y


def from_edge_distances(x: Column, y: Column, d: Box) -> Box:
    return x - d[0], y - d[1], x + d[2], y + d[3]


def inside(x: Column, y: Column, b: Box, eps: float = 1e-9) -> Column:
    return F.least(*edge_distances(x, y, b)) > eps


def scaled_to_corners(point: Box, d: Box, reg_scale: float) -> Box:
    """Edge distances in units of the reference box's side / reg_scale, as corners."""
    s = abs(reg_scale)
    step_x, step_y = point[2] / s, point[3] / s
    out = lambda k: F.lit(s / 2) + d[k]
    return point[0] - out(0) * step_x, point[1] - out(1) * step_y, point[0] + out(2) * step_x, point[1] + out(3) * step_y


def corners_to_scaled(point: Box, b: Box, reg_scale: float) -> Box:
    s = abs(reg_scale)
    unit_x, unit_y = point[2] / s + 1e-16, point[3] / s + 1e-16
    left, top, right, bottom = edge_distances(point[0], point[1], b)
    return left / unit_x - s / 2, top / unit_y - s / 2, right / unit_x - s / 2, bottom / unit_y - s / 2


def knots(reg_max: int, up: float, reg_scale: float) -> list[float]:
    """The reg_max + 1 non-uniform bin positions, symmetric about 0, by rule."""
    bound = abs(up) * abs(reg_scale)
    growth = (bound + 1) ** (2 / (reg_max - 2))
    half = [growth**i - 1 for i in range(1, reg_max // 2)]
    return [-2 * bound, *(-v for v in reversed(half)), 0.0, *half, 2 * bound]


def bin_of(value: Column, positions: list[float]) -> tuple[Column, Column, Column]:
    """(bin, weight right, weight left) of a value among knots; clamped at both ends."""
    last = len(positions) - 1
    array = F.array(*map(F.lit, positions))
    k = F.size(F.filter(array, lambda p: p <= value)) - 1
    lo, hi = F.get(array, k), F.get(array, k + 1)
    right = F.abs(value - lo) / (F.abs(value - lo) + F.abs(hi - value))
    outside = lambda low, high, mid: F.when(k < 0, F.lit(low)).when(k >= last, F.lit(high)).otherwise(mid)
    return outside(0.0, last - 0.1, k.cast("double")), outside(0.0, 1.0, right), outside(1.0, 0.0, 1 - right)


def anchor_grid(levels: DataFrame, side: float = 0.05, eps: float = 0.01) -> DataFrame:
    """lvl, gx, gy, the anchor (cx, cy, w, h) and whether it is valid, for levels (lvl, nx, ny).

    Anchors sit in the middle of the cells; an anchor is valid with all four numbers in (eps, 1 - eps).
    """
    along = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    grid = levels.select("lvl", "nx", "ny", along("nx", "gx")).select("lvl", "nx", "ny", "gx", along("ny", "gy"))
    w = F.lit(side) * F.pow(F.lit(2.0), "lvl")
    grid = grid.select("lvl", "gx", "gy", ((F.col("gx") + 0.5) / F.col("nx")).alias("cx"), ((F.col("gy") + 0.5) / F.col("ny")).alias("cy"), w.alias("w"), w.alias("h"))
    return grid.withColumn("valid", F.forall(F.array("cx", "cy", "w", "h"), lambda v: (v > eps) & (v < 1 - eps)))


def position_table(levels: DataFrame, dims: int = 256, temperature: float = 10000.0) -> DataFrame:
    """x, y, and the ``dims`` numbers of each cell of a (w, h) grid: sines and cosines of x, then of y."""
    if dims % 4:
        raise ValueError("the dimension must be a multiple of four")
    along = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    quarter = dims // 4
    omega = F.transform(F.sequence(F.lit(0), F.lit(quarter - 1)), lambda i: 1 / F.pow(F.lit(temperature), i / F.lit(float(quarter))))
    wave = lambda f, c: F.transform(omega, lambda o: f(F.col(c) * o))
    cells = levels.select("w", "h", along("w", "x")).select("x", along("h", "y"))
    return cells.select("x", "y", F.concat(wave(F.sin, "x"), wave(F.cos, "x"), wave(F.sin, "y"), wave(F.cos, "y")).alias("position"))


def mask_boxes(pixels: DataFrame, mask: str = "mask_id", x: str = "x", y: str = "y") -> DataFrame:
    """The box around the set pixels of each mask."""
    return pixels.groupBy(mask).agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, frame: str = "frame_id", eps: float = 1e-9) -> DataFrame:
    """The (point, box) pairs of a frame where the point lies inside: an equi-join on the frame."""
    return points.join(boxes, frame).where(inside(F.col("px"), F.col("py"), box(), eps))


def letterbox(w: Column, h: Column, side: int) -> dict[str, Column]:
    """How an image is fitted into a square: ratio, new size and padding."""
    r = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    new_w, new_h = (w * r).cast("int"), (h * r).cast("int")
    half = lambda v: F.floor((F.lit(side) - v) / 2).cast("int")
    return {"ratio": r, "new_w": new_w, "new_h": new_h, "pad_w": half(new_w), "pad_h": half(new_h)}


def unletterbox(b: Box, fit: dict[str, Column], w: Column, h: Column) -> Box:
    """A box of the square back in image pixels, clipped to the image."""
    back = lambda v, pad, most: F.least(F.greatest((v - pad) / fit["ratio"], F.lit(0.0)), most.cast("double"))
    return back(b[0], fit["pad_w"], w), back(b[1], fit["pad_h"], h), back(b[2], fit["pad_w"], w), back(b[3], fit["pad_h"], h)


def recognizer_size(w: Column, h: Column, rec_h: int = 48, rec_w: int = 320, max_w: int = 3200) -> tuple[Column, Column]:
    """(input width, resized width) of a text crop of w x h."""
    aspect = w / h.cast("double")
    full = F.least((F.lit(rec_h) * F.greatest(F.lit(rec_w / rec_h), aspect)).cast("int"), F.lit(max_w))
    return full, F.least(full, F.ceil(F.lit(rec_h) * aspect).cast("int"))


def label_rectangle(x1: Column, y1: Column, text_w, text_h, baseline) -> Box:
    """Background rectangle of a label drawn above a box, kept inside the image's top."""
    bottom = F.greatest(F.lit(text_h + baseline + 2), y1 - 4)
    return x1, bottom - text_h - baseline - 2, x1 + text_w, bottom


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
