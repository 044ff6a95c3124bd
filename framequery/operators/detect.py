"""Detection operators: threshold filters, clipping, ranking, pairwise overlap, suppression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import maths as M
from . import ordered
from .grouped import map_many, places

#: Backends whose own filter is strict; the others are filtered once, by >=.
STRICT_BACKENDS = ("onnx", "openvino", "pytorch")


def score_above(det: DataFrame, threshold: float) -> DataFrame:
    """A detector's own filter: strictly above, in single precision."""
    return det.where(F.col("score").cast("float") > F.lit(threshold).cast("float"))


def score_at_least(det: DataFrame, threshold: float) -> DataFrame:
    """The pipeline's filter: at or above, in double precision."""
    return det.where(F.col("score").cast("double") >= F.lit(float(threshold)))


def score_filter(det: DataFrame, threshold: float, backend: str) -> DataFrame:
    return score_at_least(score_above(det, threshold) if backend in STRICT_BACKENDS else det, threshold)


def kept_boxes(boxes: Column, threshold: float, backend: str, width: Column, height: Column, mode: str = "batch") -> Column:
    """What ``score_filter`` and ``clip`` leave of a frame's array of boxes: (det_id, class_id, score, corners), det_id counted from 0.

    For rows that keep their pixels: nothing is exploded or joined back.
    """
    score = lambda b: b["score"].cast("double") >= F.lit(float(threshold))
    strict = lambda b: b["score"].cast("float") > F.lit(threshold).cast("float")
    enough = (lambda b: strict(b) & score(b)) if backend in STRICT_BACKENDS else score

    def clipped(b: Column) -> Column:
        corners = G.clip_to_image(tuple(b[c] for c in ("x1", "y1", "x2", "y2")), width, height)
        return F.struct(b["det_id"], b["class_id"], b["score"], *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)])

    numbered = F.transform(boxes, lambda b, i: F.struct(i.alias("det_id"), *[b[c].alias(c) for c in ("class_id", "score", "x1", "y1", "x2", "y2")]))
    inside = F.transform(F.filter(numbered, enough), clipped)
    return F.filter(inside, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])) if mode == "batch" else inside


def clip(det: DataFrame, width, height, mode: str = "batch") -> DataFrame:
    """Integer boxes within the image. Batch mode drops empty boxes; stream mode keeps them."""
    x1, y1, x2, y2 = G.clip_to_image(G.box(), width, height)
    rest = [c for c in det.columns if c not in ("x1", "y1", "x2", "y2")]
    out = det.select(*rest, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return out.where("x2 > x1 AND y2 > y1") if mode == "batch" else out


def sanitize(det: DataFrame, min_size: float = 1.0) -> DataFrame:
    return det.where((F.col("x2") - F.col("x1") >= min_size) & (F.col("y2") - F.col("y1") >= min_size))


def topk(det: DataFrame, k: int, by: str = "frame_id", *ties: str) -> DataFrame:
    """The k best per frame, in a total order (window rank limit before the shuffle)."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *(ties or ("det_id",)))
    return det.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def flat_topk(queries: DataFrame, k: int, logits: str = "logits") -> DataFrame:
    """Best k of all (query, class) scores of an image: a query may come under several classes."""
    flat = queries.select("image_id", "query_id", F.posexplode(logits).alias("label", "logit"))
    scored = flat.select("image_id", "query_id", "label", M.sigmoid(F.col("logit").cast("double")).alias("score"))
    return topk(scored, k, "image_id", "query_id", "label")


def best_class_topk(queries: DataFrame, k: int, logits: str = "logits") -> DataFrame:
    """Softmax over classes, the last being background: each query's best class, then the k best queries."""
    best = lambda z, front: F.struct(M.argmax(front).alias("label"), M.let(F.array_max(z), lambda top: F.exp(F.array_max(front) - top) / M.add_up(F.transform(z, lambda v: F.exp(v - top)))).alias("score"))
    # of the softmax only its largest term is needed, and one sum
    picked = M.let(M.doubles(F.col(logits)), lambda z: M.let(F.slice(z, F.lit(1), F.size(z) - 1), lambda front: best(z, front)))
    scored = queries.select("image_id", "query_id", picked.alias("best")).select("image_id", "query_id", "best.label", "best.score")
    return topk(scored, k, "image_id", "query_id")


def select_queries(queries: DataFrame, k: int, method: str = "default", logits: str = "logits") -> DataFrame:
    """Queries kept before decoding: by best class, by single logit, or by flat (query, class) rank."""
    if method == "one2many":
        flat = queries.select("image_id", F.posexplode(logits).alias("label", "score"), "query_id")
        return topk(flat, k, "image_id", "query_id", "label").select("image_id", "query_id", "rank")
    score = F.array_max(logits) if method == "default" else F.get(logits, F.lit(0))
    return topk(queries.select("image_id", "query_id", score.alias("score")), k, "image_id", "query_id").select("image_id", "query_id", "rank")


def pairs(det: DataFrame, other: DataFrame | None = None, frame: str = "frame_id") -> DataFrame:
    """Pairs of one frame's boxes, as a_* and b_*: an equi-join on the frame, never a cross join."""
    rename = lambda d, p: d.select(F.col(frame), *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != frame])
    joined = rename(det, "a").join(rename(det if other is None else other, "b"), frame)
    return joined if other is not None else joined.where("a_det_id < b_det_id")


def overlaps(paired: DataFrame) -> list[Column]:
    a, b = G.box("a_"), G.box("b_")
    return [G.iou(a, b), G.union(a, b), G.giou(a, b)]


def greedy_suppression(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Indices kept, best first: a box goes when it overlaps a kept one by more than the threshold."""
    order = np.lexsort((np.arange(len(scores)), -scores))
    areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    alive, kept = np.ones(len(scores), bool), []
    for i in order:
        if not alive[i]:
            continue
        kept.append(int(i))
        low, high = np.maximum(boxes[i, :2], boxes[:, :2]), np.minimum(boxes[i, 2:], boxes[:, 2:])
        inter = np.clip(high - low, 0, None).prod(1)
        together = areas[i] + areas - inter
        alive &= ~(inter > threshold * together) | (together <= 0)
        alive[i] = False
    return kept


def suppressed_together(frame: np.ndarray, class_id: np.ndarray, boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows ``greedy_suppression`` keeps, for many frames and classes at once; rows are sorted by both and come best first.

    A step takes the next box of every group and removes what it overlaps, so that there are as many steps as rows in the
    largest group, and a step's work is bounded by the rows.
    """
    place = places(frame, class_id)
    first = np.flatnonzero(place == 0)
    ends = np.repeat(np.append(first[1:], len(place)), np.diff(first, append=len(place)))
    areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    alive, by_place = np.ones(len(place), bool), np.argsort(place, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(place, minlength=1)))
    for low, high in zip(starts[:-1], starts[1:], strict=True):
        taken = by_place[low:high]
        taken = taken[alive[taken]]
        left = ends[taken] - taken - 1
        i = np.repeat(taken, left)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
        i, j = i[alive[j]], j[alive[j]]
        inter = np.clip(np.minimum(boxes[i, 2:], boxes[j, 2:]) - np.maximum(boxes[i, :2], boxes[j, :2]), 0, None).prod(1)
        together = areas[i] + areas[j] - inter
        alive[j[(inter > threshold * together) & (together > 0)]] = False
    return alive


def suppress(det: DataFrame, threshold: float = 0.7, top: int = 1000, keep: int = 100, min_score: float = 0.1, frame: str = "frame_id") -> DataFrame:
    """Greedy suppression per frame and class: of the ``top`` best of a frame, at most ``keep`` stay, ranked.

    Rows are dealt once, by frame; ranking, suppression and the final rank happen there.
    """
    columns = ["class_id", "det_id", "score", "x1", "y1", "x2", "y2"]
    numbers = det.where(F.col("score") > min_score).select(frame, *[F.col(c).cast("long" if c in columns[:2] else "double").alias(c) for c in columns])

    def run(group: np.ndarray, key: list[np.ndarray], rows: list[np.ndarray]) -> tuple:
        order = np.lexsort((rows[1], -rows[2], group))
        order = order[places(group[order]) < top]
        order = order[np.lexsort((rows[0][order], group[order]))]  # by frame and class, each in the order of scores
        frame_of, class_id, corners = group[order], rows[0][order], np.stack([r[order] for r in rows[3:]], axis=1)
        kept = order[suppressed_together(frame_of, class_id, corners, threshold)]
        kept = kept[np.lexsort((rows[1][kept], -rows[2][kept], group[kept]))]
        rank = places(group[kept]) + 1
        kept, rank = kept[rank <= keep], rank[rank <= keep]
        return key[0][kept], rows[0][kept], rows[1][kept], rows[2][kept], rank

    out = map_many(numbers, [frame], ["det_id"], columns, run, f"{frame} long, class_id long, det_id long, score double, rank long")
    return out.withColumn("rank", F.col("rank").cast("int"))


# The overlaps and the area ranges (in pixels) of the public benchmark's average precision.
OVERLAPS = tuple(0.5 + 0.05 * i for i in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def match_truths(scored: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = (0.5,), area: tuple[float, float] = AREAS["all"], top: int = 100) -> DataFrame:
    """(frame_id, class_id, det_id, score, threshold, hit, ignored) of the ``top`` best detections of a frame and class.

    Greedy by score: a detection takes the free truth it overlaps most, if by the
    threshold. Truths that are crowds or lie outside the area range are taken only where no other
    fits, crowds any number of times (by the share of the detection they cover), and such detections are
    ignored, as are unmatched ones outside the area range. ``truths`` may have ``iscrowd``.
    """
    columns = ["det_id", "truth", "crowd", "score", "x1", "y1", "x2", "y2"]
    crowd = F.col("iscrowd").cast("long") if "iscrowd" in truths.columns else F.lit(0).cast("long")
    numbers = lambda d, truth, c, score: d.select("frame_id", F.col("class_id").cast("long").alias("class_id"), F.col("det_id").cast("long").alias("det_id"), F.lit(truth).alias("truth"), c.alias("crowd"), score.cast("double").alias("score"), *[F.col(x).cast("double").alias(x) for x in columns[4:]])
    both = numbers(scored, 0, F.lit(0).cast("long"), F.col("score")).unionByName(numbers(truths, 1, crowd, F.lit(0.0)))

    def run(group: np.ndarray, key: list[np.ndarray], rows: list[np.ndarray]) -> tuple:
        det_id, truth, crowds, score = rows[:4]
        corners = np.stack(rows[4:], axis=1)
        size = (corners[:, 2] - corners[:, 0]) * (corners[:, 3] - corners[:, 1])
        outside = (size < area[0]) | (size > area[1])
        crowded = crowds == 1
        spare, t, d = crowded | outside, np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
        d = d[np.lexsort((det_id[d], -score[d], group[d]))]
        place = places(group[d])
        d, place = d[place < top], place[place < top]
        first, last = (np.searchsorted(group[t], group[d], side=s) for s in ("left", "right"))
        free = np.ones((len(thresholds), len(truth)), bool)
        hits, ignored = np.zeros((len(thresholds), len(d)), bool), np.tile(outside[d], (len(thresholds), 1))
        by_place, starts = np.argsort(place, kind="stable"), np.append(0, np.cumsum(np.bincount(place, minlength=1)))
        for low, high in zip(starts[:-1], starts[1:], strict=True):  # the next detection of every group, with the group's truths
            now = by_place[low:high]
            width = last[now] - first[now]
            i = np.repeat(now, width)
            j = t[np.repeat(first[now], width) + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)]
            a, b = corners[d[i]], corners[j]
            inter = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(1)
            together = np.where(crowded[j], size[d[i]], size[d[i]] + size[j] - inter)
            quality = np.where(together > 0, inter / np.where(together > 0, together, 1), 0.0)
            best = np.lexsort((j, -quality, spare[j], i))
            i, j, quality = i[best], j[best], quality[best]
            for k, threshold in enumerate(thresholds):
                fits = np.flatnonzero((quality >= min(threshold, 1 - 1e-10)) & (free[k][j] | crowded[j]))
                fits = fits[places(i[fits]) == 0]
                free[k][j[fits]], hits[k][i[fits]], ignored[k][i[fits]] = False, ~spare[j[fits]], spare[j[fits]]
        every = lambda c: np.tile(c, len(thresholds))
        return every(key[0][d]), every(key[1][d]), every(det_id[d]), every(score[d]), np.repeat(np.array(thresholds, float), len(d)), hits.ravel(), ignored.ravel()

    return map_many(both, ["frame_id", "class_id"], ["det_id"], columns, run, "frame_id long, class_id long, det_id long, score double, threshold double, hit boolean, ignored boolean")


def precision_points(matched: DataFrame, positives: DataFrame) -> DataFrame:
    """(class_id, threshold, ap, positives) of matched detections by the 101-point definition.

    ``positives``: class_id and the number of its truths. Ranks and true positives are
    running values over blocks of a class's detections, so a frequent class is many tasks' work.
    """
    keys = ["class_id", "threshold"]
    placed = ordered.numbered(matched.where(~F.col("ignored")).select(*keys, "score", "frame_id", "det_id", "hit"), keys, [F.desc("score"), F.col("frame_id"), F.col("det_id")])
    ranked = ordered.running(placed, keys, "n", {"tp": F.col("hit").cast("long")}, {"tp": "sum"}).join(positives, "class_id")
    recall, precision = F.col("tp") / F.col("positives"), F.col("tp") / (F.col("n") + 1)
    # the best precision at or beyond each hundredth of recall
    reached = ranked.select(*keys, F.floor(recall * 100 + 1e-9).cast("int").alias("at"), precision.alias("p")).groupBy(*keys, "at").agg(F.max("p").alias("best"))
    points = reached.select(*keys, F.explode(F.sequence(F.lit(0), F.col("at"))).alias("point"), "best").groupBy(*keys, "point").agg(F.max("best").alias("best"))
    return points.groupBy(*keys).agg((F.sum("best") / 101).alias("ap"))


def average_precision(scored: DataFrame, truths: DataFrame, threshold: float | tuple[float, ...] = 0.5, area: str = "all", top: int = 100) -> DataFrame:
    """Per class, and per threshold if there are several: average precision and the number of truths that count."""
    several = not isinstance(threshold, float)
    thresholds = tuple(threshold) if several else (threshold,)
    counted = truths.where("iscrowd = 0 OR iscrowd IS NULL") if "iscrowd" in truths.columns else truths
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    counted = counted.where(size.between(*AREAS[area]))
    positives = counted.groupBy(F.col("class_id").cast("long").alias("class_id")).agg(F.count("*").alias("positives"))
    ap = precision_points(match_truths(scored, truths, thresholds, AREAS[area], top), positives)
    each = positives.select("class_id", "positives", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    out = each.join(ap, ["class_id", "threshold"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    return out.select("class_id", "threshold", "ap", "positives") if several else out.select("class_id", "ap", "positives")
