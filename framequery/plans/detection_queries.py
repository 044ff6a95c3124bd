"""Queries over detections, frames and image sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import maths as M
from ..operators import augment, detect, frames, match, metrics, sampling, spatial
from . import fixtures as X
from .catalog import query

_W, _H = X.WIDTH, X.HEIGHT
_D = "WITH " + X.DETECTIONS_SQL
_KEEP = f"""kept AS (SELECT frame_id, det_id, class_id, score,
  greatest(0, CAST(trunc(x1) AS INT)) AS x1, greatest(0, CAST(trunc(y1) AS INT)) AS y1,
  least({_W}, CAST(trunc(x2) AS INT)) AS x2, least({_H}, CAST(trunc(y2) AS INT)) AS y2 FROM det WHERE score >= 0.5),
ok AS (SELECT * FROM kept WHERE x2 > x1 AND y2 > y1)"""


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.clip(detect.score_at_least(X.detections(spark, sf_dir), 0.5), _W, _H)


@query(_D + " SELECT frame_id, det_id, class_id, score FROM det WHERE CAST(score AS FLOAT) > CAST(0.5 AS FLOAT)")
def det_score_filter(spark, sf_dir):
    return detect.score_above(X.detections(spark, sf_dir), 0.5).select("frame_id", "det_id", "class_id", "score")


@query(_D + " SELECT frame_id, det_id, class_id, score FROM det WHERE score >= CAST(0.5 AS DOUBLE)")
def det_score_filter_ge(spark, sf_dir):
    return detect.score_at_least(X.detections(spark, sf_dir), 0.5).select("frame_id", "det_id", "class_id", "score")


@query(_D + " SELECT frame_id, det_id FROM det WHERE CAST(score AS FLOAT) > CAST(0.7 AS FLOAT) AND CAST(CAST(score AS FLOAT) AS DOUBLE) >= CAST(0.7 AS DOUBLE)")
def det_backend_filter(spark, sf_dir):
    det = X.detections(spark, sf_dir).withColumn("score", F.col("score").cast("float"))
    return detect.score_filter(det, 0.7, "onnx").select("frame_id", "det_id")


@query(_D + ", " + _KEEP + " SELECT * FROM ok")
def det_clip_bbox(spark, sf_dir):
    return _kept(spark, sf_dir)


@query(_D + ", " + _KEEP + " SELECT * FROM kept")
def det_clip_stream(spark, sf_dir):
    return detect.clip(detect.score_at_least(X.detections(spark, sf_dir), 0.5), _W, _H, mode="stream")


@query(_D + " SELECT frame_id, det_id FROM det WHERE x2 - x1 >= 1 AND y2 - y1 >= 60")
def sanitize_boxes(spark, sf_dir):
    det = detect.sanitize(X.detections(spark, sf_dir), 1.0)
    return det.where("y2 - y1 >= 60").select("frame_id", "det_id")


@query(_D + " SELECT frame_id, det_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_id) AS INT) AS rank FROM det) WHERE rank <= 3")
def det_topk_per_frame(spark, sf_dir):
    return detect.topk(X.detections(spark, sf_dir), 3).select("frame_id", "det_id", "score", "rank")


_PAIR = """p AS (SELECT a.frame_id, a.det_id AS a_det_id, b.det_id AS b_det_id,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas,
  (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull
  FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.det_id < b.det_id)"""


@query(_D + ", " + _PAIR + " SELECT frame_id, a_det_id, b_det_id, round(inter / nullif(areas - inter, 0), 6) AS iou, round(areas - inter, 6) AS together FROM p")
def pair_iou(spark, sf_dir):
    p = detect.pairs(X.detections(spark, sf_dir))
    iou, together, _ = detect.overlaps(p)
    return p.select("frame_id", "a_det_id", "b_det_id", r6(iou, "iou"), r6(together, "together"))


@query(_D + ", " + _PAIR + " SELECT frame_id, a_det_id, b_det_id, round(inter / nullif(areas - inter, 0) - (hull - (areas - inter)) / nullif(hull, 0), 6) AS giou FROM p")
def pair_giou(spark, sf_dir):
    p = detect.pairs(X.detections(spark, sf_dir))
    return p.select("frame_id", "a_det_id", "b_det_id", r6(detect.overlaps(p)[2], "giou"))


_FRAMES = "fr AS (SELECT o_orderkey AS frame_id FROM orders)"
_PER = """per AS (SELECT fr.frame_id, count(ok.det_id) AS det_count, max(score) AS best_score,
  CAST(coalesce(sum(CAST((x2 - x1) * (y2 - y1) AS BIGINT)), 0) AS BIGINT) AS total_area
  FROM fr LEFT JOIN ok ON fr.frame_id = ok.frame_id GROUP BY fr.frame_id)"""


@query(f"{_D}, {_KEEP}, {_FRAMES}, {_PER} SELECT * FROM per")
def frame_summary(spark, sf_dir):
    return metrics.per_frame(X.frames(spark, sf_dir), _kept(spark, sf_dir))


_TIMED = """timed AS (SELECT per.frame_id, det_count, CAST(per.frame_id % 7 AS DOUBLE) / 64 AS det_s, CAST(det_count AS DOUBLE) / 128 AS ocr_s FROM per)"""


def _timed(spark, sf_dir):
    per = frame_summary(spark, sf_dir)
    return per.select("frame_id", "det_count", (F.pmod("frame_id", F.lit(7)).cast("double") / 64).alias("det_s"), (F.col("det_count").cast("double") / 128).alias("ocr_s"))


@query(f"{_D}, {_KEEP}, {_FRAMES}, {_PER}, {_TIMED} SELECT count(*) AS frames, CAST(sum(det_count) AS BIGINT) AS detections, sum(det_s) AS det_s, sum(ocr_s) AS ocr_s, count(*) / nullif(sum(det_s), 0) AS det_s_rate, count(*) / nullif(sum(ocr_s), 0) AS ocr_s_rate FROM timed")
def run_summary(spark, sf_dir):
    return metrics.run_totals(_timed(spark, sf_dir), ["det_s", "ocr_s"])


@query(f"{_D}, {_KEEP}, {_FRAMES}, {_PER}, {_TIMED} SELECT frame_id, CASE WHEN det_s > 0 THEN 1 / det_s ELSE 0.0 END AS det_fps, CASE WHEN ocr_s > 0 THEN 1 / ocr_s END AS rec_fps FROM timed")
def fps_guards(spark, sf_dir):
    return _timed(spark, sf_dir).select("frame_id", M.rate(F.col("det_s"), 0.0).alias("det_fps"), M.rate(F.col("ocr_s"), None).alias("rec_fps"))


def _results(spark, sf_dir):
    text = F.when(F.pmod(F.col("det_id"), F.lit(4)) == 0, "no_text_detected").otherwise(F.concat(F.lit("t"), F.col("class_id").cast("string")))
    return _kept(spark, sf_dir).withColumn("text", text)


@query(
    f"""{_D}, {_KEEP}, {_FRAMES} SELECT fr.frame_id, count(ok.det_id) AS n_sent,
  coalesce(string_agg('t' || class_id || '@' || CAST(x1 + x2 AS VARCHAR) || 'x' || CAST(y2 - y1 AS VARCHAR), ' ' ORDER BY det_id), '') AS sent
  FROM fr LEFT JOIN (SELECT * FROM ok WHERE det_id % 4 <> 0) ok ON fr.frame_id = ok.frame_id GROUP BY fr.frame_id"""
)
def empty_frames_kept(spark, sf_dir):
    sent = frames.messages(X.frames(spark, sf_dir), _results(spark, sf_dir))
    show = F.transform("detections", lambda d: F.concat(d["results"][0]["class_id"], F.lit("@"), (d["cx"] * 2).cast("int").cast("string"), F.lit("x"), d["h"].cast("int").cast("string")))
    return sent.select("frame_id", F.size("detections").cast("long").alias("n_sent"), F.array_join(show, " ").alias("sent"))


@query("SELECT frame_id, number, session, 'frame_' || lpad(CAST(number AS VARCHAR), 6, '0') || '.png' AS file FROM (SELECT o_orderkey AS frame_id, o_custkey % 50 AS session, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS INT) AS number FROM orders) WHERE number % 30 = 0")
def nth_frame(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.pmod("o_custkey", F.lit(50)).alias("session"))
    return frames.every_nth(rows, 30, partition=F.col("session")).select("frame_id", "session", "number", "file")


@query("SELECT session, frame_id, line FROM (SELECT *, '[' || i || '/' || n || ']' AS line FROM (SELECT o_custkey % 50 AS session, o_orderkey AS frame_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey % 50) AS n FROM orders)) WHERE i % 100 = 0 OR i = n")
def progress_lines(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.pmod("o_custkey", F.lit(50)).alias("session"))
    return frames.progress(rows, 100, "session", "frame_id").select("session", "frame_id", "line")


@query(
    """SELECT o_orderkey, worker, CAST(floor(i / 16) AS BIGINT) AS batch FROM (SELECT o_orderkey, o_custkey % 8 AS worker,
  row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey % 97, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 8) AS n FROM orders)
  WHERE (floor(i / 16) + 1) * 16 <= n"""
)
def batch_assign(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    order = [F.pmod("o_orderkey", F.lit(97)), F.col("o_orderkey")]
    return frames.batch_numbers(rows, 128, 8, order, F.pmod("o_custkey", F.lit(8))).select("o_orderkey", "worker", "batch")


_LB = """lb AS (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS ratio FROM img),
fit AS (SELECT *, CAST(trunc(w * ratio) AS INT) AS new_w, CAST(trunc(h * ratio) AS INT) AS new_h FROM lb)"""


@query(f"WITH {X.IMAGES_SQL}, {_LB} SELECT image_id, round(ratio, 6) AS ratio, new_w, new_h, CAST(floor((640 - new_w) / 2) AS INT) AS pad_w, CAST(floor((640 - new_h) / 2) AS INT) AS pad_h FROM fit")
def letterbox_geometry(spark, sf_dir):
    fit = G.letterbox(F.col("w"), F.col("h"), 640)
    return X.images(spark, sf_dir).select("image_id", r6(fit["ratio"], "ratio"), *[fit[k].alias(k) for k in ("new_w", "new_h", "pad_w", "pad_h")])


@query(
    f"""{_D} SELECT frame_id, det_id, round(least(greatest(x1 / 1.0, 0), 640), 6) AS x1, round(least(greatest((y1 - 80) / 1.0, 0), 480), 6) AS y1,
  round(least(greatest(x2 / 1.0, 0), 640), 6) AS x2, round(least(greatest((y2 - 80) / 1.0, 0), 480), 6) AS y2 FROM det"""
)
def unletterbox_boxes(spark, sf_dir):
    w, h = F.lit(_W), F.lit(_H)
    back = G.unletterbox(G.box(), G.letterbox(w, h, 640), w, h)
    return X.detections(spark, sf_dir).select("frame_id", "det_id", *[r6(c, n) for c, n in zip(back, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    f"""WITH {X.IMAGES_SQL}, s AS (SELECT *, least(CAST(trunc(48 * greatest(320.0::DOUBLE / 48, w / h::DOUBLE)) AS INT), 3200) AS input_w FROM img)
  SELECT image_id, input_w, least(input_w, CAST(ceil(48 * (w / h::DOUBLE)) AS INT)) AS resized_w FROM s"""
)
def recognizer_sizes(spark, sf_dir):
    full, resized = G.recognizer_size(F.col("w"), F.col("h"))
    return X.images(spark, sf_dir).select("image_id", full.alias("input_w"), resized.alias("resized_w"))


@query(f"{_D}, {_KEEP} SELECT frame_id, det_id, greatest(20, y1 - 4) AS bottom, greatest(20, y1 - 4) - 20 AS top, x1 + 60 AS right_x FROM ok")
def label_rectangles(spark, sf_dir):
    _, top, right, bottom = G.label_rectangle(F.col("x1"), F.col("y1"), 60, 14, 4)
    return _kept(spark, sf_dir).select("frame_id", "det_id", bottom.alias("bottom"), top.alias("top"), right.alias("right_x"))


@query(
    f"""{_D}, n AS (SELECT frame_id, det_id, (x1 + x2) / 2 / {_W} AS cx, (y1 + y2) / 2 / {_H} AS cy, (x2 - x1) / {_W} AS w, (y2 - y1) / {_H} AS h FROM det)
  SELECT frame_id, det_id, round(cx, 12) AS cx, round(cy, 12) AS cy, round(w, 12) AS w, round(h, 12) AS h,
  round((cx - w / 2) * {_W}, 4) AS px1, round((cy - h / 2) * {_H}, 4) AS py1, round((cx + w / 2) * {_W}, 4) AS px2, round((cy + h / 2) * {_H}, 4) AS py2 FROM n"""
)
def box_formats(spark, sf_dir):
    centre = [c.alias(n) for c, n in zip(G.scale(G.corners_to_centre(G.box()), F.lit(1.0) / _W, F.lit(1.0) / _H), ("cx", "cy", "w", "h"), strict=True)]
    n = X.detections(spark, sf_dir).select("frame_id", "det_id", *centre)
    back = G.scale(G.centre_to_corners(G.box("", ("cx", "cy", "w", "h"))), float(_W), float(_H))
    return n.select("frame_id", "det_id", *[F.round(c, 12).alias(c) for c in ("cx", "cy", "w", "h")], *[F.round(c, 4).alias(m) for c, m in zip(back, ("px1", "py1", "px2", "py2"), strict=True)])


_CODEC = f"""pt AS (SELECT frame_id, det_id, x1, y1, x2, y2, 320.0::DOUBLE AS px, 240.0::DOUBLE AS py, x2 - x1 AS w, y2 - y1 AS h FROM det)"""


@query(
    f"""{_D}, {_CODEC} SELECT frame_id, det_id, round(px - x1, 6) AS l, round(py - y1, 6) AS t, round(x2 - px, 6) AS r, round(y2 - py, 6) AS b,
  round((px - x1) / (w / 4 + 1e-16) - 2, 9) AS dl, round((y2 - py) / (h / 4 + 1e-16) - 2, 9) AS db,
  round(px - (2 + ((px - x1) / (w / 4 + 1e-16) - 2)) * (w / 4), 4) AS bx1, round(py + (2 + ((y2 - py) / (h / 4 + 1e-16) - 2)) * (h / 4), 4) AS by2 FROM pt"""
)
def distance_codec(spark, sf_dir):
    det = X.detections(spark, sf_dir).withColumns({"px": F.lit(320.0), "py": F.lit(240.0), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    d = G.edge_distances(F.col("px"), F.col("py"), G.box())
    point = G.box("", ("px", "py", "w", "h"))
    coded = G.corners_to_scaled(point, G.box(), 4.0)
    back = G.scaled_to_corners(point, coded, 4.0)
    return det.select(
        "frame_id", "det_id", *[r6(c, n) for c, n in zip(d, "ltrb", strict=True)],
        F.round(coded[0], 9).alias("dl"), F.round(coded[3], 9).alias("db"), F.round(back[0], 4).alias("bx1"), F.round(back[3], 4).alias("by2"),
    )


@query(
    f"""{_D}, pt AS (SELECT o_orderkey AS frame_id, o_custkey * 7 % 640 + 0.5::DOUBLE AS px, o_custkey * 13 % 480 + 0.5::DOUBLE AS py FROM orders)
  SELECT det.frame_id, det_id FROM pt JOIN det ON pt.frame_id = det.frame_id WHERE least(px - x1, py - y1, x2 - px, y2 - py) > 1e-9"""
)
def point_in_box(spark, sf_dir):
    at = lambda k, most: F.pmod(F.col("o_custkey") * k, F.lit(most)) + F.lit(0.5)
    points = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), at(7, 640).alias("px"), at(13, 480).alias("py"))
    return G.points_in_boxes(points, X.detections(spark, sf_dir)).select("frame_id", "det_id")


# the knots by rule: +-2 b at the ends, b = 0.5 * 4, and between them (b + 1) ^ (2 i / 30) - 1 on both sides of 0
_KNOTS = """(SELECT list_concat(list_concat(list_concat([-4.0::DOUBLE], list_transform(range(15, 0, -1), lambda i: 1 - pow(3.0::DOUBLE, 2.0 * i / 30))), [0.0::DOUBLE]),
  list_concat(list_transform(range(1, 16), lambda i: pow(3.0::DOUBLE, 2.0 * i / 30) - 1), [4.0::DOUBLE])))"""


@query(
    f"""{_D}, k AS (SELECT frame_id, det_id, CAST(edge - 1 AS INT) AS edge, ([x1, y1, x2, y2])[edge] / 50 AS v, {_KNOTS} AS knots FROM det, range(1, 5) e(edge)),
  b AS (SELECT *, len(list_filter(knots, lambda p: p <= v)) - 1 AS i FROM k)
  SELECT frame_id, det_id, edge, CASE WHEN i < 0 THEN 0.0 WHEN i >= 32 THEN 31.9 ELSE CAST(i AS DOUBLE) END AS bin,
  round(CASE WHEN i < 0 THEN 0.0 WHEN i >= 32 THEN 1.0 ELSE abs(v - knots[i + 1]) / (abs(v - knots[i + 1]) + abs(knots[i + 2] - v)) END, 6) AS weight_right,
  round(CASE WHEN i < 0 THEN 1.0 WHEN i >= 32 THEN 0.0 ELSE 1 - abs(v - knots[i + 1]) / (abs(v - knots[i + 1]) + abs(knots[i + 2] - v)) END, 6) AS weight_left FROM b"""
)
def knot_binning(spark, sf_dir):
    edges = X.detections(spark, sf_dir).select("frame_id", "det_id", F.posexplode(F.array(*G.box())).alias("edge", "v")).withColumn("v", F.col("v") / 50)
    k, right, left = G.bin_of(F.col("v"), G.knots(32, 0.5, 4.0))
    return edges.select("frame_id", "det_id", "edge", k.alias("bin"), r6(right, "weight_right"), r6(left, "weight_left"))


@query(
    """WITH lv(lvl, n) AS (VALUES (0, 80), (1, 40), (2, 20)), g AS (
  SELECT lvl, CAST(y.range AS INT) AS gy, CAST(x.range AS INT) AS gx, (x.range + 0.5) / n AS cx, (y.range + 0.5) / n AS cy, 0.05::DOUBLE * pow(2, lvl) AS side FROM lv, range(80) x, range(80) y WHERE x.range < n AND y.range < n)
  SELECT lvl, gx, gy, side > 0.01 AND side < 0.99 AND cx > 0.01 AND cx < 0.99 AND cy > 0.01 AND cy < 0.99 AS valid, round(ln(cx / (1 - cx)), 6) AS logit_x, round(ln(side / (1 - side)), 6) AS logit_side FROM g"""
)
def anchor_grid(spark, sf_dir):
    levels = spark.createDataFrame([(0, 80, 80), (1, 40, 40), (2, 20, 20)], "lvl int, nx int, ny int")
    logit = lambda c: F.ln(F.col(c) / (1 - F.col(c)))
    return G.anchor_grid(levels).select("lvl", "gx", "gy", "valid", r6(logit("cx"), "logit_x"), r6(logit("w"), "logit_side"))


@query("SELECT l_orderkey AS mask_id, CAST(min(l_partkey % 640) AS INT) AS x1, CAST(min(l_suppkey % 480) AS INT) AS y1, CAST(max(l_partkey % 640) AS INT) AS x2, CAST(max(l_suppkey % 480) AS INT) AS y2 FROM lineitem GROUP BY l_orderkey")
def mask_boxes(spark, sf_dir):
    x, y = F.pmod("l_partkey", F.lit(640)).cast("int"), F.pmod("l_suppkey", F.lit(480)).cast("int")
    return G.mask_boxes(X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mask_id"), x.alias("x"), y.alias("y")))


@query(
    f"""{_D}, c AS (SELECT frame_id, det_id, CAST(class_id AS INT) AS label, score FROM det), m(label, category) AS (VALUES (0, 1), (1, 18), (2, 44))
  SELECT frame_id, det_id, category FROM c JOIN m USING (label)"""
)
def label_remap(spark, sf_dir):
    table = spark.createDataFrame([(0, 1), (1, 18), (2, 44)], "class_id int, category int")
    return X.detections(spark, sf_dir).join(F.broadcast(table), "class_id").select("frame_id", "det_id", "category")


@query(f"{_D} SELECT frame_id, det_id, 'fine' AS part FROM det WHERE class_id = 0 UNION ALL SELECT frame_id, det_id, 'middle' FROM det WHERE class_id = 1 UNION ALL SELECT frame_id, det_id, 'coarse' FROM det WHERE class_id = 2")
def concat_levels(spark, sf_dir):
    det = X.detections(spark, sf_dir)
    level = lambda k, name: det.where(F.col("class_id") == k).select("frame_id", "det_id", F.lit(name).alias("part"))
    return level(0, "fine").unionByName(level(1, "middle")).unionByName(level(2, "coarse"))


def _normalised(spark, sf_dir, odd: bool):
    det = X.detections(spark, sf_dir).where(F.pmod("det_id", F.lit(2)) == int(odd))
    box = [c.alias(n) for c, n in zip(G.scale(G.corners_to_centre(G.box()), F.lit(1.0) / _W, F.lit(1.0) / _H), ("cx", "cy", "w", "h"), strict=True)]
    return det.select("frame_id", "det_id", "score", *box)


def costs(spark, sf_dir):
    p = detect.pairs(_normalised(spark, sf_dir, False), _normalised(spark, sf_dir, True))
    names = ("cx", "cy", "w", "h")
    probability = 0.05 + 0.9 * F.col("a_score")
    return p.select("frame_id", "a_det_id", "b_det_id", match.cost(probability, G.box("a_", names), G.box("b_", names)).alias("cost"))


_COSTS = f"""n AS (SELECT *, (x1 + x2) / 2 / {_W} AS cx, (y1 + y2) / 2 / {_H} AS cy, (x2 - x1) / {_W} AS w, (y2 - y1) / {_H} AS h FROM det),
  q AS (SELECT a.frame_id, a.det_id AS a_det_id, b.det_id AS b_det_id, 0.05 + 0.9 * a.score AS p,
    abs(a.cx - b.cx) + abs(a.cy - b.cy) + abs(a.w - b.w) + abs(a.h - b.h) AS l1,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas,
    (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull
    FROM n a JOIN n b ON a.frame_id = b.frame_id AND a.det_id % 2 = 0 AND b.det_id % 2 = 1),
  c AS (SELECT frame_id, a_det_id, b_det_id, 5 * l1 + 2 * (0.25 * (1 - p) * (1 - p) * -ln(p + 1e-8) - 0.75 * p * p * -ln(1 - p + 1e-8))
    - 2 * (inter / nullif(areas - inter, 0) - (hull - (areas - inter)) / nullif(hull, 0)) AS cost FROM q)"""


@query(f"{_D}, {_COSTS} SELECT frame_id, a_det_id, b_det_id, round(cost, 5) AS cost FROM c")
def match_cost(spark, sf_dir):
    return costs(spark, sf_dir).withColumn("cost", F.round("cost", 5))


# all ways to assign the shorter side, by the columns taken so far: the cheapest per set of columns goes on
@query(
    f"""WITH RECURSIVE {X.DETECTIONS_SQL}, {_COSTS},
  r AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY a_det_id) - 1 AS i, dense_rank() OVER (PARTITION BY frame_id ORDER BY b_det_id) - 1 AS j FROM c),
  z AS (SELECT frame_id, max(i) <= max(j) AS rows_first, least(max(i), max(j)) + 1 AS k FROM r GROUP BY frame_id),
  e AS (SELECT r.frame_id, CASE WHEN rows_first THEN i ELSE j END AS own, CASE WHEN rows_first THEN j ELSE i END AS taken, a_det_id, b_det_id, cost FROM r JOIN z ON r.frame_id = z.frame_id),
  s AS (SELECT frame_id, 0::BIGINT AS i, 0::BIGINT AS mask, 0.0::DOUBLE AS total, []::STRUCT(a BIGINT, b BIGINT, cost DOUBLE)[] AS path FROM z
    UNION ALL
    SELECT s.frame_id, s.i + 1, s.mask | (1::BIGINT << e.taken), min(s.total + e.cost), arg_min(list_append(s.path, {{'a': e.a_det_id, 'b': e.b_det_id, 'cost': e.cost}}), s.total + e.cost)
    FROM s JOIN e ON s.frame_id = e.frame_id AND e.own = s.i WHERE s.mask & (1::BIGINT << e.taken) = 0 GROUP BY s.frame_id, s.i + 1, s.mask | (1::BIGINT << e.taken)),
  best AS (SELECT s.frame_id, arg_min(path, total) AS path FROM s JOIN z ON s.frame_id = z.frame_id AND s.i = z.k GROUP BY s.frame_id)
  SELECT frame_id, p.a AS a_det_id, p.b AS b_det_id, round(p.cost, 5) AS cost FROM (SELECT frame_id, unnest(path) AS p FROM best)"""
)
def hungarian_match(spark, sf_dir):
    return match.hungarian(costs(spark, sf_dir)).withColumn("cost", F.round("cost", 5))


@query()
def repeated_match(spark, sf_dir):
    return match.hungarian(costs(spark, sf_dir), rounds=3).withColumn("cost", F.round("cost", 5))


def _round_sql(k: int) -> str:
    """SQL of round ``k`` of repeated matching: as ``hungarian_match``, over costs in which pairs of earlier rounds are dear."""
    before = " UNION ALL ".join(f"SELECT frame_id, a, b FROM pairs{i}" for i in range(k)) or "SELECT frame_id, a_det_id AS a, b_det_id AS b FROM c WHERE false"
    return f"""
  c{k} AS (SELECT c.frame_id, a_det_id, b_det_id, CASE WHEN t.a IS NULL THEN cost ELSE 1e6::DOUBLE END AS cost FROM c LEFT JOIN (SELECT DISTINCT * FROM ({before})) t ON c.frame_id = t.frame_id AND a_det_id = t.a AND b_det_id = t.b),
  r{k} AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY a_det_id) - 1 AS i, dense_rank() OVER (PARTITION BY frame_id ORDER BY b_det_id) - 1 AS j FROM c{k}),
  z{k} AS (SELECT frame_id, max(i) <= max(j) AS rows_first, least(max(i), max(j)) + 1 AS k FROM r{k} GROUP BY frame_id),
  e{k} AS (SELECT r.frame_id, CASE WHEN rows_first THEN i ELSE j END AS own, CASE WHEN rows_first THEN j ELSE i END AS taken, a_det_id, b_det_id, cost FROM r{k} r JOIN z{k} z ON r.frame_id = z.frame_id),
  s{k} AS (SELECT frame_id, 0::BIGINT AS i, 0::BIGINT AS mask, 0.0::DOUBLE AS total, []::STRUCT(a BIGINT, b BIGINT, cost DOUBLE)[] AS path FROM z{k}
    UNION ALL
    SELECT s.frame_id, s.i + 1, s.mask | (1::BIGINT << e.taken), min(s.total + e.cost), arg_min(list_append(s.path, {{'a': e.a_det_id, 'b': e.b_det_id, 'cost': e.cost}}), s.total + e.cost)
    FROM s{k} s JOIN e{k} e ON s.frame_id = e.frame_id AND e.own = s.i WHERE s.mask & (1::BIGINT << e.taken) = 0 GROUP BY s.frame_id, s.i + 1, s.mask | (1::BIGINT << e.taken)),
  pairs{k} AS (SELECT frame_id, p.a AS a, p.b AS b, p.cost AS cost FROM (SELECT s.frame_id, unnest(arg_min(path, total)) AS p FROM s{k} s JOIN z{k} z ON s.frame_id = z.frame_id AND s.i = z.k GROUP BY s.frame_id))"""


@query(
    f"WITH RECURSIVE {X.DETECTIONS_SQL}, {_COSTS}, {','.join(map(_round_sql, range(3)))} "
    + " UNION ALL ".join(f"SELECT frame_id, {k}::BIGINT AS round, count(*) AS pairs, round(sum(cost), 4) AS total FROM pairs{k} GROUP BY frame_id" for k in range(3))
)
def repeated_match_totals(spark, sf_dir):
    """What each round of repeated matching costs, a pair of an earlier round counting 1e6: the least there is, whichever of equal choices was made."""
    found = match.hungarian(costs(spark, sf_dir), rounds=3).repartition("frame_id")  # serves the window and the sums
    first = F.min("round").over(Window.partitionBy("frame_id", "a_det_id", "b_det_id"))
    paid = found.withColumn("paid", F.when(first < F.col("round"), F.lit(1e6)).otherwise(F.coalesce("cost", F.lit(1.0))))
    return paid.groupBy("frame_id", "round").agg(F.count("*").alias("pairs"), F.round(F.sum("paid"), 4).alias("total"))


_OVER = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"


@query(
    f"""WITH RECURSIVE {X.DETECTIONS_SQL},
  o AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, det_id) AS i,
    count(*) OVER (PARTITION BY frame_id, class_id) AS n FROM det WHERE score > 0.1),
  s AS (SELECT frame_id, class_id, n, 1::BIGINT AS i, [{{'det_id': det_id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': area}}] AS kept FROM o WHERE i = 1
    UNION ALL
    SELECT s.frame_id, s.class_id, s.n, s.i + 1, CASE WHEN len(list_filter(s.kept, lambda k: {_OVER.format(a="k", b="o")} > 0.7 * (k.area + o.area - {_OVER.format(a="k", b="o")}))) = 0
      THEN list_append(s.kept, {{'det_id': o.det_id, 'score': o.score, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'area': o.area}}) ELSE s.kept END
    FROM s JOIN o ON s.frame_id = o.frame_id AND s.class_id = o.class_id AND o.i = s.i + 1),
  k AS (SELECT frame_id, CAST(class_id AS BIGINT) AS class_id, unnest(kept) AS k FROM s WHERE i = n),
  t AS (SELECT frame_id, k.det_id AS det_id, class_id, k.score AS score, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY k.score DESC, k.det_id) AS INT) AS rank FROM k)
  SELECT * FROM t WHERE rank <= 100"""
)
def nms_greedy(spark, sf_dir):
    return detect.suppress(X.detections(spark, sf_dir), 0.7).select("frame_id", "det_id", "class_id", "score", "rank")


def _scored_and_truths(spark, sf_dir):
    """Fixture: the detections as truths, and two thirds of them, widened, as what a detector found."""
    det = X.detections(spark, sf_dir)
    return det.withColumns({"x1": F.col("x1") - 15, "x2": F.col("x2") + 15}).where(F.pmod("det_id", F.lit(3)) > 0), det


def _precision_sql(threshold: str, area: str = "true") -> str:
    """Greedy matching by recursion over a frame and class's detections, then the 101 points."""
    return f"""{X.DETECTIONS_SQL},
  tr AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM det), pr AS (SELECT frame_id, det_id, class_id, score, x1 - 15 AS x1, y1, x2 + 15 AS x2, y2, (x2 + 15 - (x1 - 15)) * (y2 - y1) AS area FROM det WHERE det_id % 3 > 0),
  o AS (SELECT p.frame_id, p.class_id, p.det_id, p.score, p.area, list({{'id': t.det_id, 'q': coalesce({_OVER.format(a="p", b="t")} / nullif(p.area + t.area - {_OVER.format(a="p", b="t")}, 0), 0), 'spare': NOT ({area.format("t.area")})}}
      ORDER BY NOT ({area.format("t.area")}), coalesce({_OVER.format(a="p", b="t")} / nullif(p.area + t.area - {_OVER.format(a="p", b="t")}, 0), 0) DESC, t.det_id) AS options
    FROM pr p JOIN tr t ON p.frame_id = t.frame_id AND p.class_id = t.class_id GROUP BY ALL),
  i AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, det_id) AS i FROM o),
  s AS (SELECT frame_id, class_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::DOUBLE AS score, NULL::BIGINT AS det_id, false AS hit, false AS ignored FROM i WHERE i = 1
    UNION ALL
    SELECT frame_id, class_id, n, CASE WHEN c IS NULL THEN used ELSE list_append(used, c.id) END, score, det_id, c IS NOT NULL AND NOT c.spare, CASE WHEN c IS NULL THEN outside ELSE c.spare END FROM (
      SELECT s.frame_id, s.class_id, i.i AS n, s.used, i.score, i.det_id, NOT ({area.format("i.area")}) AS outside, list_filter(i.options, lambda x: x.q >= {threshold} AND NOT list_contains(s.used, x.id))[1] AS c
      FROM s JOIN i ON s.frame_id = i.frame_id AND s.class_id = i.class_id AND i.i = s.i + 1)),
  m AS (SELECT *, sum(CAST(hit AS INT)) OVER w AS tp, row_number() OVER w AS n FROM s WHERE i > 0 AND NOT ignored WINDOW w AS (PARTITION BY class_id ORDER BY score DESC, frame_id, det_id)),
  pos AS (SELECT class_id, count(*) AS positives FROM tr WHERE {area.format("area")} GROUP BY class_id),
  u AS (SELECT pos.class_id, CAST(floor(tp / positives::DOUBLE * 100 + 1e-9) AS INT) AS reach, max(tp / n::DOUBLE) AS p FROM m JOIN pos ON m.class_id = pos.class_id GROUP BY ALL),
  pts AS (SELECT u.class_id, r.range AS point, max(p) AS best FROM u, range(101) r WHERE r.range <= u.reach GROUP BY ALL),
  ap AS (SELECT class_id, sum(best) / 101 AS ap FROM pts GROUP BY class_id)"""


@query(f"WITH RECURSIVE {_precision_sql('0.5')} SELECT CAST(pos.class_id AS BIGINT) AS class_id, round(coalesce(ap, 0), 6) AS ap, positives FROM pos LEFT JOIN ap ON pos.class_id = ap.class_id")
def average_precision(spark, sf_dir):
    return detect.average_precision(*_scored_and_truths(spark, sf_dir)).withColumn("ap", F.round("ap", 6))


@query(f"WITH RECURSIVE {_precision_sql('0.75', '{} BETWEEN 1024 AND 9216')} SELECT CAST(pos.class_id AS BIGINT) AS class_id, round(coalesce(ap, 0), 6) AS ap, positives, 0.75::DOUBLE AS threshold FROM pos LEFT JOIN ap ON pos.class_id = ap.class_id")
def average_precision_medium(spark, sf_dir):
    found = detect.average_precision(*_scored_and_truths(spark, sf_dir), threshold=(0.5, 0.75), area="medium")
    return found.where("threshold = 0.75").withColumn("ap", F.round("ap", 6))


@query("SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)) WHERE r = 1")
def match_vote(spark, sf_dir):
    return match.vote(X.table(spark, sf_dir, "events"), [], "user_id", "event_type").select("user_id", "event_type", "votes")


@query(f"{_D} SELECT a.frame_id, a.det_id, coalesce(m.label, 3) AS label FROM det a LEFT JOIN (SELECT frame_id, det_id, class_id AS label FROM det WHERE score > 0.6) m ON a.frame_id = m.frame_id AND a.det_id = m.det_id")
def class_goals(spark, sf_dir):
    det = X.detections(spark, sf_dir).select("frame_id", "det_id", "class_id", "score")
    matched = det.where("score > 0.6").select("frame_id", "det_id", F.col("class_id").alias("label"))
    return match.class_goals(det.select("frame_id", "det_id"), matched, ["frame_id", "det_id"], 3)


@query("SELECT greatest(count(*) / 8.0::DOUBLE, 1) AS num_boxes FROM lineitem")
def num_boxes(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").agg(F.greatest(F.count("*") / F.lit(8.0), F.lit(1.0)).alias("num_boxes"))


_GROUPS = """d AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) - 1 AS place, count(*) OVER (PARTITION BY frame_id) AS n FROM det),
  g AS (SELECT d.*, CAST(r.range AS INT) AS grp, CAST(r.range * n + place AS BIGINT) AS query FROM d, range(101) r WHERE r.range < greatest(CAST(floor(100 / n) AS INT), 1))"""


@query(f"{_D}, {_GROUPS} SELECT frame_id, det_id, grp, query FROM g")
def denoising_index(spark, sf_dir):
    return match.denoising_queries(X.detections(spark, sf_dir)).select("frame_id", "det_id", "grp", "query")


_DRAW = "CAST(CAST('0x' || substr(md5('5:{k}:' || CAST(frame_id AS VARCHAR) || ':' || CAST(query AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
_MOVED = "least(greatest({corner} + CASE WHEN {sign} < 0.5 THEN -1.0 ELSE 1.0 END * ({far} + {u}) * {side} / 2, 0.0), 1.0)"


def _moved(k: int, corner: str, side: str) -> str:
    return _MOVED.format(corner=corner, side=side, sign=_DRAW.format(k=2 + k), u=_DRAW.format(k=6 + k), far="CASE WHEN grp % 2 = 1 THEN 1.0 ELSE 0.0 END")


@query(
    f"""{_D}, {_GROUPS.replace("range(101)", "range(9)").replace("100 / n", "8 / n")}, n AS (SELECT *, (x1 + x2) / 2 / {_W} AS cx, (y1 + y2) / 2 / {_H} AS cy, (x2 - x1) / {_W} AS w, (y2 - y1) / {_H} AS h FROM g),
  m AS (SELECT frame_id, query, CASE WHEN {_DRAW.format(k=0)} < 0.25 THEN CAST(floor({_DRAW.format(k=1)} * 80) AS INT) ELSE class_id END AS label,
    {_moved(0, "cx - greatest(w, 0) / 2", "w")} AS a, {_moved(1, "cy - greatest(h, 0) / 2", "h")} AS b, {_moved(2, "cx + greatest(w, 0) / 2", "w")} AS c, {_moved(3, "cy + greatest(h, 0) / 2", "h")} AS d FROM n)
  SELECT frame_id, query, label, round(abs((a + c) / 2), 6) AS cx, round(abs((b + d) / 2), 6) AS cy, round(abs(c - a), 6) AS w, round(abs(d - b), 6) AS h FROM m"""
)
def denoising_noise(spark, sf_dir):
    box = {n: c for n, c in zip(("cx", "cy", "w", "h"), G.scale(G.corners_to_centre(G.box()), F.lit(1.0) / _W, F.lit(1.0) / _H), strict=True)}
    det = X.detections(spark, sf_dir).select("frame_id", "det_id", F.col("class_id").alias("label"), *[c.alias(n) for n, c in box.items()])
    noisy = match.noised(match.denoising_queries(det, 8), 80, 5, ["frame_id", "query"], negative=F.col("grp") % 2 == 1)
    return noisy.select("frame_id", "query", "label", *[r6(F.col(c), c) for c in ("cx", "cy", "w", "h")])


@query(f"{_D}, {_COSTS}, m AS (SELECT frame_id, a_det_id AS query, arg_min(b_det_id, cost) AS target FROM c GROUP BY ALL) SELECT m.frame_id, m.query, det.class_id, det.x1 FROM m JOIN det ON m.frame_id = det.frame_id AND m.target = det.det_id")
def gathered_targets(spark, sf_dir):
    nearest = costs(spark, sf_dir).groupBy("frame_id", F.col("a_det_id").alias("query")).agg(F.min_by("b_det_id", "cost").alias("target"))
    targets = X.detections(spark, sf_dir).select("frame_id", F.col("det_id").alias("target"), "class_id", "x1")
    return match.matched_targets(nearest, targets, "frame_id").select("frame_id", "query", "class_id", "x1")


@query("WITH q AS (SELECT CAST(range AS INT) AS i FROM range(60)) SELECT a.i AS query, b.i AS key, b.i < 40 AND NOT (a.i < 40 AND a.i // 8 = b.i // 8) AS masked FROM q a, q b")
def denoising_mask(spark, sf_dir):
    place = F.sequence(F.lit(0), F.lit(59))
    q = spark.range(1).select(F.explode(place).alias("query")).select("query", F.explode(place).alias("key"))
    noisy = lambda c: F.col(c) < 40
    same = F.floor(F.col("query") / 8) == F.floor(F.col("key") / 8)
    return q.withColumn("masked", noisy("key") & ~(noisy("query") & same))


def _drawn(name: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('9:{name}:' || CAST(frame_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


def _truths(spark, sf_dir):
    return X.detections(spark, sf_dir).withColumns({"width": F.lit(_W), "height": F.lit(_H)})


@query(
    f"""{_D}, f AS (SELECT *, {_drawn("flip")} < 0.5 AS flip, CASE WHEN {_drawn("zoom")} < 0.5 THEN 1 + {_drawn("ratio")} * 3 ELSE 1.0 END AS zoom FROM det),
  z AS (SELECT *, CAST(floor({_W} * zoom) AS INT) AS width, CAST(floor({_H} * zoom) AS INT) AS height FROM f),
  o AS (SELECT *, CAST(floor({_drawn("left")} * (width - {_W} + 1)) AS INT) AS l, CAST(floor({_drawn("top")} * (height - {_H} + 1)) AS INT) AS t FROM z)
  SELECT frame_id, det_id, flip, width, height, round(CASE WHEN flip THEN {_W} - x2 ELSE x1 END + l, 6) AS x1, round(CASE WHEN flip THEN {_W} - x1 ELSE x2 END + l, 6) AS x2, round(y1 + t, 6) AS y1 FROM o"""
)
def augmented_boxes(spark, sf_dir):
    out = augment.zoomed_out(augment.flipped(_truths(spark, sf_dir), 9, "frame_id"), 9, "frame_id")
    return out.select("frame_id", "det_id", "flip", "width", "height", *[r6(F.col(c), c) for c in ("x1", "x2", "y1")])


@query(
    f"""{_D}, p AS (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY {_drawn("mosaic").replace("frame_id", "o_orderkey")}, o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders)
  SELECT det.frame_id, det_id, n // 4 AS mosaic, CAST(n % 4 AS INT) AS quarter, round(x1 * 0.5 + (n % 4) % 2 * 320, 6) AS x1, round(y2 * (320 / 480.0::DOUBLE) + (n % 4) // 2 * 320, 6) AS y2
  FROM det JOIN p ON det.frame_id = p.frame_id WHERE n // 4 * 4 + 4 <= c"""
)
def mosaic_boxes(spark, sf_dir):
    out = augment.mosaic(_truths(spark, sf_dir), X.frames(spark, sf_dir), 9, 640, "frame_id")
    return out.select("frame_id", "det_id", "mosaic", "quarter", r6(F.col("x1"), "x1"), r6(F.col("y2"), "y2"))


_CROWD_PAIRS = f"""WITH {X.CROWD_SQL}, p AS (SELECT a.frame_id, a.det_id AS a_det_id, b.det_id AS b_det_id, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t,
    (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS o
  FROM crowd a JOIN crowd b ON a.frame_id = b.frame_id AND a.det_id < b.det_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"""


@query(f"{_CROWD_PAIRS} SELECT frame_id, a_det_id, b_det_id, round(i / (s + t - i), 6) AS iou, round(i / (s + t - i) - (o - (s + t - i)) / o, 6) AS giou FROM p")
def crowd_pairs(spark, sf_dir):
    """All pairs that overlap on crowded frames, by tiles."""
    pairs = spatial.overlapping(X.crowd(spark, sf_dir))
    iou, _, giou = spatial.overlap_figures(pairs)
    return pairs.select("frame_id", "a_det_id", "b_det_id", r6(iou, "iou"), r6(giou, "giou"))


@query(
    f"""WITH {X.CROWD_SQL}, pt AS (SELECT o_orderkey AS point_id, o_custkey % 16 AS frame_id, CAST((o_orderkey * 37 + o_custkey * 11) % 20000 AS DOUBLE) AS x, CAST(o_orderkey * 91 % 20000 AS DOUBLE) AS y FROM orders)
  SELECT point_id, det_id FROM pt JOIN crowd ON pt.frame_id = crowd.frame_id AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2"""
)
def points_in_crowd(spark, sf_dir):
    """Many points against the boxes of crowded frames."""
    o = X.table(spark, sf_dir, "orders")
    place = lambda e: F.pmod(e, F.lit(20000)).cast("double")
    points = o.select(F.col("o_orderkey").alias("point_id"), F.pmod("o_custkey", F.lit(16)).alias("frame_id"), place(F.col("o_orderkey") * 37 + F.col("o_custkey") * 11).alias("x"), place(F.col("o_orderkey") * 91).alias("y"))
    return spatial.containing(points, X.crowd(spark, sf_dir)).select(F.col("p_point_id").alias("point_id"), F.col("b_det_id").alias("det_id"))


_PLACES = """pl AS (SELECT l_orderkey AS query_id, l_linenumber AS point, l_partkey % 500 AS map, ((l_linenumber * 37 + l_suppkey * 7) % 120)::DOUBLE / 100 - 0.1::DOUBLE AS x, ((l_partkey * 13 + l_linenumber * 29) % 120)::DOUBLE / 100 - 0.1::DOUBLE AS y, l_quantity / 50 AS weight FROM lineitem),
  px AS (SELECT vec_id AS map, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda e: F.pmod(e, F.lit(120)).cast("double") / 100 - 0.1
    line = X.table(spark, sf_dir, "lineitem")
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    return line.select(F.col("l_orderkey").alias("query_id"), n.alias("point"), F.pmod(p, F.lit(500)).alias("map"), part(n * 37 + s * 7).alias("x"), part(p * 13 + n * 29).alias("y"), (F.col("l_quantity") / 50).alias("weight"))


@query(
    f"""WITH {_PLACES}, t AS (SELECT query_id, map, weight, floor(x * 8 - 0.5) + dx AS tx, floor(y * 8 - 0.5) + dy AS ty,
    CASE WHEN dx = 0 THEN 1 - (x * 8 - 0.5 - floor(x * 8 - 0.5)) ELSE x * 8 - 0.5 - floor(x * 8 - 0.5) END * CASE WHEN dy = 0 THEN 1 - (y * 8 - 0.5 - floor(y * 8 - 0.5)) ELSE y * 8 - 0.5 - floor(y * 8 - 0.5) END AS share
    FROM pl, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy))
  SELECT query_id, round(coalesce(sum(weight * share * value), 0), 6) AS value FROM t LEFT JOIN px ON t.map = px.map AND tx = px.x AND ty = px.y GROUP BY query_id"""
)
def deformable_sampling(spark, sf_dir):
    """Attention over sampled places: the embeddings as maps of 8 x 8, sampled between their pixels."""
    pixels = sampling.as_pixels(X.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    out = sampling.sampled(_places(spark, sf_dir), pixels, ["query_id"], 8, 8, weight="weight")
    return out.select("query_id", r6(F.col("value"), "value"))


@query(
    f"""WITH {_PLACES} SELECT query_id, point, round(coalesce(sum(value), 0), 6) AS value
  FROM pl LEFT JOIN px ON pl.map = px.map AND px.x = least(greatest(CAST(trunc(pl.x * 8 + 0.5) AS INT), 0), 7) AND px.y = least(greatest(CAST(trunc(pl.y * 8 + 0.5) AS INT), 0), 7) GROUP BY query_id, point"""
)
def discrete_sampling(spark, sf_dir):
    pixels = sampling.as_pixels(X.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    out = sampling.sampled(_places(spark, sf_dir), pixels, ["query_id", "point"], 8, 8, "discrete")
    return out.select("query_id", "point", r6(F.col("value"), "value"))


def _drawn_trial(name: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('9:{name}:' || frame_id || ':' || t), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


@query(
    f"""{_D}, i AS (SELECT frame_id, CASE WHEN {_drawn("crop")} < 0.8 THEN [0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0][CAST(floor({_drawn("overlap")} * 7) AS INT) + 1]::DOUBLE ELSE 1 END AS least FROM det GROUP BY frame_id),
  s AS (SELECT *, CAST(floor({_W} * (0.3::DOUBLE + 0.7::DOUBLE * {_drawn_trial("crop-w")})) AS INT) AS w, CAST(floor({_H} * (0.3::DOUBLE + 0.7::DOUBLE * {_drawn_trial("crop-h")})) AS INT) AS h FROM i, range(40) r(t) WHERE least < 1),
  c AS (SELECT *, CAST(floor(({_W} - w) * {_drawn_trial("crop-x")}) AS INT) AS l, CAST(floor(({_H} - h) * {_drawn_trial("crop-y")}) AS INT) AS o FROM s WHERE w::DOUBLE / h BETWEEN 0.5 AND 2),
  b AS (SELECT c.frame_id, t, c.w, h, l, o, least, greatest(least(x2, l + c.w) - greatest(x1, l), 0) * greatest(least(y2, o + h) - greatest(y1, o), 0) AS inter, (x2 - x1) * (y2 - y1) AS area
    FROM c JOIN det ON c.frame_id = det.frame_id WHERE (x1 + x2) / 2 > l AND (x1 + x2) / 2 < l + c.w AND (y1 + y2) / 2 > o AND (y1 + y2) / 2 < o + h),
  f AS (SELECT DISTINCT ON (frame_id) frame_id, t, w, h, l, o FROM b WHERE coalesce(inter / nullif(area + w * h - inter, 0), 0) >= least ORDER BY frame_id, t)
  SELECT det.frame_id, det_id, CAST(coalesce(t, -1) AS INT) AS trial, coalesce(w, {_W}) AS width, round(CASE WHEN t IS NULL THEN x1 ELSE least(greatest(x1, l), l + w) - l END, 6) AS x1, round(CASE WHEN t IS NULL THEN y2 ELSE least(greatest(y2, o), o + h) - o END, 6) AS y2
  FROM det LEFT JOIN f ON det.frame_id = f.frame_id WHERE t IS NULL OR ((x1 + x2) / 2 > l AND (x1 + x2) / 2 < l + w AND (y1 + y2) / 2 > o AND (y1 + y2) / 2 < o + h)"""
)
def cropped_boxes(spark, sf_dir):
    """Random windows that a box overlaps enough; trial is -1 for images left alone."""
    out = augment.overlap_cropped(_truths(spark, sf_dir), 9, "frame_id")
    return out.select("frame_id", "det_id", F.coalesce("trial", F.lit(-1)).alias("trial"), "width", r6(F.col("x1"), "x1"), r6(F.col("y2"), "y2"))


def _turn(p: str) -> str:
    """SQL of one walk of ``augment.Permutation`` with seed 9, digits of radix a and b."""
    h = lambda turn, d: f"CAST('0x' || substr(md5('9:{turn}:' || {d}), 1, 8) AS BIGINT)"
    return f"""(SELECT l2 * b + (r1 + {h(3, 'l2')}) % b FROM (SELECT (l1 + {h(2, 'r1')}) % a AS l2, r1 FROM (SELECT l1, (r0 + {h(1, 'l1')}) % b AS r1 FROM (SELECT (l0 + {h(0, 'r0')}) % a AS l1, r0 FROM (SELECT {p} // b AS l0, {p} % b AS r0)))))"""


@query(
    f"""WITH RECURSIVE {X.DETECTIONS_SQL}, p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
  ab AS (SELECT b, (n + b - 1) // b AS a FROM (SELECT max(n) AS n, CAST(floor(sqrt(max(n))) AS BIGINT) AS root FROM p), range(64) r(d), LATERAL (SELECT root + d AS b) ORDER BY (n + b - 1) // b * b, b LIMIT 1),
  w AS (SELECT id, n, a, b, {_turn("place")} AS v FROM p, ab UNION ALL SELECT id, n, a, b, {_turn("v")} FROM w WHERE v >= n),
  q AS (SELECT id, n, v FROM w WHERE v < n),
  m AS (SELECT x.id AS base, y.id AS partner, 0.45::DOUBLE + 0.1::DOUBLE * (CAST(CAST('0x' || substr(md5('9:blend:' || x.id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496) AS share FROM q x JOIN q y ON (x.v + 1) % x.n = y.v),
  e AS (SELECT base, base AS id, share AS weight FROM m UNION ALL SELECT base, partner, 1 - share FROM m)
  SELECT base, frame_id, det_id, round(weight, 9) AS weight FROM e JOIN det ON e.id = det.frame_id"""
)
def mixup_boxes(spark, sf_dir):
    out = augment.mixed_up(_truths(spark, sf_dir), X.frames(spark, sf_dir), 9, "frame_id")
    return out.select("base", "frame_id", "det_id", F.round("weight", 9).alias("weight"))
