"""Queries over metric series, schedules, losses and parameter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import maths as M
from ..operators import detect, frames, match, metrics
from . import fixtures as X
from .catalog import query
from .detection_queries import r6

_M = "WITH " + X.METRICS_SQL


def _doubles(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("value", "median", "largest") else c for c in df.columns])


# means of exact decimal sums, divided once, are equal to the last bit: nothing is rounded
@query(
    f"""{_M} SELECT name, step, value, quantile_disc(value, 0.5) OVER w AS median, CAST(sum(exact) OVER w AS DOUBLE) / count(*) OVER w AS average, max(value) OVER w AS largest
  FROM metrics WINDOW w AS (PARTITION BY name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def meter_rolling(spark, sf_dir):
    return _doubles(metrics.rolling(X.exact_metrics(spark, sf_dir)))


@query(f"{_M} SELECT name, step, value, value AS median, CAST(exact AS DOUBLE) AS average, value AS largest FROM metrics")
def meter_last(spark, sf_dir):
    return _doubles(metrics.rolling(X.exact_metrics(spark, sf_dir), 1))


@query(
    f"""{_M} SELECT name, step, CAST(sum(exact) OVER w AS DOUBLE) / count(*) OVER w AS global_avg,
    CAST(sum(exact) OVER w AS DOUBLE) / count(*) OVER w * (count(*) OVER (PARTITION BY name) - row_number() OVER (PARTITION BY name ORDER BY step)) AS eta
  FROM metrics WINDOW w AS (PARTITION BY name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def meter_running(spark, sf_dir):
    return metrics.running(X.exact_metrics(spark, sf_dir))


@query(f"{_M} SELECT name, round(sum(value * (1 + user_id % 4)) / sum(1 + user_id % 4), 5) AS weighted FROM metrics GROUP BY name")
def meter_weighted_avg(spark, sf_dir):
    n = 1 + F.pmod("user_id", F.lit(4))
    return X.metrics(spark, sf_dir).groupBy("name").agg(F.round(metrics.weighted_average(F.col("value"), n), 5).alias("weighted"))


@query(f"{_M}, r AS (SELECT name, user_id % 8 AS worker, sum(exact) AS v FROM metrics GROUP BY ALL) SELECT name, CAST(sum(v) AS DOUBLE) / 8 AS reduced FROM r GROUP BY name")
def distributed_mean(spark, sf_dir):
    per = X.exact_metrics(spark, sf_dir).groupBy("name", F.pmod("user_id", F.lit(8)).alias("worker")).agg(F.sum("value").alias("v"))
    return per.groupBy("name").agg((F.sum("v").cast("double") / 8).alias("reduced"))


@query(f"{_M}, r AS (SELECT name, user_id % 8 AS worker, max(exact) AS v FROM metrics GROUP BY ALL) SELECT name, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY worker) AS gathered FROM r GROUP BY name")
def gathered_values(spark, sf_dir):
    per = X.exact_metrics(spark, sf_dir).groupBy("name", F.pmod("user_id", F.lit(8)).alias("worker")).agg(F.max("value").alias("v"))
    texts = F.transform(metrics.gather(F.col("v"), F.col("worker")), lambda v: v.cast("string"))
    return per.groupBy("name").agg(F.array_join(texts, " ").alias("gathered"))


@query(f"{_M} SELECT name, step // 50 AS epoch, coalesce(round(avg(exact) FILTER (WHERE user_id % 3 > 0), 6), 0) AS share FROM metrics GROUP BY name, step // 50")
def epoch_share(spark, sf_dir):
    """The mean share of each epoch, over the steps that measured one; 0 for an epoch without any."""
    measured = F.when(F.pmod("user_id", F.lit(3)) > 0, F.col("value"))
    return X.metrics(spark, sf_dir).groupBy("name", F.floor(F.col("step") / 50).alias("epoch")).agg(r6(metrics.share_mean(measured), "share"))


# the fold as a weighted sum: x_n counts (1 - d(n)) d(n + 1) ... d(N), the product as a difference of sums of logarithms
@query(
    f"""{_M}, s AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY step) AS n FROM metrics),
  d AS (SELECT *, 0.999::DOUBLE * (1 - exp(-n / 100.0::DOUBLE)) AS d FROM s),
  l AS (SELECT *, sum(ln(d)) OVER (PARTITION BY name ORDER BY n) AS log, sum(ln(d)) OVER (PARTITION BY name) AS all_log FROM d)
  SELECT name, round(sum(value * (1 - d) * exp(all_log - log)), 5) AS ema FROM l GROUP BY name"""
)
def ema_fold(spark, sf_dir):
    return metrics.ema(X.metrics(spark, sf_dir), 0.999, 100).withColumn("ema", F.round("ema", 5))


@query(
    """SELECT event_id AS step, round(CASE WHEN event_id <= 500 THEN 0.0004 * pow(event_id / 500.0::DOUBLE, 2) WHEN event_id <= 4000 THEN 0.0004 WHEN event_id >= 9000 THEN 0.0002
  ELSE 0.0002 + 0.0002 * 0.5 * (1 + cos(pi() * (event_id - 4000) / 5000.0::DOUBLE)) END, 12) AS lr FROM events"""
)
def lr_schedule(spark, sf_dir):
    step = F.col("event_id")
    return X.table(spark, sf_dir, "events").select(step.alias("step"), F.round(M.flat_cosine(step, 10_000, 500, 4000, 1000, 0.0004, 0.0002), 12).alias("lr"))


@query("SELECT event_id AS step, least(1.0::DOUBLE, (event_id + 1) / 2000.0::DOUBLE) AS factor FROM events")
def warmup_factor(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), M.linear_warmup(F.col("event_id"), 2000).alias("factor"))


@query(
    """WITH p AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) AS share, 1 + CAST(event_id % 9 AS DOUBLE) AS w, event_id % 50 = 49 AS late FROM events),
  g AS (SELECT *, CASE WHEN share < 15 THEN 25.0::DOUBLE ELSE 15.0::DOUBLE END / 100 AS goal, share / 100 AS q FROM p)
  SELECT event_id, round(CASE WHEN share < 1e-6 OR late THEN 5.0 WHEN share BETWEEN 15 AND 25 OR w <= 1e-6 OR abs(q * (1 - goal)) < 1e-9 THEN w
    ELSE least(greatest(w * greatest(goal * (1 - q) / nullif(q * (1 - goal), 0), 0.1), w / 10), w * 10) END, 6) AS weight FROM g"""
)
def adaptive_weight(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    share, weight = F.pmod("event_id", F.lit(101)).cast("double"), 1 + F.pmod("event_id", F.lit(9)).cast("double")
    return e.select("event_id", r6(M.adapted_weight(share, weight, 20.0, 5.0, 5.0, F.pmod("event_id", F.lit(50)) == 49), "weight"))


@query(
    f"""{_M}, s AS (SELECT *, step // 2000 AS stage FROM metrics), b AS (SELECT name, stage, step, value, max(value) OVER (PARTITION BY name, stage ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
  SELECT name, stage, step, greatest(value, coalesce(before, value)) AS best, before IS NULL OR value > before AS improved FROM b"""
)
def best_epoch(spark, sf_dir):
    return metrics.best_so_far(X.metrics(spark, sf_dir), F.floor(F.col("step") / 2000))


@query("SELECT l_orderkey, coalesce(round(100 * sum(CASE WHEN l_returnflag = 'R' THEN abs(l_tax) ELSE 0 END) / nullif(sum(abs(l_tax)), 0), 5), 0) AS share FROM lineitem GROUP BY l_orderkey")
def grad_share(spark, sf_dir):
    size = F.abs("l_tax")
    part = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", size).otherwise(0.0)).alias("own"), F.sum(size).alias("all"))
    return part.select("l_orderkey", F.round(M.gradient_share(F.col("own"), F.col("all")), 5).alias("share"))


@query(
    """SELECT event_type, count(*) FILTER (WHERE value > 99 OR value < 2) AS n_bad, count(*) FILTER (WHERE value > 150) AS n_huge,
  round(avg(CASE WHEN value > 99 OR value < 2 THEN 0 ELSE value END), 5) AS mean_kept FROM events GROUP BY event_type"""
)
def nonfinite_guard(spark, sf_dir):
    v = F.col("value")
    odd = F.when(v > 150, F.lit(float("inf"))).when(v > 99, F.lit(float("nan"))).when(v < 2, F.lit(float("-inf"))).otherwise(v)
    e = X.table(spark, sf_dir, "events").withColumn("v", odd)
    kept = F.when(M.is_finite(F.col("v")), F.col("v")).otherwise(0.0)
    huge = M.finite_number(F.col("v")) >= M.FLOAT_MAX
    return e.groupBy("event_type").agg(F.count(F.when(~M.is_finite(F.col("v")), 1)).alias("n_bad"), F.count(F.when(huge, 1)).alias("n_huge"), F.round(F.avg(kept), 5).alias("mean_kept"))


_LOGITS = """t AS (SELECT frame_id, det_id, class_id = 1 AS hit, CAST(class_id = 1 AS DOUBLE) AS y, score * 4 - 2 AS z, CAST(det_id % 5 AS DOUBLE) / 5 AS quality, 1 / (1 + exp(-(score * 4 - 2))) AS p FROM det)"""
_BCE = "(greatest(z, 0) - z * {g} + ln(1 + exp(-abs(z))))"


@query(
    f"""WITH {X.DETECTIONS_SQL}, {_LOGITS}
  SELECT round(sum((0.25 * y + 0.75 * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * {_BCE.format(g="y")}) / greatest(sum(y), 1), 5) AS focal,
  round(sum((0.75 * p * p * (1 - y) + quality * y) * {_BCE.format(g="(quality * y)")}) / greatest(sum(y), 1), 5) AS varifocal,
  round(sum((pow(p, 1.5) * (1 - y) + y) * {_BCE.format(g="pow(quality * y, 1.5)")}) / greatest(sum(y), 1), 5) AS matchability FROM t"""
)
def label_losses(spark, sf_dir):
    t = X.detections(spark, sf_dir).select((F.col("class_id") == 1).cast("double").alias("y"), (F.col("score") * 4 - 2).alias("z"), (F.pmod("det_id", F.lit(5)).cast("double") / 5).alias("quality"))
    y, z, q = map(F.col, ("y", "z", "quality"))
    per = lambda loss, name: F.round(F.sum(loss) / F.greatest(F.sum("y"), F.lit(1.0)), 5).alias(name)
    return t.agg(per(M.focal_loss(z, y), "focal"), per(M.varifocal_loss(z, y, q), "varifocal"), per(M.matchability_loss(z, y, q), "matchability"))


@query(
    f"""WITH {X.DETECTIONS_SQL}, p AS (SELECT a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
    FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.class_id = b.class_id AND a.det_id < b.det_id),
  q AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS inter,
    (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) AS areas, (greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)) AS hull FROM p)
  SELECT round(sum(abs(ax1 - bx1) + abs(ay1 - by1) + abs(ax2 - bx2) + abs(ay2 - by2)) / count(*), 4) AS l1,
    round(sum(1 - (inter / nullif(areas - inter, 0) - (hull - (areas - inter)) / nullif(hull, 0))) / count(*), 5) AS giou FROM q"""
)
def box_losses(spark, sf_dir):
    p = detect.pairs(X.detections(spark, sf_dir)).where("a_class_id = b_class_id")
    a, b = G.box("a_"), G.box("b_")
    l1 = G.total(F.abs(x - y) for x, y in zip(a, b, strict=True))
    return p.agg(F.round(F.sum(l1) / F.count("*"), 4).alias("l1"), F.round(F.sum(1 - G.giou(a, b)) / F.count("*"), 5).alias("giou"))


@query(
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS e, (vec_id % 60) + 0.25 AS pos FROM embeddings)
  SELECT vec_id, round(-ln(e[CAST(floor(pos) AS INT) + 1] / list_sum(e)) * 0.75 - ln(e[CAST(floor(pos) AS INT) + 2] / list_sum(e)) * 0.25, 6) AS loss FROM s"""
)
def distribution_losses(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", M.softmax(F.col("embedding")).alias("p"))
    return e.select("vec_id", r6(M.distribution_loss(F.col("p"), F.pmod("vec_id", F.lit(60)), F.lit(0.25), F.lit(0.75)), "loss"))


@query(
    """WITH m AS (SELECT p_partkey AS id, p_name || '#' || p_partkey AS name, p_size AS shape FROM part), s AS (SELECT p_name || '#' || p_partkey AS name, p_size + CAST(p_partkey % 2 AS INT) AS shape FROM part WHERE p_partkey % 3 <> 0)
  SELECT m.id, m.name, CASE WHEN s.name IS NULL THEN 'missed' WHEN s.shape = m.shape THEN 'matched' ELSE 'unmatched' END AS state FROM m LEFT JOIN s ON m.name = s.name"""
)
def statedict_join(spark, sf_dir):
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name")
    part = X.table(spark, sf_dir, "part")
    stored = part.where(F.pmod("p_partkey", F.lit(3)) != 0).select(name, (F.col("p_size") + F.pmod("p_partkey", F.lit(2)).cast("int")).alias("shape"))
    return match.match_states(part.select(F.col("p_partkey").alias("id"), name, F.col("p_size").alias("shape")), stored).select("id", "name", "state")


@query(
    """WITH m AS (SELECT p_partkey, p_brand || '.' || p_type AS name FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(name, '1.*STEEL|STEEL.*1') THEN 0 WHEN regexp_matches(name, '^Brand#2') THEN 1 ELSE 2 END AS group_id,
  CAST(regexp_matches(name, '1.*STEEL|STEEL.*1') AS INT) + CAST(regexp_matches(name, '^Brand#2') AS INT) AS n_groups FROM m"""
)
def param_groups(spark, sf_dir):
    names = X.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type").alias("name"))
    return match.parameter_groups(names, ["1.*STEEL|STEEL.*1", "^Brand#2"]).select("p_partkey", "group_id", "n_groups")


@query("SELECT n_name AS name FROM nation EXCEPT ALL SELECT n_name FROM nation WHERE n_regionkey = 1")
def param_difference(spark, sf_dir):
    nation = X.table(spark, sf_dir, "nation")
    return nation.select(F.col("n_name").alias("name")).exceptAll(nation.where("n_regionkey = 1").select(F.col("n_name").alias("name")))


@query("SELECT count(*) AS n_absent FROM nation n WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey)")
def subset_check(spark, sf_dir):
    nation, region = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left_anti").agg(F.count("*").alias("n_absent"))


@query("SELECT CAST(i.r - 1 AS INT) AS new_position, n_name FROM (VALUES (1, 7), (2, 3), (3, 24), (4, 0)) i(r, old) JOIN nation ON n_nationkey = i.old")
def head_remap(spark, sf_dir):
    rows = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), "n_name")
    return match.remap_head(rows, [7, 3, 24, 0]).select("new_position", "n_name")


@query("SELECT p_brand, CAST(sum(CAST(p_size AS BIGINT) * (1 + p_partkey % 5)) AS BIGINT) AS n_params FROM part GROUP BY p_brand")
def param_count(spark, sf_dir):
    shape = F.array(F.col("p_size").cast("long"), 1 + F.pmod("p_partkey", F.lit(5)))
    return X.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)).alias("n_params"))


@query(
    """WITH e AS (SELECT vec_id, i - 1 AS place, least(greatest(CAST(embedding[i] AS DOUBLE), 0), 1) AS p FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
  SELECT vec_id, CAST(place AS INT) AS place, round(ln(greatest(p, 1e-5) / greatest(1 - p, 1e-5)), 6) AS logit FROM e"""
)
def inverse_sigmoid(spark, sf_dir):
    each = X.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "p"))
    return each.select("vec_id", "place", r6(M.inverse_sigmoid(F.col("p").cast("double")), "logit"))


@query(
    """SELECT user_id // 100 AS epoch, '{"epoch":' || CAST(user_id // 100 AS VARCHAR) || ',"n":' || CAST(count(*) AS VARCHAR) || ',"largest":' || CAST(CAST(floor(max(value)) AS BIGINT) AS VARCHAR) || '}' AS line FROM events GROUP BY user_id // 100"""
)
def train_log(spark, sf_dir):
    epoch = F.floor(F.col("user_id") / 100).alias("epoch")
    per = X.table(spark, sf_dir, "events").groupBy(epoch).agg(F.count("*").alias("n"), F.floor(F.max("value")).alias("largest"))
    return per.select("epoch", F.to_json(F.struct("epoch", "n", "largest")).alias("line"))


_PAIRS = """d AS (SELECT a.vec_id, list_transform(a.embedding, lambda v: CAST(v AS DOUBLE) * 4) AS s, list_transform(b.embedding, lambda v: CAST(v AS DOUBLE) * 4) AS t
    FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id)"""


@query(
    f"""WITH {_PAIRS}, e AS (SELECT vec_id, list_transform(s, lambda v: v / 5) AS s, list_transform(t, lambda v: v / 5) AS t FROM d),
  l AS (SELECT vec_id, list_transform(s, lambda v: v - ln(list_sum(list_transform(s, lambda u: exp(u))))) AS s, list_transform(t, lambda v: v - ln(list_sum(list_transform(t, lambda u: exp(u))))) AS t FROM e),
  k AS (SELECT vec_id, 25 * list_sum(list_transform(list_zip(t, s), lambda z: exp(z[1]) * (z[1] - z[2]))) AS loss, CASE WHEN vec_id % 3 = 0 THEN 0.75 ELSE 0.25 END AS w, vec_id % 3 = 0 AS matched FROM l)
  SELECT round((avg(w * loss) FILTER (WHERE matched) * sqrt(count(*) FILTER (WHERE matched)) + avg(w * loss) FILTER (WHERE NOT matched) * sqrt(count(*) FILTER (WHERE NOT matched)))
    / (sqrt(count(*) FILTER (WHERE matched)) + sqrt(count(*) FILTER (WHERE NOT matched))), 6) AS loss FROM k"""
)
def decoupled_loss(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 4).alias("student"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("student").alias("teacher"))
    matched = F.pmod("vec_id", F.lit(3)) == 0
    rows = e.join(other, "vec_id").select(M.distillation_divergence(F.col("student"), F.col("teacher")).alias("loss"), F.when(matched, 0.75).otherwise(0.25).alias("w"), matched.alias("matched"))
    return rows.agg(r6(M.decoupled_loss(F.col("loss"), F.col("w"), F.col("matched")), "loss"))


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_sum(list_transform(list_zip(s, t), lambda z: CASE WHEN z[1] > 0 OR z[2] > 0 THEN (z[1] - z[2]) * (z[1] - z[2]) ELSE 0 END)), 6) AS loss FROM d")
def masked_feature_loss(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 4).alias("f"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("f").alias("t"))
    return e.join(other, "vec_id").select("vec_id", r6(M.add_up(F.zip_with("f", "t", M.masked_square)), "loss"))


@query("SELECT p_partkey, CAST(ceil(p_size / 8.0::DOUBLE) * 8 AS BIGINT) AS divisible, p_size // 2 AS padding, round(p_retailprice * (p_size + 1) / sqrt(p_partkey + 1 + 0.00001::DOUBLE), 6) AS weight, round(0.5 - 2 * (p_size + 1) / sqrt(p_partkey + 1 + 0.00001::DOUBLE), 6) AS bias FROM part")
def layer_algebra(spark, sf_dir):
    size = F.col("p_size")
    weight, bias = M.folded_norm(F.col("p_retailprice"), size + F.lit(1.0), F.lit(0.5), F.lit(2.0), F.col("p_partkey") + F.lit(1.0))
    return X.table(spark, sf_dir, "part").select("p_partkey", M.divisible(size, 8).cast("long").alias("divisible"), M.same_padding(size).alias("padding"), r6(weight, "weight"), r6(bias, "bias"))


@query("SELECT CAST(n_nationkey AS INT) AS layer, round(0.5 + n_nationkey * 0.5 / 24, 9) AS weight, 42 + n_nationkey AS seed FROM nation")
def gradual_steps(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("layer"), F.round(M.gradual_step(F.col("n_nationkey"), 25), 9).alias("weight"), frames.worker_seed(42, F.col("n_nationkey")).alias("seed"))


@query(
    """WITH c AS (SELECT CAST(x.range AS INT) AS x, CAST(y.range AS INT) AS y FROM range(20) x, range(15) y), k AS (SELECT CAST(range AS INT) AS k FROM range(16))
  SELECT x, y, k AS place, round(CASE WHEN k // 4 = 0 THEN sin(x / pow(10000.0::DOUBLE, (k % 4) / 4.0::DOUBLE)) WHEN k // 4 = 1 THEN cos(x / pow(10000.0::DOUBLE, (k % 4) / 4.0::DOUBLE))
    WHEN k // 4 = 2 THEN sin(y / pow(10000.0::DOUBLE, (k % 4) / 4.0::DOUBLE)) ELSE cos(y / pow(10000.0::DOUBLE, (k % 4) / 4.0::DOUBLE)) END, 6) + 0.0 AS value FROM c, k"""
)
def position_table(spark, sf_dir):
    table = G.position_table(spark.createDataFrame([(20, 15)], "w int, h int"), 16)
    return table.select("x", "y", F.posexplode("position").alias("place", "value")).select("x", "y", "place", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(f"{_M} SELECT name, step, value FROM metrics WHERE step % 10 = 0")
def log_scalars(spark, sf_dir):
    return metrics.scalars(X.metrics(spark, sf_dir)).select("name", "step", "value")


@query(
    """WITH e AS (SELECT user_id AS epoch, max(value) AS v, max(max(value)) OVER (PARTITION BY user_id >= 60 ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events GROUP BY user_id)
  SELECT epoch, 'last' AS file FROM e WHERE epoch < 60 UNION ALL SELECT epoch, 'checkpoint' || lpad(CAST(epoch AS VARCHAR), 4, '0') FROM e WHERE epoch < 60 AND (epoch + 1) % 12 = 0
  UNION ALL SELECT epoch, CASE WHEN epoch < 60 THEN 'best_stg1' ELSE 'best_stg2' END FROM e WHERE before IS NULL OR v > before"""
)
def checkpoint_files(spark, sf_dir):
    epochs = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step")).agg(F.max("value").alias("value")).withColumn("name", F.lit("top1"))
    best = metrics.best_so_far(epochs, F.col("step") >= 60)
    return metrics.checkpoints(best.withColumnRenamed("step", "epoch"), 12, 60)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, round(-ln((1 - (n_nationkey + 1) / 100.0::DOUBLE) / ((n_nationkey + 1) / 100.0::DOUBLE)), 6) AS bias FROM nation")
def prior_bias(spark, sf_dir):
    return spark.createDataFrame([(k, round(M.prior_bias((k + 1) / 100), 6)) for k in range(25)], "k long, bias double")


@query(
    """SELECT o_orderkey, worker, CAST(floor(i / 16) AS BIGINT) AS batch FROM (SELECT o_orderkey, o_custkey % 8 AS worker,
  row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY md5('3:1:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 8) AS n FROM orders)
  WHERE (floor(i / 16) + 1) * 16 <= n"""
)
def shuffled_batches(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    order = [frames.shuffled("o_orderkey", 3, 1), F.col("o_orderkey")]
    return frames.batch_numbers(rows, 128, 8, order, F.pmod("o_custkey", F.lit(8))).select("o_orderkey", "worker", "batch")


_EPOCHS = f"""WITH RECURSIVE {X.METRICS_SQL}, e AS (SELECT name, step // 50 AS epoch, CASE WHEN step // 50 % 41 = 7 THEN 0::DOUBLE ELSE CAST(sum(exact) AS DOUBLE) / count(*) * 0.4::DOUBLE END AS share FROM metrics GROUP BY name, step // 50),
  n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY epoch) AS nth, epoch % 60 = 59 AS late FROM e),
  g AS (SELECT *, CASE WHEN share < 15 THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END AS goal, share / 100 AS p FROM n),
  r AS (SELECT name, 0::BIGINT AS nth, NULL::BIGINT AS epoch, 1::DOUBLE AS weight FROM (SELECT DISTINCT name FROM n)
    UNION ALL SELECT g.name, g.nth, g.epoch, CASE WHEN share < 1e-6 OR late THEN 5::DOUBLE WHEN share BETWEEN 15 AND 25 OR weight <= 1e-6 OR abs(p * (1 - goal)) < 1e-9 THEN weight
      ELSE least(greatest(weight * greatest(goal * (1 - p) / nullif(p * (1 - goal), 0), 0.1::DOUBLE), weight / 10), weight * 10) END FROM r JOIN g ON r.name = g.name AND g.nth = r.nth + 1)"""


@query(f"{_EPOCHS} SELECT name, epoch, round(log10(weight), 6) AS log_weight FROM r WHERE nth > 0")
def weight_controller(spark, sf_dir):
    """The distillation weight through the epochs of each series: an epoch's weight is made of the one before it."""
    epochs = X.metrics(spark, sf_dir).groupBy("name", F.floor(F.col("step") / 50).alias("epoch")).agg((F.sum("exact").cast("double") / F.count("*") * F.lit(0.4)).alias("mean"))
    shares = epochs.select("name", "epoch", F.when(F.pmod("epoch", F.lit(41)) == 7, F.lit(0.0)).otherwise(F.col("mean")).alias("share"), (F.pmod("epoch", F.lit(60)) == 59).alias("late"))
    weighted = metrics.controlled_weights(shares, ["name"], "epoch", "share", "late", rho=20.0, delta=5.0, default=5.0, start=1.0)
    return weighted.select("name", "epoch", r6(F.log10("weight"), "log_weight"))
