"""Run statistics: per-frame and per-run totals, meters, folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..plans.runtime import free_name
from . import ordered

WINDOW = 20


def per_frame(frames: DataFrame, det: DataFrame, key: str = "frame_id") -> DataFrame:
    """Totals of every frame, empty ones included; detections are reduced before the join."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    totals = det.groupBy(key).agg(F.count("*").alias("det_count"), F.max("score").alias("best_score"), F.sum(size.cast("long")).alias("total_area"))
    return frames.join(totals, key, "left").select(key, F.coalesce("det_count", F.lit(0)).alias("det_count"), "best_score", F.coalesce("total_area", F.lit(0)).alias("total_area"))


def run_totals(frames: DataFrame, seconds: list[str]) -> DataFrame:
    """One row: frames, detections, summed times and rates as ratios of sums (NULL where no time passed)."""
    sums = [F.sum(c).alias(c) for c in seconds]
    totals = frames.agg(F.count("*").alias("frames"), F.sum("det_count").alias("detections"), *sums)
    return totals.select("*", *[(F.col("frames") / F.nullif(F.col(c), F.lit(0.0))).alias(f"{c}_rate") for c in seconds])


def _placed(series: DataFrame, total: str | None = None) -> DataFrame:
    return ordered.numbered(series.select("name", "step", "value"), ["name"], [F.col("step")], total=total)


def rolling(series: DataFrame, size: int = WINDOW) -> DataFrame:
    """Last, mean, largest and lower-middle median of the last ``size`` values of each series.

    Means of decimal values are exact sums divided once.
    """

    def median(w) -> Column:
        values = F.array_sort(F.collect_list("value").over(w))
        return F.element_at(values, F.ceil(F.size(values) / F.lit(2.0)).cast("int"))

    mean = lambda w: F.sum("value").over(w).cast("double") / F.count("value").over(w)
    out = ordered.recent(_placed(series), ["name"], "n", size, {"median": median, "average": mean, "largest": lambda w: F.max("value").over(w)})
    return out.drop("n")


def running(series: DataFrame) -> DataFrame:
    """Running mean of each series, and the time left at that mean."""
    out = ordered.running(_placed(series, "all"), ["name"], "n", {"sum": F.col("value"), "count": F.lit(1).cast("long")}, {"sum": "sum", "count": "sum"})
    mean = F.col("sum").cast("double") / F.col("count")
    return out.select("name", "step", mean.alias("global_avg"), (mean * (F.col("all") - F.col("n") - 1)).alias("eta"))


def weighted_average(value: Column, n: Column) -> Column:
    return F.sum(value * n) / F.nullif(F.sum(n), F.lit(0)).cast("double")


def share_mean(shares: Column) -> Column:
    """Mean of an epoch's shares, 0 without any."""
    return F.coalesce(F.avg(shares), F.lit(0.0))


def gather(value: Column, worker: Column) -> Column:
    """Every worker's value, in worker order (an array as long as there are workers)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(worker.alias("worker"), value.alias("value")))), lambda x: x["value"])


def best_so_far(series: DataFrame, stage: Column) -> DataFrame:
    """The best value up to each step within its stage, and whether the step made it."""
    rows = ordered.numbered(series.select("name", stage.alias("stage"), "step", "value"), ["name", "stage"], [F.col("step")])
    out = ordered.running(rows, ["name", "stage"], "n", {"before": F.col("value")}, {"before": "max"}, before=True)
    return out.select("name", "stage", "step", F.greatest("before", "value").alias("best"), (F.col("before").isNull() | (F.col("value") > F.col("before"))).alias("improved"))


def checkpoints(epochs: DataFrame, every: int, stop_epoch: int) -> DataFrame:
    """(epoch, file): what a run writes after each epoch (0-based, rank 0 only).

    ``last`` in every epoch before ``stop_epoch``, a numbered file in every ``every``-th
    of them, and the best file of the stage where ``improved``.
    """
    early = F.col("epoch") < stop_epoch
    files = F.array_compact(
        F.array(
            F.when(early, F.lit("last")),
            F.when(early & ((F.col("epoch") + 1) % every == 0), F.format_string("checkpoint%04d", F.col("epoch").cast("int"))),
            F.when(F.col("improved"), F.when(early, F.lit("best_stg1")).otherwise(F.lit("best_stg2"))),
        )
    )
    return epochs.select("epoch", F.explode(files).alias("file"))


def scalars(series: DataFrame, every: int = 10) -> DataFrame:
    """The points of a training log's curves: every ``every``-th step."""
    return series.where(F.col("step") % every == 0)


def ema(series: DataFrame, decay: float, warmups: int, start: int = 0) -> DataFrame:
    """Exponential moving average of each series in step order, from 0, skipping the first ``start`` updates.

    The fold v = v d(n) + x (1 - d(n)) with d(n) = decay (1 - exp(-n / warmups)) is a weighted
    sum: x_n has the weight (1 - d(n)) d(n+1) ... d(N). The logarithm of d(1) ... d(n) comes from a table up
    to where d(n) equals ``decay`` in double precision, and from there on grows by a constant.
    """
    rows = ordered.numbered(series.select("name", "step", "value"), ["name"], [F.col("step")], total="all")
    rows = rows.where(F.col("n") >= start).select("name", "value", (F.col("n") + 1 - start).alias("n"), (F.col("all") - start).alias("all"))
    still = 40 * warmups if warmups else 0
    logs, rates, log = [0.0], [decay], 0.0
    for n in range(1, still + 1):
        rates.append(decay * -math.expm1(-n / warmups))
        log += math.log(rates[-1])
        logs.append(log)
    table = series.sparkSession.createDataFrame(list(zip(range(still + 1), logs, rates, strict=True)), "at long, log double, rate double")
    place = lambda n: F.least(n, F.lit(still))
    # a row per step of the warm-up: its bound is the parameter
    own = table.select(F.col("at").alias("own"), F.col("log").alias("own_log"), "rate")
    end = table.select(F.col("at").alias("end"), F.col("log").alias("end_log"))
    rows = rows.join(F.broadcast(own), place(F.col("n")) == F.col("own")).join(F.broadcast(end), place(F.col("all")) == F.col("end"))
    far = lambda n: F.greatest(n - still, F.lit(0)).cast("double") * math.log(decay)
    later = F.col("end_log") + far(F.col("all")) - F.col("own_log") - far(F.col("n"))
    return rows.groupBy("name").agg(F.sum(F.col("value") * (1 - F.col("rate")) * F.exp(later)).alias("ema"))


def controlled_weights(series: DataFrame, keys: list[str], step: str, share: str, late: str, rho: float, delta: float, default: float, start: float) -> DataFrame:
    """``series`` with ``weight``: the loss weight after each step, worked out from the one before it.

    Each step sets the weight to ``default`` (share nothing, or late), leaves it (share in rho +- delta, or the weight is
    nothing by now) or multiplies it by a factor of the share alone. So a series falls apart at its resets, which forget
    what came before; between them the weight is a running product, up to the first place where it comes to nothing and stays.
    Resets, products and first places are running values over blocks: a long series is many tasks' work,
    and no task folds it row by row. Steps must differ within a key; a null share leaves the weight alone.
    """
    names = [free_name(n, series.columns) for n in ("_place", "_run", "_product", "_end")]
    place, run, product, end = names
    reset = F.coalesce((F.col(share) < maths.NOTHING) | F.col(late), F.lit(False))
    placed = ordered.running(ordered.numbered(series, keys, [F.col(step)], place), keys, place, {run: reset.cast("long")}, {run: "sum"})
    factor = F.when(reset, F.lit(1.0)).otherwise(maths.weight_factor(F.col(share), rho, delta))
    grown = ordered.running(placed, [*keys, run], place, {product: factor}, {product: "product"})
    first = F.when(F.col(run) > 0, F.lit(float(default))).otherwise(F.lit(float(start)))
    free = grown.withColumn(product, F.when(first <= maths.NOTHING, first).otherwise(first * F.col(product)))
    spent = F.when(F.col(product) <= maths.NOTHING, F.struct(place, product))
    ended = ordered.running(free, [*keys, run], place, {end: spent}, {end: "min"})
    weight = F.coalesce(F.col(f"{end}.{product}"), F.col(product))
    return ended.withColumn(free_name("weight", series.columns), weight).drop(*names)
