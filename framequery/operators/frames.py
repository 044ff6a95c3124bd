"""Frame-level relations: messages, numbering, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import frame_file, succeeded
from . import ordered


def messages(frames: DataFrame, results: DataFrame, key: str = "frame_id") -> DataFrame:
    """One message per frame, also if empty: detections with text, ordered, as centre and size."""
    cx, cy, w, h = G.corners_to_centre(tuple(c.cast("double") for c in G.box()))
    entry = F.struct("det_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), F.array(F.struct(F.col("text").alias("class_id"), "score")).alias("results"))
    sent = results.where(succeeded(F.col("text"))).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("detections"))
    empty = F.array().cast(sent.schema["detections"].dataType)
    return frames.join(sent, key, "left").withColumn("detections", F.coalesce("detections", empty))


def every_nth(frames: DataFrame, n: int, order: str = "frame_id", partition: Column | None = None) -> DataFrame:
    """Frames whose number, counted from 1, is a multiple of n, with the file name to save under.

    Numbers are counted within ``partition`` (one stream or session), else over all frames.
    """
    rows = frames if partition is None else frames.withColumn("_group", partition)
    placed = ordered.numbered(rows, [] if partition is None else ["_group"], [F.col(order)], "number")
    numbers = placed.withColumn("number", F.col("number") + 1).where(F.col("number") % n == 0)
    return numbers.select(*frames.columns, F.col("number").cast("int").alias("number"), frame_file(F.col("number")).alias("file"))


def progress(frames: DataFrame, interval: int, group: str, order: str) -> DataFrame:
    """Lines to print: every ``interval``-th frame of a group and its last, as [i/n]."""
    placed = ordered.numbered(frames.select(group, order), [group], [F.col(order)], "i", "n").withColumn("i", F.col("i") + 1)
    return placed.where((F.col("i") % interval == 0) | (F.col("i") == F.col("n"))).withColumn("line", F.format_string("[%d/%d]", "i", "n"))


def shuffled(key: str, seed: int, epoch: int = 0) -> Column:
    """An order for ``batch_numbers`` that is random but the same in every run: a seeded hash of the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key)))


def batch_numbers(rows: DataFrame, size: int, world: int, order: list[Column], shard: Column) -> DataFrame:
    """Batches of ``size // world`` rows per worker; a short last batch is dropped."""
    if size % world:
        raise ValueError("the total batch size must be a multiple of the workers")
    each = size // world
    out = ordered.numbered(rows.withColumn("worker", shard), ["worker"], order, "_i", "_n")
    return out.withColumn("batch", F.floor(F.col("_i") / each)).where((F.col("batch") + 1) * each <= F.col("_n")).drop("_i", "_n")


def worker_seed(seed: int, rank: Column) -> Column:
    """A seed of its own for every worker."""
    return F.lit(seed) + rank
