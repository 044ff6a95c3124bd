"""Recognizer output to text: greedy CTC decoding as a window over time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..plans.runtime import broadcast_small


def best_steps(steps: DataFrame) -> DataFrame:
    """crop_id, t, idx, best: each step's first best class and its score."""
    return steps.select("crop_id", "t", M.argmax(F.col("probs")).alias("idx"), F.array_max("probs").alias("best"))


def emitted(best: DataFrame, blank: int = 0) -> DataFrame:
    """Steps that emit: not blank and not the class of the step before (blanks part repeats)."""
    before = F.lag("idx", 1, -1).over(Window.partitionBy("crop_id").orderBy("t"))
    return best.withColumn("prev", before).where((F.col("idx") != blank) & (F.col("idx") != F.col("prev"))).drop("prev")


def ctc_decode(steps: DataFrame, letter: Column | None = None, alphabet: DataFrame | None = None) -> DataFrame:
    """crop_id, text, confidence; crops that emit nothing have '' and 0.

    Classes become text by ``letter`` (an expression over idx) or by ``alphabet``
    (idx, ch), joined on idx. A class missing from the alphabet is an error.
    """
    kept = emitted(best_steps(steps))
    if alphabet is not None:
        kept = kept.join(broadcast_small(alphabet), "idx", "left")
        letter = F.when(F.col("ch").isNull(), F.raise_error(F.lit("class outside the alphabet")).cast("string")).otherwise(F.col("ch"))
    pieces = F.array_sort(F.collect_list(F.struct("t", letter.alias("ch"))))
    text = kept.groupBy("crop_id").agg(F.array_join(F.transform(pieces, lambda x: x["ch"]), "").alias("text"), F.avg(F.col("best").cast("double")).alias("confidence"))
    crops = steps.select("crop_id").distinct()
    return crops.join(text, "crop_id", "left").select("crop_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
