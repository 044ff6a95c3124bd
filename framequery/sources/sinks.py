"""Sinks: detection messages, run reports, training log, quarantine."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images, pixels
from ..functions.text import succeeded
from .stores import store


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per frame, empty frames included."""
    messages.write.mode(mode).json(path)


def write_report(totals: DataFrame, path: str) -> bool:
    """The run's totals as JSON; nothing is written for a run without frames."""
    row = totals.head()
    if row is None or not row["frames"]:
        return False
    totals.coalesce(1).write.mode("overwrite").json(path)  # one row
    return True


def write_log(epochs: DataFrame, path: str) -> None:
    """A JSON line per epoch."""
    epochs.select(F.to_json(F.struct(*epochs.columns)).alias("value")).write.mode("append").text(path)


def split_errors(scored: DataFrame, result: str = "result", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of a scoring step that returns a result or an error."""
    return scored.where(F.col(error).isNull()).drop(error), scored.where(F.col(error).isNotNull()).drop(result)


def annotated(frames: DataFrame, results: DataFrame, fallback: str = "text") -> DataFrame:
    """(origin, name, content): every frame as PNG with its boxes and texts drawn, under its input's name.

    ``results``: origin, x1..y2 and text; where recognition failed, ``fallback`` is the label.
    """
    lists = results.groupBy(F.col("origin").alias("_origin")).agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2", "text"))).alias("results"))
    return annotated_rows(frames.join(lists, F.col("origin") == F.col("_origin"), "left"), fallback)


def annotated_rows(read: DataFrame, fallback: str = "text") -> DataFrame:
    """As ``annotated``, of frames that have their results as an array in the same row: no join, pixels stay where they are."""
    label = lambda b: F.when(succeeded(b["text"]), b["text"]).otherwise(F.lit(fallback)).alias("text")
    boxes = F.array_sort(F.transform("results", lambda b: F.struct(*[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")], label(b))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                origin, h, w, c, data, found = (batch.column(i)[row].as_py() for i in range(6))
                img = pixels.annotate(pixels.image(data, h, w, c), [tuple(b.values()) for b in found or ()])
                name = posixpath.splitext(posixpath.basename(origin))[0] + ".png"
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([name]), pa.array([images.encode_png(img)], pa.binary())], names=["origin", "name", "content"])

    return read.select("origin", "height", "width", "nChannels", "data", boxes.alias("boxes")).mapInArrow(run, "origin string, name string, content binary")


def write_files(files: DataFrame, uri: str) -> int:
    """Write (name, content) rows as files under a URI that driver and executors share; returns how many.

    A file is written under a name of its own and then moved, so a task that runs again replaces whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(uri)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{root}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
