"""The frame pipeline as a stream: the batch transform inside ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ordered


def run(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    sinks: list[Callable[[DataFrame, int], None]],
    checkpoint: str,
    once: bool = False,
    optional: list[Callable[[DataFrame, int], None]] | None = None,
    failed: Callable[[int, Exception], None] | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Each micro-batch goes once through ``transform`` and then to every sink.

    A failing sink is raised after the others have run, so Spark's retry sees it; a failing
    ``optional`` sink (annotated frames) is only told to ``failed``.
    """

    def each(batch: DataFrame, number: int) -> None:
        out, error = transform(batch), None
        if len(sinks) + len(optional or ()) > 1:
            out = out.persist()
        try:
            for sink in sinks:
                try:
                    sink(out, number)
                except Exception as e:
                    error = error or e
            for sink in optional or ():
                try:
                    sink(out, number)
                except Exception as e:
                    if failed:
                        failed(number, e)
        finally:
            out.unpersist()
        if error:
            raise error

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


def finish(query: StreamingQuery, flush: Callable[[], None]) -> None:
    """Wait for the end of a stream, whatever ended it, and then flush the run's totals."""
    try:
        query.awaitTermination()
    finally:
        flush()


def running_totals(stream: DataFrame, seconds: list[str]) -> DataFrame:
    """Counters over the life of a stream, for complete or update mode."""
    return stream.groupBy().agg(F.count("*").alias("frames"), F.sum("det_count").alias("detections"), *[F.sum(c).alias(c) for c in seconds])


class Numbers:
    """Numbers of a stream's frames, counted on over micro-batches (from 1).

    Each batch leaves the number of frames up to its end in a file of its own under ``path`` (a shared
    folder): a batch reads the file of the one before, however long the stream has lived, and a batch that runs again
    gets the same numbers.
    """

    def __init__(self, path: str, order: str):
        self.path, self.order = path.rstrip("/"), order

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        spark, rows = batch.sparkSession, batch.count()
        before = spark.read.schema("frames long").parquet(f"{self.path}/batch={number - 1}").first()[0] if number else 0
        spark.range(1).select(F.lit(before + rows).alias("frames")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return ordered.numbered(batch, [], [F.col(self.order)], "number").withColumn("number", F.col("number") + before + 1)
