"""Live topics as a stream source: a queue of bounded length a topic that drops its oldest messages.

A node that subscribes to a topic keeps the last few messages; what a slow consumer has not taken by
its next trigger is gone. Here a log of messages plays the live topics: the clock moves on by a fixed step at
each trigger, and a trigger gets, of every topic, the last ``queue`` messages of its step. The reader is
a Python data source: offsets are times, so a restart goes on where the checkpoint ended and a batch that runs
again reads the same messages. Topics are dealt over the tasks of a batch by hash, and a task holds
``queue`` messages a topic at most, however many pass by; where everything is kept, a step's time is dealt instead.

The log is Parquet, written by Spark and sorted by time, so that a step's reader skips the files and row groups of other
times. Its path must be one that pyarrow's file systems know, as executors read it outside Spark's readers.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .stores import store

#: Times of messages, in microseconds, and the flag of a dropped message.
STAMP, DROPPED = "at_us", "dropped"
#: Messages of a step, on average, that one task reads where nothing is dropped.
ROWS = 250_000


def write_log(messages: DataFrame, path: str, topic: str, order: str) -> None:
    """``messages`` (with STAMP) as a log: by time, ties by ``order``; null times and topics are no messages."""
    by = [F.col(STAMP), F.col(order)]
    kept = messages.where(F.col(STAMP).isNotNull() & F.col(topic).isNotNull())
    kept.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def open_topics(spark: SparkSession, path: str, topic: str, order: str, every: int, queue: int = 10, tasks: int = 4, report: bool = False, group: str = "one", last: int | None = None) -> DataFrame:
    """The log under ``path`` as a stream, ``every`` microseconds a trigger, up to time ``last`` (else to its end).

    ``queue`` 0 keeps everything. With ``report`` dropped messages come too, marked in DROPPED. ``group`` names
    the consumer whose position is kept beside the log; it belongs to one checkpoint.
    """
    log = spark.read.parquet(path)
    first, end, rows = log.agg(F.min(STAMP), F.max(STAMP), F.count("*")).first()
    if not queue and end is not None:
        tasks = max(tasks, -(-rows // (ROWS * max(1, -(-(end + 1 - first) // every)))))
    spark.dataSource.register(Topics)
    options = {"path": path, "topic": topic, "order": order, "every": every, "queue": queue, "tasks": tasks, "report": report, "group": group, "first": first or 0, "end": (end + 1 if end is not None else 0) if last is None else last}
    return spark.readStream.format(Topics.name()).schema(log.withColumn(DROPPED, F.lit(False)).schema).options(**{k: str(v) for k, v in options.items()}).load()


def drain(query: StreamingQuery, last: int, seconds: float = 600) -> None:
    """Wait until a stream of topics has come to time ``last`` and has done what that calls for (timers), then stop it."""
    until = time.time() + seconds
    while query.isActive and time.time() < until:
        progress = query.lastProgress
        reached = json.loads(progress.json)["sources"][0]["endOffset"] if progress else None
        if reached and reached["at"] >= last:
            break
        time.sleep(0.05)
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    if query.exception():
        raise query.exception()


class Step(InputPartition):
    """The messages from one time to another, of some topics or (part None) of all."""

    def __init__(self, start: int, end: int, part: int | None):
        self.start, self.end, self.part = start, end, part


class Topics(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_topics"

    def streamReader(self, schema) -> TopicsReader:
        return TopicsReader({**self.options}, schema)


class TopicsReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema):
        whole = lambda k: int(options[k])
        self.path, self.topic, self.order = options["path"], options["topic"], options["order"]
        self.every, self.queue, self.tasks, self.end = whole("every"), whole("queue"), whole("tasks"), whole("end")
        self.report, self.names = options["report"] == "True", list(schema.names)
        self.position = f"_position-{options['group']}"
        self.first = whole("first")
        self.at = None

    def initialOffset(self) -> dict:
        return {"at": self.first}

    def latestOffset(self) -> dict:
        """One step on. A reader that has just started goes on from the position of its group: at most a step behind."""
        if self.at is None:
            self.at = self._kept()
        self.at = max(self.at, min(self.at + self.every, self.end))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Step]:
        self.at = max(self.at or self.first, end["at"])
        if self.queue:
            return [Step(start["at"], end["at"], part) for part in range(self.tasks)]
        # nothing is dropped, so topics may be parted: each task reads a time of its own, not the whole step
        span = end["at"] - start["at"]
        edges = [start["at"] + span * k // self.tasks for k in range(self.tasks + 1)]
        return [Step(a, b, None) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b] or [Step(start["at"], end["at"], None)]

    def commit(self, end: dict) -> None:
        system, path = store(self.path)
        with system.open_output_stream(f"{path}/{self.position}") as out:
            out.write(json.dumps(end).encode())

    def _kept(self) -> int:
        system, path = store(self.path)
        if system.get_file_info(f"{path}/{self.position}").type == fs.FileType.NotFound:
            return self.first
        with system.open_input_stream(f"{path}/{self.position}") as kept:
            return json.loads(kept.read())["at"]

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        system, path = store(self.path)
        stamp = ds.field(STAMP)
        log = ds.dataset(path, filesystem=system, format="parquet")
        columns = [c for c in self.names if c != DROPPED]
        held: pa.Table | None = None
        for batch in log.to_batches(columns=columns, filter=(stamp >= partition.start) & (stamp < partition.end), batch_size=1 << 14, batch_readahead=2, fragment_readahead=1):
            if partition.part is None:
                yield from self._marked(pa.Table.from_batches([batch]), False)
                continue
            coded = batch.column(columns.index(self.topic)).dictionary_encode()
            own = np.array([_deal(t, self.tasks) == partition.part for t in coded.dictionary.to_pylist()], bool)
            table = pa.Table.from_batches([batch.filter(pa.array(own[coded.indices.to_numpy()]))])
            if not table.num_rows:
                continue
            held, gone = self._last(table if held is None else pa.concat_tables([held, table]))
            if self.report and gone.num_rows:
                yield from self._marked(gone, True)
        if held is not None:
            yield from self._marked(held, False)

    def _last(self, table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The last messages of each topic, and the others."""
        topic = table[self.topic].combine_chunks().dictionary_encode().indices.to_numpy()
        ranked = np.lexsort((-table[self.order].to_numpy(), -table[STAMP].to_numpy(), topic))
        sorted_topic = topic[ranked]
        new = np.concatenate([[True], sorted_topic[1:] != sorted_topic[:-1]])
        starts = np.flatnonzero(new)
        place = np.arange(len(ranked)) - starts[np.cumsum(new) - 1]
        return table.take(ranked[place < self.queue]), table.take(ranked[place >= self.queue])

    def _marked(self, table: pa.Table, dropped: bool) -> Iterator[pa.RecordBatch]:
        table = table.append_column(DROPPED, pa.array(np.full(table.num_rows, dropped)))
        yield from table.select(self.names).combine_chunks().to_batches()


def _deal(topic: object, tasks: int) -> int:
    """A task number that is the same in every process."""
    return zlib.crc32(str(topic).encode()) % tasks
