"""Queries over live topics and sessions: streams that Spark replays from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import event_files, topics
from ..streaming import frames as stream
from ..streaming import progress, sessions
from . import fixtures as X
from .catalog import query
from .runtime import delete_on_exit, shared_dir

_DAY = 86_400_000_000


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def _keep(out: str):
    """A sink that a batch that runs again overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def _us(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query(
    f"""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS at_us FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
  t AS (SELECT *, (at_us - (SELECT min(at_us) FROM e)) // {3 * _DAY} AS step FROM e)
  SELECT event_id, event_type AS topic, step, row_number() OVER (PARTITION BY event_type, step ORDER BY at_us DESC, event_id DESC) > 10 AS dropped FROM t"""
)
def bounded_queue(spark, sf_dir):
    """The events as live topics: a trigger every three days takes the last ten of a topic, older ones are dropped."""
    e = X.table(spark, sf_dir, "events")
    log, out = _folder(spark, "topics"), _folder(spark, "taken")
    topics.write_log(e.select(_us("ts").alias(topics.STAMP), F.col("event_type").alias("topic"), "event_id"), log, "topic", "event_id")
    first, last = spark.read.parquet(log).agg(F.min(topics.STAMP), F.max(topics.STAMP)).first()
    live = topics.open_topics(spark, log, "topic", "event_id", every=3 * _DAY, queue=10, report=True)
    topics.drain(stream.run(live, lambda batch: batch, [_keep(out)], _folder(spark, "progress")), last + 1)
    read = spark.read.schema("at_us long, topic string, event_id long, dropped boolean").parquet(out)
    return read.select("event_id", "topic", F.floor((F.col(topics.STAMP) - F.lit(first)) / F.lit(3 * _DAY)).alias("step"), "dropped")


_GAP = 200 * _DAY

_SESSIONS = f"""o AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderkey AS frame_id, epoch_us(o_orderdate) AS at_us, 1 + o_orderkey % 7 AS det_count, CAST(round(o_totalprice * 100) AS BIGINT) AS det_us FROM orders),
  g AS (SELECT *, coalesce(at_us - lag(at_us) OVER w > {_GAP}, true) AS opens FROM o WINDOW w AS (PARTITION BY customer ORDER BY at_us, frame_id)),
  s AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY customer ORDER BY at_us, frame_id) AS nth FROM g)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as frames of their customers' sessions, through a stream that stops half-way and starts again."""
    o = X.table(spark, sf_dir, "orders")
    log, out, progress = (_folder(spark, n) for n in ("frames", "counted", "progress"))
    frame = o.select(
        _us("o_orderdate").alias(topics.STAMP), F.col("o_custkey").cast("string").alias("session"), F.col("o_orderkey").alias("frame_id"), (1 + F.pmod("o_orderkey", F.lit(7))).alias("det_count"), F.round(F.col("o_totalprice") * 100).cast("long").alias("det_us")
    )
    topics.write_log(frame, log, "session", "frame_id")
    first, last = spark.read.parquet(log).agg(F.min(topics.STAMP), F.max(topics.STAMP)).first()
    middle = first + (last - first) // 2
    for end in (middle, last + 1):
        live = topics.open_topics(spark, log, "session", "frame_id", every=700 * _DAY, queue=0, last=end)
        with sessions.state_store(spark):
            started = stream.run(sessions.count_sessions(live, _GAP), lambda batch: batch, [_keep(out)], progress)
        topics.drain(started, end)
    return spark.read.schema(sessions.OUTPUT).parquet(out)


@query(
    f"""WITH {_SESSIONS} SELECT customer, frame_id, row_number() OVER w AS number, CAST(sum(det_count) OVER w AS BIGINT) AS detections, CAST(sum(det_us) OVER w AS BIGINT) AS det_us, row_number() OVER w % 10 = 0 AS save
  FROM s WINDOW w AS (PARTITION BY customer, nth ORDER BY at_us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def session_frames(spark, sf_dir):
    return _sessions(spark, sf_dir).where("kind = 'frame'").select(F.col("session").alias("customer"), "frame_id", "number", "detections", "det_us", "save")


@query(
    f"""WITH {_SESSIONS}, t AS (SELECT customer, nth, count(*) AS frames, CAST(sum(det_count) AS BIGINT) AS detections, CAST(sum(det_us) AS BIGINT) AS det_us, min(at_us) AS first_us, max(at_us) AS last_us FROM s GROUP BY customer, nth)
  SELECT customer, frames, detections, det_us, first_us, last_us FROM t WHERE (last_us + {_GAP}) // 1000 + 1 <= (SELECT max(at_us) // 1000 FROM o) OR EXISTS (SELECT 1 FROM t u WHERE u.customer = t.customer AND u.nth > t.nth)"""
)
def session_ends(spark, sf_dir):
    """The totals that a session's timer sends when it has been silent for 200 days."""
    return _sessions(spark, sf_dir).where("kind = 'end'").select(F.col("session").alias("customer"), "frames", "detections", "det_us", "first_us", "last_us")


@query(
    f"""WITH e AS (SELECT epoch_us(ts) AS at_us FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL), t AS (SELECT (at_us - (SELECT min(at_us) FROM e)) // {10 * _DAY} AS step FROM e)
  SELECT 'whole' AS run, count(*) AS frames, count(DISTINCT step) AS batches, true AS timed, false AS failed FROM t UNION ALL SELECT 'broken', count(*) FILTER (WHERE step = 0), 1, true, true FROM t"""
)
def listened_totals(spark, sf_dir):
    """A run's totals as Spark's progress tells them: of a stream that ends well, and of one whose sink fails in its second batch."""
    e = X.table(spark, sf_dir, "events")
    log = _folder(spark, "topics")
    topics.write_log(e.select(_us("ts").alias(topics.STAMP), F.col("event_type").alias("topic"), "event_id"), log, "topic", "event_id")
    last = spark.read.parquet(log).agg(F.max(topics.STAMP)).first()[0] + 1
    told: list[tuple] = []

    def breaks(batch: DataFrame, number: int) -> None:
        if number == 1:
            raise OSError("no room")

    for run, sinks in (("whole", [_keep(_folder(spark, "taken"))]), ("broken", [_keep(_folder(spark, "taken")), breaks])):
        name = f"{run}-{uuid.uuid4().hex}"
        listener = progress.watch(spark, name, lambda t, run=run: told.append((run, t.rows, t.batches, t.milliseconds.get("triggerExecution", 0) > 0, t.error is not None)))
        live = topics.open_topics(spark, log, "topic", "event_id", every=10 * _DAY, queue=0, group=run)
        started = stream.run(live, lambda batch: batch, sinks, _folder(spark, "progress"), name=name)
        try:
            topics.drain(started, last)
        except Exception as error:
            if run == "whole" or "no room" not in str(error):
                raise
        progress.settle(spark, listener)
    return spark.createDataFrame(told, "run string, frames long, batches long, timed boolean, failed boolean")  # two rows


@query(f"WITH {X.METRICS_SQL} SELECT name AS tag, step, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM metrics WHERE step % 10 = 0")
def event_file_scalars(spark, sf_dir):
    """The training log's scalars through event files: written by tasks, committed by the driver, read back with all checksums tried."""
    from ..operators import metrics

    out = _folder(spark, "event-files")
    event_files.write_events(metrics.scalars(X.metrics(spark, sf_dir)).select(F.col("name").alias("tag"), "step", "value"), out)
    return event_files.read_events(spark, out).select("tag", "step", F.col("value").cast("double").alias("value"))
