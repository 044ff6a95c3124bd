"""Live topics and session state: what a bounded queue drops, and numbers that go on after a restart."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequery.plans import runtime
from framequery.sources import topics
from framequery.streaming import frames as stream
from framequery.streaming import sessions


def _folder(spark, name):
    import uuid

    return f"{runtime.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _run(spark, df, out, progress, end):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    topics.drain(stream.run(df, lambda b: b, [write], progress), end, 120)


@pytest.mark.parametrize("queue", [0, 3])
def test_queue_keeps_the_last_of_each_topic(spark, queue):
    rng = random.Random(queue)
    rows = [(rng.randrange(400), rng.choice(["a", "b", "é"]), k) for k in range(300)] + [(None, "a", 900), (5, None, 901)] + [(399, "hot", 1000 + k) for k in range(500)]
    log, out, progress = (_folder(spark, n) for n in ("log", "out", "progress"))
    df = spark.createDataFrame(rows, "at_us long, topic string, id long").withColumn("payload", F.lit("x"))
    topics.write_log(df.repartition(3), log, "topic", "id")
    first = min(r[0] for r in rows if r[0] is not None)
    _run(spark, topics.open_topics(spark, log, "topic", "id", every=150, queue=queue, report=True, last=250), out, progress, 250)
    _run(spark, topics.open_topics(spark, log, "topic", "id", every=150, queue=queue, report=True), out, progress, 400)  # goes on where it ended
    want, groups = [], {}
    for at, topic, k in rows:
        if at is not None and topic is not None:
            edges = [e for e in (first, first + 150, 250, 400)]
            groups.setdefault((topic, max(e for e in edges if e <= at)), []).append((at, k))
    for (topic, _), own in groups.items():
        own.sort(reverse=True)
        want += [(k, topic, bool(queue) and n >= queue) for n, (_, k) in enumerate(own)]
    read = spark.read.schema("at_us long, topic string, id long, payload string, dropped boolean").parquet(out)
    assert sorted((r["id"], r["topic"], r["dropped"]) for r in read.collect()) == sorted(want)


def test_a_task_holds_no_more_than_the_queue():
    reader = topics.TopicsReader({"path": "x", "topic": "t", "order": "k", "every": "1", "queue": "2", "tasks": "1", "end": "9", "report": "True", "group": "g", "first": "0"}, type("S", (), {"names": ["at_us", "t", "k", "dropped"]}))
    table = pa.table({"at_us": [1, 2, 2, 3], "t": ["a", "a", "b", "a"], "k": [1, 2, 3, 4]})
    held, gone = reader._last(table)
    assert sorted(held["k"].to_pylist()) == [2, 3, 4] and gone["k"].to_pylist() == [1]


def test_sessions_go_on_after_a_restart_and_end_by_timer(spark):
    rng = random.Random(8)
    rows = sorted(((rng.randrange(1000) * 1000, rng.choice(["a", "b", None]), k, rng.choice([None, 2]), k) for k in range(200)), key=lambda r: (r[0], r[2]))
    log, out, progress = (_folder(spark, n) for n in ("log", "out", "progress"))
    df = spark.createDataFrame(rows, "at_us long, session string, frame_id long, det_count long, det_us long").fillna({"session": "none"})
    topics.write_log(df, log, "session", "frame_id")
    end = max(r[0] for r in rows) + 1
    for last in (400_000, end):
        live = topics.open_topics(spark, log, "session", "frame_id", every=250_000, queue=0, last=last)
        with sessions.state_store(spark):
            counted = sessions.count_sessions(live, gap_us=20_000, interval=3)
            _run(spark, counted, out, progress, last)
    got = spark.read.schema(sessions.OUTPUT).parquet(out).collect()
    frames, ends = [], []
    for name in ("a", "b", "none"):
        run = []
        for at, session, k, n, us in [r for r in rows if (r[1] or "none") == name]:
            if run and at - run[-1][0] > 20_000:
                ends.append((name, len(run), sum(r[1] for r in run), sum(r[2] for r in run), run[0][0], run[-1][0]))
                run = []
            run.append((at, n or 0, us))
            frames.append((name, k, len(run), sum(r[1] for r in run), len(run) % 3 == 0))
        if (run[-1][0] + 20_000) // 1000 + 1 <= (end - 1) // 1000:
            ends.append((name, len(run), sum(r[1] for r in run), sum(r[2] for r in run), run[0][0], run[-1][0]))
    assert sorted((r["session"], r["frame_id"], r["number"], r["detections"], r["save"]) for r in got if r["kind"] == "frame") == sorted(frames)
    assert sorted((r["session"], r["frames"], r["detections"], r["det_us"], r["first_us"], r["last_us"]) for r in got if r["kind"] == "end") == sorted(ends)


def test_numbers_read_one_earlier_batch(spark):
    counts = stream.Numbers(_folder(spark, "numbers"), "k")
    for number, first in enumerate((0, 4, 4, 9)):
        batch = spark.range(first, first + 5).withColumnRenamed("id", "k")
        want = [5 * number + i + 1 for i in range(5)]
        for _ in range(2):  # a batch that runs again
            assert [r["number"] for r in counts(batch, number).orderBy("k").collect()] == want


def test_tasks_of_a_whole_step_read_times_of_their_own():
    options = {"path": "x", "topic": "t", "order": "k", "every": "10", "queue": "0", "tasks": "4", "end": "9", "report": "False", "group": "g", "first": "0"}
    steps = topics.TopicsReader(options, type("S", (), {"names": ["at_us", "t", "k", "dropped"]})).partitions({"at": 3}, {"at": 9})
    assert [t for s in steps for t in range(s.start, s.end)] == list(range(3, 9)) and len(steps) == 4
    assert all(s.part is None for s in steps)
