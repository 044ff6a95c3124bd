"""Places, running values and recent rows against plain versions, over block borders, ties, nulls and many partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.operators import detect, match, metrics, ordered


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), step, rng.randrange(100)) for step in rng.sample(range(1000), 400)]
    return data, spark.createDataFrame(data, "name string, step long, value int").repartition(5)


def _groups(data):
    out = {}
    for name, step, value in sorted(data, key=lambda r: r[1]):
        out.setdefault(name, []).append((step, value))
    return out


def test_numbered(rows):
    data, df = rows
    want = {(name, step): (i, len(g)) for name, g in _groups(data).items() for i, (step, _) in enumerate(g)}
    got = {(r["name"], r["step"]): (r["n"], r["all"]) for r in ordered.numbered(df, ["name"], [F.col("step")], total="all").collect()}
    assert got == want
    whole = [r["step"] for r in ordered.numbered(df, [], [F.desc("step")]).orderBy("n").collect()]
    assert whole == sorted(whole, reverse=True) and len(whole) == 400
    assert ordered.numbered(df.limit(0), ["name"], [F.col("step")]).count() == 0


@pytest.mark.parametrize("before", [False, True])
def test_running_and_recent(rows, monkeypatch, before):
    data, df = rows
    monkeypatch.setattr(ordered, "BLOCK", 7)
    placed = ordered.numbered(df, ["name"], [F.col("step")])
    got = {(r["name"], r["step"]): (r["total"], r["top"]) for r in ordered.running(placed, ["name"], "n", {"total": F.col("value"), "top": F.col("value")}, {"total": "sum", "top": "max"}, before).collect()}
    for name, g in _groups(data).items():
        for i, (step, _) in enumerate(g):
            seen = [v for _, v in g[: i + (not before)]]
            assert got[name, step] == ((sum(seen), max(seen)) if seen else (None, None))
    near = {(r["name"], r["step"]): r["sum"] for r in ordered.recent(placed, ["name"], "n", 5, {"sum": lambda w: F.sum("value").over(w)}).collect()}
    assert near == {(name, step): sum(v for _, v in g[max(0, i - 4) : i + 1]) for name, g in _groups(data).items() for i, (step, _) in enumerate(g)}


@pytest.mark.parametrize(("warmups", "start"), [(0, 0), (3, 0), (3, 5)])
def test_ema_is_the_fold(rows, warmups, start):
    import math

    data, df = rows
    got = {r["name"]: r["ema"] for r in metrics.ema(df, 0.9, warmups, start).collect()}
    for name, g in _groups(data).items():
        v = 0.0
        for n, (_, x) in enumerate(g[start:], 1):
            d = 0.9 * (1 - math.exp(-n / warmups)) if warmups else 0.9
            v = v * d + (1 - d) * x
        assert abs(got[name] - v) < 1e-9


def test_repeated_rounds_by_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2).tolist()
        costs = rng.random((n, m))
        table = costs.copy()
        for x, y in match.repeated(costs, 2):
            k = min(n, m)
            best = min(sum(table[a, b] for a, b in zip(p, q)) for p in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
            assert len(x) == k and abs(table[x, y].sum() - best) < 1e-6
            table[x, y] = 1e6


def test_precision_with_crowds_and_areas(spark):
    truths = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0), (1, 2, 0, 50.0, 50.0, 60.0, 60.0, 1), (2, 1, 0, 0.0, 0.0, 100.0, 100.0, 0), (2, 2, 1, 0.0, 0.0, 10.0, 10.0, 0)]
    found = [(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.8, 50.0, 50.0, 55.0, 55.0), (1, 3, 0, 0.7, 52.0, 52.0, 57.0, 57.0), (2, 4, 0, 0.6, 0.0, 0.0, 100.0, 60.0), (2, 5, 0, 0.5, 300.0, 300.0, 310.0, 310.0)]
    t = spark.createDataFrame(truths, "frame_id long, det_id long, class_id int, x1 double, y1 double, x2 double, y2 double, iscrowd int")
    d = spark.createDataFrame(found, "frame_id long, det_id long, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["class_id"], round(r["threshold"], 2)): (round(r["ap"], 4), r["positives"]) for r in detect.average_precision(d, t, (0.5, 0.75)).collect()}
    # the crowd takes both detections inside it, which then count neither way
    assert got == {(0, 0.5): (1.0, 2), (0, 0.75): (round(51 / 101, 4), 2), (1, 0.5): (0.0, 1), (1, 0.75): (0.0, 1)}
    small = {r["class_id"]: (round(r["ap"], 4), r["positives"]) for r in detect.average_precision(d, t, area="small").collect()}
    assert small == {0: (1.0, 1), 1: (0.0, 1)}


def test_numbered_runs_its_child_once(spark):
    from collections.abc import Iterator

    import pyarrow as pa

    passed = spark.sparkContext.accumulator(0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).select((-F.col("id")).alias("id")).mapInArrow(counted, "id long")
    assert [r["id"] for r in ordered.numbered(rows, [], [F.col("id")]).orderBy("n").collect()] == list(range(-999, 1))
    assert passed.value == 1000


def test_assignments_of_one_shape_equal_single_ones():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (1, 4), (4, 1), (3, 3), (5, 2), (4, 6)]:
        costs = rng.integers(0, 4, (50, n, m)).astype(float)  # many ties
        for table, held in zip(costs, match.assign_alike(costs), strict=True):
            x, y = match.assign(table)
            got = sorted(zip(held.tolist(), range(m))) if n > m else list(enumerate(held.tolist()))
            assert got == list(zip(x.tolist(), y.tolist()))


def test_suppression_of_many_groups_equals_single_ones():
    rng = np.random.default_rng(5)
    n = 600
    frame, class_id = np.sort(rng.integers(0, 40, n)), np.zeros(n, int)
    for f in range(40):
        class_id[frame == f] = np.sort(rng.integers(0, 3, (frame == f).sum()))
    low = rng.integers(0, 6, (n, 2)).astype(float)
    boxes = np.hstack([low, low + rng.integers(0, 6, (n, 2))])
    got, want = detect.suppressed_together(frame, class_id, boxes, 0.3), np.zeros(n, bool)
    for f in range(40):
        for c in range(3):
            own = np.flatnonzero((frame == f) & (class_id == c))
            want[own[detect.greedy_suppression(boxes[own], -np.arange(len(own)), 0.3)]] = True
    assert (got == want).all() and 0 < got.sum() < n
