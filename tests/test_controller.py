"""The weight controller against a plain loop, with resets, weights that come to nothing, and block borders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framequery.operators import metrics, ordered


def _plainly(rows, default, start):
    weight, out = start, []
    for share, late in rows:
        if share is not None and share < 1e-6 or late:
            weight = default
        elif share is not None and not 15 <= share <= 25 and weight > 1e-6:
            goal, p = (0.25 if share < 15 else 0.15), share / 100
            if abs(p * (1 - goal)) >= 1e-9:
                change = max(goal * (1 - p) / (p * (1 - goal)), 0.1)
                weight = min(max(weight * change, weight / 10), weight * 10)
        out.append(weight)
    return out


@pytest.mark.parametrize(("default", "start", "block"), [(5.0, 1.0, 7), (1e-4, 1e-3, 3), (1e-7, 2.0, 1 << 16), (2.0, 1e-9, 5)])
def test_equals_the_plain_loop(spark, monkeypatch, default, start, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    rng = random.Random(block)
    series = {k: [(rng.choice([0.0, 14.0, 20.0, 26.0, 26.0, 60.0, 99.9, 100.0, rng.uniform(0, 100), None]) if rng.random() < 0.9 else 40.0, rng.random() < 0.03) for _ in range(90)] for k in ("a", "b", None)}
    rows = [(k, n, s, late) for k, steps in series.items() for n, (s, late) in enumerate(steps)]
    df = spark.createDataFrame(rows, "name string, step long, share double, late boolean").withColumn("weight", F.lit(0)).withColumn("_run", F.lit(1)).repartition(5)
    out = metrics.controlled_weights(df, ["name"], "step", "share", "late", 20.0, 5.0, default, start)
    assert out.columns == [*df.columns, "weight_1"]
    got = {(r["name"], r["step"]): r["weight_1"] for r in out.collect()}
    for k, steps in series.items():
        for n, weight in enumerate(_plainly(steps, default, start)):
            assert math.isclose(got[k, n], weight, rel_tol=1e-9), (k, n)
    assert metrics.controlled_weights(df.limit(0), ["name"], "step", "share", "late", 20.0, 5.0, default, start).count() == 0
