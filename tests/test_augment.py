"""Sampling, permutations, dense places, overlap crops and mixup against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import pixels
from framequery.operators import augment, sampling


@pytest.mark.parametrize("method", ["bilinear", "discrete"])
def test_sampling_equals_arrays(spark, method):
    rng = np.random.default_rng(2)
    maps = {k: rng.normal(size=(4, 4)) for k in range(3)}
    rows = [(int(rng.integers(0, 5)), int(rng.integers(0, 4)), float(rng.uniform(-0.4, 1.4)), float(rng.uniform(-0.4, 1.4)), float(rng.uniform(-1, 2))) for _ in range(200)]
    rows += [(9, 0, 0.125, 0.125, 1.0), (9, 1, 1.0, 1.0, 2.0), (10, 0, None, 0.5, 1.0), (11, 1, 0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "k long, map long, x double, y double, w double")
    px = sampling.as_pixels(spark.createDataFrame([(k, m.ravel().tolist()) for k, m in maps.items()], "id long, v array<double>"), "id", "v", 4)
    got = {r["k"]: r["value"] for r in sampling.sampled(df, px, ["k"], 4, 4, method, "w").collect()}
    want = {}
    for k, m, x, y, w in rows:
        want.setdefault(k, 0.0)
        if m in maps and None not in (x, y, w):
            if method == "discrete":
                value = maps[m][min(max(int(y * 4 + 0.5), 0), 3), min(max(int(x * 4 + 0.5), 0), 3)]
            else:
                value = pixels.sample(maps[m], np.array([x]), np.array([y]))[0]
            want[k] += w * value
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sampling.sampled(df.limit(0), px, ["k"], 4, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000])
def test_permutation_and_inverse(spark, n):
    turn = augment.Permutation(n, 5)
    got = spark.range(n).select("id", turn.of(F.col("id")).alias("to"), turn.of(turn.of(F.col("id")), back=True).alias("again")).collect()
    assert sorted(r["to"] for r in got) == list(range(n)) and all(r["again"] == r["id"] for r in got)
    assert n < 90 or [r["to"] for r in sorted(got)] != list(range(n))
    walked = augment.Permutation(n, 5)
    walked.b = walked.b + 3  # many results out of range
    walked.a = -(-n // walked.b) + 2
    got = spark.range(n).select("id", walked.of(F.col("id")).alias("to"), walked.of(walked.of(F.col("id")), back=True).alias("again")).collect()
    assert sorted(r["to"] for r in got) == list(range(n)) and all(r["again"] == r["id"] for r in got)


def test_dense_places(spark):
    ids = random.Random(1).sample(range(-500, 10_000), 300) + [10**15]
    got, n = augment.dense_places(spark.createDataFrame([(i,) for i in ids], "id long").repartition(3), "id", "at", per_bucket=20)
    assert n == 301 and {r["id"]: r["at"] for r in got.collect()} == {i: k for k, i in enumerate(sorted(ids))}
    assert augment.dense_places(spark.createDataFrame([], "id long"), "id", "at")[1] == 0


def test_mixup_pairs_each_image_once(spark):
    images = spark.range(0, 120, 3).withColumnRenamed("id", "image_id")
    truths = images.where("image_id % 2 = 0").select("image_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("det"))
    rows = augment.mixed_up(truths, images, 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["image_id"], set()).add((r["base"], r["weight"]))
    assert all(len(v) == 2 for v in by.values()) and len(by) == 20  # once as base, once as partner
    assert all({b for b, _ in v} - {i} for i, v in by.items())
    own = {i: w for i, v in by.items() for b, w in v if b == i}
    assert all(0.45 <= w < 0.55 for w in own.values()) and len(rows) == 4 * 20
    one = augment.mixed_up(truths.where("image_id = 0"), images.limit(1), 4).collect()
    assert abs(sum(r["weight"] for r in one if r["det"] == 1) - 1) < 1e-12
    assert augment.mixed_up(truths, images.limit(0), 4).count() == 0


def test_overlap_crops(spark):
    rows = [(i, d, 10.0 * d, 5.0 * d, 10.0 * d + 40 + i % 30, 5.0 * d + 60, 200, 150) for i in range(60) for d in range(4)] + [(99, 0, 0.0, 0.0, 0.0, 0.0, 200, 150)]
    df = spark.createDataFrame(rows, "image_id long, det_id int, x1 double, y1 double, x2 double, y2 double, width int, height int")
    out = augment.overlap_cropped(df, 3, probability=1.0).collect()
    cropped = [r for r in out if r["trial"] is not None]
    assert cropped and len(cropped) < len(out) and {r["image_id"] for r in out} == {r[0] for r in rows}
    for r in cropped:
        assert 0 <= r["x1"] <= r["x2"] <= r["width"] <= 200 and 0 <= r["y1"] <= r["y2"] <= r["height"] <= 150 and 0.5 <= r["width"] / r["height"] <= 2
        assert r["left"] + r["width"] <= 200 and r["top"] + r["height"] <= 150
    whole = augment.overlap_cropped(df, 3, probability=0.0).drop("left", "top", "trial").select(df.columns)
    assert sorted(map(tuple, whole.collect())) == sorted(rows)
    assert augment.overlap_cropped(df.limit(0), 3).count() == 0


def test_small_maps_meet_places_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.5, 1.0)], "k int, map int, x double, y double, w double")
    px = spark.createDataFrame([(1, 2, 1, 4.0), (1, 1, 1, 2.0)], "map int, y int, x int, value double")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        out = sampling.sampled(df, px, ["k"], 4, 4, weight="w")
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        assert [tuple(r) for r in out.collect()] == [(1, 1.5)]
    finally:
        spark.conf.set(key, before)


def test_windows_too_large_for_the_boxes_are_not_placed(spark):
    """The bound passes over windows and never over one that fits: a box as large as the window's least overlap."""
    rows = [(k, k, 0.0, 0.0, w, h, 100, 100) for k in range(120) for w, h in [[(100.0, 100.0), (30.0, 30.0), (3.0, 3.0)][k % 3]]]
    df = spark.createDataFrame(rows, "image_id int, det_id int, x1 double, y1 double, x2 double, y2 double, width int, height int").withColumns({c: F.col(c) + 40 for c in ("x1", "y1")}).withColumns({c: F.col(c) + 40 for c in ("x2", "y2")})
    got = {r["image_id"]: r["trial"] for r in augment.overlap_cropped(df, 9).select("image_id", "trial").collect()}
    early = [t for t in got.values() if t is not None]
    assert len(got) == 120 and max(early) >= 4 > min(early) and augment._pieces(40) == [(0, 4), (4, 12), (12, 40)]
