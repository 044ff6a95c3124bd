"""Column functions against NumPy and plain Python."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequery.functions import config, geometry as G, maths as M, pixels, text as T
from framequery.operators import detect, match


def test_squeeze_matches_python(spark):
    cases = ["  a 　 b\t\nc ", "\x1c\x1dx\x1f", " y z", "", " ", "plain", "a\x85b"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "s string").select(T.squeeze(F.col("s"))).collect()]
    assert got == [" ".join(c.split()) for c in cases]


def test_thresholds_at_their_edges(spark):
    det = spark.createDataFrame([(1, 0.7), (2, 0.4), (3, 0.5), (4, 0.50001)], "det_id int, score double").withColumn("score", F.col("score").cast("float"))
    ids = lambda d: sorted(r["det_id"] for r in d.collect())
    assert ids(detect.score_above(det, 0.7)) == []
    assert ids(detect.score_at_least(det, 0.7)) == []  # 0.7 in single precision lies below 0.7
    assert ids(detect.score_at_least(det, 0.4)) == [1, 2, 3, 4]
    assert ids(detect.score_filter(det, 0.5, "onnx")) == [1, 4] and ids(detect.score_filter(det, 0.5, "paddle")) == [1, 3, 4]


def test_clip_truncates_toward_zero(spark):
    det = spark.createDataFrame([(-0.9, -3.5, 700.9, 5.9), (10.9, 2.2, 10.99, 9.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in detect.clip(det, 640, 480, "stream").collect()] == [(0, 0, 640, 5), (10, 2, 10, 9)]
    assert detect.clip(det, 640, 480).count() == 1


def test_overlap_properties(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(v) for v in (*a, *(a + w), *b, *(b + u))) for a, w, b, u in ((rng.integers(0, 20, 2), rng.integers(0, 9, 2), rng.integers(0, 20, 2), rng.integers(0, 9, 2)) for _ in range(200))]
    names = [f"{p}_{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2")]
    a, b = G.box("a_"), G.box("b_")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    for r in df.select(G.iou(a, b).alias("i"), G.iou(b, a).alias("j"), G.giou(a, b).alias("g")).collect():
        assert r["i"] == r["j"]
        if r["i"] is not None:
            assert 0 <= r["i"] <= 1 and (r["g"] is None or -1 <= r["g"] <= r["i"] + 1e-12)


def test_knots_are_symmetric_and_increase():
    k = G.knots(32, 0.5, 4.0)
    assert len(k) == 33 and k == sorted(k) and k[16] == 0 and all(abs(x + y) < 1e-12 for x, y in zip(k, reversed(k), strict=True))


def test_schedule_branches(spark):
    lr = M.flat_cosine(F.col("id"), 100, 10, 40, 20, 1.0, 0.1)
    got = [r[0] for r in spark.range(101).select(lr).collect()]
    assert got[0] == 0 and got[5] == 0.25 and got[10] == 1 and got[40] == 1 and got[80] == 0.1 and got[100] == 0.1
    assert math.isclose(got[60], 0.1 + 0.9 * 0.5)


@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_assignment_is_cheapest(n, m, seed):
    from itertools import permutations

    c = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    i, j = match.assign(c)
    k = min(n, m)
    assert len(i) == k == len(set(i)) == len(set(j)) and (np.diff(i) > 0).all()
    small = c if n <= m else c.T
    best = min(sum(small[r, p[r]] for r in range(k)) for p in permutations(range(max(n, m)), k))
    assert math.isclose(c[i, j].sum(), best)


def test_suppression_leaves_no_overlap():
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 50, (80, 2))
    boxes, scores = np.concatenate([xy, xy + rng.uniform(5, 30, (80, 2))], axis=1), rng.uniform(size=80)
    kept = detect.greedy_suppression(boxes, scores, 0.4)
    assert kept[0] == scores.argmax() and list(scores[kept]) == sorted(scores[kept], reverse=True)

    def iou(a, b):
        inter = np.clip(np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]), 0, None).prod()
        return inter / ((a[2:] - a[:2]).prod() + (b[2:] - b[:2]).prod() - inter)

    assert all(iou(boxes[i], boxes[j]) <= 0.4 for i in kept for j in kept if i != j)
    assert all(any(iou(boxes[i], boxes[j]) > 0.4 and scores[j] >= scores[i] for j in kept) for i in set(range(80)) - set(kept))


def test_pixels():
    img = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (pixels.resize(img, 6, 4) == img).all()
    square, ratio, left, top = pixels.letterbox(img, 12)
    assert square.shape == (12, 12, 3) and ratio == 2 and (left, top) == (0, 2) and (square[:2] == pixels.PAD_VALUE).all()
    assert pixels.detector_input(square).shape == (1, 3, 12, 12)
    assert pixels.crop(img, 2, 1, -3, 3).size == 0 and pixels.crop(img, -5, 0, 2, 2).shape == (2, 2, 3)
    assert pixels.recognizer_input(img).shape == (3, 48, 320)
    assert (pixels.equalized_gray(img, 3).shape[0], pixels.draw_rectangle(img, 0, 0, 3, 3, (1, 2, 3), 1)[0, 0].tolist()) == (2, [1, 2, 3])


def test_config(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "base.yml").write_text("a: {x: 1, y: 2}\nb: [1]\n")
    (tmp_path / "top.yml").write_text("__include__: [sub/base.yml]\na: {y: 3}\n")
    assert config.load_tree(tmp_path / "top.yml") == {"a": {"x": 1, "y": 3}, "b": [1]} == config.load_tree(tmp_path / "top.yml")
    assert config.overrides(["a.c=3", "a.d=[x]"]) == {"a": {"c": 3, "d": ["x"]}}
    (tmp_path / "p.yml").write_text("other: {k: 1}\n/**: {ros__parameters: {t: 1}}\nnode: {ros__parameters: {t: 2}}\n")
    assert config.node_parameters(tmp_path / "p.yml", "node") == {"t": 2} and config.node_parameters(tmp_path / "p.yml", "none") == {"t": 1}
    assert config.resolve_path("m/x.onnx", tmp_path / "configs" / "a.yml") == tmp_path.resolve() / "m" / "x.onnx"
