"""The image chain runs each model once a frame and box, with no shuffle, and agrees with the separate operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import text as T
from framequery.operators import detect, scoring
from framequery.plans import runtime
from framequery.sources import images


def counting(kind, path):
    """A model that notes each call in a file."""

    def note():
        with open(path, "a") as out:
            out.write("x\n")

    def find(img):
        note()
        if img.shape[0] == 13:
            raise RuntimeError("bad frame")
        return [[1, 0.9, 1.7, 2.2, 9.9, 8.1], [2, 0.5, 0, 0, 5, 5], [3, 0.7, -4, -4, 500, 6], [4, 0.8, 40, 2, 50, 9]]

    def read(img):
        note()
        if img.shape[1] == 9:
            raise ValueError("unreadable")
        return f"{img.shape[1]}x{img.shape[0]}", 0.6 if img.shape[0] > 5 else 0.2

    return find if kind == "find" else read


@pytest.fixture
def frames(spark):
    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH", "")
    env["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(__file__), before) if x)
    runtime.shared_dir(spark)
    rows = [(f"f{k}", 30, h, bytes(np.full((h, 30, 3), k, np.uint8))) for k, h in enumerate([20, 13, 8, 20, 20])]
    df = spark.createDataFrame(rows, "origin string, width int, height int, data binary").withColumns({"nChannels": F.lit(3), "mode": F.lit(16)})
    yield df.select("origin", "height", "width", "nChannels", "mode", "data").repartition(2).checkpoint()
    env["PYTHONPATH"] = before


scoring.register("detector", "counting", "test_chain:counting")
scoring.register("recognizer", "counting", "test_chain:counting")


@pytest.mark.parametrize("mode", ["batch", "stream"])
def test_one_call_each_and_no_exchange(frames, tmp_path, mode):
    found, reads = str(tmp_path / "found"), str(tmp_path / "reads")
    read = scoring.read_frames(frames, "counting", "counting", mode=mode, recognizer_options={"kind": "read", "path": reads}, kind="find", path=found)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    got = {r["origin"]: r for r in read.collect()}
    assert len(open(found).readlines()) == 5
    assert got["f1"]["error"] == "RuntimeError: bad frame" and not got["f1"]["results"]
    boxes = {k: [b["det_id"] for b in r["results"]] for k, r in got.items() if r["error"] is None}
    assert all(v == ([0, 2] if mode == "batch" else [0, 2, 3]) for v in boxes.values())  # the score 0.5 is not strictly above
    assert len(open(reads).readlines()) == 2 * len(boxes)  # empty crops are not read
    texts = {(r["origin"], r["det_id"]): r["text"] for r in scoring.texts(read).collect()}
    assert texts["f0", 0] == "8x6" and texts["f0", 2] == "30x6"
    assert mode == "batch" or texts["f0", 3] == T.EMPTY_CROP


def test_arrays_agree_with_rows(frames, tmp_path):
    path = str(tmp_path / "found")
    scored = scoring.score_frames(frames, "counting", with_pixels=True, kind="find", path=path)
    assert set(frames.columns) < set(scored.columns)
    good = scored.where("error IS NULL")
    for backend in ("onnx", "paddle"):
        for mode in ("batch", "stream"):
            rows = detect.clip(detect.score_filter(scoring.detections(good.drop("data")), 0.5, backend), F.col("width"), F.col("height"), mode)
            kept = good.select("origin", F.explode(detect.kept_boxes(F.col("boxes"), 0.5, backend, F.col("width"), F.col("height"), mode)).alias("b")).select("origin", "b.*")
            columns = ["origin", "det_id", "class_id", "score", "x1", "y1", "x2", "y2"]
            assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, kept.select(columns).collect()))


def test_no_frames(frames):
    none = frames.limit(0)
    assert scoring.texts(scoring.read_frames(none, "counting", "counting", recognizer_options={"kind": "read", "path": "x"}, kind="find", path="x")).count() == 0
    assert images.in_memory(none).count() == 0
