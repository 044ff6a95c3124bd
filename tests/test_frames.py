"""Sources, scoring, decoding and streaming on small generated images."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.functions import text as T
from framequery.operators import decode, detect, frames, grouped, metrics, scoring
from framequery.sources import images, sinks
from framequery.streaming import frames as stream


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    for i in range(3):
        rgb = np.full((20, 30, 3), 10, np.uint8)
        rgb[5:10, 3 + i : 12 + i] = (200, 100, 50 + i)
        (tmp_path / f"img{i}.{'PNG' if i else 'png'}").write_bytes(png(rgb))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def bright(**_):
    """A stand-in detector: the bounding box of bright pixels."""

    def run(img):
        if img[0, 0, 0] == 99:
            raise RuntimeError("bad frame")
        y, x = np.nonzero(img.max(axis=2) > 50)
        return [[1, 0.9, x.min() - 0.5, y.min(), x.max() + 1.5, y.max() + 1]] if len(x) else []

    return run


def blue(**_):
    def run(img):
        if img.size < 10:
            raise RuntimeError("too small")
        return f" blue {int(img[-1, -2, 0])} ", 0.6

    return run


scoring.register("detector", "bright", "test_frames:bright")
scoring.register("recognizer", "blue", "test_frames:blue")


def pipeline(loaded):
    found, errors = scoring.detect(loaded, "bright")
    boxes = detect.clip(detect.score_filter(found, 0.5, "onnx"), 30, 20)
    crops = scoring.crop_boxes(loaded, boxes)
    return scoring.recognize(crops, "blue").select("origin", "det_id", "text"), errors


@pytest.fixture
def on_path(spark):
    import os

    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH", "")
    env["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(__file__), before) if x)
    yield
    env["PYTHONPATH"] = before


def test_images_to_text(spark, folder, on_path):
    assert [r["path"].rsplit("/", 1)[1] for r in images.collect_images(spark, folder).collect()] == ["broken.png", "img0.png", "img1.PNG", "img2.PNG"]
    loaded, rejected = images.load_images(spark, folder)
    assert loaded.count() == 3 and rejected.count() >= 1
    got, errors = pipeline(images.in_memory(loaded))
    assert sorted(r["text"] for r in got.collect()) == ["blue 50", "blue 51", "blue 52"] and errors.count() == 0
    with pytest.raises(ValueError):
        scoring.resolve("detector", "none")
    bad = loaded.limit(1).withColumn("data", F.unhex(F.lit("63" * (30 * 20 * 3))))
    assert scoring.detect(bad, "bright")[1].head()["error"] == "RuntimeError: bad frame"
    tiny = loaded.limit(1).select("origin", F.lit(0).alias("height"), F.lit(0).alias("width"), "nChannels", F.lit(b"").alias("data"))
    assert scoring.recognize(tiny, "blue").head()["text"] == T.EMPTY_CROP


def test_stream_equals_batch(spark, folder, on_path, tmp_path):
    (files,) = ([] for _ in range(1))
    source = images.stream_images(spark, folder)
    sized = lambda d: d.select("path", F.length("content").alias("n"))
    query = stream.run(source, sized, [lambda b, n: files.extend(b.collect()), lambda b, n: None], str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    assert sorted(map(tuple, files)) == sorted(map(tuple, sized(images.image_files(spark, folder, with_content=True)).collect()))


def test_ctc(spark):
    path = lambda ids: [[1.0 if i == k else 0.1 for i in range(4)] for k in ids]
    rows = [(1, t, p) for t, p in enumerate(path([1, 1, 0, 1, 2, 2, 3]))] + [(2, t, p) for t, p in enumerate(path([0, 0]))]
    steps = spark.createDataFrame(rows, "crop_id long, t long, probs array<float>")
    letters = spark.createDataFrame([(0, ""), (1, "a"), (2, "b"), (3, " ")], "idx int, ch string")
    got = {r["crop_id"]: (r["text"], r["confidence"]) for r in decode.ctc_decode(steps, alphabet=letters).collect()}
    assert got == {1: ("aab ", 1.0), 2: ("", 0.0)}
    with pytest.raises(Exception, match="alphabet"):
        decode.ctc_decode(steps, alphabet=letters.where("idx < 3")).collect()


def test_alphabet_and_truths(spark, tmp_path):
    (tmp_path / "d.txt").write_text("　\nx\ny\n")
    (tmp_path / "d.yml").write_text("PostProcess:\n  character_dict: ['　', x, 'y']\n")
    for f in ("d.txt", "d.yml"):
        assert [r["ch"] for r in images.alphabet(spark, str(tmp_path / f)).orderBy("idx").collect()] == ["", "　", "x", "y", " "]
    (tmp_path / "c.json").write_text('{"images":[{"id":1,"file_name":"a","width":100,"height":50}],"annotations":[{"id":7,"image_id":1,"category_id":2,"bbox":[10,5,20,10]}],"categories":[{"id":2,"name":"sign"}]}')
    r = images.coco_truths(spark, str(tmp_path / "c.json")).head()
    assert (r["category"], r["x2"], r["y2"], r["cx"], r["h"]) == ("sign", 30, 15, 0.2, 0.2)


def test_groups_span_batches(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = grouped.map_groups(df, ["k"], ["id"], ["id"], lambda key, rows: (np.array([key[0]]), np.array([rows[0].sum()])), "k long, total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: r["total"] for r in got} == {k: sum(range(k, 1000, 7)) for k in range(7)}


def test_reports(spark, tmp_path):
    per = spark.createDataFrame([(1, 2, 0.5), (2, 0, 0.0)], "frame_id long, det_count int, det_s double")
    totals = metrics.run_totals(per, ["det_s"])
    assert tuple(totals.head()) == (2, 2, 0.5, 4.0)
    assert sinks.write_report(totals, str(tmp_path / "r")) and not sinks.write_report(metrics.run_totals(per.limit(0), ["det_s"]), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        frames.batch_numbers(per, 10, 3, [F.col("frame_id")], F.lit(0))


def test_triggers_grow_with_the_folder(spark, tmp_path):
    for k in range(90):
        (tmp_path / f"{k}.png").write_bytes(b"x" * 100)
    folder = str(tmp_path)
    assert images.files_per_trigger(spark, folder, least=4, triggers=3) == 30  # a fixed 4 would make 23 triggers
    assert images.files_per_trigger(spark, folder, least=40, triggers=3) == 40
    assert images.files_per_trigger(spark, folder, least=4, triggers=3, most_bytes=1000) == 10
