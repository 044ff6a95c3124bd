"""Queries over image files, streams of them, and what a run writes. The models are stand-ins that find a grey box."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions import text as T
from ..operators import augment, frames, metrics, scoring
from ..sources import images, sinks
from ..streaming import frames as stream
from . import fixtures as X
from .catalog import query
from .runtime import delete_on_exit, shared_dir

_P = "WITH " + X.PICTURES_SQL


def box_finder(**_):
    """The bounding box of the light pixels, half a pixel wide of them."""

    def run(img: np.ndarray) -> list:
        y, x = np.nonzero(img.max(axis=2) > 50)
        return [[1, 0.9, x.min() - 0.5, y.min() - 0.5, x.max() + 1.5, y.max() + 1.5], [2, 0.3, 0, 0, 5, 5]] if len(x) else []

    return run


def stray_finder(**_):
    """As ``box_finder``, and a box beyond the image's right border in place of the weak one."""
    find = box_finder()
    return lambda img: [*find(img)[:1], [3, 0.8, img.shape[1] + 4, 2, img.shape[1] + 9, 8]]


def size_reader(**_):
    """Names the size of a crop; none of 9 wide."""

    def run(img: np.ndarray) -> tuple[str, float]:
        if img.shape[1] == 11:
            raise RuntimeError("unreadable")
        return f" {img.shape[1]}  by {img.shape[0]} ", 0.4 if img.shape[1] == 9 else 0.6

    return run


scoring.register("detector", "box finder", f"{__name__}:box_finder")
scoring.register("detector", "stray finder", f"{__name__}:stray_finder")
scoring.register("recognizer", "size reader", f"{__name__}:size_reader")


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.decode_images(images.image_files(spark, X.pictures(spark, sf_dir), with_content=True).drop("length"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = X.pictures(spark, sf_dir)
    return images.stream_images(spark, folder, images.files_per_trigger(spark, folder)).drop("length")


def _name(c: str):
    return T.base_name(F.col(c)).alias("name")


@query(f"{_P} SELECT stem || suffix AS name FROM pic UNION ALL SELECT 'broken.png'")
def image_scan(spark, sf_dir):
    return images.collect_images(spark, X.pictures(spark, sf_dir)).select(_name("path"))


_BYTES = """repeat(chr(10), 3 * width * y1) || repeat(repeat(chr(10), 3 * x1) || repeat('d', 3 * (x2 - x1)) || repeat(chr(10), 3 * (width - x2)), y2 - y1) || repeat(chr(10), 3 * width * (height - y2))"""


@query(f"{_P} SELECT stem || suffix AS name, height, width, 3 AS channels, md5({_BYTES}) AS pixels FROM pic")
def image_load(spark, sf_dir):
    loaded, _ = images.load_images(spark, X.pictures(spark, sf_dir))
    return images.in_memory(loaded).select(_name("origin"), "height", "width", F.col("nChannels").alias("channels"), F.md5("data").alias("pixels"))


@query(f"{_P} SELECT stem || suffix AS name, height, width, md5({_BYTES}) AS pixels, NULL AS error FROM pic UNION ALL SELECT 'broken.png', 0, 0, NULL, 'not an image of a known format'")
def image_decode(spark, sf_dir):
    size = [F.coalesce(c, F.lit(0)).alias(c) for c in ("height", "width")]
    return _decoded(spark, sf_dir).select(_name("origin"), *size, F.md5("data").alias("pixels"), "error")


_FOUND = """found AS (SELECT stem || suffix AS name, x1, y1, x2, y2, CASE x2 - x1 WHEN 9 THEN 'no_text_detected' WHEN 11 THEN 'ocr_error' ELSE CAST(x2 - x1 AS VARCHAR) || ' by ' || CAST(y2 - y1 AS VARCHAR) END AS text
  FROM (SELECT stem, suffix, x1, y1, x2 + 1 AS x2, y2 + 1 AS y2 FROM (SELECT stem, suffix, CAST(trunc(x1 - 0.5) AS INT) AS x1, CAST(trunc(y1 - 0.5) AS INT) AS y1, CAST(trunc(x2 - 0.5) AS INT) AS x2, CAST(trunc(y2 - 0.5) AS INT) AS y2 FROM pic)))"""


def _read(decoded: DataFrame, detector: str = "box finder", mode: str = "batch") -> DataFrame:
    """Frames to texts in one pass; pixels stay in their rows."""
    return scoring.read_frames(decoded.where("error IS NULL").drop("error"), detector, "size reader", mode=mode)


def read_frames(decoded: DataFrame) -> DataFrame:
    """A row per text: score, filter, clip, crop, recognize."""
    return scoring.texts(_read(decoded))


@query(f"{_P}, {_FOUND} SELECT * FROM found")
def image_texts(spark, sf_dir):
    return read_frames(_decoded(spark, sf_dir)).select(_name("origin"), "x1", "y1", "x2", "y2", "text")


@query(f"{_P}, {_FOUND} SELECT name, 0 AS det_id, text FROM found UNION ALL SELECT name, 1, 'empty_crop' FROM found")
def empty_crops(spark, sf_dir):
    """A stream's frames keep boxes that lie outside the image: their crops are empty and say so."""
    read = scoring.texts(_read(_decoded(spark, sf_dir), "stray finder", "stream"))
    return read.select(_name("origin"), "det_id", "text")


@query(f"{_P}, {_FOUND} SELECT *, true AS stamped FROM found")
def image_stream(spark, sf_dir):
    out, again = _folder(spark, "texts"), _folder(spark, "progress")
    files = _streamed(spark, sf_dir)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.finish(stream.run(images.decode_images(files), read_frames, [write], again, once=True), lambda: None)
    read = spark.read.parquet(out)
    return read.select(_name("origin"), "x1", "y1", "x2", "y2", "text", F.col("event_time").isNotNull().alias("stamped"))


@query(f"{_P} SELECT count(*) AS frames, CAST(count(*) AS INT) AS detections, least(count(*), 10) - 1 AS saved, 1 AS failed FROM pic")
def stream_totals(spark, sf_dir):
    """Running counts of a stream, its numbered frames, and a sink that may fail, flushed at the end."""
    out, again, counts = _folder(spark, "totals"), _folder(spark, "progress"), stream.Numbers(_folder(spark, "numbers"), "origin")
    files = _streamed(spark, sf_dir)
    told: list[int] = []

    def count(decoded: DataFrame) -> DataFrame:
        scored = scoring.score_frames(decoded.where("error IS NULL").drop("error"), "box finder")
        return scored.select("origin", F.size(F.filter("boxes", lambda b: b["score"] > 0.5)).cast("long").alias("det_count"))

    def write(batch: DataFrame, number: int) -> None:
        counts(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def broken(batch: DataFrame, number: int) -> None:
        raise OSError("no display")

    result: list[DataFrame] = []

    def flush() -> None:
        kept = spark.read.parquet(out)
        result.append(kept.agg(F.count("*").alias("frames"), F.sum("det_count").cast("int").alias("detections"), F.count(F.when(F.col("number").between(2, 10), 1)).alias("saved"), F.lit(int(bool(told))).alias("failed")))

    stream.finish(stream.run(images.decode_images(files), count, [write], again, once=True, optional=[broken], failed=lambda n, e: told.append(n)), flush)
    return result[0]


@query(f"{_P} SELECT count(*) AS frames, CAST(sum(2 + k % 3) AS BIGINT) AS detections, CAST(sum(width) AS DOUBLE) / 64 AS det_s FROM pic")
def stream_counters(spark, sf_dir):
    """Counters of a stream's whole life, kept by Spark's state and written anew after each batch."""
    out = _folder(spark, "counters")
    files = _streamed(spark, sf_dir)
    decoded = images.decode_images(files).where("error IS NULL")
    k = F.substring(T.base_name(F.col("origin")), 4, 9).cast("int")
    counted = stream.running_totals(decoded.select((2 + F.pmod(k, F.lit(3))).cast("long").alias("det_count"), (F.col("width").cast("double") / 64).alias("det_s")), ["det_s"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", _folder(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"{_P} SELECT stem || '.png' AS name, height, width, '00FF00' AS corner, '0A0A0A' AS ground FROM pic")
def annotated_frames(spark, sf_dir):
    out = _folder(spark, "annotated")
    sinks.write_files(sinks.annotated_rows(_read(_decoded(spark, sf_dir))), out)
    back = images.decode_images(images.image_files(spark, out, with_content=True))
    k = F.substring(_name("origin"), 4, 9).cast("int")
    x, y = 2 + F.pmod(k, F.lit(5)), 24 + F.pmod(k, F.lit(4))
    pixel = lambda px, py: F.hex(F.substring("data", (3 * (py * F.col("width") + px) + 1).cast("int"), F.lit(3)))
    return back.select(_name("origin"), "height", "width", pixel(x - 1, y).alias("corner"), pixel(F.lit(0), F.col("height") - 1).alias("ground"))


@query(f"{_P} SELECT stem || '.png' AS name, true AS drawn, 1 AS failed FROM pic")
def annotated_stream(spark, sf_dir):
    """Annotated frames as a stream's own sink, beside one that fails: the results are written all the same."""
    out, drawn = _folder(spark, "texts"), _folder(spark, "drawn")
    files = _streamed(spark, sf_dir)
    told: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        scoring.texts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def draw(batch: DataFrame, number: int) -> None:
        sinks.write_files(sinks.annotated_rows(batch), drawn)

    def broken(batch: DataFrame, number: int) -> None:
        raise OSError("no display")

    started = stream.run(images.decode_images(files), _read, [write], _folder(spark, "progress"), once=True, optional=[draw, broken], failed=lambda n, e: told.append(n))
    stream.finish(started, lambda: None)
    texts = spark.read.parquet(out).select(F.regexp_replace(T.base_name(F.col("origin")), r"\.(png|PNG)$", ".png").alias("name")).distinct()
    found = images.collect_images(spark, drawn).select(_name("path"), F.lit(True).alias("drawn"))
    return texts.join(found, "name", "left").select("name", F.coalesce("drawn", F.lit(False)).alias("drawn"), F.lit(int(bool(told))).alias("failed"))


@query(
    f"""{_P}, lb AS (SELECT *, least(64.0::DOUBLE / width, 64.0::DOUBLE / height) AS ratio FROM pic)
  SELECT stem || suffix AS name, 4096 - CAST(trunc(width * ratio) AS INT) * CAST(trunc(height * ratio) AS INT) AS padding, round(114 / 255.0::DOUBLE, 6) AS largest,
    least(CAST(trunc(48 * greatest(320.0::DOUBLE / 48, width / height::DOUBLE)) AS INT), 3200) AS read_width, 255 * 3 * (x2 - x1) * (y2 - y1) AS light, 4 * 3 * (10 * (width * height - (x2 - x1) * (y2 - y1)) + 100 * (x2 - x1) * (y2 - y1)) AS doubled FROM lb"""
)
def prepared_frames(spark, sf_dir):
    """What goes into the models: padded squares, recognizer inputs, equalised grey, enlarged images, as figures of their pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                origin, h, w, data = (batch.column(i)[row].as_py() for i in range(4))
                img = pixels.image(data, h, w)
                square = pixels.letterbox(img, 64)[0]
                rows.append((origin, int((square == pixels.PAD_VALUE).all(axis=2).sum()), round(float(pixels.detector_input(square).max()), 6), pixels.recognizer_input(img).shape[2], int(pixels.equalized_gray(img, 960).sum()), int(pixels.nearest(img, 2).sum())))
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["origin", "padding", "largest", "read_width", "light", "doubled"])

    good = _decoded(spark, sf_dir).where("error IS NULL").select("origin", "height", "width", "data")
    out = good.mapInArrow(run, "origin string, padding int, largest double, read_width int, light int, doubled int")
    return out.select(_name("origin"), "padding", F.round("largest", 6).alias("largest"), "read_width", "light", "doubled")


def _uniform(name: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('9:{name}:' || stem || suffix), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


def _factor(name: str, low: float, high: float) -> str:
    return f"CASE WHEN {_uniform(name + '-use')} < 0.5 THEN {low}::DOUBLE + {high - low}::DOUBLE * {_uniform(name)} END"


# the pictures are grey, so that saturation and hue leave them alone; ground and box are followed one by one
@query(
    f"""{_P}, d AS (SELECT *, {_factor("brightness", 0.875, 1.125)} AS b, {_factor("contrast", 0.5, 1.5)} AS c, (x2 - x1) * (y2 - y1) AS n FROM pic),
  l AS (SELECT *, coalesce(floor(10 * b + 0.5), 10) AS g, coalesce(floor(100 * b + 0.5), 100) AS f FROM d),
  m AS (SELECT *, (g * (width * height - n) + f * n) / (width * height) AS mean FROM l)
  SELECT stem || suffix AS name, CAST(CASE WHEN c IS NULL THEN g ELSE least(greatest(floor(g * c + (1 - c) * mean + 0.5), 0), 255) END AS INT) AS ground, CAST(CASE WHEN c IS NULL THEN f ELSE least(greatest(floor(f * c + (1 - c) * mean + 0.5), 0), 255) END AS INT) AS box FROM m"""
)
def distorted_frames(spark, sf_dir):
    """Photometric distortion with drawn factors, shown by a frame's first pixel and by one inside its box."""
    good = _decoded(spark, sf_dir).where("error IS NULL").withColumn("origin", T.base_name(F.col("origin")))
    drawn = augment.photometric(good.select("origin", "height", "width", "data"), 9, "origin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                origin, h, w, data, *factors = (batch.column(i)[row].as_py() for i in range(9))
                img = pixels.distorted(pixels.image(data, h, w), *factors)
                k = int(origin[3:12])
                rows.append((origin, int(img[0, 0, 0]), int(img[24 + k % 4, 2 + k % 5, 2])))
            name, ground, box = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(ground, pa.int32()), pa.array(box, pa.int32())], names=["name", "ground", "box"])

    factors = ["brightness", "contrast", "saturation", "hue", "contrast_first"]
    return drawn.select("origin", "height", "width", "data", *factors).mapInArrow(run, "name string, ground int, box int")


@query("SELECT 'broken.png' AS name, 'not an image of a known format' AS error")
def quarantined(spark, sf_dir):
    _, bad = sinks.split_errors(_decoded(spark, sf_dir), "data")
    return bad.select(_name("origin"), "error")


@query(f"{_P} SELECT count(*) AS frames, CAST(2 * count(*) AS INT) AS detections, CAST(sum(width) AS DOUBLE) / 64 AS det_s, round(count(*) / (CAST(sum(width) AS DOUBLE) / 64), 9) AS det_s_rate FROM pic")
def run_report(spark, sf_dir):
    out = _folder(spark, "report")
    per = _decoded(spark, sf_dir).where("error IS NULL").select((F.col("width").cast("double") / 64).alias("det_s"), F.lit(2).alias("det_count"))
    sinks.write_report(metrics.run_totals(per, ["det_s"]), out)
    read = spark.read.schema("frames long, detections int, det_s double, det_s_rate double").json(out)
    return read.withColumn("det_s_rate", F.round("det_s_rate", 9))


@query(f"{_P}, {_FOUND} SELECT name, CASE WHEN text IN ('no_text_detected', 'ocr_error') THEN 0 ELSE 1 END AS n, CASE WHEN text IN ('no_text_detected', 'ocr_error') THEN NULL ELSE text END AS text FROM found")
def message_files(spark, sf_dir):
    out = _folder(spark, "messages")
    decoded = _decoded(spark, sf_dir).where("error IS NULL")
    results = read_frames(decoded)
    sinks.write_messages(frames.messages(decoded.select("origin"), results, "origin"), out)
    read = spark.read.schema("origin string, detections array<struct<results:array<struct<class_id:string>>>>").json(out)
    return read.select(_name("origin"), F.size("detections").alias("n"), F.get("detections", F.lit(0))["results"][0]["class_id"].alias("text"))


@query("SELECT 0 AS idx, '' AS ch UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT), n_name FROM nation UNION ALL SELECT 26, ' '")
def character_dictionary(spark, sf_dir):
    out = _folder(spark, "dictionary")
    X.table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(out)  # 25 rows
    return images.alphabet(spark, out)


@query(
    """SELECT CAST(s_nationkey AS BIGINT) AS image_id, s_suppkey AS gt_id, r_name AS category, 'f' || s_nationkey AS file_name, CAST(s_suppkey % 90 AS DOUBLE) AS x1, CAST(s_suppkey % 40 + 10 AS DOUBLE) AS y2,
  round((s_suppkey % 90 + 2.5::DOUBLE) / (100 + s_nationkey), 9) AS cx, round(10.0::DOUBLE / 50, 9) AS h, round(s_suppkey % 90 * 640.0::DOUBLE / (100 + s_nationkey), 6) AS resized_x1
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def annotation_file(spark, sf_dir):
    out = _folder(spark, "annotations")
    nation, region, supplier = (X.table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    some = lambda df, *c: df.agg(F.collect_list(F.struct(*c)).alias("list"))
    pictures = some(nation, F.col("n_nationkey").alias("id"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file_name"), (100 + F.col("n_nationkey")).alias("width"), F.lit(50).alias("height"))
    box = F.array(F.pmod("s_suppkey", F.lit(90)).cast("double"), F.pmod("s_suppkey", F.lit(40)).cast("double"), F.lit(5.0), F.lit(10.0)).alias("bbox")
    marks = some(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("image_id"), F.col("n_regionkey").alias("category_id"), box, F.lit(50.0).alias("area"), F.lit(0).alias("iscrowd"))
    names = some(region, F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    # the format is one JSON object
    whole = pictures.select(F.col("list").alias("images")).join(marks.select(F.col("list").alias("annotations"))).join(names.select(F.col("list").alias("categories")))
    whole.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value")).coalesce(1).write.text(out)
    truths = images.coco_truths(spark, out)
    resized = images.training_boxes(truths).select("gt_id", F.round("x1", 6).alias("resized_x1"))
    return truths.join(resized, "gt_id").select("image_id", "gt_id", "category", "file_name", "x1", "y2", F.round("cx", 9).alias("cx"), F.round("h", 9).alias("h"), "resized_x1")
