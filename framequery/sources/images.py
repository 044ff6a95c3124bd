"""Sources: image folders (batch and stream), annotation files, character dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import images

# The file suffixes taken as images.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")
#: OpenCV's type number of three unsigned 8-bit channels, which Spark's image schema uses.
BGR_MODE = 16
IMAGE = T.StructType(
    [T.StructField(n, t) for n, t in (("origin", T.StringType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("nChannels", T.IntegerType()), ("mode", T.IntegerType()), ("data", T.BinaryType()))]
)


def is_image(path: Column) -> Column:
    """The suffix test ignores case, unlike the reader's glob filter."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*SUFFIXES)


def image_files(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of the image files right in a folder.

    The content column is read only if it is asked for.
    """
    files = spark.read.format("binaryFile").load(folder).where(is_image(F.col("path")))
    return files if with_content else files.drop("content")


def collect_images(spark: SparkSession, folder: str) -> DataFrame:
    """The image paths in order; an error if there is none."""
    files = image_files(spark, folder).select("path")
    if not files.head(1):
        raise ValueError(f"no images in {folder}")
    return files.orderBy("path")


def load_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(frames, rejected): the folder's image files by Spark's reader, as BGR, and those that can't be decoded.

    For the formats that Java reads; ``decode_images`` takes bytes from anywhere, streams included.
    """
    read = spark.read.format("image").load(folder).select("image.*").where(is_image(F.col("origin")))
    return read.where("width > 0"), read.where("width <= 0").select(F.col("origin").alias("path"), F.lit("not decodable").alias("error"))


def decode_images(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Frames of encoded images in a column, batch or stream: the image columns, the other columns, and ``error``.

    An image that can't be decoded has an error and null pixels; it never stops a run.
    """
    kept = [c for c in files.columns if c not in (path, content)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a frame at a time: pixels are much larger than files
                try:
                    img = images.decode(batch.column(1)[row].as_py())
                    values = (img.shape[0], img.shape[1], 3, BGR_MODE, img.tobytes(), None)
                except ValueError as e:
                    values = (None, None, None, None, None, str(e))
                columns = [pa.array([v], t) for v, t in zip(values, (*[pa.int32()] * 4, pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *columns, *[batch.column(2 + k).slice(row, 1) for k in range(len(kept))]], names=[*[f.name for f in IMAGE], "error", *kept])

    schema = T.StructType([*IMAGE, T.StructField("error", T.StringType()), *[files.schema[c] for c in kept]])
    return files.select(F.col(path).cast("string"), content, *kept).mapInArrow(run, schema)


def files_per_trigger(spark: SparkSession, folder: str, least: int = 40, triggers: int = 25, most_bytes: int = 256 << 20) -> int:
    """A trigger's share of what lies in a folder now: ``triggers`` triggers in all, so that their fixed cost does not grow with the folder.

    Never fewer than ``least`` files; beyond them no more than make up ``most_bytes``, as large files are work enough.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place)
    files, size = found.getFileCount(), found.getLength()
    return max(least, min(-(-files // triggers), files * most_bytes // max(size, 1)))


def stream_images(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Encoded frames as a stream of a folder's files; the file time is the event time.

    The trigger limit throttles; unlike a bounded queue it drops nothing.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.where(is_image(F.col("path"))).withColumnRenamed("modificationTime", "event_time")


def in_memory(frames: DataFrame) -> DataFrame:
    """Frames that are loaded already: checks the columns and the channel count."""
    missing = [f.name for f in IMAGE if f.name not in frames.columns]
    if missing:
        raise ValueError(f"frames lack {missing}")
    return frames.where(F.when(F.col("nChannels") == 3, True).otherwise(F.raise_error(F.lit("an image must have three channels")).cast("boolean")))


_COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType())]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)


def coco_truths(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of a COCO file: corners and normalised centre boxes with names and sizes."""
    read = spark.read.option("multiLine", True).schema(_COCO).json(path)
    part = lambda name: read.select(F.explode(name).alias("x")).select("x.*")
    images = part("images").withColumnRenamed("id", "image_id")
    names = part("categories").withColumnsRenamed({"id": "category_id", "name": "category"})
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    rows = part("annotations").join(images, "image_id").join(names, "category_id", "left")
    return rows.select(
        "image_id", F.col("id").alias("gt_id"), "category_id", "category", "file_name", "width", "height",
        x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
        ((x + w / 2) / F.col("width")).alias("cx"), ((y + h / 2) / F.col("height")).alias("cy"), (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"), "iscrowd",
    )


def training_boxes(truths: DataFrame, side: int = 640) -> DataFrame:
    """Truths as a training step sees them: corners in the image resized to a square, and normalised centre boxes."""
    sx, sy = F.lit(float(side)) / F.col("width"), F.lit(float(side)) / F.col("height")
    resized = G.scale(G.box(), sx, sy)
    centre = G.scale(G.corners_to_centre(resized), F.lit(1.0) / side, F.lit(1.0) / side)
    return truths.withColumns({n: c for n, c in zip(("x1", "y1", "x2", "y2", "cx", "cy", "w", "h"), (*resized, *centre), strict=True)})


def alphabet(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch) of a recognizer: the blank, the dictionary's entries in order, a space at the end.

    ``path`` is a text file with one entry a line, or YAML with PostProcess.character_dict.
    A dictionary is a small model file (tens of thousands of entries), read on the driver.
    """
    text = spark.read.text(path, wholetext=True).head()[0]
    if path.endswith((".yml", ".yaml")):
        import yaml

        entries = [str(c) for c in yaml.safe_load(text)["PostProcess"]["character_dict"]]
    else:
        entries = text.split("\n")
        entries = entries[:-1] if entries and entries[-1] == "" else entries
    return spark.createDataFrame([(i, c) for i, c in enumerate(["", *entries, " "])], "idx int, ch string")
