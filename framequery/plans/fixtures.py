"""Bridges from the driver's tables to the library's logical inputs.

Each bridge has a DataFrame form and SQL text (a CTE) that DuckDB runs too, so that
queries and their reference SQL start from equal rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images as images_of
from ..sources import sinks
from .runtime import delete_on_exit, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Regions found in frames of 640 x 480 (one frame per order). The id is made of the row itself, so no
#: row is numbered by a window and filters reach the scan.
DETECTIONS_SQL = """det AS (
 SELECT frame_id, det_id, class_id, score, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (
  SELECT l_orderkey AS frame_id,
   l_linenumber + 8 * ((l_partkey * 7919 + l_suppkey * 104729 + CAST(l_quantity AS BIGINT) * 1299709) % 1099511627689) AS det_id,
   CAST(l_linenumber % 3 AS INT) AS class_id,
   CAST((l_partkey*37 + l_suppkey*11 + l_linenumber*7) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
   CAST((l_partkey*13 + l_linenumber*101) % 680 AS DOUBLE) - CAST(20 AS DOUBLE) + l_tax AS x1,
   CAST((l_suppkey*29 + l_linenumber*17) % 500 AS DOUBLE) - CAST(10 AS DOUBLE) + l_discount AS y1,
   l_quantity * CAST(4 AS DOUBLE) AS w, CAST(l_linenumber*30 AS DOUBLE) AS h FROM lineitem) t)"""

#: The same regions on sixteen crowded frames of 20000 x 20000, one in a thousand of them twenty times as large.
CROWD_SQL = """crowd AS (
 SELECT frame_id, det_id, x1, y1, x1 + w * far AS x2, y1 + h * far AS y2 FROM (
  SELECT l_suppkey % 16 AS frame_id, (l_orderkey * 8 + l_linenumber) * 1000003 + (l_partkey * 7919 + l_suppkey * 104729 + CAST(l_quantity AS BIGINT)) % 1000003 AS det_id,
   CAST((l_partkey*131 + l_linenumber*1009 + l_orderkey*7) % 20000 AS DOUBLE) AS x1,
   CAST((l_suppkey*977 + l_orderkey*31 + l_linenumber*57) % 20000 AS DOUBLE) AS y1,
   l_quantity * CAST(4 AS DOUBLE) AS w, CAST(l_linenumber*30 AS DOUBLE) AS h, CASE WHEN l_orderkey % 997 = 0 THEN 20 ELSE 1 END AS far FROM lineitem) t)"""


def crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, det_id, x1, y1, x2, y2."""
    return spark.sql("WITH " + CROWD_SQL.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM crowd", lineitem=table(spark, sf_dir, "lineitem"))


WIDTH, HEIGHT = 640, 480


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, det_id, class_id, score, x1, y1, x2, y2."""
    query = "WITH " + DETECTIONS_SQL.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM det"
    return spark.sql(query, lineitem=table(spark, sf_dir, "lineitem"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id of every frame, those without detections included."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))


IMAGES_SQL = """img AS (SELECT doc_id AS image_id, CAST(100 + n_chars % 1900 AS INT) AS w, CAST(100 + (n_chars * 7) % 1000 AS INT) AS h FROM documents)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h: image sizes."""
    size = lambda e, most: (F.lit(100) + F.pmod(e, F.lit(most))).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), size(F.col("n_chars"), 1900).alias("w"), size(F.col("n_chars") * 7, 1000).alias("h")
    )


STEPS_SQL = "steps AS (SELECT label AS crop_id, vec_id AS t, embedding AS probs FROM embeddings)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crop_id, t, probs: a recognizer's class scores per time step (only their order matters)."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("crop_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("probs"))


METRICS_SQL = "metrics AS (SELECT event_type AS name, event_id AS step, value, CAST(value AS DECIMAL(18, 2)) AS exact, user_id FROM events)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, step, value, user_id: a metric series per event type. ``exact``: the values, which have two places, as decimals."""
    exact = F.col("value").cast("decimal(18,2)").alias("exact")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value", exact, "user_id")


def exact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).withColumn("value", F.col("exact"))


#: Small images, one per supplier: a grey box on a dark ground.
PICTURES_SQL = """pic AS (SELECT s_suppkey AS k, 'img' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS stem,
  CASE WHEN s_suppkey % 2 = 0 THEN '.png' ELSE '.PNG' END AS suffix,
  60 + s_suppkey % 25 AS width, 40 + s_suppkey % 7 AS height, 2 + s_suppkey % 5 AS x1, 24 + s_suppkey % 4 AS y1,
  2 + s_suppkey % 5 + 6 + s_suppkey % 6 AS x2, 24 + s_suppkey % 4 + 5 + s_suppkey % 3 AS y2 FROM supplier)"""


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file by Spark's file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(content))
    out.close()


def pictures(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the suppliers' pictures, with one file that is broken and one that is no image; executors make them."""
    folder = f"{shared_dir(spark).rstrip('/')}/pictures-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files = [], []
            for k in batch.column(0).to_pylist():
                img = np.full((40 + k % 7, 60 + k % 25, 3), 10, np.uint8)
                x, y = 2 + k % 5, 24 + k % 4
                img[y : y + 5 + k % 3, x : x + 6 + k % 6] = 100
                names.append(f"img{k:09d}{'.PNG' if k % 2 else '.png'}")
                files.append(images_of.encode_png(img))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], names=["name", "content"])

    sinks.write_files(table(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(run, "name string, content binary"), folder)
    put(spark, f"{folder}/broken.png", b"nothing")
    put(spark, f"{folder}/notes.txt", b"no image")
    return folder
