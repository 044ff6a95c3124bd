"""Event files: the format, the checks of the reader, and jobs that fail."""

import io
import math
import os
import struct

import pytest
from pyspark.sql import functions as F

from framequery.sources import event_files as E


def test_checksums():
    unmask = lambda m: (m - E.MASK & 0xFFFFFFFF) >> 17 | ((m - E.MASK & 0xFFFFFFFF) << 15) & 0xFFFFFFFF
    assert unmask(E.masked_crc(b"123456789")) == 0xE3069283 and unmask(E.masked_crc(b"\0" * 32)) == 0x8A9136AA  # published values


def test_records_round_trip_and_damage():
    events = [(0.5, 0, "a", 1.0), (1e9, -3, "Löss/total", -2.5), (2.0, 2**40, "x" * 300, math.inf)]
    whole = b"".join(E.framed(E.scalar_event(*e)) for e in events)
    assert [E.parse_event(r) for r in E.records(io.BytesIO(E.framed(E.version_event()) + whole))] == [[]] + [[e] for e in events]
    for at in range(0, len(whole), 7):
        bad = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
        with pytest.raises(ValueError):
            list(E.records(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(E.records(io.BytesIO(whole[:-1])))
    assert E.parse_event(struct.pack("<Bd", 9, 1.0) + bytes([0x30, 5])) == []  # an unknown field


def test_write_and_read(spark, tmp_path):
    rows = [("a", 1, 0.1, 5.0), ("b", -2, 1e30, None), (None, 3, 1.0, 1.0), ("c", None, 1.0, 1.0), ("d", 4, None, 1.0), ("e", 5, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "tag string, step long, value double, wall_time double").withColumn("extra", F.lit(1)).repartition(3)
    path = str(tmp_path / "log")
    E.write_events(df, path)
    E.write_events(df.where("tag = 'a'"), path)
    got = sorted((r["tag"], r["step"], str(r["value"]), r["wall_time"]) for r in E.read_events(spark, path).collect())
    single = lambda v: str(struct.unpack("<f", struct.pack("<f", v))[0])
    assert got == [("a", 1, single(0.1), 5.0)] * 2 + [("b", -2, single(1e30), 0.0), ("e", 5, "nan", 2.0)]
    assert all(f.startswith(E.PREFIX) for f in os.listdir(path))
    E.write_events(df.limit(0), str(tmp_path / "none"))
    assert E.read_events(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    df = spark.range(100).repartition(4).select(F.lit("a").alias("tag"), F.col("id").alias("step"), F.when(F.col("id") == 57, F.raise_error(F.lit("no value"))).otherwise(1.0).cast("double").alias("value"))
    with pytest.raises(Exception, match="no value"):
        E.write_events(df, str(path))
    assert os.listdir(path) == []


def test_a_damaged_file_is_an_error(spark, tmp_path):
    path = str(tmp_path / "log")
    E.write_events(spark.createDataFrame([("a", 1, 1.0)], "tag string, step long, value double"), path)
    (name,) = os.listdir(path)
    with open(f"{path}/{name}", "r+b") as out:
        out.seek(30)
        out.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        E.read_events(spark, path).collect()
