"""Jump hashing against the published loop, slots, growth, and the defined cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from framequery.llm import sharding


def _jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def _key(doc_id) -> int:
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 40, 1000])
def test_jump_equals_the_plain_loop(spark, shards):
    keys = [0, 1, 2**64 - 1, 2**63, 0xDEADBEEF] + [random.Random(shards).getrandbits(64) for _ in range(300)]
    df = spark.createDataFrame([(f"{k:016x}",) for k in keys], "k string")
    got = {r["k"]: r["s"] for r in df.select("k", sharding.jump(F.col("k"), shards).alias("s")).collect()}
    assert got == {f"{k:016x}": _jump(k, shards) for k in keys}


def test_rows_that_outlast_the_short_fold(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHORT", 2)
    got = sharding.assign(spark.range(500).withColumnRenamed("id", "doc_id"), 64).collect()
    assert all(r["shard"] == _jump(_key(r["doc_id"]), 64) for r in got)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.place(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 40).collect()
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 40 for r in moved) and 50 < len(moved) < 150
    counts = [sum(r["shard"] == s for r in rows) for s in range(40)]
    assert min(counts) > 60 and max(counts) < 145


def test_defined_cases(spark):
    texts = [(1, "é\U0001f600"), (2, None), (3, ""), (None, "a"), (None, None), (7, "z" * 300_000), (8, "b"), (8, "c")] + [(9, "hot")] * 50
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot", "3 AS row", "4 AS key")
    rows = sharding.place(df, 4).collect()
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), _jump(_key(i), 4), _jump(_key(i), 5)) for i, t in ((-1 if i is None else i, t) for i, t in texts if i is not None))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] is not None) == want
    assert {r["shard"] for r in rows if r["doc_id"] is None} == {_jump(_key(None), 4)}
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.place(df.limit(0), 4).count() == 0
    assert sharding.assign(df, 4).columns == [*df.columns, "shard_1"]
    with pytest.raises(ValueError):
        sharding.jump(F.lit("0" * 16), 0)


def test_written_shards(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    sharding.write_shards(df, str(tmp_path / "out"), 5, files=2)
    read = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in read) == [(i, _jump(_key(i), 5)) for i in range(300)]
