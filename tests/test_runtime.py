"""Lineage cuts: results outlive their inputs, and the session is left as it was."""

import pytest
from pyspark.sql import functions as F

from framequery.plans import runtime

BATCH, CLEANUP = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.mark.parametrize("keep", [runtime.cut, lambda df: runtime.spill(df, "rows")])
@pytest.mark.parametrize("batch", [None, "7"])
def test_steps_leave_the_session_alone(spark, keep, batch):
    if batch:
        spark.conf.set(BATCH, batch)
    seen = spark.conf.get(BATCH), spark.conf.get(CLEANUP)
    try:
        df = spark.range(1000).repartition(4).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
        kept = keep(df)
        assert {r["k"]: r["s"] for r in kept.collect()} == {k: sum(range(k, 1000, 10)) for k in range(10)}
        assert kept.columns == df.columns and df.count() == 10
        assert (spark.conf.get(BATCH), spark.conf.get(CLEANUP)) == seen
        with pytest.raises(Exception, match="no such"):
            keep(spark.range(1).select(F.raise_error(F.lit("no such")).alias("x")))
        assert (spark.conf.get(BATCH), spark.conf.get(CLEANUP)) == seen
    finally:
        spark.conf.unset(BATCH)


def test_free_names():
    assert runtime.free_name("a", ["b", "A", "a_1"]) == "a_2" and runtime.free_name("c", ["a"]) == "c"


def test_steps_of_several_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    seen = spark.conf.get(BATCH), spark.conf.get(CLEANUP)
    frames = [spark.range(20_000 * (k + 1)).repartition(3).groupBy((F.col("id") % 5).alias("k")).count() for k in range(6)]
    with ThreadPoolExecutor(4) as pool:
        kept = list(pool.map(runtime.cut, frames))
    assert [k.agg(F.sum("count")).first()[0] for k in kept] == [20_000 * (k + 1) for k in range(6)]
    assert (spark.conf.get(BATCH), spark.conf.get(CLEANUP)) == seen and not runtime._RUNNING


def test_scans_and_small_tables(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert runtime.is_scan(t) and runtime.is_scan(t.where("id > 3").select((F.col("id") + 1).alias("x"))) and runtime.is_scan(runtime.cut(t))
    assert not runtime.is_scan(t.distinct()) and not runtime.is_scan(t.join(t, "id")) and not runtime.is_scan(t.select(F.explode(F.array("id", "id"))))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(runtime.broadcast_small(t, 100)) and not hinted(runtime.broadcast_small(t, 99))
