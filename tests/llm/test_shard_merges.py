"""At the library's own constants every block is merged from shards, and what repeats is found through the merge."""

import os

from pyspark.sql import functions as F

from framequery.llm import suffix_dedup

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def _blocks(spark):
    """The blocks that a task makes of the table's contexts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = suffix_dedup._anchor_rows(docs, 200)
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = found.join(again, "anchor").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
    contexts = suffix_dedup._contexts(docs.join(places, ["doc_id", "mark"]), 200, True)
    rows = contexts.groupBy("anchor", "context", "before", "bytes").agg(F.sum("n").alias("n")).orderBy("anchor", "context").collect()
    blocks, block = [], []
    for k, r in enumerate(rows):
        block.append([bytes(r["context"]), r["before"], bytes(r["bytes"]), r["n"]])
        if len(block) >= suffix_dedup.BLOCK and (k + 1 == len(rows) or rows[k + 1]["anchor"] != r["anchor"]):
            blocks.append(block)
            block = []
    return blocks + [block] * bool(block)


def test_blocks_are_merged(spark):
    merges = across = 0
    for block in _blocks(spark):
        shards = suffix_dedup.shards_of(len(block))
        assert sorted(i for s in shards for i in s.tolist()) == list(range(len(block)))
        assert len(shards) >= 2 and max(map(len, shards)) <= suffix_dedup.SHARD or len(block) < 2
        merges += len(shards) - 1
        together = {c for c, _, _ in suffix_dedup.solve_block(block, 200)}
        alone = {block[i][0] for s in shards for i in s.tolist() if block[i][3] > 1}
        across += len(together - alone)
    assert merges > 0 and across > 0


def test_shards_of_any_size(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 4)
    for n in range(30):
        shards = suffix_dedup.shards_of(n)
        assert sorted(i for s in shards for i in s.tolist()) == list(range(n)) and all(len(s) <= 4 for s in shards)
        assert len(shards) >= 2 or n < 2
