"""The frequency table of the n-gram join: packing, its size, and levels against plain counts."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framequery.llm import ngram_join as J


def test_packed_counters():
    rng = np.random.default_rng(1)
    counts = np.where(rng.random(J.CHUNK) < 0.01, rng.integers(0, 1 << 31, J.CHUNK), rng.integers(0, 3, J.CHUNK)).astype(np.uint32)
    counts[:3] = 254, 255, 256
    assert (J._unpacked(J._packed(counts)) == counts).all()
    assert (J._unpacked(counts.astype(np.int64).tobytes()) == counts).all()
    assert not J._unpacked(J._packed(np.zeros(J.CHUNK, np.uint32))).any()


def test_levels_follow_counts(spark):
    texts = [f"a b c d e f{i % 40} g h" for i in range(600)] + ["p q r s t"] * 300 + [None, ""]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, mark long, text string").repartition(40)
    slots = J.slot_bits(df)
    assert slots == J.LEAST_BITS and J.slot_bits(df.limit(0)) == J.LEAST_BITS
    profile = J._profile(df, 5, 0, 64, slots).cache()
    levels = J._levels(profile.where("part is not null"), slots)
    shingler, plain = J.Shingler(5, 0), Counter()
    for t in texts:
        offsets, data = J.text_buffers(pa.array([t], pa.string()))
        plain.update((shingler.sets(offsets, data)[0] >> np.uint64(64 - slots)).tolist())
    want = np.zeros(1 << slots, np.uint8)
    for slot, n in plain.items():
        want[slot] = min(255, int(np.log2(1 + n) * 4))
    assert (levels == want).all() and levels.max() > 30
    assert profile.where("part is null").count() == len(texts)
    assert (J._levels(profile.where(F.lit(False)), slots) == 0).all()


def test_size_follows_the_texts(spark):
    df = spark.range(64).select(F.repeat(F.lit("x"), 1 << 17).alias("text"))
    assert J.slot_bits(df) == 18
