"""Resampling against a plain version, the radix selection against sorting, and the defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequery.llm import resampling, wordspans


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _plainly(docs, target, percent, buckets, runs, least):
    def features(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_words(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    rank = {}
    for k, r in enumerate(drawn):
        rank.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], (rank.get(r[:4]) or [None]).pop(0) if rank.get(r[:4]) else None) for r in rows), key=str)


@pytest.mark.parametrize(("runs", "least"), [((1, 1), 3), ((1, 2), 0), ((2, 3), 1)])
def test_equals_the_plain_version(spark, runs, least):
    rng = random.Random(5)
    vocabulary = ["Ab", "b9", "é", "ÉA", "c" * 60, "dd", "e", "\U0001f600", "w" * 49, "v" * 48]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.randrange(12))) for i in range(120)] + [(200, None), (201, ""), (202, "..."), (None, "ab b9 e e"), (203, "x" * 400_000 + " e b9 ab")]
    docs += [(300, "ab e b9 dd")] * 6
    target = [text(6) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), 30, 997, runs, least)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == _plainly(docs, target, 30, 997, runs, least)


def test_empty_tables(spark):
    none, some = (spark.createDataFrame(r, "doc_id long, text string") for r in ([], [(1, "a b"), (2, "c")]))
    assert resampling.resample(none, some.select("text")).count() == 0
    got = resampling.resample(some, none.select("text"), percent=100, least_words=0, buckets=16).collect()
    assert sorted(r["rank"] for r in got) == [1, 2]


@pytest.mark.parametrize("k", [0, 1, 17, 250, 399, 400, 1000])
def test_kth_key(spark, k):
    rng = random.Random(k)
    wide = [-(2**63), 2**63 - 1, 0, -1, None] + [rng.randrange(-(2**62), 2**62) for _ in range(15)]
    rows = [(rng.choice([5, -5, 2**40]), rng.choice(wide), n) for n in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, n long").repartition(6)
    condition, passes = resampling.below_kth(df, [("a", True), ("b", False), ("n", False)], k)
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[:k]
    assert sorted(r["n"] for r in df.where(condition).collect()) == sorted(r[2] for r in want) and passes <= 12


def test_words_and_checksums():
    texts = ["Ab cd", None, "", "é" * 200_000 + " x", "xy", "1" * 47 + "-" + "2" * 48 + "-" + "3" * 49]
    words, offsets, data = wordspans.Words(resampling.WORD), *resampling.text_buffers(pa.array(texts))
    starts, ends = words.spans(offsets, data)
    plain = [w for t in texts for w in _words(t)]
    assert [words.folded[data[a:b]].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == plain
    crc = words.crc32(data, starts, ends)
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in plain]
    assert words.crc32(data, starts, ends, wordspans.space_after(crc)).tolist() == [zlib.crc32(f"{w} {w}".encode()) for w in plain]
    assert len(words.spans(np.zeros(1, np.int64), np.zeros(0, np.uint8))[0]) == 0


def test_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["a b", "".join(rng.choice(["Ab", "é", "c9", "x" * 50]) + rng.choice([" ", "-", ". "]) for _ in range(200_000)), "", "w" * 700_000, None]
    words = wordspans.Words(resampling.WORD)

    def found():
        out = [[] for _ in texts]
        for row, _, n, buckets, whose in resampling.feature_buckets(words, pa.array(texts), 997, (1, 1)):
            assert n.sum() == len(buckets)
            for b, w in zip(buckets.tolist(), whose.tolist(), strict=True):
                out[row + w].append(b)
        return out

    whole = found()
    monkeypatch.setattr(resampling, "LONG", 10_000)
    assert found() == whole == [[zlib.crc32(w.encode()) % 997 for w in _words(t)] for t in texts]
