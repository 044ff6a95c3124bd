"""Neighbours come from the routed parts; recall and probed share on tables larger than the sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.llm import ann


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def _search(spark, df, step=10):
    got = {}
    for r in ann.search(df, F.col("vec_id") % step == 0, k=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    return got


def _two_parts(monkeypatch, d):
    """Two parts by the sign of the first component, of which one is probed."""
    weights = np.zeros((d, 2))
    weights[0] = 1, -1
    monkeypatch.setattr(ann, "fit", lambda *_: ann.Index(weights, np.zeros(2)))
    monkeypatch.setattr(ann, "probes_for", lambda *_: 1)


def _nearest(x, q, allowed):
    order = np.lexsort((np.arange(len(x)), -(x * x[q]).sum(axis=1)))
    return dict(enumerate([i for i in order.tolist() if i != q and allowed[i]][:20], 1))


def test_neighbours_come_from_probed_parts(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(600, 8))
    _two_parts(monkeypatch, 8)
    got = _search(spark, _frame(spark, x))
    assert set(got) == set(range(0, 600, 10))
    assert all(found == _nearest(x, q, (x[:, 0] > 0) == (x[q, 0] > 0)) for q, found in got.items())


def test_more_parts_are_probed_where_they_are_small(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(600, 8))
    x[:, 0] = np.abs(x[:, 0])
    x[:5, 0] *= -1
    _two_parts(monkeypatch, 8)
    got = _search(spark, _frame(spark, x))
    assert got[0] == _nearest(x, 0, np.ones(600, bool)) and set(got) == set(range(0, 600, 10)) and all(sorted(found) == list(range(1, 21)) for found in got.values())


@pytest.mark.parametrize("levels", [1, 2])
def test_recall_beyond_the_sample(spark, monkeypatch, levels):
    """12,000 clustered vectors, an index fitted on 500: recall of what the parts give, and the share probed."""
    rng = np.random.default_rng(levels)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 12_000)] + 0.35 * rng.normal(size=(12_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "LEAST", 16 if levels == 1 else 62)
    monkeypatch.setattr(ann, "WIDE", 128 * 1024 if levels == 1 else 100)
    seen = []
    real = ann.probes_for
    monkeypatch.setattr(ann, "probes_for", lambda index, *rest: seen.append((type(index), index.parts, real(index, *rest))) or seen[-1][2])
    got = _search(spark, _frame(spark, x).repartition(4), 100)
    hits = sum(len(set(_nearest(x, q, np.ones(len(x), bool)).values()) & set(found.values())) for q, found in got.items())
    kind, parts, probes = seen[0]
    assert len(got) == 120 and hits >= 0.9 * 20 * 120
    assert kind is (ann.Index if levels == 1 else ann.Tree) and parts > (8 if levels == 1 else 16) and probes < 0.7 * parts


def test_fit_does_not_depend_on_partitions(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(900, 8))
    monkeypatch.setattr(ann, "SAMPLE", 300)
    a = [tuple(r) for r in ann._drawn(ann.valid(_frame(spark, x).repartition(7)), 900).collect()]
    assert a == [tuple(r) for r in ann._drawn(ann.valid(_frame(spark, x).coalesce(1)), 900).collect()] and len(a) == 300
