"""The toxicity query against a plain model of the same kind, the mix beyond the broadcast bound, archives with null ids."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framequery.llm import mixing, queries, toxicity, warc

DATA = "/root/testdata/sf0.01"


def _grams(text):
    t = re.sub(r"\W+", " ", f" {(text or '').lower()} ")
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def test_toxicity_query_equals_a_plain_model(spark):
    """Naive Bayes ratios and penalised logistic regression on the n-grams themselves, solved by Newton steps in the span of the examples."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows, _ = toxicity.sample(docs, labels.where(queries._fold(F.col("doc_id")) != 0), "toxic", toxicity.PER_CLASS)
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in rows.collect())
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows)
    grams, y = [_grams(t) for _, _, t in rows], np.array([y for _, y, _ in rows])
    place = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    n = np.zeros((2, len(place)))
    for g, c in zip(grams, y, strict=True):
        n[c, [place[x] for x in g]] += 1
    shown = np.bincount(y, minlength=2)
    r = np.log((n[1] + 1) / (shown[1] + 2)) - np.log((n[0] + 1) / (shown[0] + 2))
    x = np.zeros((len(rows), len(place)), np.float32)
    for i, g in enumerate(grams):
        at = [place[k] for k in g]
        x[i, at] = r[at]
    kernel = x.astype(np.float64) @ x.T.astype(np.float64) + 1
    s, own = np.where(y == 1, 1.0, -1.0), np.diag(kernel)
    share = np.full(len(rows), 0.5)  # w = sum share_i s_i x_i, and at the optimum share_i = 1 / (1 + exp(s_i z_i))
    z = kernel @ (share * s)
    for _ in range(400):
        for i in range(len(rows)):  # bisection of one example's own equation
            low, high, rest = 0.0, 1.0, s[i] * z[i] - share[i] * own[i]
            for _ in range(45):
                middle = (low + high) / 2
                low, high = (middle, high) if middle < 1 / (1 + math.exp(min(rest + middle * own[i], 700.0))) else (low, middle)
            z += (low - share[i]) * s[i] * kernel[i]
            share[i] = low
        if np.abs(share - 1 / (1 + np.exp(np.clip(s * z, -700, 700)))).max() < 1e-4:
            break
    else:
        raise AssertionError("the plain model does not settle")
    a = share * s
    weights, bias = (x.T @ a) * r, a.sum()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in entry.queries()["op6_toxicity"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    plain = np.array([bias + sum(weights[place[g]] for g in _grams(t) if g in place) for t in texts.values()])
    ours = np.array([math.log(s / (1 - s)) for s in (min(max(got[i]["score"], 1e-12), 1 - 1e-12) for i in texts)])
    inside = np.abs(ours) < 20
    slope, shift = np.polyfit(plain[inside], ours[inside], 1)  # the scale of the scores is set on folds
    assert slope > 0 and np.std(ours[inside] - slope * plain[inside] - shift) < 0.05 * np.std(ours[inside])
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL").collect()}
    held = [i for i in toxic if i in got and got[i]["held_out"]]
    assert len(held) > 20 and np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.9


@pytest.mark.parametrize("bound", [0, 50_000])
def test_mixing_joins_by_shuffle_beyond_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    rows = [(i, "w " * (i % 7), ["a", "b", None, "é"][i % 4]) for i in range(200)]
    planned = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted((r["doc_id"], r["mix_size"], r["mix_target"], r["mix_copies"]) for r in planned.collect())
    assert len(got) == 200 and all(copies <= 3 for *_, copies in got)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 50_000)
    again = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got == sorted((r["doc_id"], r["mix_size"], r["mix_target"], r["mix_copies"]) for r in again.collect())


def test_archives_with_null_page_ids(spark):
    rows = [(None, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", None), (3, "u", "")]
    path = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=0)
    got = warc.read_archives(spark, path, ["page_id", "payload_bytes", "record_type", "refers_to"]).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in got) == sorted((str(i), len(h or "")) for i, _, h in rows)
    kinds = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None}
    assert kinds == {(1, 4): ("revisit", 2), (2, 4): ("response", None), (3, 0): ("response", None)}
    assert all(r["record_type"] in ("response", "revisit") for r in got)
