"""Texts longer than the pieces that workers read, through Spark."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framequery.llm import line_dedup, mixing, ngram_join, suffix_dedup

WORDS = 230_000  # about 1.4 MB


@pytest.fixture(scope="module")
def text():
    rng = random.Random(6)
    return " ".join(f"w{rng.randrange(10**4)}" for _ in range(WORDS))


def test_lines_and_sizes(spark, text):
    lines = "\n".join(["follow us", text, "follow us", text[:5]])
    docs = spark.createDataFrame([(i, lines if i < 2 else "follow us", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.remove_boilerplate(docs, min_sites=4).collect()}
    assert got[0] == (4, 0, lines) and got[1] == (4, 2, f"{text}\n{text[:5]}") and got[2] == (1, 1, "")
    sizes = {r["doc_id"]: r["mix_size"] for r in mixing.plan(docs).select("doc_id", "mix_size").collect()}
    assert sizes[0] == WORDS + 4 + len(text[:5].split()) and sizes[3] == 2


def test_near_copies(spark, text):
    words = text.split()
    changed = words[:]
    for i in range(0, WORDS, 40):  # five of forty shingles go: a similarity of 7 / 9
        changed[i] = "x"
    little = words[:]
    for i in range(0, WORDS, 80):
        little[i] = "x"
    docs = spark.createDataFrame([(1, text), (2, " ".join(changed)), (3, " ".join(little)), (4, text + " end"), (5, text[: len(text) // 2])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = r["text"].split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert linked(1, 3) and linked(1, 4) and not linked(1, 5)
    assert got == {1: 1, 2: 1 if linked(1, 2) or linked(2, 3) else 2, 3: 1, 4: 1, 5: 5}


def test_repeats(spark, text):
    at = len(text) // 2
    other = text[:at] + "#" + text[at + 1 :]
    docs = spark.createDataFrame([(1, text), (2, other), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1] == ([(0, at), (at + 1, len(text))], sha(text[at])) and got[2] == ([(0, at), (at + 1, len(text))], sha("#")) and got[3] == ([], sha("short"))
    assert docs.select(F.max(F.length("text"))).first()[0] > 1 << 20
