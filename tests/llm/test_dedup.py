"""The n-gram join and suffix dedup by brute force on random texts with copies."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequery.llm import ngram_join, suffix_dedup, textbytes
from framequery.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text, k=5):
    w = SPLIT.findall((text or "").translate(FOLD))
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def _components(docs, percent=80):
    sets = [(_set(t), i) for i, t in docs]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][0], sets[b][0]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = {}
    for a in range(len(sets)):
        ids.setdefault(find(a), []).append(sets[a][1])
    low = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(sets[a][1], len(sets[a][0]), low[find(a)] if sets[a][0] else sets[a][1]) for a in range(len(sets))]


def _corpus(seed, n=120, words=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "stone", "Éa", "x1", "run,", "blue", "dog"]) + str(rng.randrange(30))
    base = [[word() for _ in range(rng.choice([3, 5, 30, words, 3 * words]))] for _ in range(n // 6)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = word()
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "solo"), (n + 4, "SOLO"), (n + 4, "solo"), (None, "solo"), (None, "lonely text"), (n + 5, "　 é")]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_by_brute_force(spark, seed):
    docs = _corpus(seed)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("cls", F.lit("x")).withColumn("token", F.lit(1)).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if seed == 1 else 1000)
    try:
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(_components(docs), key=str)


def _dense(seed, n, changes):
    """Near copies of one text around the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(n):
        w = list(base)
        for _ in range(changes(i)):
            w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    return docs


def _joined(df, **kw):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, **kw).collect())


@pytest.mark.parametrize(("seed", "above"), [(7, 64), (8, 0)])
def test_join_of_a_dense_group(spark, monkeypatch, seed, above):
    """One star per bucket is not enough: more stars and pairs across components follow."""
    docs = _dense(seed, 70, lambda i: 2 + i % 2)
    monkeypatch.setattr(ngram_join, "STARS_ABOVE", above)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    assert _joined(spark.createDataFrame(docs, "doc_id long, text string")) == sorted(_components(docs))


def test_join_of_copies_in_many_partitions_and_frequent_shingles(spark, monkeypatch):
    """Buckets that are dealt into parts, texts fetched by a shuffle join, batches of three rows."""
    docs = _dense(3, 12, lambda i: i % 4)
    docs = [(20 * i + j, t) for i, t in docs for j in range(20)] + [(1000 + i, t) for i, t in _corpus(5)[:60]]
    for name, value in (("BUCKET", 4), ("FREQUENT", 1), ("WANTED", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = _joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(_components(docs))


def test_sets_that_meet_in_one_class_id_are_hashed_anew(spark):
    docs = _corpus(9)[:60]
    rows, groups = ngram_join.link_classes(spark.createDataFrame(docs, "doc_id long, text string"), bits=3)
    got = rows.join(groups, "cls", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).collect()
    assert sorted(tuple(r) for r in got) == sorted(_components(docs))


def test_bucket_streams_do_not_depend_on_batches(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.randrange(2), c, 20, 1 + c % 3, 0) for c in (rng.randrange(9) for _ in range(200))]
    frame = spark.createDataFrame(rows, "token long, part int, cls long, n int, pos int, suffix long")
    found = []
    for size in (1, 2, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(tuple(r) for r in ngram_join._shared(frame, 80).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] == found[3]
    assert sorted(r[:3] for r in found[0]) == sorted({r[:3] for r in rows})


@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), max_size=12), st.sets(st.integers(0, 60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_filters_lose_no_link(x, out, more):
    """At their first common shingle two linked sets pass all filters."""
    y = (x - out) | more
    if not y or 100 * len(x & y) < 80 * len(x | y):
        return
    sets = [np.sort(textbytes.mix64(np.array(sorted(v), np.uint64))) for v in (x, y)]
    both = np.intersect1d(*sets)
    rows = []
    for s in sets:
        pos = int(np.searchsorted(s, both[0]))
        assert pos < ngram_join.prefix_length(len(s), 80)
        rows += [np.array([len(s)]), np.array([pos + 1]), ngram_join._suffixes(s, np.arange(len(s)))[pos : pos + 1]]
    assert ngram_join._near(*rows, 80).all()


def test_keep_one_and_empty(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here now ok yes"), (4, None), (5, ""), (1, "a b c d e f"), (3, "third text that is quite different")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1))
    kept = ngram_join.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("text <> ''").collect()) == [(1, "a b c d e f"), (3, "other words here now ok yes"), (3, "third text that is quite different")]
    assert kept.count() == 5
    assert ngram_join.near_duplicates(rows.limit(0)).count() == 0
    assert ngram_join.near_duplicates(rows.where("text is null or text = ''")).count() == 2


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (500, 400), (400, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and got[500] == got[400] == 400
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.text(alphabet="aB é\n\t.", max_size=60), max_size=6), st.integers(2, 40))
@settings(max_examples=80, deadline=None)
def test_word_hashes_do_not_depend_on_pieces(texts, piece):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    whole = textbytes.WordHasher(ngram_join._WORD).words(offsets, data)
    old, textbytes.PIECE = textbytes.PIECE, piece
    try:
        parts = textbytes.WordHasher(ngram_join._WORD).words(offsets, data)
    finally:
        textbytes.PIECE = old
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    words = [w for t in texts for w in SPLIT.findall(t.translate(FOLD))]
    assert len(whole[0]) == len(words) and len(set(whole[0].tolist())) == len(set(words))


def _repeats(docs, length):
    seen: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, x in raw:
        for j in range(len(x) - length + 1):
            seen[x[j : j + length]] = seen.get(x[j : j + length], 0) + 1
    out = []
    for i, x in raw:
        cover = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            if seen[x[j : j + length]] > 1:
                cover[j : j + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(int), [0]])))
        rest = np.frombuffer(x, np.uint8)[~cover].tobytes()
        out.append((i, len(x), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)], hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 40), (2, 64), (3, 200)])
def test_repeats_by_brute_force(spark, seed, length, monkeypatch):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(rng.choice([length - 1, length, length + 1, 2 * length])) for _ in range(6)]
    docs = []
    for i in range(50):
        parts = [text(rng.randrange(60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(8))]
        docs.append((i, "".join(parts)))
    docs += [(50, None), (51, ""), (52, "a" * (length - 1)), (53, "a" * (3 * length)), (54, docs[3][1]), (55, docs[3][1]), (55, docs[3][1]), (None, passages[0]), (None, passages[5] * 2), (56, "ab" * 300), (57, "\0" * length + passages[3])]
    monkeypatch.setattr(suffix_dedup, "SHARD", 7)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 40)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("places", F.lit("x")).repartition(3)
    got = [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(rows, length, keep_bytes=True).collect()]
    assert all(g[3] == g[4] for g in got)
    assert sorted((g[:4] for g in got), key=str) == sorted(_repeats(docs, length), key=str)
    assert suffix_dedup.remove_repeats(rows.limit(0), length).count() == 0


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(0, 4, 20_000).astype(np.uint8)
    offsets = np.array([0, 5, 12_000, 12_000, 20_000])
    covered = lambda: {(int(r), int(p) + 0, j) for rows in suffix_dedup.anchors(offsets, data, 200) for r, h, p, f, e in zip(*rows, strict=True) for j in range(int(f), int(e) + 1)}
    whole = covered()
    assert len(whole) == 12_000 - 5 - 199 + 8_000 - 199
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert covered() == whole
