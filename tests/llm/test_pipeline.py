"""The corpus pipeline on a small corpus against a plain version of every stage."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framequery.llm.queries import toxicity_model
from test_dedup import _components
from test_relational import _dedup_plainly
from test_search import _hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["tree", "house", "river", "stone", "light"]) + str(rng.randrange(200)) for _ in range(n))
    items = [(i, text(14)) for i in range(4)]
    rows = []
    for i in range(240):
        t = text(rng.choice([8, 40, 60])) + "\n" + text(30)
        t += "\nfollow us on the web" if i % 3 == 0 else ""
        t += " vile dimwit scum " * 2 if i % 8 == 1 else ""
        t += "\n" + items[i % 4][1] if i % 29 == 2 else ""
        rows.append((i, t, "en", f"s{i % 13}"))
    rows += [(300 + i, rows[5 + i % 3][1], "en", "s1") for i in range(6)] + [(400, None, "en", "s1"), (401, "", None, None), (402, "follow us on the web", "en", "s2")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages_match_plain_versions(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity_model(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    rows = [r for r in rows if model.score(r[1]) < 0.5]
    assert {r[0] for r in docs.collect()} - {r[0] for r in rows} == {i for i in range(240) if i % 8 == 1}
    cleaned = dict(_dedup_plainly([(r[0], r[1], r[3]) for r in rows], corpus_pipeline.MIN_SITES))
    rows = [(r[0], cleaned[r[0]], r[2], r[3]) for r in rows if not (cleaned[r[0]] != r[1] and not (cleaned[r[0]] or "").strip(" "))]
    keep = {i for i, _, c in _components([(r[0], r[1]) for r in rows]) if i == c}
    rows = [r for r in rows if r[0] in keep]
    rows = [r for r in rows if not _hits(r[1], [(str(i), t) for i, t in items], 10)[1]]
    want = {r[0]: r for r in rows}
    out = corpus_pipeline.run(spark, path).collect()
    copies: dict[int, int] = {}
    for r in out:
        assert (r["doc_id"], r["text"], r["lang"], r["source"]) == want[r["doc_id"]] and r["n_chars"] == len(r["text"] or "")
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    level, total = None, sum(sizes.values())
    while True:
        full = {s for s in sizes if level is not None and 3 * sizes[s] <= weight[s] * level}
        new = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        if new == level:
            break
        level = new
    for r in rows:
        rate = min(3 * sizes[r[3]], weight[r[3]] * level) / sizes[r[3]] if sizes[r[3]] else 0
        draw = int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies.get(r[0], 0) == int(rate) + (draw < rate - int(rate))
    assert len(out) == len({(r["doc_id"], r["mix_copy"]) for r in out})


#: Names that operators give to columns of their own.
CLASHES = ["n_lines", "n_removed", "_kept", "toxicity", "mix_size", "mix_copies", "mix_copy", "mix_source", "hit_spans", "n_words", "row_key", "cls", "token", "part", "component", "mark", "_turn", "pos"]


def test_stages_keep_the_columns(spark, folder):
    """Columns of the stages on an empty table, and on one whose own columns have the operators' names."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    named = docs.where("doc_id < 40 OR doc_id >= 300").select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        assert stage(spark, docs.limit(0), path).count() == 0
        for rows in (docs.limit(0), named):
            out = stage(spark, rows, path)
            assert out.columns[: len(rows.columns)] == rows.columns and len(out.columns) == len(rows.columns) + last, name
        got = out.select("doc_id", *CLASHES).collect()
        assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in CLASHES), name


def test_near_copies_by_row(spark, folder):
    """Repeated and null ids: a text goes only where a copy of it stays."""
    path, _ = folder
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t), (5, "a text of its own with an id that is used twice"), (5, t), (None, "two rows of this one and no id"), (None, "two rows of this one and no id"), (None, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_turn", F.lit("mine"))
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, path).collect()]
    assert sorted(kept, key=str) == sorted([(3, t, "mine"), (5, rows[1][1], "mine"), (None, rows[3][1], "mine")], key=str)
