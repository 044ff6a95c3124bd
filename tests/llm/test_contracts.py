"""Every opN query of the entry on the smallest tables: SQL where there is some, else plain versions."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from framequery.llm import pii, queries
from test_dedup import _components, _repeats
from test_search import _hits

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _rows(spark, name):
    frame = entry.queries()[name](spark, DATA)
    return frame, [r.asDict() for r in frame.collect()]


def _types(frame):
    return {f.name: f.dataType.simpleString() for f in frame.schema.fields}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    frame, found = entry.queries()[name](spark, DATA), duck.execute(entry.oracle_sql()[name])
    places = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    columns = sorted(frame.columns)
    assert columns == [found.description[i][0] for i in places]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in found.fetchall())


def test_op3(spark, duck):
    frame, got = _rows(spark, "op3_decontamination")
    items = [(str(i), t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = []
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        n, hit, found = _hits(text, items, 10)
        want.append((doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    assert [_types(frame)[c] for c in names] == ["bigint", "bigint", "bigint", "bigint", "string", "boolean"]


def test_op4(spark, duck):
    _, got = _rows(spark, "op4_pii")
    replace, undo = pii.replacer(queries.DEMO_KEY), pii.replacer(queries.DEMO_KEY, back=True)
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        if text is not None:
            new, finds = replace(text)
            assert r["text"] == new and r["n_pii"] == len(finds) and undo(new)[0] == text


def test_op5(spark, duck):
    frame, got = _rows(spark, "op5_ann")
    rows = [(i, np.array(v, np.float64)) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        near = sorted(found.pop(int(ids[q])), key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == list(range(1, len(order) + 1))
        assert [r["score"] for r in near] == sorted((r["score"] for r in near), reverse=True)
        assert all(r["score"] == score[np.flatnonzero(ids == r["vec_id"])[0]] for r in near)
        hits += len({r["vec_id"] for r in near} & set(ids[order].tolist()))
        total += len(order)
    assert not found and hits >= 0.9 * total
    assert [_types(frame)[c] for c in ("query_id", "rank", "vec_id", "score")] == ["bigint", "int", "bigint", "double"]


def test_op6(spark, duck):
    frame, got = _rows(spark, "op6_toxicity")
    assert {r["doc_id"] for r in got} == {i for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [_types(frame)[c] for c in ("held_out", "score", "predicted")] == ["boolean", "double", "int"]


def test_op7(spark, duck):
    frame, got = _rows(spark, "op7_warc")
    pages = [(i, (h or "").encode()) for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()]
    last = {}
    for i, h in pages:
        last[h] = max(i, last.get(h, i))
    want = [(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = sorted((tuple(r[c] for c in names) for r in got), key=str)
    assert rows == sorted(want, key=str) == sorted(duck.execute(queries.OP7_SQL).fetchall(), key=str)
    assert _types(frame)["payload_bytes"] == "bigint"


def test_op9(spark, duck):
    _, got = _rows(spark, "op9_ngram_join")
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(_components(docs))


def test_op10(spark, duck):
    _, got = _rows(spark, "op10_suffix_dedup")
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = [(i, n, sum(b - a for a, b in spans), len(spans), sha) for i, n, spans, sha in _repeats(docs, 200)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
