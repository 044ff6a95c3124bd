"""Queries that once left rows or components of their tables out, against plain versions over the whole tables."""

import math

import duckdb

from framequery.plans import catalog, fixtures

from test_queries import DATA


def test_ema_fold_takes_every_event(spark):
    series = {}
    for name, value in duckdb.sql(f"SELECT event_type, value FROM '{DATA}/events.parquet' ORDER BY event_id").fetchall():
        series.setdefault(name, []).append(value)
    want = {}
    for name, values in series.items():
        v = 0.0
        for n, x in enumerate(values, 1):
            d = 0.999 * (1 - math.exp(-n / 100))
            v = v * d + (1 - d) * x
        want[name] = round(v, 5)
    got = {r["name"]: r["ema"] for r in catalog.QUERIES["ema_fold"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_denoising_index_takes_every_frame(spark):
    sizes = duckdb.sql(f"SELECT l_orderkey, count(*) FROM '{DATA}/lineitem.parquet' GROUP BY 1").fetchall()
    want = {(f, g, q) for f, n in sizes for g in range(max(100 // n, 1)) for q in range(g * n, (g + 1) * n)}
    got = [(r["frame_id"], r["grp"], r["query"]) for r in catalog.QUERIES["denoising_index"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want


def _embeddings():
    return [(r[0], r[1], [float(v) for v in r[2]]) for r in duckdb.sql(f"SELECT label, vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()]


def _best(scored, k):
    """Rows (image, *rest) -> {(image, rank): rest} of the k first of each image, by (-score, *ties)."""
    out, seen = {}, {}
    for image, order, rest in sorted(scored):
        seen[image] = seen.get(image, 0) + 1
        if seen[image] <= k:
            out[image, seen[image]] = rest
    return out


def test_flat_topk_takes_every_component(spark):
    want = _best(((i, (-1 / (1 + math.exp(-v)), q, c), (q, c)) for i, q, e in _embeddings() for c, v in enumerate(e)), 30)
    got = {(r["image_id"], r["rank"]): (r["query_id"], r["label"]) for r in catalog.QUERIES["flat_topk"](spark, DATA).collect()}
    assert got == want and any(label > 7 for _, label in got.values())


def test_best_class_topk_takes_every_component(spark):
    def rows():
        for i, q, e in _embeddings():
            p = [math.exp(v) for v in e]
            label = max(range(63), key=lambda c: (p[c], -c))
            yield i, (-p[label] / sum(p), q), (q, label)

    got = {(r["image_id"], r["rank"]): (r["query_id"], r["label"]) for r in catalog.QUERIES["best_class_topk"](spark, DATA).collect()}
    assert got == _best(rows(), 10)


def test_query_select_takes_every_component(spark):
    e = _embeddings()
    want = {
        "default": _best(((i, (-max(v), q), q) for i, q, v in e), 10),
        "agnostic": _best(((i, (-v[0], q), q) for i, q, v in e), 10),
        "one2many": _best(((i, (-x, q, c), q) for i, q, v in e for c, x in enumerate(v)), 10),
    }
    got = {m: {} for m in want}
    for r in catalog.QUERIES["query_select"](spark, DATA).collect():
        got[r["method"]][r["image_id"], r["rank"]] = r["query_id"]
    assert got == want


def test_sanitize_keeps_narrow_boxes(spark):
    want = duckdb.sql(f"SELECT count(*) FROM '{DATA}/lineitem.parquet' WHERE l_quantity * 4 BETWEEN 4 AND 56 AND l_linenumber >= 3").fetchall()[0][0]
    got = catalog.QUERIES["sanitize_boxes"](spark, DATA)
    narrow = fixtures.detections(spark, DATA).where("x2 - x1 < 59 AND y2 - y1 > 61").join(got, ["frame_id", "det_id"], "left_semi")
    assert want and narrow.count() == want


def test_three_labels_do_not_gather_the_boxes(spark):
    plan = catalog.QUERIES["label_remap"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
