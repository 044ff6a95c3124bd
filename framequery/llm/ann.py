"""Approximate nearest neighbours by learned partitions.

Fit, on a sample of at most ``SAMPLE`` vectors (those with the smallest hashes): a
nearest-neighbour graph, a balanced partitioning of that graph (moves that gain most
edges within parts, under a size cap) and a softmax classifier that learns which parts a
vector's neighbours lie in. Tables of more than ``WIDE`` rows a part get a second level:
every part is fitted again, each on a bounded sample of its own rows and each in a task
of its own, so the number of parts follows the table. At last, the number of parts to probe is taken as the
least that reaches ``recall`` on the sample.

Search: every vector of the table is put in the part the classifier finds likeliest. A
query goes to the parts likeliest for it, and to further ones while these hold fewer than
k other rows; parts are dealt into blocks of bounded size, so a part that holds a third of all
rows is many tasks' work. Blocks stream: base rows first, then queries, of which each
leaves its best k, but none below its k-th best score on the sample's rows in the parts it
goes to, which none of its k best there can be; they are ranked by exact inner product in
double precision, ties to the smaller id. The sample gives that bound and no results.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows with a null id or with another length than most; equal rows count
once; a query never finds rows of its own id; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns, whatever their names, are not
read. Vectors are as long as they are: a row has to fit in a task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut

#: Bound on the vectors that an index, or one part's second level, is fitted on.
SAMPLE = 8192
#: Rows that meet the queries in one block, on average.
BLOCK = 4096
GRAPH = 16
#: Aimed rows of a part; parts of one level; sampled rows a part needs at least.
ROWS, PARTS, LEAST = 1024, 128, 64
#: Mean rows of a part above which parts are fitted again.
WIDE = 128 * ROWS


class Index:
    """weights, bias: the classifier; probes: how many parts a query visits."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, probes: int = 1):
        self.weights, self.bias, self.probes = weights, bias, probes

    @property
    def parts(self) -> int:
        return len(self.bias)

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        return unit @ self.weights + self.bias

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        return self.logits(vectors).argmax(1)


class Tree:
    """Two levels: the parts of all children, numbered in turn, by their joint probabilities."""

    def __init__(self, top: Index, children: list[Index]):
        self.top, self.children, self.probes = top, children, 1
        self.first = np.concatenate([[0], np.cumsum([c.parts for c in children])])

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        above = _log_shares(self.top.logits(vectors))
        return np.concatenate([above[:, [i]] + _log_shares(c.logits(vectors)) for i, c in enumerate(self.children)], axis=1)

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        out, above = np.zeros(len(vectors), np.int64), self.top.homes(vectors)
        for i in np.unique(above):
            out[above == i] = self.first[i] + self.children[i].homes(vectors[above == i])
        return out


def _log_shares(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def valid(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, vector as array of doubles) of the rows that take part."""
    x = F.col("vector")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & x.isNotNull())
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists(x, lambda v: v != 0))
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("vector") == (common["d"] if common else 0))
    return rows.dropDuplicates(["vec_id", "vector"])


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest by inner product of each row, itself excluded."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")
        out[a : a + 1024] = np.take_along_axis(part, order, 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 20) -> np.ndarray:
    """Parts of about equal size that keep neighbours together.

    Starts from recursive halving along principal directions; then nodes move to the
    part that holds most of their neighbours, largest gain first, while caps allow.
    """
    n = len(x)
    label = np.zeros(n, np.int64)
    shares = [(np.arange(n), parts)]
    used = 0
    while shares:
        rows, p = shares.pop()
        if p == 1:
            label[rows] = used
            used += 1
            continue
        centred = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        left = p // 2
        at = len(rows) * left // p
        shares += [(order[:at], left), (order[at:], p - left)]
    cap = int(np.ceil(n / parts * (1 + slack)))
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        ties = np.zeros((n, parts), np.int32)
        np.add.at(ties, (starts, label[ends]), 1)
        best = ties.argmax(1)
        gain = ties[np.arange(n), best] - ties[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < cap:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 500 + 1:
            break
    return label


def _softmax(x: np.ndarray, goal: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft goals by Adam."""
    w, b = np.zeros((x.shape[1], goal.shape[1])), np.zeros(goal.shape[1])
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        z = x @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        e = (z / z.sum(1, keepdims=True) - goal) / len(x)
        for p, g, mm, vv in zip((w, b), (x.T @ e + 1e-5 * w, e.sum(0)), m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p -= 0.1 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-9)
    return w, b


def fit(sample: np.ndarray, rows: int) -> Index:
    """An index of one level for ``rows`` vectors from a bounded sample of them."""
    n, d = sample.shape
    parts = int(min(PARTS, max(4, rows // ROWS), max(1, n // LEAST)))
    if n <= 8 * GRAPH or parts == 1:
        return Index(np.zeros((d, 1)), np.zeros(1))
    graph = _graph(sample, GRAPH)
    label = balanced_parts(sample, graph, parts)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), GRAPH), label[graph].ravel()), 1.0 / GRAPH)
    goal = 0.5 * goal + 0.5 * np.eye(parts)[label]
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    return Index(*_softmax(unit, goal))


def probes_for(index: Index | Tree, sample: np.ndarray, k: int, recall: float) -> int:
    """The least number of likeliest parts that hold ``recall`` of the sample's neighbours."""
    n = len(sample)
    if n < 2 or index.parts == 1:
        return 1
    home, probe = index.homes(sample), np.arange(0, n, max(1, n // 1000))
    near = _graph(sample, min(k, n - 1))[probe]
    reached = np.zeros(index.parts, np.int64)
    for a in range(0, len(probe), 100):
        logits = index.logits(sample[probe[a : a + 100]])
        rank = np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1, kind="stable")
        reached += np.bincount(np.take_along_axis(rank, home[near[a : a + 100]], 1).ravel(), minlength=index.parts)
    return min(index.parts, int(np.searchsorted(reached.cumsum() / near.size, recall) + 1))


def _drawn(rows: DataFrame, n: int) -> DataFrame:
    """At most SAMPLE rows: those with the smallest hashes, so the same ones in every run."""
    turn = F.pmod(F.xxhash64(F.lit(5), "vec_id", "vector"), F.lit(1 << 30))
    share = min(1.0, 1.2 * SAMPLE / max(1, n) + 1e-6)
    return rows.select("vec_id", "vector", turn.alias("turn")).where(F.col("turn") < int(share * (1 << 30))).orderBy("turn", "vec_id", "vector").limit(SAMPLE)


def _second(rows: DataFrame, top: Index) -> Tree:
    """``top`` with every part fitted again, each on at most SAMPLE of its rows in a task of its own."""
    held = rows.sparkSession.sparkContext.broadcast(top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.homes(_matrix(batch.column(0)))), *batch.columns], names=["part", *batch.schema.names])

    turn = F.pmod(F.xxhash64(F.lit(7), "vec_id", "vector"), F.lit(1 << 30))
    placed = cut(rows.select("vector", "vec_id", turn.alias("turn")).mapInArrow(place, "part long, vector array<double>, vec_id long, turn long"))
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per part
    bound = F.element_at(F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, int(min(1.0, 0.9 * SAMPLE / n) * (1 << 30)))]), F.col("part"))

    def child(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["turn", "vec_id"])[:SAMPLE]
        part = int(frame["part"].iloc[0])
        return pd.DataFrame({"part": [part], "child": [pickle.dumps(fit(np.stack(frame["vector"].to_numpy()), sizes[part]))]})

    fitted = placed.where(F.col("turn") < bound).groupBy("part").applyInPandas(child, "part long, child binary").collect()
    found = {r["part"]: pickle.loads(r["child"]) for r in fitted}
    none = Index(np.zeros((top.weights.shape[0], 1)), np.zeros(1))
    return Tree(top, [found.get(i, none) for i in range(top.parts)])


def search(table: DataFrame, is_query, k: int = 20, recall: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that ``is_query`` selects."""
    rows = cut(valid(table, vector, key))
    n = rows.count()
    drawn = _drawn(rows, n).collect()
    sample = np.array([r["vector"] for r in drawn], np.float64).reshape(len(drawn), len(drawn[0]["vector"]) if drawn else 1)
    index: Index | Tree = fit(sample, n) if drawn else Index(np.zeros((0, 1)), np.zeros(1))
    if n > WIDE * index.parts and index.parts > 1:
        index = _second(rows, index)
    index.probes = probes_for(index, sample, k, recall)
    held = table.sparkSession.sparkContext.broadcast((index, sample, np.array([r["vec_id"] for r in drawn], np.int64), index.homes(sample) if drawn else np.zeros(0, np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value[0].homes(_matrix(batch.column(1)))), *batch.columns], names=["part", *batch.schema.names])

    placed = cut(rows.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks")).mapInArrow(place, "part long, vec_id long, vector array<double>, asks boolean"))
    sizes = cut(placed.groupBy("part").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks")))  # a row per part
    count = np.zeros(index.parts, np.int64)
    for r in sizes.collect():
        count[r["part"]] = r["n"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known, known_ids, homes = held.value
        for batch in batches:
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            floor, mark, parts = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64), []
            for at in range(len(ids)):
                order = np.argsort(-found.logits(x[at : at + 1])[0], kind="stable")
                enough = int(np.searchsorted(np.cumsum(count[order]), k + 1)) + 1
                order = order[: max(found.probes, enough)]
                parts.append(order[count[order] > 0])
                mark[at] = _mark(x[at])
                near, score = _nearest(known, known_ids, x[at], ids[at], k, among=np.isin(homes, order))
                if len(near) == k:
                    floor[at] = score[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int64())), pa.array(floor), pa.array(mark)], names=[*batch.schema.names, "parts", "floor", "mark"])

    asked = cut(placed.where("asks").select("vec_id", "vector").mapInArrow(route, "vec_id long, vector array<double>, parts array<long>, floor double, mark long"))
    wide = F.broadcast(sizes.select("part", "blocks"))
    rounds = max(1, -(-asked.count() // (16 * BLOCK)))  # queries are dealt too, so no block meets them all
    left = placed.join(wide, "part").select(
        "part", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"), F.lit(0).alias("kind"), "vec_id", "vector", F.lit(None).cast("double").alias("floor")
    )
    right = (
        asked.select(F.explode("parts").alias("part"), "vec_id", "vector", "floor")
        .join(wide, "part")
        .select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(rounds)).cast("int").alias("round"), F.lit(1).alias("kind"), "vec_id", "vector", "floor")
    )
    met = left.unionByName(right).repartition("part", "block", "round").sortWithinPartitions("part", "block", "round", "kind", "vec_id")
    best = met.select("part", "block", "round", "kind", "vec_id", "vector", "floor").mapInArrow(_scan(k), "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    # rows that share an id: the nearest of them counts
    once = best.groupBy("query_id", "mark", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _mark(q: np.ndarray) -> int:
    """Tells apart queries that share an id."""
    return int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "big", signed=True)


def _nearest(base: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float = -np.inf, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows ``among`` all that reach ``floor`` and are not the query's own."""
    if not len(base):
        return ids, np.zeros(0)
    rough = base @ q
    rough[ids == own if among is None else (ids == own) | ~among] = -np.inf
    if len(ids) > k:
        floor = max(floor, np.partition(rough, len(ids) - k)[len(ids) - k])
    near = np.flatnonzero(np.isfinite(rough) & (rough >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else np.isfinite(rough)))
    score = (base[near] * q).sum(axis=1)  # one order of summation everywhere
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def _scan(k: int):
    """Streams sorted blocks: base rows are held, queries meet them in batches."""

    def best(base: np.ndarray, ids: np.ndarray, asked: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        for q, own, low in zip(queries, asked, floor, strict=True):
            near, score = _nearest(base, ids, q, own, k, low)
            yield own, _mark(q), near, score

    def pack(found: list[tuple]) -> pa.RecordBatch:
        size = [len(f[2]) for f in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([f[0] for f in found], size), pa.int64()),
                pa.array(np.repeat([f[1] for f in found], size), pa.int64()),
                pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                pa.array(np.concatenate([f[3] for f in found]), pa.float64()),
            ],
            names=["query_id", "mark", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, ids = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            kind, vec_id, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _matrix(batch.column(5))
            floor = batch.column(6).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (kind[1:] != kind[:-1])])) if len(kind) else []
            for a, b in zip(cuts, [*cuts[1:], len(kind)], strict=False):
                if key != tuple(keys[a]):
                    key, base, ids = tuple(keys[a]), [], []
                if kind[a] == 0:
                    base.append(x[a:b])
                    ids.append(vec_id[a:b])
                elif base:
                    base, ids = [np.concatenate(base)], [np.concatenate(ids)]
                    found = [f for f in best(base[0], ids[0], vec_id[a:b], x[a:b], floor[a:b]) if len(f[2])]
                    if found:
                        yield pack(found)

    return run
