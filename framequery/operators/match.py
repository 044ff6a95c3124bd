"""Matching predictions to targets, votes over layers, and joins of parameter tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import maths as M

# Weights of the cost terms.
CLASS_WEIGHT, L1_WEIGHT, GIOU_WEIGHT = 2.0, 5.0, 2.0
#: Cost of a pair that an earlier round has chosen, and cells of the tables that are assigned together.
TAKEN, CELLS = 1e6, 1 << 20


def cost(probability: Column, a: G.Box, b: G.Box) -> Column:
    """Cost of a pair; ``a`` and ``b`` are (cx, cy, w, h), normalised."""
    l1 = G.total(F.abs(x - y) for x, y in zip(a, b, strict=True))
    overlap = G.giou(G.centre_to_corners(a), G.centre_to_corners(b))
    return L1_WEIGHT * l1 + CLASS_WEIGHT * M.focal_cost(probability) - GIOU_WEIGHT * overlap


def assign(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest one-to-one assignment of the shorter side, by shortest augmenting paths. NaN costs 1."""
    costs = np.where(np.isnan(costs), 1.0, costs)
    turned = costs.shape[0] > costs.shape[1]
    c = costs.T if turned else costs
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner, held = np.full(m, -1), np.full(n, -1)  # the row of a column, the column of a row
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, free = start, 0.0, -1
        while free < 0:
            reach = base + c[row] - row_price[row] - col_price
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], row
            j = int(np.where(done, np.inf, dist).argmin())
            base, done[j] = dist[j], True
            row = owner[j]
            if row < 0:
                free = j
        for j in np.flatnonzero(done):
            if owner[j] >= 0 and j != free:
                row_price[owner[j]] += base - dist[j]
            col_price[j] -= base - dist[j]
        row_price[start] += base
        while True:
            row = via[free]
            owner[free] = row
            held[row], free = free, held[row]
            if row == start:
                break
    cols = np.flatnonzero(owner >= 0)
    rows = owner[cols]
    a, b = (cols, rows) if turned else (rows, cols)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def repeated(costs: np.ndarray, rounds: int, taken: float = TAKEN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Assignments of several rounds; a pair chosen in a round costs ``taken`` in the later ones."""
    costs, out = np.where(np.isnan(costs), 1.0, costs), []
    for _ in range(rounds):
        x, y = assign(costs)
        out.append((x, y))
        costs[x, y] = taken
    return out


def assign_alike(costs: np.ndarray) -> np.ndarray:
    """As ``assign`` for many tables of one shape at once, [table, row, column] without NaN: [table, short side], the place on the long side.

    Every table takes the same steps as alone, so that ties fall alike; the steps of all tables are array operations.
    """
    c = costs.transpose(0, 2, 1) if costs.shape[1] > costs.shape[2] else costs
    size, n, m = c.shape
    row_price, col_price = np.zeros((size, n)), np.zeros((size, m))
    owner, held = np.full((size, m), -1), np.full((size, n), -1)
    for start in range(n):
        dist, via, done = np.full((size, m), np.inf), np.full((size, m), -1), np.zeros((size, m), bool)
        row, base, free = np.full(size, start), np.zeros(size), np.full(size, -1)
        t = np.arange(size)  # tables still searching
        while len(t):
            r = row[t]
            reach = base[t, None] + c[t, r] - row_price[t, r][:, None] - col_price[t]
            better = ~done[t] & (reach < dist[t])
            dist[t] = np.where(better, reach, dist[t])
            via[t] = np.where(better, r[:, None], via[t])
            j = np.where(done[t], np.inf, dist[t]).argmin(axis=1)
            base[t], done[t, j] = dist[t, j], True
            row[t] = owner[t, j]
            ended = row[t] < 0
            free[t[ended]] = j[ended]
            t = t[~ended]
        every = np.arange(size)
        passed, at = np.nonzero(done)
        gain = base[passed] - dist[passed, at]
        owned = (owner[passed, at] >= 0) & (at != free[passed])
        row_price[passed[owned], owner[passed, at][owned]] += gain[owned]
        col_price[passed, at] -= gain
        row_price[:, start] += base
        t = every
        while len(t):
            r, f = via[t, free[t]], free[t]
            owner[t, f] = r
            before = held[t, r].copy()
            held[t, r] = f
            free[t] = before
            t = t[r != start]
    return held


def hungarian(costs: DataFrame, frame: str = "frame_id", a: str = "a_det_id", b: str = "b_det_id", rounds: int = 1) -> DataFrame:
    """(frame, a, b, cost): the cheapest assignment within each frame; a frame has every (a, b) once.

    With ``rounds`` > 1 there is a ``round`` column: each round matches anew without the
    pairs of those before. Pairs are gathered where the join on the frame left them; frames of a batch with as many rows
    and columns are assigned together.
    """
    schema = f"{frame} long, {a} long, {b} long, cost double, round long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            group = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False))
            left, right, cost = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            i, rows_of, n = _places(group, left, len(keys))
            j, cols_of, m = _places(group, right, len(keys))
            row_start, col_start = np.cumsum(n) - n, np.cumsum(m) - m
            found = []
            for shape in np.unique(np.stack([n, m], axis=1), axis=0):
                own = np.flatnonzero((n == shape[0]) & (m == shape[1]))
                each = max(1, CELLS // int(shape.prod()))
                for tables in (own[k : k + each] for k in range(0, len(own), each)):
                    place = np.full(len(keys), -1)
                    place[tables] = np.arange(len(tables))
                    pairs = np.flatnonzero(place[group] >= 0)
                    table = np.full((len(tables), *shape), np.nan)
                    table[place[group[pairs]], i[pairs], j[pairs]] = cost[pairs]
                    work, turned = np.where(np.isnan(table), 1.0, table), shape[0] > shape[1]
                    for k in range(rounds):
                        held = assign_alike(work)
                        t, short = np.divmod(np.arange(held.size), held.shape[1])
                        x, y = (held.ravel(), short) if turned else (short, held.ravel())
                        found.append((keys[tables][t], rows_of[row_start[tables][t] + x], cols_of[col_start[tables][t] + y], table[t, x, y], np.full(len(t), k)))
                        work[t, x, y] = TAKEN
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[p.split()[0] for p in schema.split(", ")])

    pairs = costs.select(frame, F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b), F.col("cost").cast("double").alias("cost"))
    out = pairs.groupBy(frame).agg(F.collect_list(F.struct(a, b, "cost")).alias("rows")).mapInArrow(run, schema)
    return out if rounds > 1 else out.drop("round")


def _places(group: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each id among its group's distinct ids, these ids group by group, and how many each group has."""
    order = np.lexsort((ids, group))
    g, v = group[order], ids[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    count = np.bincount(g[first], minlength=groups)
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(first) - 1 - (np.cumsum(count) - count)[g]
    return place, v[first], count


def matched_targets(matches: DataFrame, targets: DataFrame, image: str = "image_id", target: str = "target") -> DataFrame:
    """Each match with its target's columns: a gather by (image, target)."""
    return matches.join(targets, [image, target])


def denoising_queries(targets: DataFrame, number: int = 100, frame: str = "frame_id", order: str = "det_id") -> DataFrame:
    """Targets repeated in groups: grp, the target's place in its frame and its query place.

    A frame of n targets gets max(number // n, 1) groups, and place p of group g is query g n + p.
    """
    w = Window.partitionBy(frame)
    placed = targets.withColumns({"place": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})
    groups = F.greatest(F.floor(F.lit(number) / F.col("n")).cast("int"), F.lit(1))
    out = placed.withColumn("grp", F.explode(F.sequence(F.lit(0), groups - 1)))
    return out.withColumn("query", (F.col("grp") * F.col("n") + F.col("place")).cast("long")).drop("n")


def noised(queries: DataFrame, classes: int, seed: int, key: list[str], label_ratio: float = 0.5, box_scale: float = 1.0, negative: Column | None = None) -> DataFrame:
    """Denoising queries with noise in ``label`` and the normalised box (cx, cy, w, h).

    A label is drawn anew with probability ``label_ratio`` / 2. Every corner moves by a
    random sign times U x half the side x ``box_scale``, U in [0, 1), or in [1, 2) for
    ``negative`` rows, and is clipped to [0, 1]. Draws are hashes of the key and ``seed``,
    so a task that runs again draws the same.
    """
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), *key)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    label = F.when(draw(0) < label_ratio * 0.5, F.floor(draw(1) * classes).cast("int")).otherwise(F.col("label"))
    far = F.lit(0.0) if negative is None else F.when(negative, 1.0).otherwise(0.0)
    corners = G.centre_to_corners(G.box("", ("cx", "cy", "w", "h")))

    def moved(k: int, corner: Column, side: str) -> Column:
        sign = F.when(draw(2 + k) < 0.5, -1.0).otherwise(1.0)
        return F.least(F.greatest(corner + sign * (far + draw(6 + k)) * F.col(side) / 2 * box_scale, F.lit(0.0)), F.lit(1.0))

    box = G.corners_to_centre(tuple(moved(k, c, "w" if k % 2 == 0 else "h") for k, c in enumerate(corners)))
    return queries.withColumns({"label": label, **{n: F.abs(c) for n, c in zip(("cx", "cy", "w", "h"), box, strict=True)}})


def vote(matches: DataFrame, group: list[str], query: str, target: str) -> DataFrame:
    """Over all layers' matches: each query's most voted target, ties to the smaller."""
    counts = matches.groupBy(*group, query, target).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(*group, query).orderBy(F.desc("votes"), target)
    return counts.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def class_goals(predictions: DataFrame, matched: DataFrame, keys: list[str], background: int) -> DataFrame:
    """Each prediction's label, ``background`` where it is unmatched."""
    return predictions.join(matched, keys, "left").withColumn("label", F.coalesce("label", F.lit(background)))


def match_states(model: DataFrame, stored: DataFrame, name: str = "name", shape: str = "shape") -> DataFrame:
    """Model parameters against stored ones: matched, unmatched (shape differs) or missed."""
    s = stored.select(F.col(name), F.col(shape).alias("_stored"))
    state = F.when(F.col("_stored").isNull(), "missed").when(F.col(shape) == F.col("_stored"), "matched").otherwise("unmatched")
    return model.join(s, name, "left").select(*model.columns, state.alias("state"))


def parameter_groups(names: DataFrame, patterns: list[str], name: str = "name") -> DataFrame:
    """Group of each parameter: the place of the first pattern it fits, or the number of patterns.

    ``n_groups`` counts the patterns it fits; a run over more than one is an error for the caller.
    """
    fits = [F.col(name).rlike(p) for p in patterns]
    group = F.coalesce(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)], F.lit(len(patterns)))
    return names.select("*", group.alias("group_id"), G.total([f.cast("int") for f in fits]).alias("n_groups"))


def remap_head(rows: DataFrame, ids: list[int], position: str = "position") -> DataFrame:
    """Rows of a class head in a new order: new place k takes old row ids[k]; the id table is small and fixed."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(ids)), "new_position int, _old int")
    return F.broadcast(table).join(rows, F.col("_old") == F.col(position)).drop("_old")
