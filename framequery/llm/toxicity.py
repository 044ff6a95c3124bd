"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Features are the presence of lower-cased character n-grams (3 to 5 code points, runs of
other characters than letters, digits and _ read as one blank), hashed into 2^20 buckets. From a
bounded sample of labelled rows, per-class document counts give each bucket its
log-count ratio r, and L2-penalised logistic regression is fitted on presence x r over
all buckets that occur, by dual coordinate ascent with exact steps. The scale of the
scores is set on examples that the model had not seen (folds of the sample).
A text's score is the logistic of the sum over its buckets.

Only the text is an input of a score. Training takes at most ``per_class`` labelled
documents of each class, those with the smallest hashes; everything else runs over all
rows. Defined cases: null text scores like an empty text; null labels and labels of
unknown documents are ignored; conflicting labels of one document are separate
examples; with one class or no labels every text scores the smoothed base rate; a text
of any length is normalised whole and hashed in slices that overlap by the longest
n-gram less one; repeated rows score alike; a null id is no label's document; empty tables work; other
columns pass through, and the score's own column takes a suffix where a name clashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut, free_name
from .textbytes import text_buffers

ORDERS = (3, 4, 5)
BITS = 20
#: Bound on the labelled documents of each class that training reads.
PER_CLASS = 1000
#: Code points hashed at once.
SLICE = 1 << 18
#: Folds whose unseen examples set the scale of the scores.
FOLDS = 3
_GAP = re.compile(r"\W+")


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of a text."""
    codes = np.frombuffer(_GAP.sub(" ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for at in range(0, max(1, len(codes) - max(ORDERS) + 1), SLICE):
        part = codes[at : at + SLICE + max(ORDERS) - 1]
        h = part * np.uint32(0x9E3779B1)
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[n - 1 :] * np.uint32(0xC2B2AE35)
            if n in ORDERS:
                found.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    s = np.concatenate(found) if found else np.zeros(0, np.uint32)
    s.sort()
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(max(z, -700.0)) / (1 + math.exp(max(z, -700.0)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float64), float(bias)

    def score(self, text: str | None) -> float:
        return logistic(self.bias + float(self.weights[features(text or "")].sum()))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` labelled documents a class, and the counts of labels."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]))
    # at most 2 x per_class short rows: a proven bound; of rows that share an id and a label one is taken
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")), counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, penalty: float = 1.0) -> Model:
    """Train on the rows of ``labels``; what must stay unseen is filtered out by the caller."""
    rows, counts = sample(docs, labels, label, per_class)
    base = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    empty = Model(np.zeros(1 << BITS), math.log(base / (1 - base)))
    if not counts.get(0) or not counts.get(1):
        return empty

    # one task trains on the whole sample and one on each fold's rest; the sample's bound is their memory's
    parts = F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("part")
    dealt = rows.select(parts, "doc_id", "y", "text").repartitionByRange(FOLDS + 1, "part")
    trained = {r["part"]: r for r in dealt.groupBy("part").applyInPandas(_trainer(penalty), "part int, y binary, z binary, weights binary, bias double").collect()}
    if FOLDS not in trained or trained[FOLDS]["weights"] is None:
        return empty
    whole = trained.pop(FOLDS)
    y, z = (np.concatenate([np.frombuffer(r[c], t) for r in trained.values()]) for c, t in (("y", np.int64), ("z", np.float64)))
    # the sample is not drawn in the labels' proportions: each example counts for its share of the labels
    slope, shift = calibrate(z, y, np.array([counts[0], counts[1]])[y] / np.bincount(y, minlength=2)[y])
    return Model(slope * np.frombuffer(whole["weights"], np.float32), slope * whole["bias"] + shift)


def _trainer(penalty: float):
    """One part's task: a fold gives its examples' labels and the sums of a model that has not seen them, the last part the model."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        frame = frame.sort_values(["doc_id", "y"], kind="stable")
        x, y = [features(t) for t in frame["text"]], frame["y"].to_numpy(np.int64)
        aside = np.arange(len(x)) % FOLDS == part
        learnt = np.flatnonzero(~aside)
        none = {"part": [part], "y": [y[aside].tobytes()], "z": [np.zeros(aside.sum()).tobytes()], "weights": [None], "bias": [0.0]}
        if len(set(y[learnt].tolist())) < 2:
            return pd.DataFrame(none)
        r = ratios([x[i] for i in learnt], y[learnt])
        w, b = train([x[i] for i in learnt], y[learnt], r, penalty)
        w *= r
        z = np.array([b + float(w[x[i]].sum()) for i in np.flatnonzero(aside)])
        return pd.DataFrame(none | {"z": [z.tobytes()], "bias": [b]} | ({"weights": [w.astype(np.float32).tobytes()]} if part == FOLDS else {}))

    return run


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the weighted logistic regression of labels on sums, by guarded Newton steps; drawn to slope 1."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = lambda p: float((weight * np.logaddexp(0, -sign * (p[0] * z + p[1]))).sum() + (p[0] - 1) ** 2 / 2)
    p = np.array([1.0, 0.0])
    for _ in range(100):
        e = 1 / (1 + np.exp(-np.clip(p[0] * z + p[1], -30, 30)))
        g = np.array([(weight * (e - y) * z).sum() + (p[0] - 1), (weight * (e - y)).sum()])
        c = weight * e * (1 - e) + 1e-9
        step = np.linalg.solve(np.array([[(c * z * z).sum() + 1, (c * z).sum()], [(c * z).sum(), c.sum() + 1e-9]]), g)
        at, most = cost(p), 1.0
        while most > 1e-6 and cost(p - most * step) > at:
            most /= 2
        if most <= 1e-6 or np.abs(most * step).max() < 1e-8:
            break
        p -= most * step
    return float(max(p[0], 0.0)), float(p[1])


def ratios(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log-count ratio of each bucket, 0 where it does not occur."""
    n = np.zeros((2, 1 << BITS))
    for row, c in zip(x, y, strict=True):
        n[c, row] += 1
    shown = np.bincount(y, minlength=2)
    r = np.log((n[1] + 1) / (shown[1] + 2)) - np.log((n[0] + 1) / (shown[0] + 2))
    return np.where(n.any(0), r, 0.0)


def train(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, penalty: float = 1.0, rounds: int = 60, close: float = 2e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise sum log(1 + exp(-s (w.x r + b))) + penalty / 2 (|w|^2 + b^2), s = +-1.

    Dual coordinate ascent: each step maximises the dual over one example exactly; it
    ends when no example's share of the solution moves by more than ``close``.
    """
    w, b = np.zeros(len(r)), 0.0
    norm = [(float(r[row] @ r[row]) + 1) / penalty for row in x]
    share, sign = [0.5] * len(x), np.where(y == 1, 1.0, -1.0).tolist()
    for row, s in zip(x, sign, strict=True):
        w[row] += 0.5 * s / penalty * r[row]
        b += 0.5 * s / penalty
    rng = np.random.Generator(np.random.PCG64(17))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)).tolist():
            row, s, a0, q = x[i], sign[i], share[i], norm[i]
            v = r[row]
            m = s * (float(w[row] @ v) + b)
            a = _step(a0, q, m)
            if a != a0:
                w[row] += (a - a0) * s / penalty * v
                b += (a - a0) * s / penalty
                share[i] = a
                moved = max(moved, abs(a - a0))
        if moved < close:
            break
    return w, b


def _step(a0: float, q: float, m: float) -> float:
    """The root a of log((1 - a) / a) = m + q (a - a0), which lies in (0, 1): Newton kept in a shrinking bracket."""
    low, high, a = 0.0, 1.0, min(max(a0, 1e-12), 1 - 1e-12)
    for _ in range(50):
        f = math.log((1 - a) / a) - m - q * (a - a0)
        if f > 0:
            low = a
        else:
            high = a
        new = a + f / (1 / (a * (1 - a)) + q)
        if not low < new < high:
            new = (low + high) / 2
        if not 1e-14 < new < 1 - 1e-14 or abs(new - a) < 1e-10:
            return min(max(new, 1e-14), 1 - 1e-14)
        a = new
    return a


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the score of every whole text. Only texts go to Python, only scores come back."""
    name = free_name(name, docs.columns)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*held.value)
        for column in columns:
            offsets, data = text_buffers(column)
            yield pa.array([m.score(str(data[a:b], "utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.float64())

    scored = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(F.col(text).cast("string"))
    return docs.select(*(docs.columns if keep is None else keep), scored.alias(name))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score under ``threshold``, with their own columns."""
    scored = score(docs, model, text)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)
