"""Run a NumPy function over many small groups, streaming sorted partitions.

``applyInPandas`` costs milliseconds a group, which is too dear for one group per
frame. Here rows are dealt and sorted by key, and each partition is cut at key changes
in whole Arrow batches; only a group that spans batches is carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], run: Callable[..., tuple | None], schema: str) -> DataFrame:
    """``run(keys, arrays)`` per group gives arrays for ``schema`` (or None); keys and columns are numeric."""

    def each(group: np.ndarray, key: list[np.ndarray], rows: list[np.ndarray]) -> tuple | None:
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=len(group))).tolist()
        out = [run(tuple(k[a] for k in key), [r[a:b] for r in rows]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = [o for o in out if o is not None]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else None

    return map_many(df, keys, order, columns, each, schema)


def map_many(df: DataFrame, keys: list[str], order: list[str], columns: list[str], run: Callable[..., tuple | None], schema: str) -> DataFrame:
    """As ``map_groups``, with many whole groups a call: ``run(group, keys, arrays)`` gets each row's group number (from 0, rising) and key."""
    names = [*keys, *[c for c in columns if c not in keys]]
    wanted = [keys.index(c) if c in keys else names.index(c) for c in columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            if rest is not None:
                data = [np.concatenate([a, b]) for a, b in zip(rest, data, strict=True)]
            last = _cuts(data[: len(keys)])[-1]
            rest = [a[last:] for a in data]
            yield from emit([a[:last] for a in data])
        if rest is not None:
            yield from emit(rest)

    def emit(data: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(data[0]):
            return
        group = np.zeros(len(data[0]), np.int64)
        group[_cuts(data[: len(keys)])[1:]] = 1
        out = run(np.cumsum(group), data[: len(keys)], [data[i] for i in wanted])
        if out is not None and len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[p.split()[0] for p in schema.split(", ")])

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def places(*group: np.ndarray) -> np.ndarray:
    """Each row's place in its group, of rows that are sorted by group."""
    first = _cuts(list(group)) if len(group[0]) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(group[0]))
    return np.arange(len(group[0])) - np.repeat(first, size)


def _cuts(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the groups."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
