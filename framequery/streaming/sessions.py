"""Frame numbers and counters of sessions, in keyed stream state with timers.

Each session (a robot's run, a camera) has its own numbers and totals, which live as long as the stream,
through restarts, in the state store that Spark keeps beside the checkpoint: a frame's cost does not grow with
the stream's life. A session ends when no frame has come for ``gap``: an event-time timer then sends its totals and
frees its state. Sessions are dealt by hash to a fixed number of parts, which are the keys of the state: a trigger reads and
writes the state of a part once and counts all its sessions together, as a call for each session costs far more than its frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

_LONGS = ("frame_id", "number", "frames", "detections", "det_us", "first_us", "last_us")
OUTPUT = T.StructType([T.StructField("session", T.StringType()), T.StructField("kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in _LONGS], T.StructField("save", T.BooleanType())])
#: The state of a part: its open sessions as a table of ``_KEPT``, written by Arrow.
_STATE = T.StructType([T.StructField("sessions", T.BinaryType())])
_TOTALS = ("frames", "detections", "det_us", "first_us", "last_us")
_KEPT = pa.schema([("session", pa.string()), *[(c, pa.int64()) for c in _TOTALS]])
#: What a frame brings to its part.
_FRAME = pa.schema([("session", pa.string()), ("at_us", pa.int64()), ("frame_id", pa.int64()), ("named", pa.bool_()), ("det_count", pa.int64()), ("det_us", pa.int64())])
#: Parts that sessions are dealt to, and rows that a part sends at once.
PARTS, ROWS = 1024, 1 << 14


class Counters(StatefulProcessor):
    """Rows of kind 'frame' with the session's numbers and totals so far, and of kind 'end' with its final totals; a key is a part of the sessions."""

    def __init__(self, gap_us: int, interval: int):
        self.gap_us, self.interval = gap_us, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._load()
        came = pa.concat_tables([pa.Table.from_pandas(r[["session", *_FRAME.names[1:]]], schema=_FRAME, preserve_index=False) for r in rows])
        names = pa.chunked_array([*kept["session"].chunks, *came["session"].chunks], pa.string()).combine_chunks().dictionary_encode("encode")
        known, old = kept.num_rows, [kept[c].to_numpy() for c in _TOTALS]
        at, frame, named, count, us = (came[c].to_numpy() for c in _FRAME.names[1:])
        session = names.indices.to_numpy()[known:]  # an open session's place in the state, others follow
        order = np.lexsort((frame, ~named, at, session))  # a trigger's frames of one session
        session, at, frame, named, count, us = (a[order] for a in (session, at, frame, named, count, us))

        first = np.diff(session, prepend=-1) != 0
        goes_on = first & (session < known)
        before = np.concatenate([at[:1], at[:-1]])
        before[goes_on] = old[4][session[goes_on]]
        opens = (first & ~goes_on) | (at - before > self.gap_us)
        goes_on &= ~opens
        starts = np.flatnonzero(first | opens)
        run = np.cumsum(first | opens) - 1
        carried = [np.where(goes_on[starts], o[np.where(goes_on[starts], session[starts], 0)], 0) if known else np.zeros(len(starts), np.int64) for o in old]
        so_far = lambda v, c: np.cumsum(v) - (np.cumsum(v) - v)[starts][run] + c[run]
        began = np.where(goes_on[starts], carried[3], at[starts])[run]
        totals = [so_far(np.ones(len(at), np.int64), carried[0]), so_far(count, carried[1]), so_far(us, carried[2]), began, at]

        # ended by a later frame: open sessions whose next frame opens one, and runs that another of their session follows
        over = np.unique(session[first & opens & (session < known)])
        ends = np.append(starts[1:], len(at)) - 1
        last = np.append(session[starts[1:]] != session[starts[:-1]], True)
        who = names.dictionary.take(pa.array(session))
        yield from self._rows(kept["session"].combine_chunks().take(pa.array(over)), "end", [o[over] for o in old])
        yield from self._rows(who.take(pa.array(ends[~last])), "end", [t[ends[~last]] for t in totals])
        yield from self._rows(who, "frame", totals, pa.array(frame, mask=~named))

        silent = np.setdiff1d(np.arange(known), session)
        held = [pa.concat_arrays([kept["session"].combine_chunks().take(pa.array(silent)), who.take(pa.array(ends[last]))])]
        held += [pa.array(np.concatenate([o[silent], t[ends[last]]])) for o, t in zip(old, totals, strict=True)]
        self._keep(pa.Table.from_arrays(held, schema=_KEPT), kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._load()
        over = self._expiry(kept) <= timerValues.getCurrentWatermarkInMs()
        ended = kept.filter(pa.array(over))
        yield from self._rows(ended["session"].combine_chunks(), "end", [ended[c].to_numpy() for c in _TOTALS])
        self._keep(kept.filter(pa.array(~over)), kept, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _load(self) -> pa.Table:
        state = self.state.get()
        if state is None:
            return _KEPT.empty_table()
        return pa.ipc.open_stream(pa.py_buffer(bytes(state[0]))).read_all()

    def _keep(self, now: pa.Table, before: pa.Table, fired: int | None = None) -> None:
        """The part's open sessions, and its timer at the first of their ends."""
        if now.num_rows:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, _KEPT) as writer:
                writer.write_table(now)
            self.state.update((out.getvalue().to_pybytes(),))
        else:
            self.state.clear()
        was, to = (int(self._expiry(t).min()) if t.num_rows else None for t in (before, now))
        if was != to:
            if was is not None and was != fired:
                self.handle.deleteTimer(was)
            if to is not None:
                self.handle.registerTimer(to)

    def _expiry(self, sessions: pa.Table) -> np.ndarray:
        return (sessions["last_us"].to_numpy() + self.gap_us) // 1000 + 1

    def _rows(self, who: pa.Array, kind: str, totals: list[np.ndarray], frame: pa.Array | None = None) -> Iterator[pd.DataFrame]:
        n, number = len(who), pa.array(totals[0])
        nothing = pa.nulls(n, pa.int64())
        save = pa.array((totals[0] % self.interval == 0) & (frame is not None))
        columns = [who, pa.repeat(kind, n), nothing if frame is None else frame, nothing if frame is None else number, number, *[pa.array(t) for t in totals[1:]], save]
        table = pa.Table.from_arrays(columns, names=OUTPUT.names)
        for low in range(0, n, ROWS):
            yield table.slice(low, ROWS).to_pandas(integer_object_nulls=True)


def count_sessions(frames: DataFrame, gap_us: int, interval: int = 10, parts: int = PARTS) -> DataFrame:
    """Numbers, running totals and ends of sessions of a stream of frames (session, frame_id, at_us, det_count, det_us).

    Frames are numbered from 1 within their session in the order of triggers, inside a trigger by time and id; every
    ``interval``-th is to be saved. Null counts add nothing; a null session is one of its own. Start the query inside
    ``state_store``, and in append mode. ``parts`` belongs to the checkpoint; a task holds a trigger's frames of one part.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    named = F.col("frame_id").isNotNull().alias("named")
    timed = frames.select(F.pmod(F.hash("session"), F.lit(parts)).alias("part"), "session", "at_us", whole("frame_id"), named, whole("det_count"), whole("det_us"), F.timestamp_micros("at_us").alias("stamp")).withWatermark("stamp", "0 seconds")
    return timed.groupBy("part").transformWithStateInPandas(Counters(gap_us, interval), OUTPUT, "Append", "EventTime")


#: The state store that keyed state and timers need; a trigger commits its changes alone, not the whole store.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that keyed state and timers need; a query keeps it from its start on."""
    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
