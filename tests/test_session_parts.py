"""Sessions counted by parts, without a stream: against a plain model, and by how often a part's state is touched."""

import random

import pandas as pd

from framequery.streaming import sessions

GAP = 20_000


class Handle:
    """A part's state and timers, and how often they are touched."""

    def __init__(self):
        self.kept, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls, self.kept = self.calls + 1, value

    def clear(self):
        self.calls, self.kept = self.calls + 1, None

    def registerTimer(self, at):
        assert at not in self.timers
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Times:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def _plain(triggers):
    """(frames, ends) of triggers' (session, at, id, det_count, det_us), with a watermark after each."""
    frames, ends, open_ = [], [], {}
    for rows in triggers:
        for s, at, k, n, us in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0)):
            if s in open_ and at - open_[s][4] > GAP:
                ends.append((s, *open_.pop(s)))
            f, d, u, first, _ = open_.get(s, (0, 0, 0, at, at))
            open_[s] = (f + 1, d + n, u + us, first, at)
            frames.append((s, k, f + 1, *open_[s], (f + 1) % 3 == 0))
        mark = max(r[1] for r in rows) // 1000
        for s in [s for s, o in open_.items() if (o[4] + GAP) // 1000 + 1 <= mark]:
            ends.append((s, *open_.pop(s)))
    return frames, ends, open_


def test_a_part_counts_its_sessions_together():
    rng = random.Random(3)
    names = [None, "", "é", *[f"s{k}" for k in range(400)]]
    triggers = []
    for t in range(4):
        own = names if t < 3 else names[:5]  # most are silent in the end
        triggers.append([(rng.choice(own), t * 50_000 + rng.randrange(50_000), rng.choice([None, 2**60 + k]) if k % 50 == 0 else 2**60 + k, rng.randrange(3), 2**53 + k) for k in range(3000)])
    handle, got = Handle(), []
    counters = sessions.Counters(GAP, 3)
    counters.init(handle)
    for rows in triggers:
        sent = pd.DataFrame({"part": 1, **{c: pd.Series([r[i] for r in rows], dtype=object if c == "session" else "int64") for i, c in ((0, "session"), (1, "at_us"), (3, "det_count"), (4, "det_us"))}})
        sent["frame_id"], sent["named"] = [r[2] or 0 for r in rows], [r[2] is not None for r in rows]
        mark, handle.calls = max(r[1] for r in rows) // 1000, 0
        got += list(counters.handleInputRows((1,), iter([sent[:1000], sent[1000:]]), None))
        for at in sorted(a for a in handle.timers if a <= mark):
            got += list(counters.handleExpiredTimer((1,), Times(mark), Times(at)))
            handle.timers.remove(at)
        assert handle.calls <= 7 and len(handle.timers) <= 1  # of 403 sessions: read, written, timer moved, and once more as it fires
    rows = [tuple(None if v is pd.NA or v != v else v for v in r) for d in got for r in d[sessions.OUTPUT.names].itertuples(index=False, name=None)]
    frames, ends, open_ = _plain(triggers)
    key = lambda r: tuple((v is None, v or 0) if i else (v is None, v or "") for i, v in enumerate(r))
    assert sorted([(r[0], r[2], r[3], *r[4:9], r[9]) for r in rows if r[1] == "frame"], key=key) == sorted(frames, key=key)
    assert sorted([(r[0], *r[4:9]) for r in rows if r[1] == "end"], key=key) == sorted(ends, key=key)
    assert ends and len(open_) <= 5 and (handle.kept is None) == (not open_)
