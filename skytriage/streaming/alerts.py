"""A streaming front end of the prefixes: alerts arrive in any order, the batch semantics is the spec.

State per object is a first detection, a count for each epoch and the rows that the watermark has not passed: these may still
be preceded by others, so they wait, in order of time, and are then added to the counts and forgotten. However long an
object is watched, its state is as large as what arrives within the delay. When the watermark passes t0 + the last epoch each
epoch is emitted once; a mark that the object is done stays. Rows behind the watermark are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EPOCHS

OUTPUT = "object_id long, epoch double, t0 double, n_obs long, n_det long, last_mjd double"
STATE = "done boolean, t0 double, n_obs array<long>, n_det array<long>, last_mjd array<double>, mjd array<double>, det array<boolean>"
#: mjd of the Unix epoch, and a day in milliseconds.
UNIX_MJD, DAY_MS = 40587.0, 86400000


def release(state: tuple, passed: float, epochs: tuple[float, ...]) -> tuple:
    """The state with its waiting rows up to the day `passed` added to its counts. Rows before the first detection are in
    every prefix; t0 is -1 while nothing is detected."""
    done, t0, n_obs, n_det, last, mjd, det = state
    n_obs, n_det, last = list(n_obs), list(n_det), list(last)
    waiting = sorted(zip(mjd, det, strict=True))
    for k, (m, d) in enumerate(waiting):
        if m > passed:
            break
        if d and t0 < 0:
            t0 = m
        for i, e in enumerate(epochs):
            if t0 < 0 or m <= t0 + e:
                n_obs[i] += 1
                n_det[i] += bool(d)
                last[i] = m
    else:
        k = len(waiting)
    rest = waiting[k:]
    return done, t0, n_obs, n_det, last, [m for m, _ in rest], [bool(d) for _, d in rest]


def prefix_counts(alerts: DataFrame, delay: str = "1 day", epochs: tuple[float, ...] = EPOCHS) -> DataFrame:
    """alerts (object_id, ts timestamp, mjd, det boolean), a stream -> a row per object and epoch when its window is over."""
    empty = (False, -1.0, [0] * len(epochs), [0] * len(epochs), [0.0] * len(epochs), [], [])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else empty
        if now[0]:
            return
        mjd, det = list(now[5]), list(now[6])
        if not state.hasTimedOut:
            for f in frames:
                mjd += f.mjd.tolist()
                det += [bool(x) for x in f.det]
        passed = UNIX_MJD + state.getCurrentWatermarkMs() / DAY_MS
        now = release((*now[:5], mjd, det), passed, epochs)
        t0 = now[1]
        if t0 >= 0 and passed >= t0 + max(epochs):
            yield pd.DataFrame({"object_id": key[0], "epoch": list(epochs), "t0": t0, "n_obs": now[2], "n_det": now[3], "last_mjd": now[4]})
            state.update((True, t0, [], [], [], [], []))
            return
        state.update(now)
        first = t0 if t0 >= 0 else min((m for m, d in zip(now[5], now[6], strict=True) if d), default=None)
        if first is not None:
            due = int((first + max(epochs) - UNIX_MJD) * DAY_MS) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = alerts.withWatermark("ts", delay).select("object_id", "ts", "mjd", "det")
    return rows.groupBy("object_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
