"""Weighted centred moments of pairs (x, y) by group, mergeable: no sum of raw squares is ever taken.

A task keeps (n, weight, means, centred sums of squares and products) of each group it meets; two such states merge exactly
(Chan's formulas), so a group may lie in any number of tasks and a task sends one row for it. The states of a group are
folded where they meet: there are as many as tasks that have met the group, whatever its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds before it sends them on.
HELD = 1 << 17
STATE = ("n", "w", "mx", "my", "cxx", "cxy", "cyy", "tx", "txx")


def _states(group: np.ndarray, groups: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """groups x STATE: means first, then sums about them. tx and txx are the unweighted mean and centred square of x."""
    add = lambda v: np.bincount(group, v, minlength=groups)
    n, total = add(np.ones(len(x))), add(w)
    mx, my, tx = add(w * x) / total, add(w * y) / total, add(x) / n
    dx, dy, dt = x - mx[group], y - my[group], x - tx[group]
    return np.stack([n, total, mx, my, add(w * dx * dx), add(w * dx * dy), add(w * dy * dy), tx, add(dt * dt)], 1)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, w = a[0] + b[0], a[1] + b[1]
    dx, dy, dt = b[2] - a[2], b[3] - a[3], b[7] - a[7]
    part, share = a[1] * b[1] / w, a[0] * b[0] / n
    return np.array([n, w, a[2] + dx * b[1] / w, a[3] + dy * b[1] / w, a[4] + b[4] + dx * dx * part, a[5] + b[5] + dx * dy * part, a[6] + b[6] + dy * dy * part, a[7] + dt * b[0] / n, a[8] + b[8] + dt * dt * share])


def _fold(states: Column) -> Column:
    """The same merge as a column expression over an array of states, in order, so that the result does not hang on theirs."""
    ordered = F.array_sort(states)

    def merge(a: Column, b: Column) -> Column:
        n, w = a["n"] + b["n"], a["w"] + b["w"]
        dx, dy, dt = b["mx"] - a["mx"], b["my"] - a["my"], b["tx"] - a["tx"]
        part, share = a["w"] * b["w"] / w, a["n"] * b["n"] / n
        cells = [n, w, a["mx"] + dx * b["w"] / w, a["my"] + dy * b["w"] / w, a["cxx"] + b["cxx"] + dx * dx * part, a["cxy"] + b["cxy"] + dx * dy * part, a["cyy"] + b["cyy"] + dy * dy * part, a["tx"] + dt * b["n"] / n, a["txx"] + b["txx"] + dt * dt * share]
        return F.struct(*(c.alias(k) for c, k in zip(cells, STATE, strict=True)))

    return F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, F.lit(0)), merge)


def moments(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Rows (keys..., n, w, mx, my, cxx, cxy, cyy, tx, txx) of rows whose x, y and positive weight are all there; tx and txx
    are x's mean and centred sum of squares without weights."""
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = df.where((F.col(w) > 0) & F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *(F.col(c).cast("double").alias(f"_{k}") for k, c in (("x", x), ("y", y), ("w", w))))
    kinds = [to_arrow_schema(picked.schema).field(i).type for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names, cells = list(zip(*held, strict=True)) if keys else [], np.array(list(held.values()))
            return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(names, kinds, strict=True)), *(pa.array(c) for c in cells.T)], [*keys, *STATE])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            group = np.fromiter((number.setdefault(k, len(number)) for k in names), np.int64, len(names))
            states = _states(group, len(number), *(batch.column(len(keys) + i).to_numpy() for i in range(3)))
            for name, k in number.items():
                held[name] = _merged(held[name], states[k]) if name in held else states[k]
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    schema = ", ".join([*(f"{k} {t}" for k, t in picked.dtypes[: len(keys)]), *(f"{c} double" for c in STATE)])
    each = picked.mapInArrow(run, schema).groupBy(*keys).agg(F.collect_list(F.struct(*STATE)).alias("_s"))
    return each.select(*keys, _fold(F.col("_s")).alias("_m")).select(*keys, "_m.*").withColumn("n", F.col("n").cast("long"))
