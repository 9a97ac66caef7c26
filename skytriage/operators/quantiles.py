"""Exact percentiles of many columns, groups and shares at once, by refining histograms.

A double is a 64-bit key of the same order. A scan counts the keys' first BITS bits, each task by itself, so that a task sends
a row for each prefix that it has met. The totals tell in which prefix a rank lies; the next scan looks into these prefixes
alone, by as many bits as keep what the driver gets below MOST rows, whatever the number of groups, columns and shares. As soon
as few enough rows are left in them their values themselves are counted: two scans for some millions of values of a column,
three or four for more. Nothing is written or sorted, only counts are shuffled, and the driver gets them as Arrow columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a scan adds at most and at least, and rows that are few enough to be counted by value.
BITS, LEAST_BITS, FEW = 16, 4, 50_000
#: Counts that a scan after the first sends to the driver at most, unless there are more than MOST >> LEAST_BITS prefixes to refine.
MOST = 1 << 18
_TOP = np.uint64(1 << 63)


def keys_of(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0.0 is 0.0."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >= _TOP, ~b, b | _TOP)


def values_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys >= _TOP, keys & ~_TOP, ~keys).view(np.float64)


def _numbered(batch: pa.RecordBatch, by: int) -> tuple[np.ndarray, list[tuple]]:
    """The group of each row, by its first `by` columns, and the groups."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in range(by):
        own = batch.column(c).dictionary_encode("encode").indices.to_numpy()
        _, code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)
    first = np.unique(code, return_index=True)[1]
    rows = batch.select(range(by)).take(pa.array(first))
    return code, list(zip(*(rows.column(c).to_pylist() for c in range(by)), strict=True)) if by else [()] * len(first)


def _scan(df: DataFrame, columns: list[str], by: tuple[str, ...], inside: dict[tuple, np.ndarray] | None, before: int, bits: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(column, group...) -> prefixes of `bits` bits in order and their counts; only of keys whose first `before` bits are in `inside`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = df.select(*by, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
    kinds = [to_arrow_schema(picked.schema).field(i).type for i in range(len(by))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, names = _numbered(batch, len(by))
            for i in range(len(columns)):
                x = batch.column(len(by) + i)
                x = x.to_numpy(zero_copy_only=False)  # nulls are NaN
                for g, name in enumerate(names):
                    own = x[group == g] if len(names) > 1 else x
                    k = keys_of(own[~np.isnan(own)])
                    if inside is not None:
                        k = k[np.isin(k >> np.uint64(64 - before), inside.get((i, *name), np.zeros(0, np.uint64)))]
                    if len(k):
                        found, n = np.unique(k >> np.uint64(64 - bits), return_counts=True)
                        if (i, *name) in held:
                            old, m = held[i, *name]
                            found, where = np.unique(np.concatenate([old, found]), return_inverse=True)
                            n = np.bincount(where, np.concatenate([m, n])).astype(np.int64)
                        held[i, *name] = (found, n)
        for (i, *name), (found, n) in held.items():
            groups = [pa.array([v] * len(found), t) for v, t in zip(name, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), *groups, pa.array(found.view(np.int64)), pa.array(n)], ["column", *by, "prefix", "n"])

    schema = ", ".join(["column int", *(f"{c} {t}" for c, t in picked.dtypes[: len(by)]), "prefix long, n long"])
    counts = picked.mapInArrow(run, schema).groupBy("column", *by, "prefix").agg(F.sum("n").alias("n")).toArrow()  # 2^BITS rows at most for each column and group, or MOST
    found = {}
    for batch in counts.combine_chunks().to_batches():
        prefix, n = batch.column("prefix").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        group, names = _numbered(batch, 1 + len(by))
        order = np.lexsort((prefix, group))
        ends = np.searchsorted(group[order], np.arange(len(names) + 1))
        for g, name in enumerate(names):
            own = order[ends[g] : ends[g + 1]]
            found[name] = (prefix[own], n[own])
    return found


def order_statistics(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]], by: tuple[str, ...] = ()) -> dict[tuple, tuple[int, dict[int, float]]]:
    """(column, group...) -> number of values and the value at each rank (from 0) that ranks(number) asks for. Nulls and NaN
    are no values. Jobs run while this is called; df is scanned two to four times, more often for thousands of ranks, and has to
    give the same rows each time."""
    before, bits = 0, BITS
    hist = _scan(df, columns, by, None, before, bits)
    total = {name: int(n.sum()) for name, (_, n) in hist.items()}
    # for each rank that is asked for: the prefix it lies in and its rank inside that
    at = {name: {r: (None, r) for r in sorted(set(ranks(n)))} for name, n in total.items()}
    while True:
        left, inside = 0, {}
        for name, own in at.items():
            prefix, n = hist.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            for r, (old, rank) in own.items():
                a, b = (0, len(prefix)) if old is None else np.searchsorted(prefix >> np.uint64(bits - before), np.array([old, old + np.uint64(1)]))
                ends = np.cumsum(n[a:b])
                k = int(np.searchsorted(ends, rank, side="right"))
                own[r] = (prefix[a + k], rank - int(ends[k] - n[a + k]))
            inside[name] = np.unique(np.array([p for p, _ in own.values()], np.uint64))
            left += int(n[np.isin(prefix, inside[name])].sum())
        if bits == 64:
            return {name: (total[name], {r: float(values_of(np.array([p], np.uint64))[0]) for r, (p, _) in own.items()}) for name, own in at.items()}
        before, bits = bits, 64 if left <= FEW else min(64, bits + _added(left, sum(map(len, inside.values()))))
        hist = _scan(df, columns, by, inside, before, bits)


def _added(left: int, prefixes: int) -> int:
    """Bits of the next scan, which counts no more rows than are left and no more parts than the prefixes have."""
    return BITS if left <= MOST else max(min(LEAST_BITS, BITS), min(BITS, (MOST // max(prefixes, 1)).bit_length() - 1))


def percentiles_of(df: DataFrame, columns: list[str], shares: list[float] | Callable[[int], list[float]], by: tuple[str, ...] = ()) -> dict[tuple, list[float]]:
    """(column, group...) -> exact percentiles with linear interpolation; `shares` may depend on the number of values. A column
    and group without values has no entry."""
    of = shares if callable(shares) else lambda n: shares
    found = order_statistics(df, columns, lambda n: [f(q * (n - 1)) for q in of(n) for f in (math.floor, math.ceil)], by)
    out = {}
    for (i, *name), (n, value) in found.items():
        ends = [(value[math.floor(p)], value[math.ceil(p)], p - math.floor(p)) for p in (q * (n - 1) for q in of(n))]
        out[columns[i], *name] = [low if low == high else low + (high - low) * part for low, high, part in ends]
    return out


def percentiles(df: DataFrame, x: str, shares: list[float] | Callable[[int], list[float]], by: tuple[str, ...] = ()) -> dict[tuple, list[float]]:
    """group -> exact percentiles of one column."""
    return {name: v for (_, *name), v in percentiles_of(df, [x], shares, by).items() for name in [tuple(name)]}
