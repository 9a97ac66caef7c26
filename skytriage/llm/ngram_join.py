"""N-gram Jaccard join by rare-first prefixes, and the components of its links.

1. One pass takes each document's set of hashed word n-grams and a fingerprint of the set (equal sets are one class), and
   counts n-grams that repeat within chunks of CHUNK n-grams. The most frequent of these, LISTED at most, are a table of
   fixed size that every task gets. The order (listed count, hash) puts the n-grams known as frequent last, wherever they
   occur; the table only ranks, so what it leaves out costs time and never a link.
2. A second pass emits each class's prefix in that order: two sets with Jaccard of at least T share an n-gram of their
   prefixes. Prefix rows meet by n-gram, those of very frequent n-grams split into cells, and stay if some other row of
   their n-gram passes the length and positional filters.
3. First each cell pairs its members with a few pivots only; what these connect needs no further comparison. Then every two
   components that still meet try a few of their pairs, since in a large group of near copies nearly all of what the pivots
   left apart links somewhere. At last all remaining pairs between different components are candidates, cell against cell, so
   every link between components is found.
   Rows of n-grams with many rows carry a signature, counts of their set by 256 slots: what two signatures differ by
   bounds the symmetric difference from below, so large groups of sets that are near each other but do not link are not
   paired.
4. A candidate pair is verified once: its signatures, a suffix filter, then the intersection of the two sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, by_bytes, discard, mix, ready, shared_folder, windows
from .components import connected_components

SLICE_BYTES = 1 << 20
#: N-grams that are counted together, and most entries of the table of frequent ones.
CHUNK, LISTED = 1 << 22, 1 << 20
#: Rows of a frequent n-gram in a cell, pivots of a cell, rounds of pivots, pairs that are verified against one copy of a set.
CELL_ROWS, PIVOTS, PIVOT_ROUNDS, PAIRS_PER_COPY = 2048, 3, 2, 1024
#: Rounds in which two components try a few pairs before all, and how many.
ROOT_ROUNDS, ROOT_PAIRS = 2, 8
#: Halvings of the suffix filter.
SUFFIX_DEPTH = 3
#: Rows of an n-gram from which on they carry signatures, slots of a signature.
MANY, SLOTS = 24, 256
#: Bytes of all sets for which there is a bucket at least.
BUCKET_BYTES = 128 << 20


def token_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes; a text with fewer words has its whole sequence as one, one without has none."""
    w = Words(column, lower=True)
    runs, bounds = windows(w.hashes, w.first, width)
    out = []
    for k, n in enumerate(np.diff(w.first)):
        if n >= width:
            x = np.sort(runs[bounds[k] : bounds[k + 1]])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif n:
            x = np.array([n], np.uint64)
            for h in w.hashes[w.first[k] : w.first[k + 1]]:
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h)
            out.append(x)
        else:
            out.append(w.hashes[:0])
    return out


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    b = mix(x + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return tuple(mix(np.array([a, b + np.uint64(len(x))])).view(np.int64).tolist())


def named(print_: tuple[int, int], shared: frozenset[int] = frozenset()) -> int:
    """A class's node: the first half of its fingerprint, or, where another set has the same, a mix of both."""
    if print_[0] not in shared:
        return print_[0]
    a, b = np.array(print_, np.int64).view(np.uint64)
    return int(mix(np.array([mix(a) + b])).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def enough(common, n, m, percent: int):
    """Whether an overlap makes 100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (n + m)


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """A row (id, n, node, check, h) for each document (id, text, h), and rows (token, times) of n-grams that repeat within a chunk."""
    id_type = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "node", "check", "h", "token", "times"]
        held, size, seen = [], 0, set()
        schema = None

        def close() -> Iterator[pa.RecordBatch]:
            token, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, times = token[times > 1].view(np.int64), times[times > 1]
            held.clear()
            for at in range(0, len(token), 1 << 16):
                part = slice(at, at + (1 << 16))
                none = [pa.nulls(len(token[part]), schema.field(k).type) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*none, pa.array(token[part]), pa.array(times[part])], schema=schema)

        for batch in by_bytes(batches, "text", SLICE_BYTES):
            sets = token_sets(batch.column("text"), width)
            prints = np.array([fingerprint(x) for x in sets], np.int64).reshape(-1, 2)
            n = len(sets)
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), batch.column("h"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            schema = out.schema
            yield out
            for x, node in zip(sets, prints[:, 0].tolist(), strict=True):
                if len(x) and node not in seen:
                    seen.add(node)
                    held.append(x)
                    size += len(x)
            if size >= CHUNK:
                yield from close()
                size, seen = 0, set()
        if schema is not None:
            yield from close()

    return docs.mapInArrow(run, f"id {id_type.simpleString()}, n long, node long, check long, h long, token long, times long")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-grams, each one's rank (which grows with its count) and number of cells: at most LISTED entries."""
    counts = counts.groupBy("token").agg(F.sum("times").alias("times"))
    # powers of 2^(1/4) keep this histogram to a few hundred rows
    level = F.floor(4 * F.log2("times")).cast("int")
    least, total = 1 << 20, 0
    for k, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if total + n > LISTED:
            break
        least, total = k, total + n
    found = counts.where(level >= least).toArrow()
    token, times = found.column("token").to_numpy().view(np.uint64), found.column("times").to_numpy()
    order = np.argsort(token)
    token, times = token[order], times[order]
    return token, np.minimum(np.floor(4 * np.log2(np.maximum(times, 1))), 255).astype(np.uint8), np.minimum(1 + times // CELL_ROWS, 65535).astype(np.int32)


def _alike(sized: DataFrame) -> frozenset[int]:
    """First halves of fingerprints that different sets have in common: some n * n / 2^65 of n sets, so nearly always none."""
    return frozenset(r[0] for r in sized.where("n > 0").groupBy("node").agg((F.min("check") < F.max("check")).alias("alike")).where("alike").select("node").collect())


def _prefixes(docs: DataFrame, width: int, percent: int, ranks, alike: frozenset[int]) -> DataFrame:
    """Rows (token, cell, cells, node, n, at): each class's prefix, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, rank, cells = (np.append(x, x.dtype.type(y)) for x, y in zip(ranks.value, (2**64 - 1, 0, 1), strict=True))
        seen: set[int] = set()
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            tokens, splits, nodes, sizes, places = [], [], [], [], []
            for x in token_sets(batch.column("text"), width):
                if not len(x):
                    continue
                node = named(fingerprint(x), alike)
                if node in seen:
                    continue
                seen.add(node)
                p = prefix_length(len(x), percent)
                k = np.searchsorted(listed, x)
                k[listed[k] != x] = len(rank) - 1
                order = np.argsort((rank[k].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8)), kind="stable")[:p]
                tokens.append(x[order])
                splits.append(cells[k[order]])
                nodes.append(node)
                sizes.append(len(x))
                places.append(p)
            if not tokens:
                continue
            token, repeat = np.concatenate(tokens), np.array(places)
            node, n = np.repeat(np.array(nodes, np.int64), repeat), np.repeat(np.array(sizes, np.int32), repeat)
            at = (np.arange(len(token)) - np.repeat(np.cumsum(repeat) - repeat, repeat)).astype(np.int32)
            split = np.concatenate(splits)
            cell = (mix(node.view(np.uint64)) % split.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (token.view(np.int64), cell, split, node, n, at))], ["token", "cell", "cells", "node", "n", "at"])

    return docs.mapInArrow(run, "token long, cell int, cells int, node long, n int, at int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal keys in a sorted stream, and the first row of each run (and one entry more)."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: _signatures(batch.column(c)) if c == "slots" else batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        rows = new if rest is None else {c: np.concatenate([rest[c], x]) for c, x in new.items()}
        edge = np.zeros(len(rows[keys[0]]) - 1, bool)
        for k in keys:
            edge |= rows[k][1:] != rows[k][:-1]
        first = np.flatnonzero(edge) + 1
        if len(first):
            yield {c: x[: first[-1]] for c, x in rows.items()}, np.concatenate([[0], first])
            rest = {c: x[first[-1] :] for c, x in rows.items()}
        else:
            rest = rows
    if rest is not None:
        yield rest, np.array([0, len(rest[keys[0]])])


def _shared(prefixes: DataFrame, percent: int) -> DataFrame:
    """Prefix rows that pass the length and positional filters with another row of their cell, or whose n-gram is split
    into cells; each class once. An n-gram that the table of frequent ones lacks is split here if it has many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "cell", "cells", "node", "n", "at", "many"]
        for rows, first in _groups(batches, ["token", "cell"]):
            fresh = np.ones(len(rows["token"]), bool)
            fresh[1:] = (rows["node"][1:] != rows["node"][:-1]) | (rows["token"][1:] != rows["token"][:-1])
            size = np.add.reduceat(fresh.astype(np.int64), first[:-1])
            rows["cells"] = np.where(rows["cells"] > 1, rows["cells"], np.minimum(1 + np.repeat(size, np.diff(first)) // CELL_ROWS, 65535)).astype(np.int32)
            keep = fresh & ((np.repeat(size, np.diff(first)) > 1) | (rows["cells"] > 1))
            rows |= {"many": (np.repeat(size, np.diff(first)) >= MANY) | (rows["cells"] > 1), "root": rows["node"]}
            rows = {c: x[keep] for c, x in rows.items()}
            if not keep.any():
                continue
            edge = np.flatnonzero((rows["token"][1:] != rows["token"][:-1]) | (rows["cell"][1:] != rows["cell"][:-1])) + 1
            end = np.repeat(np.append(edge, keep.sum()), np.diff(np.concatenate([[0], edge, [keep.sum()]])))
            place = np.arange(len(end))
            met = rows["cells"] > 1
            step = 1
            while not met.all() and len(x := np.flatnonzero(place + step < end)):
                x = x[~(met[x] & met[x + step])]
                good = x[_pairs(rows, x, x + step, percent)]
                met[good] = met[good + step] = True
                step += 1
            if met.any():
                rows["cell"] = (mix(rows["node"].view(np.uint64)) % rows["cells"].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][met]) for c in names], names)

    return prefixes.repartition("token", "cell").sortWithinPartitions("token", "cell", "node").mapInArrow(run, "token long, cell int, cells int, node long, n int, at int, many boolean")


def signature(x: np.ndarray) -> bytes:
    return np.bincount((x & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint8).tobytes()


def _signatures(column: pa.Array) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, SLOTS)


def _near(slots: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of signatures differ by `most` at most; counts are modulo 256, and so are their differences."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 8192):
        part = slice(at, at + 8192)
        gap = slots[x[part]] - slots[y[part]]
        out[part] = np.minimum(gap, -gap).sum(axis=1, dtype=np.int64) <= most[part]
    return out


def _pairs(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows lie in different components and pass the length and positional filters."""
    n, m = rows["n"][x].astype(np.int64), rows["n"][y].astype(np.int64)
    left = np.minimum(n - rows["at"][x], m - rows["at"][y])
    good = (rows["root"][x] != rows["root"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & enough(left, n, m, percent)
    if "slots" in rows:
        k = np.flatnonzero(good)
        total = (n + m)[k]
        good[k] = _near(rows["slots"], x[k], y[k], total - 2 * -(-percent * total // (100 + percent)))
    return good


def _emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        for at in range(0, len(pairs), 1 << 16):
            part = pairs[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, k]) for k in range(part.shape[1])], ["a", "b", "low", "high"][: part.shape[1]])


def _pivot_pairs(rows: DataFrame, keys: list[str], seed: int, percent: int) -> DataFrame:
    """Candidates (a, b), a the pivot: a cell's rows against its PIVOTS rows of least keyed hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _groups(batches, keys):
            size = np.diff(first)
            cell = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((mix(rows["node"].view(np.uint64) ^ np.uint64(seed)), cell))
            place = np.arange(len(cell)) - np.repeat(first[:-1], size)
            found = []
            for k in range(PIVOTS):
                own = np.flatnonzero(place > k)
                x, y = order[first[:-1][cell[own]] + k], order[own]
                keep = _pairs(rows, x, y, percent)
                found.append(np.stack([rows["node"][x[keep]], rows["node"][y[keep]]], 1))
            yield from _emit([f for f in found if len(f)])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _few(found: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """ROOT_PAIRS at most of the rows (a, b, low, high) of any two components low and high, by a keyed hash of the pair."""
    x = np.unique(np.concatenate(found), axis=0)
    lot = mix(mix(x[:, 0].view(np.uint64) ^ np.uint64(seed)) + x[:, 1].view(np.uint64))
    x = x[np.lexsort((lot, x[:, 3], x[:, 2]))]
    first = np.flatnonzero(np.append(True, (x[1:, 2:] != x[:-1, 2:]).any(axis=1)))
    return [x[np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < ROOT_PAIRS]]


def _all_pairs(rows: DataFrame, percent: int, seed: int | None = None) -> DataFrame:
    """Candidates (a, b), a < b: every pair of an n-gram's rows, cells of a split n-gram meeting two by two. With a seed, rows
    (a, b, low, high) of a few of them for any two components low and high, ROOT_PAIRS from each task's stretch of rows."""
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    met = rows.withColumn("other", other).withColumns({"low": F.least("cell", "other"), "high": F.greatest("cell", "other")}).drop("other", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _groups(batches, ["token", "low", "high"]):
            end = np.repeat(first[1:], np.diff(first))
            found, held = [], 0
            for step in range(1, int(np.diff(first).max())):
                x = np.flatnonzero(np.arange(len(end)) + step < end)
                y = x + step
                keep = _pairs(rows, x, y, percent) & ((rows["low"][x] == rows["high"][x]) | (rows["cell"][x] != rows["cell"][y]))
                a, b = rows["node"][x[keep]], rows["node"][y[keep]]
                if len(a):
                    ends = [np.minimum(a, b), np.maximum(a, b)]
                    if seed is not None:
                        a, b = rows["root"][x[keep]], rows["root"][y[keep]]
                        ends += [np.minimum(a, b), np.maximum(a, b)]
                    found.append(np.stack(ends, 1))
                    held += len(a)
                if held > 1 << 20:
                    found = found if seed is None else _few(found, seed)
                    held = 0 if seed is None else len(found[0])
                    if held == 0 or held > 1 << 19:
                        yield from _emit(found)
                        found, held = [], 0
            yield from _emit(found if seed is None or not found else _few(found, seed))

    keys = ["token", "low", "high"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long" + (", low long, high long" if seed is not None else ""))


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int, alike: frozenset[int]) -> DataFrame:
    """Rows (node, n, tokens, slots): sorted n-grams and signatures of the classes in nodes, and of few others.

    The broadcast is a bitmap of 2^26 bits, 8 MB at any size; where it fills up, more sets than needed are kept."""
    slot = F.shiftrightunsigned("node", 38)
    bits = nodes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # at most 2048 rows of 4 KB
    held = np.zeros((2049, 4096), np.uint8)
    for k, b in bits:
        held[k] = np.frombuffer(b, np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        seen: set[int] = set()
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            out = []
            for x in token_sets(batch.column("text"), width):
                node = named(fingerprint(x), alike) if len(x) else 0
                s = (node & (1 << 64) - 1) >> 38
                bucket, place = _bit(s)
                if len(x) and node not in seen and bitmap[bucket, place >> 3] >> (place & 7) & 1:
                    seen.add(node)
                    out.append((node, len(x), x.tobytes(), signature(x)))
            if out:
                a, n, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["node", "n", "tokens", "slots"])

    return docs.mapInArrow(run, "node long, n long, tokens binary, slots binary")


def _bucketed(df: DataFrame, key: str, buckets: int, folder: str, name: str) -> DataFrame:
    """The rows with one row per key, as a table of the shared folder bucketed by key: what joins on it stays where it is."""
    df.repartition(buckets, key).dropDuplicates([key]).write.bucketBy(buckets, key).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


def _screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow a link; signatures are a thirtieth of a common set and travel in its stead."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("slots").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("slots").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            k = np.arange(batch.num_rows)
            slots = np.concatenate([_signatures(batch.column("x")), _signatures(batch.column("y"))])
            good = _near(slots, k, k + len(k), total - 2 * -(-percent * total // (100 + percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _bit(value: int) -> tuple[int, int]:
    """Bucket and place of a value that is not negative, as bitmap_bucket_number and bitmap_bit_position have them."""
    return (1 + (value - 1) // 32768, (value - 1) % 32768) if value > 0 else (0, 0)


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of the symmetric difference, by halving around a pivot; over `most` as soon as it is known to be."""
    bound = abs(len(x) - len(y))
    if not depth or bound > most or not len(x) or not len(y):
        return bound
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    left = _apart(x[:i], y[:j], most - abs((len(x) - i) - (len(y) - j)), depth - 1)
    if left + abs((len(x) - i) - (len(y) - j)) > most:
        return most + 1
    return left + _apart(x[i:], y[j:], most - left, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the Jaccard threshold: suffix filter, then the intersection."""
    n, m = len(x), len(y)
    least = -(-percent * (n + m) // (100 + percent))
    if _apart(x, y, n + m - 2 * least, SUFFIX_DEPTH) > n + m - 2 * least:
        return False
    at = np.searchsorted(x, y)
    return bool(enough(int((x[np.minimum(at, n - 1)] == y).sum()), n, m, percent))


def _requests(pairs: DataFrame) -> DataFrame:
    """Rows (node, a, copy, b): which set goes where. A pair's second set travels to its first, which goes there once (b
    null); a set with very many pairs goes to several places."""
    copies = (1 + F.floor((F.col("times") - 1) / PAIRS_PER_COPY)).cast("int")
    firsts = pairs.groupBy("a").agg(F.count("*").alias("times")).select("a", copies.alias("copies"))
    seconds = pairs.join(firsts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"), "b")
    heads = firsts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("b"))
    return seconds.unionByName(heads)


def _verified(requests: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links. Sets are shuffled once, and not at all where the requests are few enough to broadcast."""
    moved = requests.join(sets.select("node", "tokens"), "node").drop("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = None, None
        for batch in batches:
            out = []
            tokens = batch.column("tokens")
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                y = np.frombuffer(tokens[k].as_buffer(), np.uint64)
                if b is None:
                    own, x = a, y.copy()
                elif own == a and linked(x, y, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return moved.repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _kept(df: DataFrame, folder: str) -> DataFrame:
    """The rows, written to the shared folder and read back."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ngram_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, n_shingles, group, component_id), one per document: h is xxhash64 of the text, group a number that the rows
    of a component share and no others do, null where there are no n-grams. See ngram_join."""
    spark = ready(docs.sparkSession)
    folder, work = shared_folder(spark, "ngram-join"), shared_folder(spark, "ngram-join-work")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    described = _kept(_describe(rows.withColumn("h", F.xxhash64("text")), width), f"{folder}/documents")
    sized = described.where("token is null").select("id", "n", "node", "check", "h")
    alike = _alike(sized)
    if alike:
        sized = sized.withColumn("node", F.udf(lambda a, b: named((a, b), alike), "long")("node", "check"))
    name = f"ngram_join_{uuid.uuid4().hex}"
    try:
        roots = _roots(rows, described, width, percent, alike, folder, work, name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(work)

    classes = sized.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    if roots is not None:
        classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        tops = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
        classes = classes.join(tops, "root").select("node", "root", "component")
    else:
        classes = classes.select("node", F.col("node").alias("root"), F.col("least").alias("component"))
    out = sized.join(classes.withColumnRenamed("node", "class"), (F.col("node") == F.col("class")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), "h", F.col("n").alias("n_shingles"), F.col("root").alias("group"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id), one per document.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of `width` words, or the
    whole sequence of fewer words. Sets link at 100 * intersection >= percent * union; a component's id is the least id
    in it. Documents without words (or with a null text) have no n-grams and are their own component. Equal sets (by 128
    bits of fingerprint) are one class at any count, repeated rows included. A null id is never a component's id unless
    its component has no other, and then the component is null. Other columns are not read; an empty table gives no rows.
    """
    return ngram_groups(docs, width, percent, id_col, text_col).select(id_col, "n_shingles", "component_id")


def _roots(rows: DataFrame, described: DataFrame, width: int, percent: int, alike: frozenset[int], folder: str, work: str, name: str) -> DataFrame | None:
    """Rows (node, root) of all classes that have a link, in `folder`; None if there are none. `work` holds what is met on the way."""
    spark = rows.sparkSession
    ranks = spark.sparkContext.broadcast(_frequent(described.where("token is not null").select("token", "times")))
    shared = _kept(_shared(_prefixes(rows, width, percent, ranks, alike), percent), f"{work}/shared")
    bytes_ = 8 * (described.agg(F.sum("n")).first()[0] or 0)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES))
    sets = _bucketed(_sets_of(rows, shared.select("node").distinct(), width, alike), "node", buckets, f"{work}/sets", name)

    tried = roots = None
    last = PIVOT_ROUNDS + ROOT_ROUNDS
    for turn in range(last + 1):
        now = shared.withColumn("root", F.col("node")) if roots is None else shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if roots is not None:
            open_ = now.groupBy("token").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("token")
            now = now.join(open_, "token", "left_semi")
        if turn and turn < PIVOT_ROUNDS:
            now = now.where("cells > 1")
        few, many = now.where("not many").drop("many"), now.where("many").drop("many").join(sets.select("node", "slots"), "node")
        if turn == last:
            pairs = _all_pairs(few, percent).union(_all_pairs(many, percent))
        elif turn >= PIVOT_ROUNDS:
            pairs = _all_pairs(few, percent, turn).union(_all_pairs(many, percent, turn)).dropDuplicates(["a", "b"])
            place = F.row_number().over(Window.partitionBy("low", "high").orderBy(F.xxhash64("a", "b", F.lit(turn))))
            pairs = pairs.withColumn("place", place).where(F.col("place") <= ROOT_PAIRS).select("a", "b")
        elif turn:  # cells of a split n-gram send a member of each component; others have met already
            one = F.min_by(F.struct("node", "n", "at", "slots"), F.xxhash64("node", F.lit(turn)))
            split = many.groupBy("token", "cell", "cells", "root").agg(one.alias("x")).select("token", "cell", "cells", "root", "x.*")
            pairs = _pivot_pairs(split, ["token"], turn, percent)
        else:
            pairs = _pivot_pairs(few, ["token", "cell"], turn, percent).union(_pivot_pairs(many, ["token", "cell"], turn, percent))
        if tried is not None:
            pairs = pairs.join(tried, (F.least(pairs.a, pairs.b) == tried.low) & (F.greatest(pairs.a, pairs.b) == tried.high), "left_anti")
        pairs = _kept(pairs.dropDuplicates(["a", "b"]), f"{work}/pairs-{turn}")
        if pairs.isEmpty():
            continue
        near = _kept(_screened(pairs, sets, percent), f"{work}/near-{turn}")
        requests = _kept(_requests(near), f"{work}/requests-{turn}")
        links = _kept(_verified(requests, sets, percent), f"{work}/links-{turn}")
        done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        tried = done if tried is None else tried.unionByName(done)
        if not links.isEmpty():  # a node and its root are as good as all links before
            links = links if roots is None else links.unionByName(roots.toDF("a", "b"))
            roots = _kept(connected_components(links), f"{folder}/roots-{turn}")
    return roots
