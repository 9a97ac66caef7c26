"""Approximate nearest neighbours by a forest of hash prefixes.

A row's hash strings are the signs of its vector's products with seeded random directions: TREES strings of BITS bits,
and one more that routes. The table is dealt into shards by ranges of the routing string; a query goes to the shards
whose ranges meet its longest routing prefix that still holds enough neighbours. A shard has TREES sorted arrays of
strings. A query descends to its longest common prefix in every array, then all arrays ascend together, one bit at a
time, until the rows whose prefixes agree in any of them are as many as asked for; only these are scored. The routing
prefix and the share to ask for are fitted to the true neighbours, among all rows, of a bounded sample of queries.
Vectors of different length never meet: each length has its own fit and its own shards.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attempt_name, filesystem, publish, ready, shared_folder

TREES, BITS, SEED = 48, 32, 11
SHARD_ROWS, QUERY_BLOCK = 16384, 128
#: Rows and queries of the sample that is fitted to, recall to reach there by the routing prefix and by the forest, and
#: fewest sample rows that stand for a shard.
FIT_ROWS, FIT_QUERIES, ROUTED, TARGET, WINDOW = 4096, 256, 0.98, 0.95, 64
#: Cosine above which two vectors may be equal; equal ones, which meet in every tree, are left out of the fit.
SAME = 1 - 1e-5


def strings(vectors: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """trees x n hash strings, as unsigned integers whose upper bit is the first."""
    directions = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((trees * BITS, vectors.shape[1]))
    out = np.zeros((trees, len(vectors)), np.uint64)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for at in range(0, len(vectors), 4096):
        signs = (unit(vectors[at : at + 4096]) @ directions.T) > 0
        out[:, at : at + 4096] = (signs.reshape(-1, trees, BITS) * weights).sum(axis=2, dtype=np.uint64).T
    return out


def routes(vectors: np.ndarray) -> np.ndarray:
    """The strings that deal rows into shards."""
    return strings(vectors, 1, SEED + 1)[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Double-precision vectors scaled by their largest component, which keeps squares in range; cosines are unchanged."""
    v = vectors.astype(np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True)


class Forest:
    def __init__(self, vectors: np.ndarray, sorted_: np.ndarray | None = None, perm: np.ndarray | None = None):
        self.vectors = vectors
        if perm is None:
            h = strings(vectors)
            perm = np.argsort(h, axis=1, kind="stable").astype(np.int32)
            sorted_ = np.take_along_axis(h, perm, axis=1)
        self.sorted, self.perm = sorted_, perm

    def candidates(self, own: np.ndarray, least: int) -> np.ndarray:
        """Rows met when `least` different ones have been, own being the query's strings, one per tree."""
        n = len(self.vectors)
        if least >= n:
            return np.arange(n)
        keep = np.arange(BITS + 1, dtype=np.uint64)
        width = np.uint64(1) << (np.uint64(BITS) - keep)  # of the range that shares so many bits
        low = own[:, None] // width * width
        lo = np.stack([np.searchsorted(s, x, side="left") for s, x in zip(self.sorted, low, strict=True)])
        hi = np.stack([np.searchsorted(s, x, side="left") for s, x in zip(self.sorted, low + width, strict=True)])
        total = (hi - lo).sum(axis=0)
        seen = np.zeros(n, bool)
        level = int(np.flatnonzero(total >= least).max())  # no level below can have met so many
        while True:
            order = np.argsort(-(hi - lo)[:, level]) if level else range(TREES)
            for done, t in enumerate(order):
                seen[self.perm[t, lo[t, level] : hi[t, level]]] = True
                if done % 8 == 7 and np.count_nonzero(seen) >= least:
                    return np.flatnonzero(seen)
            if np.count_nonzero(seen) >= least:
                return np.flatnonzero(seen)
            level -= 1


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two vectors, its sums rounded once: the same wherever and beside whatever it is computed."""
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def best(q: np.ndarray, rows: np.ndarray, vectors: np.ndarray, unit32: np.ndarray, ids: list[list[int]], own: int | None, k: int) -> list[tuple[float, int]]:
    """The k nearest (cosine in double precision, id) among rows; ids lists each vector's rows, smallest first."""
    if not len(rows):
        return []
    qu = unit(q[None])[0]
    rough = unit32[rows] @ (qu / np.sqrt(qu @ qu)).astype(np.float32)
    want = k + 1
    while True:
        floor = np.partition(rough, len(rough) - want)[len(rough) - want] - 1e-4 if want < len(rough) else -np.inf
        near = rows[rough >= floor]
        found = sorted((-cosine(v, qu), i) for v, r in zip(unit(vectors[near]), near.tolist(), strict=True) for i in ids[r] if i != own)
        out, met = [], set()
        for s, i in found:
            if i not in met:
                met.add(i)
                out.append((-s, i))
        if len(out) >= k or len(near) == len(rows):
            return out[:k]
        want *= 4


def _scaled(vectors: np.ndarray) -> np.ndarray:
    u = unit(vectors)
    return (u / np.sqrt((u * u).sum(axis=1, keepdims=True))).astype(np.float32)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits of the longest common prefix of strings."""
    return BITS - np.frexp((x ^ y).astype(np.float64))[1]


def fit(sample: np.ndarray, queries: np.ndarray, true: list[np.ndarray], shards: int = 1) -> tuple[int, float]:
    """Bits of the routing prefix, and share of a shard's rows to ask for, from queries and their true neighbours.

    The prefix is the longest that ROUTED of the neighbours share. A neighbour is met when its shard has been ascended to
    the longest prefix that any tree has in common with it; the sample rows of near routes stand for the shard, and those
    met by then are the share it takes. The share is the least that meets TARGET of the neighbours."""
    pairs = [(q, x) for q, own in enumerate(true) for x in own]
    if not pairs or not len(sample):
        return 0, 1.0
    at, near = np.array([q for q, _ in pairs]), np.stack([x for _, x in pairs])
    common = _common(routes(queries)[at], routes(near))
    bits = max(b for b in range(BITS + 1) if (common >= b).mean() >= ROUTED)
    route = routes(sample)
    order = np.argsort(route, kind="stable")
    own, found, rows, place = strings(queries), strings(near), strings(sample[order]), np.searchsorted(route[order], routes(near))
    wide = min(len(sample), max(WINDOW, len(sample) // max(1, shards)))
    needed = np.zeros(len(pairs))
    for q in range(len(queries)):
        if not (mine := np.flatnonzero(at == q)).size:
            continue
        level = _common(own[:, q, None], rows).max(axis=0)
        least = _common(own[:, q, None], found[:, mine]).max(axis=0)
        for k, low in zip(mine, least, strict=True):
            first = min(max(0, place[k] - wide // 2), len(sample) - wide)
            needed[k] = ((level[first : first + wide] >= low).sum() + 1) / (wide + 1)
    return bits, float(np.sort(needed)[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))])


def true_neighbours(vectors: np.ndarray, queries: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cosines (queries x k) and rows (queries x k x length) of the nearest of vectors, and of `best` before; vectors that
    equal the query are left out. Where there are fewer, the cosine is -inf."""
    score, rows = best or (np.full((len(queries), k), -np.inf), np.zeros((len(queries), k, queries.shape[1])))
    q = _scaled(queries)
    for at in range(0, len(vectors), 8192):
        part = vectors[at : at + 8192]
        s = (q @ _scaled(part).T).astype(np.float64)
        like, row = np.nonzero(s > SAME)
        equal = (queries[like] == part[row]).all(axis=1)
        s[like[equal], row[equal]] = -np.inf
        all_ = np.concatenate([score, s], axis=1)
        top = np.argpartition(-all_, k - 1, axis=1)[:, :k] if all_.shape[1] > k else np.tile(np.arange(k), (len(q), 1))
        score = np.take_along_axis(all_, top, axis=1)
        old = top < k
        rows = np.where(old[:, :, None], np.take_along_axis(rows, np.where(old, top, 0)[:, :, None], axis=1), part[np.where(old, 0, top - k)])
    return score, rows


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """Different vectors from about FIT_ROWS of n rows of one length, in an order that says nothing of them."""
    part = rows if n <= FIT_ROWS else rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 24)) < (FIT_ROWS << 24) // n)
    found = part.orderBy(F.xxhash64("id"), "id").limit(2 * FIT_ROWS).toArrow().column("v").combine_chunks()
    own = np.unique(_vectors(found), axis=0) if len(found) else np.zeros((0, 1))
    return own[np.random.default_rng(SEED).permutation(len(own))]


def _fitted(rows: DataFrame, n: int, k: int, shards: int) -> tuple[int, float]:
    """fit() to a bounded sample of n rows of one length; its first rows are queries, which meet all rows once."""
    sample = _sample(rows, n)
    if not len(sample):
        return 0, 1.0
    queries = sample[:FIT_QUERIES].astype(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast(queries)  # FIT_QUERIES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                best = true_neighbours(_vectors(batch.column("v")).astype(np.float64), shared.value, k, best)
        if best is not None:
            q, place = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[0][q, place]), pa.array(list(best[1][q, place]), pa.list_(pa.float64()))], ["q", "s", "v"])

    each = rows.mapInArrow(run, "q int, s double, v array<double>")  # k rows for each query and task
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k)
    true: list[list] = [[] for _ in queries]
    for r in top.select("q", "v").collect():  # FIT_QUERIES * k rows
        true[r.q].append(r.v)
    return fit(sample, queries, [np.array(x) for x in true], shards)


def _fits(rows: DataFrame, k: int) -> dict[int, tuple[int, float]]:
    """Length -> its fit. Lengths of fewer than FIT_ROWS rows beside a longer list are not fitted: without an entry, all rows
    of the length are scored. The one length of a small table is fitted, whatever its rows."""
    counts = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d")
    many = counts.where(F.col("count") >= FIT_ROWS).collect() or counts.limit(1).collect()  # a row for each FIT_ROWS rows at most
    return {r.d: _fitted(rows.where(F.size("v") == r.d), r["count"], k, max(1, -(-r["count"] // SHARD_ROWS))) for r in many}


def _parts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys inside the batches."""
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if b > a:
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", fitted: tuple[int, float] | dict[int, tuple[int, float]] | None = None) -> DataFrame:
    """Rows (query_id, rank, <id>, score): the k nearest found of all rows of `vectors` but the query's own id.

    Score is the cosine in double precision on the original vectors; ties go to the smaller id, at any partitioning.
    Rows whose id or vector is null, and vectors that are empty, zero or hold null or non-finite components take no
    part, as rows or as queries. Vectors are compared with those of their own length. Rows that repeat an id count as
    that id once, with their best score; of equal vectors in a shard the k + 1 smallest different ids stand for all,
    which loses no result. Fewer candidates give fewer rows; an empty table gives none. Other columns are not read.
    A query id of several vectors asks with the least of them. `fitted` (routing bits, share of a shard's rows), for all
    lengths or by length, takes the place of the fit; (0, 1.0) is exact, and so are lengths that a mapping lacks.
    """
    spark = ready(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("v")
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null").where(good)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size,), batch in _parts(batches, ["size"]):
            yield batch.append_column("route", pa.array(routes(_vectors(batch.column("v"))).astype(np.int64)))

    def routed(df: DataFrame) -> DataFrame:
        return df.select("id", "v", F.size("v").alias("size")).mapInArrow(route, f"id long, v array<{kind}>, size int, route long")

    rows = sound(vectors)
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    fits = _fits(rows, k) if fitted is None else fitted
    fit_of = lambda size: fits if isinstance(fits, tuple) else fits.get(size, (0, 1.0))
    folder = shared_folder(spark, "hash-forest")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()

        def close(size: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            all_ids, all_v, route = (np.concatenate([f(b.column(c)) for b in held]) for c, f in (("id", pa.Array.to_numpy), ("v", _vectors), ("route", pa.Array.to_numpy)))
            order = np.argsort(all_ids, kind="stable")
            all_ids, all_v = all_ids[order], all_v[order]
            own, which = np.unique(all_v, axis=0, return_inverse=True)
            order = np.argsort(which, kind="stable")  # by vector, then by id
            which, all_ids = which[order], all_ids[order]
            once = np.ones(len(order), bool)
            once[1:] = (which[1:] != which[:-1]) | (all_ids[1:] != all_ids[:-1])
            which, all_ids = which[once], all_ids[once]
            sizes = np.bincount(which, minlength=len(own))
            place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place <= k
            forest = Forest(own)
            data = io.BytesIO()
            np.savez(data, vectors=own, sorted=forest.sorted, perm=forest.perm, ids=all_ids[keep], sizes=np.minimum(sizes, k + 1))
            publish(f"{folder}/shard-{size}-{shard}.npz", lambda out: out.write(data.getbuffer()), attempt_name())
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([shard], pa.int32()), pa.array([route.min()]), pa.array([route.max()])], ["size", "shard", "least", "most"])

        size, held = None, []
        for (now,), batch in _parts(batches, ["size"]):
            if size not in (None, now):
                yield close(size, held)
                held = []
            size = now
            held.append(batch)
        if held:
            yield close(size, held)

    # equal strings, whatever their number, are cut at a hash of the id
    dealt = routed(rows).withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id())).repartitionByRange(shards, "size", "route", "salt")
    built = dealt.sortWithinPartitions("size").mapInArrow(build, "size int, shard int, least long, most long").collect()  # a row for each SHARD_ROWS rows
    ranges: dict[int, tuple[np.ndarray, ...]] = {}
    for size in {r.size for r in built}:
        own = sorted((r.least, r.most, r.shard) for r in built if r.size == size)  # shards follow each other, so both ends grow
        ranges[size] = tuple(np.array(x) for x in zip(*own, strict=True))
    known = spark.sparkContext.broadcast(ranges)

    asked = sound(queries).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select("id", "v", F.size("v").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every shard whose range meets its prefix, found by two searches."""
        for (size,), batch in _parts(batches, ["size"]):
            if size not in known.value:
                continue
            least, most, shard = known.value[size]
            wide = 1 << (BITS - fit_of(size)[0])
            low = routes(_vectors(batch.column("v"))).astype(np.int64) // wide * wide
            first, last = np.searchsorted(most, low, side="left"), np.searchsorted(least, low + wide, side="left")
            n = np.maximum(last - first, 0)
            for at in range(0, batch.num_rows, 64):  # a query goes to its shards, whose number the prefix bounds
                some = slice(at, at + 64)
                row = np.repeat(np.arange(at, min(at + 64, batch.num_rows)), n[some])
                place = np.concatenate([np.arange(a, a + m) for a, m in zip(first[some], n[some], strict=True)])
                if len(row):
                    yield batch.take(pa.array(row)).append_column("shard", pa.array(shard[place.astype(np.int64)].astype(np.int32)))

    work = asked.mapInArrow(meet, f"id long, v array<{kind}>, size int, block int, shard int")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for key, batch in _parts(batches, ["size", "shard"]):
            if held != key:
                held = key
                fs, path = filesystem(f"{folder}/shard-{key[0]}-{key[1]}.npz")
                with fs.open_input_file(path) as source:
                    data = np.load(io.BytesIO(source.read()))
                forest = Forest(data["vectors"], data["sorted"], data["perm"])
                u = _scaled(forest.vectors)
                ids = [x.tolist() for x in np.split(data["ids"], np.cumsum(data["sizes"])[:-1])]
                least = max(k + 1, int(np.ceil(fit_of(key[0])[1] * len(u))))
            q = _vectors(batch.column("v"))
            own = strings(q)
            found = [(i, r, s) for j, i in enumerate(batch.column("id").to_pylist()) for s, r in best(q[j], forest.candidates(own[:, j], least), forest.vectors, u, ids, i, k)]
            if found:
                a1, a2, a3 = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a1, pa.int64()), pa.array(a2, pa.int64()), pa.array(a3, pa.float64())], ["query_id", "id", "score"])

    tasks = max(1, min(blocks * shards, 1 << 14))
    hits = work.repartition(tasks, "size", "shard", "block").sortWithinPartitions("size", "shard", "block").mapInArrow(search, "query_id long, id long, score double")
    once = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
