"""Shards of near-equal bytes by sampled splitters, with DataFrame operations only.

Rows are sampled with a chance in proportion to their size; the sample's weighted quantiles are splitters that cut the
key into ranges; ranges found overfull are cut again at sampled keys, and those that a single key fills are dealt out by
row. A range is worked on in cells of CELL_ROWS rows or so, dealt by row. Each cell is ordered by itself, and the cells'
exact totals place every row on one line of bytes, which the shards cut at equal distances. No cell grows with the
table or its skew, and only totals by range and by shard reach the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, shared_folder

#: Rows of a cell at about; fewest and most ranges, expected samples of a range, times the mean beyond which a range is
#: overfull, rounds of cutting at sampled keys.
CELL_ROWS, FEWEST, MOST, SAMPLES, OVERFULL, ROUNDS = 200_000, 192, 1024, 64, 1.5, 2
_GRAIN = 1 << 30


def _cuts(sample: list[tuple], n: int) -> list:
    """At most n - 1 keys that cut a sorted (key, weight) sample into n parts of even weight."""
    ends = list(accumulate(w for _, w in sample))
    marks = [bisect_right(ends, ends[-1] * i / n) for i in range(1, n)] if sample else []
    return sorted({sample[min(m, len(sample) - 1)][0] for m in marks} - {sample[0][0]} if sample else ())


def _range_of(key: Column, cuts: list, low: int = 0) -> Column:
    """Number of cuts at or below key, as a balanced tree of comparisons; nulls come first."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(key >= F.lit(cuts[mid]), _range_of(key, cuts[mid + 1 :], low + mid + 1)).otherwise(_range_of(key, cuts[:mid], low))


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard), one per document; the law is `bytes`.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of nothing (0). Shards are runs of
    the order (cell, id, row) that end nearest to equal shares of all bytes. Null ids come first; repeated rows and ids
    are placed row by row, whatever share of the table has one id. Fewer rows than shards leave shards empty; an empty
    table gives no rows. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    text = docs[text_col]
    sizes = docs.select(docs[id_col].alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"), F.monotonically_increasing_id().alias("row"))
    folder = shared_folder(spark, "sharding")
    sizes.write.parquet(folder)  # texts are read once; row numbers hold from here on
    sizes = spark.read.parquet(folder)
    total, n = sizes.agg(F.sum("size"), F.count("*")).first()
    total, wanted = total or 1, -(-n // CELL_ROWS)
    ranges = max(FEWEST, min(MOST, wanted))
    deal = -(-wanted // ranges) or 1  # cells of a range that is not overfull

    samples = SAMPLES * ranges
    chance = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(_GRAIN)) < F.col("size") * F.lit(samples * _GRAIN / total)
    drawn = sizes.where(chance & F.col("id").isNotNull()).select("id", F.greatest(F.lit(1.0), F.col("size") * F.lit(samples / total))).collect()  # about SAMPLES rows for each range
    sample = sorted((k, w) for k, w in drawn)
    cuts = _cuts(sample, ranges)
    most = OVERFULL * total / ranges
    for left in range(ROUNDS, -1, -1):
        held = {r: (b, m) for r, b, m in sizes.groupBy(_range_of(F.col("id"), cuts).alias("range")).agg(F.sum("size"), F.count("*")).collect()}
        over = {r: int(b // most) + 1 for r, (b, _) in held.items() if b > most}
        edges = [None, *cuts, None]
        inside = {r: [x for x in sample if (edges[r] is None or x[0] >= edges[r]) and (edges[r + 1] is None or x[0] < edges[r + 1])] for r in over} if left else {}
        new = sorted({*cuts, *(c for r, x in inside.items() for c in _cuts(x, over[r]))})
        if new == cuts:
            break
        cuts = new

    parts = [max(over.get(r, 1), deal, -(-held.get(r, (0, 0))[1] // (2 * CELL_ROWS))) for r in range(len(cuts) + 1)]
    first = [0, *accumulate(parts)]
    placed = sizes.withColumn("range", _range_of(F.col("id"), cuts))
    cell = (_pick(first[:-1], F.col("range")) + F.pmod(F.xxhash64("row"), _pick(parts, F.col("range")))).cast("int")
    placed = placed.withColumn("cell", cell).drop("range")
    up = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    base = placed.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("m"))
    base = base.select("cell", F.coalesce(F.sum("b").over(up), F.lit(0)).alias("base_bytes"), F.coalesce(F.sum("m").over(up), F.lit(0)).alias("base_rows"))

    w = Window.partitionBy("cell").orderBy("id", "row")
    before = F.col("base_bytes") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rank = F.col("base_rows") + F.row_number().over(w) - 1
    lined = placed.join(F.broadcast(base), "cell").select("id", "size", "crc", before.cast("long").alias("before"), rank.cast("long").alias("rank"))
    middle = (2 * F.col("before") + F.col("size")) * F.lit(shards)
    lined = lined.select("*", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * total))).cast("int").alias("shard"))
    counts = dict(lined.groupBy("shard").count().collect())
    start = [0, *accumulate(counts.get(s, 0) for s in range(shards))][:-1]
    return lined.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - _pick(start, F.col("shard"))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
