"""Source divergence audit: how far the words of each source of a language lie from those of its other sources and of the language.

Texts are cut into terms and counted by DuckDB where they lie. The counts go to shards by hash of (language, term), where
DuckDB adds them up, keeps the terms of enough documents and writes one row for each kept term with its counts by source.
A second pass over these rows gives, again by DuckDB, partial sums for each two sources and the first terms of each source;
Spark adds the sums and ranks. All arithmetic is on integers.

A sum over all kept terms of f(p, q) is taken apart, so that terms which a source does not hold cost nothing: every term
at first counts as absent from both sources; terms of one source correct this by a histogram of its counts, and terms of both
by a join inside the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import by_bytes, ready, shared_folder

#: Fixed values of the audit: a term, documents of a language that hold a kept one, unit of the shares, ranks of terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, UNIT, RANKS = 3, 1_000_000_000, 200
#: Bytes of texts and rows of counts that DuckDB holds at once; (language, source) groups whose totals tasks hold at once.
SLICE_BYTES, SLICE_ROWS, GROUPS = 4 << 20, 400_000, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _duck():
    """A database in memory, of one thread; it writes no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _query(con, sql: str, **tables: pa.Table) -> pa.Table:
    for name, table in tables.items():
        con.register(name, table)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


_COUNT_SQL = f"""WITH t AS (SELECT lang, source, nr, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM texts),
d AS (SELECT lang, source, term, nr, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM d GROUP BY ALL
UNION ALL SELECT lang, source, NULL, 0, 0 FROM texts GROUP BY ALL"""
_ADD_SQL = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"
_COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by language and source over the whole texts of a task; a row without a term for each group."""
    con = _duck()
    held: list[pa.Table] = []
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        texts = pa.Table.from_batches([batch]).append_column("nr", pa.array(np.arange(batch.num_rows)))
        held.append(_query(con, _COUNT_SQL, texts=texts))
        if sum(t.num_rows for t in held) > SLICE_ROWS:
            held = [_query(con, _ADD_SQL, counts=pa.concat_tables(held))]
            if held[0].num_rows > SLICE_ROWS // 2:  # new terms go on coming: what is there goes out
                yield from held.pop().to_batches(max_chunksize=50_000)
    if held:
        yield from _query(con, _ADD_SQL, counts=pa.concat_tables(held)).to_batches(max_chunksize=50_000)
    con.close()


_KEEP_SQL = """WITH a AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL)
SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts, sum(n)::BIGINT AS total FROM a GROUP BY lang, term HAVING term IS NULL OR sum(docs) >= {least}"""
_TERMS = "lang string, term string, sources array<string>, counts array<long>, total long"


def _kept_terms(least: int):
    """Counts of a shard, in the order of `cell`, to a row for each kept term (and one without a term for each language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        held: list[pa.RecordBatch] = []

        def out(counts: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from _query(con, _KEEP_SQL.format(least=least), counts=counts).to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > SLICE_ROWS:
                rows = pa.Table.from_batches(held)
                cells = rows.column("cell").to_numpy()
                cut = int(np.searchsorted(cells, cells[-1]))  # the last term may go on in the next batch
                yield from out(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))
        con.close()

    return run


_F = "({0} - {1}) * ({0} - {1}) // {1}"
_PAIR_SQL = f"""WITH e AS (SELECT nr, lang, term, total, unnest(sources) AS source, unnest(counts) AS n FROM terms),
p AS (SELECT e.*, g.base, g.lang_size, (1 + {UNIT}::HUGEINT * (n + 1) // g.size)::BIGINT AS p, (1 + {UNIT}::HUGEINT * (total + 1) // g.lang_size)::BIGINT AS q FROM e JOIN groups g USING (lang, source)),
v AS (SELECT lang, source, term, {_F.format('p', 'q')} AS v FROM p WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY v DESC, term) <= {{ranks}})
SELECT 'count' AS part, lang, source, NULL AS item, n, count(*)::DECIMAL(38, 0) AS v FROM p GROUP BY lang, source, n
UNION ALL SELECT 'pair', a.lang, a.source, b.source, NULL, sum({_F.format('a.p', 'b.p')} - {_F.format('a.p', 'b.base')} - {_F.format('a.base', 'b.p')} + {_F.format('a.base', 'b.base')})::DECIMAL(38, 0)
  FROM p a JOIN p b ON a.nr = b.nr AND a.source <> b.source GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, NULL, v::DECIMAL(38, 0) FROM v"""
_PARTS = "part string, lang string, source string, item string, n long, v decimal(38,0)"


def _partial_sums(groups, ranks: int):
    """Kept terms to partial sums of pairs of sources, histograms of counts and each source's first terms; slices by cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.register("groups", pa.Table.from_pylist(groups.value, pa.schema([("lang", pa.string()), ("source", pa.string()), ("size", pa.int64()), ("base", pa.int64()), ("lang_size", pa.int64())])))
        for batch in batches:
            ends = np.cumsum(batch.column("width").to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_ROWS, side="right")))
                terms = pa.Table.from_batches([batch.slice(at, to - at)]).append_column("nr", pa.array(np.arange(to - at)))
                yield from _query(con, _PAIR_SQL.format(ranks=ranks), terms=terms).to_batches(max_chunksize=50_000)
                at = to
        con.close()

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part "pair" has every other source of the language, part "term" the
    first `ranks` terms that the source holds more often than its language.

    Null texts, languages and sources are empty ones. A document is a row, whatever its id; other columns are not read.
    A group without kept terms has pairs like any other, with the shares of a source that holds none of them (value 0
    if the language keeps no term at all), and no terms. Ties go to the item of smaller UTF-8. A language of one source
    has no pairs; an empty table gives no rows. There are as many pairs as the sources of each language have: their
    number is the size of the result, and only totals of GROUPS groups (or of one language) are with the tasks at once."""
    spark = ready(docs.sparkSession)
    text = lambda c, name: F.coalesce(docs[c].cast("string"), F.lit("")).alias(name)
    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    shards = rows.mapInArrow(count_terms, _COUNTS).repartition("lang", "term").withColumn("cell", F.xxhash64("lang", "term")).sortWithinPartitions("cell")
    terms = kept(shards.mapInArrow(_kept_terms(least), _TERMS), "divergence-terms")

    named = terms.where("term is not null")
    held = named.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    whole = named.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    groups = terms.where("term is null").select("lang", F.explode("sources").alias("source")).distinct()
    groups = groups.join(held, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("n", F.lit(0)) + F.coalesce("kept", F.lit(0))).alias("size"), (F.col("lang_n") + F.col("kept")).alias("lang_size"))
    groups = kept(groups.withColumn("base", F.when(F.col("kept") > 0, F.expr(f"1 + {UNIT} div size"))), "divergence-groups")

    blocks = max(1, -(-groups.count() // GROUPS))
    own = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    folder = shared_folder(spark, "divergence-sums")
    for k in range(blocks):
        some = [r.asDict() for r in groups.where("kept > 0").where(own == k).select("lang", "source", "size", "base", "lang_size").collect()]
        known = spark.sparkContext.broadcast(some)
        wide = named.where(own == k).withColumn("width", F.size("sources"))
        wide.mapInArrow(_partial_sums(known, ranks), _PARTS).write.parquet(f"{folder}/block={k}")
    sums = spark.read.schema(_PARTS).parquet(*(f"{folder}/block={k}" for k in range(blocks)))

    a, b = groups.alias("a"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other")).alias("b")
    f = lambda p, q: F.expr(f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))")
    pairs = a.join(b, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * F.when(F.col("kept") > 0, f("base", "other"))).cast("decimal(38,0)").alias("v"))
    one = sums.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("v").alias("m")).join(groups, ["lang", "source"])
    one = one.withColumn("p", F.expr(f"cast(1 + cast({UNIT} as decimal(10,0)) * cast(n + 1 as decimal(20,0)) div cast(size as decimal(20,0)) as long)"))
    one = one.join(b, "lang").where("source <> item")
    forth = one.select("lang", "source", "item", (F.col("m") * (f("p", "other") - f("base", "other"))).cast("decimal(38,0)").alias("v"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (f("other", "p") - f("other", "base"))).cast("decimal(38,0)").alias("v"))
    both = sums.where("part = 'pair'").select("lang", "source", "item", "v")
    pairs = pairs.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("value"))
    best = sums.where("part = 'term'").select("lang", "source", "item", F.col("v").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(best, "term").where(F.col("rank") <= ranks))
