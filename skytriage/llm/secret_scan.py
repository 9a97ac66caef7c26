"""Secret scans by a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean query of trigrams is derived that every match must satisfy. Postings
(trigram, block of documents -> document ids) are built for the trigrams that the queries name, intersected and united
as each query says, and only the documents found are verified against the rule. Rules without a mandatory trigram scan
all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Documents in a block of postings; bounds a posting list.
BLOCK_ROWS = 4096
#: Strings that a run of a regular expression may stand for before it is closed.
_MOST = 64
#: Matches that are folded together, characters of a text's block.
CHUNK, BLOCK_CHARS = 128, 1024
_SPANS = "array<struct<start:int,k:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters. Patterns mean the same to Python and Java."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds and patterns of the base, in the order that spans of one start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the scan adds: formats that carry their own mark.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

Query = frozenset[frozenset[str]]  # any of these sets, each with all of its trigrams; a set without any: all documents
_ALL: Query = frozenset([frozenset()])


def _least(query: set[frozenset[str]]) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    out = _least({x | y for x, y in product(a, b)})
    return out if len(out) <= _MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that the items stand for, if few, and a query that each match satisfies. Letters are folded to lower case."""
    query, run, exact = _ALL, {""}, True

    def close() -> None:
        nonlocal query, run
        query, run = _both(query, _of_strings(run)), {""}

    for op, arg in items:
        own: set[str] | None = None
        inner = _ALL
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            own = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            own, inner = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            own = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            inner = _least(set().union(*(q if s is None else _of_strings(s) for s, q in parts)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            strings, q = _walk(sub)
            if (low, high) == (0, 1) and strings is not None:
                own = strings | {""}
            elif low == high and strings is not None and len(strings) ** low <= _MOST:
                own = {"".join(x) for x in product(strings, repeat=low)}
            elif low:
                inner = q if strings is None else _of_strings(strings)
        elif op is C.AT:
            own = {""}
        if own is not None and len(own) * len(run) <= _MOST:
            run = {a + b for a, b in product(run, own)}
            continue
        close()
        exact = False
        if own is not None and len(own) <= _MOST:
            run = own
        else:
            query = _both(query, inner)
    if exact:
        return run, _of_strings(run)
    close()
    return None, query


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams of which any text with a match has one set whole, in any case of letters."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame | None:
    """Rows (id, rules): the rules that may match in some text of that id; None if no rule has a mandatory trigram."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != _ALL}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    if not grams:
        return None
    id_type = docs.schema[id_col].dataType.simpleString()
    folded = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col]).alias("folded"))
    present = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams)))
    rows = folded.select("id", F.explode(present).alias("gram"))
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    postings = rows.groupBy("gram", block).agg(F.collect_set(F.struct("id")).alias("ids"))
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("index"))
    none = F.array().cast(f"array<struct<id:{id_type}>>")
    listed = lambda g: F.coalesce(F.try_element_at("index", F.lit(g)), none)
    found = [F.struct(F.lit(kind).alias("rule"), reduce(F.array_union, [reduce(F.array_intersect, map(listed, sorted(s))) for s in sorted(query, key=sorted)]).alias("ids")) for kind, query in queries.items()]
    pairs = index.select(F.explode(F.array(*found)).alias("x")).select("x.rule", F.explode("x.ids").alias("doc"))
    return pairs.groupBy(F.col("doc.id").alias("_id")).agg(F.collect_set("rule").alias("_rules"))


def _chunks(values: Column) -> Column:
    """Slices of CHUNK entries, so that a fold that grows an array copies CHUNK entries at most for each one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, CHUNK))


def _folded(pieces: str, k: int, least: int) -> Column:
    """Of each chunk of pieces: its length, and its spans from its own begin on."""
    none = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(k).alias("k"), (start + x["m"]).alias("end"))
        return F.struct((start + F.coalesce(x["m"], F.lit(0))).alias("at"), F.when(x["g"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    fold = F.transform(_chunks(F.col(pieces)), lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
    return F.when(F.col(pieces).isNotNull(), fold)


def _moved(folded: str, bases: str) -> Column:
    """The chunks' spans from the text's begin on."""
    none = F.array().cast(_SPANS)
    move = lambda b: lambda x: F.struct((x["start"] + b).alias("start"), x["k"].alias("k"), (x["end"] + b).alias("end"))
    moved = F.zip_with(folded, bases, lambda c, b: F.when(c.isNotNull(), F.transform(c["spans"], move(b))).otherwise(none))
    return F.coalesce(F.flatten(moved), none)


def _with_spans(df: DataFrame, text: Column, wanted: dict[int, Column], rules: tuple[Rule, ...]) -> DataFrame:
    """df with columns `_s<k>`: array<struct<start, k, end>> of rule k's matches where `wanted` says so, in code points, by
    the lengths of what lies between them. Lengths add up chunk by chunk, then from chunk to chunk."""
    pieces, folded, bases, out = {}, {}, {}, {}
    for k, when in wanted.items():
        pattern = F.lit(rules[k].pattern)
        found = F.arrays_zip(
            F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("m"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(rules[k].group)), F.char_length).alias("g"),
            F.transform(F.split(text, rules[k].pattern, -1), F.char_length).alias("gap"),
        )
        pieces[f"_p{k}"] = F.when(when & F.rlike(text, pattern), found)
        folded[f"_f{k}"] = _folded(f"_p{k}", k, rules[k].least)
        bases[f"_b{k}"] = F.when(F.size(f"_f{k}") > 0, F.aggregate(f"_f{k}", F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"]))))
        out[f"_s{k}"] = _moved(f"_f{k}", f"_b{k}")
    # a column for each step, so that none is computed again inside another's loop
    for columns in (pieces, folded, bases, out):
        df = df.withColumns(columns)
    return df.drop(*pieces, *folded, *bases)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column `_spans`: array<array<struct<start, k, end>>>, one array per rule, k its place in rules."""
    ready(docs.sparkSession)
    found = candidates(docs, rules, id_col, text_col)
    free = {r.kind for r in rules if trigram_query(r.pattern) == _ALL}
    docs = docs.join(found, docs[id_col].eqNullSafe(F.col("_id")), "left") if found is not None else docs.withColumns({"_id": F.lit(None), "_rules": F.lit(None).cast("array<string>")})
    wanted = {k: F.lit(True) if r.kind in free else F.coalesce(F.array_contains("_rules", F.lit(r.kind)), F.lit(False)) for k, r in enumerate(rules)}
    docs = _with_spans(docs, F.col(text_col), wanted, rules)
    each = [f"_s{k}" for k in range(len(rules))]
    return docs.withColumn("_spans", F.array(*each)).drop("_id", "_rules", *each)


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(F.flatten(spans)), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, base_sha256, spans), one per document; spans are kind:start:end in code points.

    A null or empty text has no spans. Each row is scanned whole and by itself: repeated rows and null ids give a row
    each (candidates are found by id, so rows of one id are verified together); other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = scan(rows, RULES, "id", "text").select("id", "_spans")
    base = F.slice("_spans", 1, len(BASE))
    counts = [F.size(F.element_at("_spans", k + 1)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("_spans"), RULES).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span, or run of overlapping spans, in text_col put as [kind] of its first; other columns as they are.

    Null texts stay null, texts without spans unchanged. Spans are walked chunk by chunk, each from the furthest end before
    it, and what stays of a text is taken from blocks of BLOCK_CHARS characters."""
    names = F.array(*(F.lit(r.kind) for r in RULES))
    columns = docs.columns  # renamed by place, so that none can clash with the scan's own
    id_at, text_at = (f"_in{columns.index(c)}" for c in (id_col, text_col))
    whole = scan(docs.toDF(*(f"_in{k}" for k in range(len(columns)))), RULES, id_at, text_at).withColumn("_spans", F.array_sort(F.flatten("_spans")))
    text, some = F.col(text_at), F.size("_spans") > 0
    whole = whole.withColumn("_spans", F.when(some, F.col("_spans")))
    whole = whole.withColumns({"_chunks": _chunks(F.col("_spans")), "_blocks": F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)))})
    furthest = F.transform("_chunks", lambda c: F.array_max(F.transform(c, lambda x: x["end"])))
    whole = whole.withColumn("_ends", F.aggregate(furthest, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e)))))
    none = F.array().cast("array<struct<low:int,high:int,k:int>>")
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] < acc["at"], acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(F.struct(acc["at"].alias("low"), x["start"].alias("high"), x["k"].alias("k"))))).alias("cuts"),
    )
    cuts = F.zip_with("_chunks", "_ends", lambda c, at: F.when(c.isNotNull(), F.aggregate(c, F.struct(at.alias("at"), none.alias("cuts")), step, lambda acc: acc["cuts"])).otherwise(none))
    # `at` of a chunk may lie inside a span of one before, which a cut's `low` then is the end of: what is kept starts there
    whole = whole.withColumn("_cuts", F.flatten(cuts))

    def part(low: Column, high: Column) -> Column:
        a, b = F.floor(low / BLOCK_CHARS).cast("int"), F.floor((high - 1) / BLOCK_CHARS).cast("int")
        block = lambda i: F.get("_blocks", i)
        inside = F.substring(block(a), low - a * BLOCK_CHARS + 1, high - low)
        across = F.concat(F.substring(block(a), low - a * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)), F.array_join(F.slice("_blocks", a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(block(b), F.lit(1), high - b * BLOCK_CHARS))
        return F.when(high <= low, F.lit("")).when(a == b, inside).otherwise(across)

    pieces = F.transform("_cuts", lambda c: F.concat(part(c["low"], c["high"]), F.lit("["), F.element_at(names, c["k"] + 1), F.lit("]")))
    clean = F.concat(F.array_join(pieces, ""), part(F.element_at("_ends", -1), F.char_length(text)))
    return whole.withColumn(text_at, F.when(F.col("_spans").isNotNull(), clean).otherwise(text)).drop("_spans", "_chunks", "_blocks", "_ends", "_cuts").toDF(*columns)


def matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """The rule's spans in one text, as Python's own library finds them; what tests hold the scan against."""
    return [m.span() for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
