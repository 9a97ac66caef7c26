"""The divergence audit against a dense count in plain Python, on odd tables, small slices and many languages."""

import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa

from skytriage.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, ranks=200):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)), s) for t, g, s in rows if g == lang]
        sources = sorted({s for _, s in own})
        docs = Counter(w for ws, _ in own for w in set(ws))
        kept = {w for w, n in docs.items() if n >= least}
        count = defaultdict(Counter)
        for ws, s in own:
            count[s].update(w for w in ws if w in kept)
        every = sum(count.values(), Counter())
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(share(count[s], w), share(count[o], w)) for w in kept), o) for o in sources if o != s]
            terms = [(f(p, q), w) for w in kept if count[s][w] for p, q in [(share(count[s], w), share(every, w))] if p > q]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < ranks]
    return sorted(out)


def _odd():
    rows = []
    for i in range(60):
        words = [f"w{'abcdefghij'[(i * k) % 10]}x" for k in range(1, 9)] + ["Über", "ünder", "MIX", "mix"] * (i % 3)
        rows.append((i, " ".join(words) + f" 12{i} \x00 alone{'q' * i}", ["en", "de", "en", None][i % 4], ["a", "b", "c", None, "ä", "Z"][(i // 2) % 6]))
    rows += [(5, None, "en", "a"), (5, "", "en", "empty only"), (5, " 1 2 3 ", "none", "one"), (None, "mix mix", "none", "two"), (7, "mix", "fr", "alone")]
    return rows + [(5, "mix wax", "en", "hot")] * 40 + [(1, "tie toe", "xx", s) for s in "abcabc"]


def test_rows(spark, monkeypatch):
    rows = _odd()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", D.F.lit("clash")).withColumn("n", D.F.lit(1))
    want = plain(rows)
    assert sorted(map(tuple, D.audit(docs.repartition(5)).collect())) == want
    assert sorted(map(tuple, D.audit(docs.coalesce(1), least=1, ranks=3).collect())) == plain(rows, 1, 3)
    monkeypatch.setattr(D, "GROUPS", 4)  # languages in blocks
    assert sorted(map(tuple, D.audit(docs).collect())) == want
    assert D.audit(docs.limit(0)).collect() == []
    assert D.audit(docs.where("lang = 'fr'")).collect() == []


def test_slices(monkeypatch):
    """Tiny slices inside a task change no count: texts, shards and kept terms cut anywhere."""
    rows = _odd()
    names = ["doc_id", "text", "lang", "source"]
    batch = pa.RecordBatch.from_pylist([{k: v if v is not None or k == "doc_id" else "" for k, v in zip(names, r, strict=True)} for r in rows]).select(["lang", "source", "text"])
    total = lambda parts: sorted(Counter({}).items()) if not parts else sorted(_sum(parts).items(), key=str)

    def _sum(parts):
        out = Counter()
        for p in parts:
            for r in p.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    whole = list(D.count_terms(iter([batch])))
    monkeypatch.setattr(D, "SLICE_BYTES", 64)
    monkeypatch.setattr(D, "SLICE_ROWS", 50)
    parts = list(D.count_terms(iter([batch.slice(0, 7), batch.slice(7)])))
    assert len(parts) > 1 and total(parts) == total(whole)

    cell = lambda r: hash((r["lang"], r["term"])) & 0xFFFFFFFF
    counts = sorted((dict(r, cell=cell(r)) for p in parts for r in p.to_pylist()), key=lambda r: r["cell"])
    table = pa.Table.from_pylist(counts)
    cut = lambda n: iter(table.to_batches(max_chunksize=n))
    terms = [r for n in (3, 1000) for r in [sorted((str(x) for b in D._kept_terms(3)(cut(n)) for x in b.to_pylist()))]]
    assert terms[0] == terms[1] and terms[0]

    kept = [x for b in D._kept_terms(3)(cut(1000)) for x in b.to_pylist() if x["term"] is not None]
    wide = pa.RecordBatch.from_pylist([dict(x, width=len(x["sources"])) for x in kept], pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("total", pa.int64()), ("width", pa.int32())]))
    groups = SimpleNamespace(value=[{"lang": g, "source": s, "size": 100, "base": 10_000_001, "lang_size": 900} for g, s in sorted({(x["lang"], s) for x in kept for s in x["sources"]})])

    def sums(size):
        monkeypatch.setattr(D, "SLICE_ROWS", size)
        out = Counter()
        for b in D._partial_sums(groups, 200)(iter([wide])):
            for r in b.to_pylist():
                out[r["part"], r["lang"], r["source"], r["item"], r["n"]] += r["v"]
        return out

    assert sums(2) == sums(10**6)
