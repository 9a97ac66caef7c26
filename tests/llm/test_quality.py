"""Base counts against plain Python, and the classifier's held-out verdicts."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from skytriage.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "a a a a a", "x\ny\nx\n x\nx\n\n\n", "é🙂 #*$ %&|<>\x0b\x0cq", "same line here\nsame line here\r\nsame line here",
    "    w", "w " * 3000, "z" * 400000 + " end " + "q" * 300000, "\n".join(["alpha beta gamma delta"] * 40), "a b c d a b c x b c d",
]


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {}
    for r in runs:
        often[r] = often.get(r, 0) + 1
    cover = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_base_counts(spark):
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = TEXTS + real
    _, n = Q.base_counts(pa.array(texts, pa.string()))
    assert [list(map(int, x)) for x in zip(*n.values(), strict=True)] == [base(t) for t in texts]
    part = pa.array(["skip", *texts], pa.string()).slice(1)
    _, again = Q.base_counts(part)
    assert all((again[k] == n[k]).all() for k in n)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0)], docs.schema)
    out = Q.quality_rules(docs.union(odd).withColumn("kept", docs.lang), labels)
    rows = out.collect()
    assert len(rows) == docs.count() + 3
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id is None or r.doc_id == 10**6)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:200]:
        b = base(text.get(r.doc_id))
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
    good = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(good[r.doc_id], r.kept) for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(k for g, k in judged if g) >= 0.98 * sum(1 for g, _ in judged if g)
    assert sum(k for g, k in judged if not g) <= 0.2 * sum(1 for g, _ in judged if not g)
    assert Q.quality_rules(docs.limit(0), labels).count() == 0
    assert Q.quality_rules(docs, labels.limit(0)).where("kept").count() > 0


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = Q.train(docs, labels)
    accuracy, loss = model.held_out
    assert accuracy > 0.93 and loss < 0.25


def plain_margin(model, text):
    """Margins in plain Python: each run's slot by exact integers, counted, weighed and summed."""
    m64 = (1 << 64) - 1
    shift = 64 - Q.SLOTS.bit_length() + 1
    words = [int(Q.Words(pa.array([x])).hashes[0]) for x in WORD.findall(text)]
    kinds = [[h >> shift for h in words]]
    kinds.append([int(Q.windows(np.array(p, np.uint64), np.array([0, 2]), 2)[0][0]) >> shift for p in zip(words, words[1:], strict=False)])
    for n in (1, 2, 3):
        slots = []
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + (ord(c) + 1) * 0xC2B2AE3D27D4EB4F) & m64
            slots.append((h * 0xFF51AFD7ED558CCD & m64) >> shift)
        kinds.append(slots)
    return model.bias + sum(float(Q.GAIN[k]) * sum(float(model.weights[k][s]) for s in x) / max(len(x), 1) for k, x in enumerate(kinds))


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return Q.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")), [r.text for r in docs.select("text").collect()]


def test_a_text_is_scored_by_itself(fitted):
    """Alone, in reverse and in odd slices: equal bits. A plain scorer agrees."""
    model, texts = fitted
    texts = [x for x in TEXTS if x is None or len(x) < 10**5] + texts
    bits = lambda part: Q.judge(model, pa.array(part, pa.string()))[2].tolist()
    whole = bits(texts)
    assert [p for t in texts for p in bits([t])] == whole
    assert bits(texts[::-1])[::-1] == whole
    cuts = [0, 1, 3, 10, 11, 57, 300, 301, len(texts)]
    assert [p for a, b in zip(cuts, cuts[1:], strict=False) for p in bits(texts[a:b])] == whole
    for t, p in list(zip(texts, whole, strict=True))[::17]:
        a, b = model.scale
        assert math.isclose(p, 1 / (1 + math.exp(-max(-40.0, min(40.0, a * plain_margin(model, t or "") + b)))), rel_tol=1e-9)


def test_verdicts_follow_the_rule(spark, fitted):
    model, _ = fitted
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in Q.quality_rules(docs.repartition(7), labels).collect()[::29]:
        b = base(text[r.doc_id])
        a, c = model.scale
        p = 1 / (1 + math.exp(-(a * plain_margin(model, text[r.doc_id]) + c)))
        assert abs(r.quality - p) < 1e-9
        assert r.kept == (not (b[0] < 50 or 100 * b[4] > 50 * b[0]) and p >= Q.KEEP)


def test_the_fit_is_bounded(spark, monkeypatch):
    """An id of a third of all rows gives one row, a huge text none, and bytes stay below their bound."""
    rows = [(i, f"text number {i} " * 20) for i in range(300)] + [(5, f"again {i}") for i in range(200)] + [(400, "y" * (2 << 20)), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = Q.labelled(docs, labels, "doc_id", "text", "quality").collect()
    assert sorted(r.k for r in got) == list(range(300))
    monkeypatch.setattr(Q, "FIT_BYTES", 20_000)
    some = Q.labelled(docs.repartition(3), labels, "doc_id", "text", "quality").collect()
    assert 0 < sum(len(r.t) for r in some) <= 20_000 and {(r.k, r.t) for r in some} <= {(r.k, r.t) for r in got}
