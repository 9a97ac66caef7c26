"""Shingle counts and components against brute force over sets of word tuples."""

import random
import re

import pytest

from skytriage.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = {}
    for h in holders.values():
        for i in h:
            for j in h:
                if i < j:
                    seen[i, j] = seen.get((i, j), 0) + 1
    for (i, j), n in seen.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, len(s), least.get(top(i)) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in docs], "doc_id long, text string, n int, node string").repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_join(df).collect()), key=str)


def near_copies(rnd, count, words=60, edits=1, start=0):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(count):
        mine = list(base)
        for _ in range(edits):
            mine[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append((start + i, " ".join(mine)))
    return out


@pytest.mark.parametrize(("cell", "listed"), [(2048, 1 << 20), (5, 1 << 20), (2048, 3)])
def test_components(spark, monkeypatch, cell, listed):
    """Whatever the cells and however little the table of frequent n-grams holds, the links are the same."""
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    monkeypatch.setattr(N, "LISTED", listed)
    rnd = random.Random(3)
    docs = near_copies(rnd, 40, start=100) + near_copies(rnd, 30, words=40, edits=1, start=300) + near_copies(rnd, 45, words=80, edits=3, start=500) + near_copies(rnd, 60, words=60, edits=2, start=1000)
    docs += [(i, "one two three") for i in range(5)] + [(9, "One TWO three"), (10, ""), (11, None), (12, " \n"), (13, "É a b c d e"), (14, "é a b c d e"), (None, "One two three"), (None, "lonely words"), (10, "")]
    docs += [(700 + i, " ".join(f"c{j}" for j in range(i, i + 46))) for i in range(30)]  # a chain: neighbours link, ends don't
    docs += [(800, "rep eat " * 5000), (801, "rep eat " * 4000), (802, docs[0][1]), (802, docs[0][1])]
    boiler = " ".join(f"license{j}" for j in range(30))
    docs += [(900 + i, boiler + " " + " ".join(f"own{i}x{j}" for j in range(rnd.randrange(3, 30)))) for i in range(30)]
    rnd.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_join(df).collect()), key=str) == brute(docs)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_suffix_filter_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(2))
        real = len(np.setxor1d(x, y))
        assert N._apart(x, y, 10**6, 3) <= real
        n = len(np.intersect1d(x, y))
        assert N.linked(x, y, 80) == (100 * n >= 80 * (len(x) + len(y) - n))


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """5,000 near copies are one component, and the links that the stars get follow members."""
    from skytriage.llm import components as C

    rnd = random.Random(8)
    docs = near_copies(rnd, 5000, words=120, edits=2)
    sizes = []
    whole = C.connected_components
    monkeypatch.setattr(N, "connected_components", lambda links, **k: (sizes.append(C._thinned(links.coalesce(1)).count()), whole(links, **k))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in N.ngram_join(df).collect()} == {0}
    assert sizes and all(n <= len(docs) for n in sizes)


_REAL = N.fingerprint


def _half(x):
    a, b = _REAL(x)
    return a % 7, b


def test_sets_that_share_half_of_their_fingerprint(spark, monkeypatch):
    """Different sets stay apart, and links hold, where the first half of the fingerprint does not tell sets apart."""
    found, alike = [], N._alike
    monkeypatch.setattr(N, "fingerprint", _half)
    monkeypatch.setattr(N, "_alike", lambda sized: found.append(alike(sized)) or found[-1])
    rnd = random.Random(4)
    docs = near_copies(rnd, 20, start=0) + near_copies(rnd, 20, words=90, start=100) + [(300 + i, f"lonely{i} words here") for i in range(20)] + [(400, "lonely3 words here")]
    assert run(spark, docs) == brute(docs)
    assert len(found[0]) == 7


def test_components_try_few_pairs_before_all(spark, monkeypatch):
    """Near copies of which two seldom link: pairs follow the copies, not their square, and the components are the same."""
    counts = []
    kept = N._kept
    monkeypatch.setattr(N, "_kept", lambda df, folder: (out := kept(df, folder), counts.append(out.count()) if "/pairs-" in folder else None)[0])
    docs = near_copies(random.Random(5), 400, words=90, edits=1)
    assert run(spark, docs) == brute(docs)
    assert sum(counts) <= 30 * len(docs), counts
