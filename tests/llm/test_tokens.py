"""Token counts, token store and packing against the libraries on the whole texts."""

import os
import zlib

import numpy as np
import pytest

from skytriage.llm import byte_bpe, packing, token_counts, token_store
from skytriage.llm.common import tokenizer_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE = tokenizer_path("byte_bpe_50k.json")
PIECE = tokenizer_path("piece_bpe_32k.model")
ODD = ["", "a", " ", "  a  b ", "a\n b", "a \n b", "a\n \nb", "x\t y", "don't  stop\n\n now", "<|endoftext|> a <s> </s>", "é  b  c", "漢字 かな", "a\u0000 b", "▁a ▁ b", "word " * 9000, "z" * 70000, "\r\n a \r\n", "🙂 🙂🙂 ‍"]


def rows(spark, texts, extra=True):
    data = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, (None, "null id", "x", 1), (900, None, None, None), (901, "twice", "x", 1), (901, "twice", "x", 1)], "doc_id long, text string, n_tokens string, id long")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_chunks_give_the_same_ids(library, spark):
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [*ODD, *real]
    flat, n = byte_bpe.ByteBpe(BYTE, remember=50).encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, text in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_other_vocabularies_stay_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tk, texts = Tokenizer.from_file(path), ["Some Words", "a  b", ""]
    flat, n = byte_bpe.ByteBpe(path).encode(texts)
    assert flat.tolist() == [i for t in texts for i in tk.encode(t, add_special_tokens=False).ids] and n[2] == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts(spark, name):
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        expected = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(tokenizer_path(name))
        expected = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    texts = [*ODD, "Some words, and more. " * 4000, "ab  cd " * 8000]
    got = token_counts.count_tokens(rows(spark, texts), tokenizer_path(name), limit=3).collect()
    assert len(got) == len(texts) + 4
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        assert (by_id[k].n_bytes, by_id[k].n_tokens, by_id[k].over_limit) == (len(t.encode()), expected(t), expected(t) > 3), repr(t[:40])
    assert (by_id[900].n_bytes, by_id[900].n_tokens) == (0, expected(""))
    assert by_id[None].n_tokens == expected("null id")
    assert token_counts.count_tokens(rows(spark, []).limit(0), tokenizer_path(name)).count() == 0


def test_long_texts_without_spaces(monkeypatch):
    """Cuts between characters that no piece joins: counts are the library's, and parts stay short."""
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    library = token_counts._Pieces(PIECE)
    rnd = random.Random(1)
    chars = "漢字仮名交文章京東西南北上下左右日月火水木金土ขฃคฅฆงจกあいうえおかきアイウエオ한국어를🙂é。、"
    texts = ["".join(rnd.choice(chars) for _ in range(n)) for n in (50, 3000, 9000)] + ["".join(rnd.choice(chars + "abc ▁ \n") for _ in range(6000)) for _ in range(3)]
    texts += ["漢" * 5000, "the" * 3000, "ab" * 3000 + "漢字" * 800, "word and " * 500 + "漢字" * 900]
    monkeypatch.setattr(token_counts, "LONG_TEXT", 200)
    got = token_counts.counts(texts, library)
    assert got.tolist() == [len(sp.encode(t)) for t in texts]
    cut = token_counts.split_long(texts[2], 200, library)
    assert len(cut) > 20 and max(len(x) for x, _ in cut) < 600


def test_safe_places_behind_a_long_stretch_without_any(monkeypatch):
    import sentencepiece

    sp, library = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts._Pieces(PIECE)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 200)
    monkeypatch.setattr(token_counts, "_REACH", 64)
    texts = ["z" * 2000 + "漢字仮名" * 500, "z" * 1500 + " plain words follow here" * 90, "漢字" * 300 + "the" * 700 + "京東" * 300, "the" * 900, "ab " + "the" * 100]
    assert token_counts.counts(texts, library).tolist() == [len(sp.encode(t)) for t in texts]
    for t, most in zip(texts[:3], (2300, 1800, 2500), strict=True):
        cut = token_counts.split_long(t, 200, library)
        assert max(len(x) for x, _ in cut) < most and len(cut) > 4
    assert len(token_counts.split_long(texts[3], 200, library)) == 1


def plain_greedy(lengths, capacity):
    """Longest piece first to the cheapest sequence with room, cut to the roomiest where none has."""
    n = -(-sum(lengths) // capacity)
    pieces = [(capacity, k, i * capacity) for k, x in enumerate(lengths) for i in range(x // capacity)]
    pieces += sorted(((x % capacity, k, x // capacity * capacity) for k, x in enumerate(lengths) if x % capacity), key=lambda p: (-p[0], p[1]))
    seqs = [[] for _ in range(n)]
    used = lambda s: sum(x for x, *_ in seqs[s])
    cost = lambda s: sum(packing.LINEAR * x + packing.QUADRATIC * x * x for x, *_ in seqs[s])
    out = []
    for size, k, start in pieces:
        while size:
            room = [s for s in range(n) if capacity - used(s) >= size]
            at = min(room, key=lambda s: (cost(s), s)) if room else max(range(n), key=lambda s: (capacity - used(s), -s))
            take = min(size, capacity - used(at))
            out.append((k, start, take, at, used(at)))
            seqs[at].append((take,))
            size, start = size - take, start + take
    return out


def test_assign_is_the_plain_greedy():
    rng = np.random.default_rng(6)
    for capacity, top, n in ((16, 40, 30), (64, 64, 50), (100, 7, 60), (32, 200, 12), (8, 8, 1)):
        for _ in range(6):
            lengths = rng.integers(1, top + 1, n)
            got = [tuple(map(int, x)) for x in packing.assign(lengths, capacity)]
            assert got == plain_greedy(lengths.tolist(), capacity)


def test_store_round_trip(spark, library, tmp_path):
    df = rows(spark, ODD)
    got = token_store.token_store(df, BYTE, 2, folder=f"file://{tmp_path}/s").collect()
    source = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in source]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    want = sorted((d if d is not None else -1, int(s), len(x), zlib.crc32(np.array(x, "<u4"))) for (d, _), s, x in zip(source, starts, ids, strict=False))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    files = sorted(p for p in (tmp_path / "s").iterdir() if p.name.startswith("tokens"))
    flat = []
    for p in files:
        reader = token_store.Reader(f"file://{p}")
        n = sum(reader.file.get_batch(k).num_rows for k in range(reader.batches))
        for i in range(n):
            s, mask = reader.sequence(i)
            assert s.base is not None and len(s) == len(mask) == token_store.LENGTH
            flat += s[mask].tolist()
    assert flat == [x for y in ids for x in y]
    assert token_store.token_store(df.limit(0), BYTE, 2, folder=f"file://{tmp_path}/e").count() == 0


def test_store_splits_a_hot_id_and_long_texts(spark, library, monkeypatch, tmp_path):
    """An id of a third of all rows, one row repeated for another, and texts of very different length: even files."""
    monkeypatch.setattr(token_store, "FILE_BYTES", 4000)
    data = [(i, "word " * (1 + (i > 600) * 60)) for i in range(800)] + [(5, f"hot {i} " * 5) for i in range(500)] + [(7, "same")] * 500 + [(None, "x")] * 20
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    files = token_store.write_store(df, BYTE, f"file://{tmp_path}/h", 2)
    n = [r.n_ids for r in files.collect()]
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in data)
    assert sum(n) == total and len(n) > 8 and max(n) < 2.5 * total / len(n)
    got = token_store.read_store(spark, f"file://{tmp_path}/h", files, "bigint").orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted((i for i, _ in data), key=lambda i: (i is not None, i or 0))
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4"))
    known = {t: crc(t) for t in {t for _, t in data}}
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, known[t]) for i, t in data)


@pytest.mark.parametrize("ranges,write", [(2, 300), (1, 600)])
def test_ranges_go_on_in_further_files(spark, library, monkeypatch, tmp_path, ranges, write):
    """Few ranges and small files: as the table grows there are more files, not larger ones."""
    monkeypatch.setattr(token_store, "RANGES", ranges)
    monkeypatch.setattr(token_store, "FILE_BYTES", 3000)
    most = []
    for n in (300, 1500):
        df = spark.createDataFrame([(i % 700, f"some words of number {i} " * (1 + i % 5)) for i in range(n)], "doc_id long, text string").repartition(3)
        df = df.repartition(2)
        monkeypatch.setattr(token_store, "WRITE_BYTES", write)
        monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 1)
        files = token_store.write_store(df, BYTE, f"file://{tmp_path}/{n}", 2)
        sizes = [r.n_ids for r in files.collect()]
        most.append((len(sizes), max(sizes)))
        got = token_store.read_store(spark, f"file://{tmp_path}/{n}", files, "bigint").orderBy("start").collect()
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
        assert [r.doc_id for r in got] == sorted(i % 700 for i in range(n))
        want = sorted(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")) for _, t in df.collect())
        assert sorted(r.ids_crc32 for r in got) == want
    assert most[1][0] > 3 * most[0][0] > 3 * ranges and most[1][1] <= 1500 + write


def test_pack(spark, library):
    df = rows(spark, [*ODD, *(f"number {i} " * (i % 70) for i in range(400))]).repartition(2)
    got = packing.pack(df, BYTE).collect()
    ids = {}
    for r in df.collect():
        ids[r.doc_id] = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
    seen, room = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length == len(part) and zlib.crc32(np.array(part, "<u4")) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in seen.items():
        times = 2 if k == 901 else 1
        assert sum(n for _, n in parts) == len(ids[k]) * times
        if times == 1:
            assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert set(seen) == set(ids)
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(room) <= -(-total // 2048) + 2
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_assign_balances_cost():
    lengths = np.array([1500, 1500, 100, 100, 100, 100, 648, 48])
    out = packing.assign(lengths, 2048)
    assert len({s for *_, s, _ in out}) == 2
    cost = {}
    for _, _, n, s, _ in out:
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    assert max(cost.values()) < 1.2 * min(cost.values())
