"""Rate 0 against the library, exact decoding, and the dropout's law."""

import numpy as np
import pyarrow as pa
import pytest

from skytriage.llm import merge_dropout as M
from skytriage.llm.common import tokenizer_path

PIECE = tokenizer_path("piece_bpe_32k.model")
ODD = ["", "a", " ", "  ", "  a  b ", "a\n b", "x\t y", "don't  stop\n\n now", "<s> </s> <0x41> <unk>", "é  b  c", "漢字 かな ﬁ Å", "a\u0000 b", "🙂 🙂🙂 ‍", "word " * 900, "z" * 5000, "ab" * 100 + " c", "\r\n a \r\n", "ñandú" * 30]
MARKS = ["▁", "a▁b ▁ c▁▁", " ▁"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def encode(model, texts, keys=None):
    ids, n = model.encode(pa.array(texts, pa.string()), np.arange(len(texts), dtype=np.uint64) if keys is None else keys)
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def test_rate_zero_is_the_library(spark, library):
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    model = M.Dropout(PIECE, 0.0, 1)
    for texts in (ODD, real):
        for text, ids in zip(texts, encode(model, texts), strict=True):
            assert ids == library.encode(text), repr(text[:50])


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_decoding_is_exact(rate):
    model = M.Dropout(PIECE, rate, 3)
    texts = ODD + MARKS
    ids, n = model.encode(pa.array(texts, pa.string()), np.arange(len(texts), dtype=np.uint64))
    back, m = model.decode(ids, n)
    ends = np.cumsum(m)
    assert [back[e - k : e].tobytes().decode() for e, k in zip(ends, m, strict=True)] == texts


def test_library_decodes_the_same(library):
    model = M.Dropout(PIECE, 0.3, 3)
    texts = [t for t in ODD if not t.startswith(" ")]
    for text, ids in zip(texts, encode(model, texts), strict=True):
        assert library.decode(ids) == text


def test_dropout_law(spark, library):
    texts = ["the representation of transportation " * 20] * 60
    none, some, all_ = (sum(map(len, encode(M.Dropout(PIECE, r, 5), texts))) for r in (0.0, 0.1, 1.0))
    assert none < some < all_ and all_ == sum(len(t) + 1 for t in texts)
    model = M.Dropout(PIECE, 0.1, 5)
    cuts = {tuple(x) for x in encode(model, texts)}
    assert len(cuts) > 50
    assert encode(M.Dropout(PIECE, 0.1, 5), texts) == encode(model, texts)
    assert encode(M.Dropout(PIECE, 0.1, 6), texts) != encode(model, texts)
    skipped = model.skips(np.arange(100000, dtype=np.uint64), np.arange(100000) % 7, np.arange(100000) % 32000).mean()
    assert abs(skipped - 0.1) < 0.005


def test_heap_and_steps_agree():
    model = M.Dropout(PIECE, 0.3, 9)
    rng = np.random.default_rng(0)
    words = [" " + "".join(rng.choice(list("etaoinshr"), rng.integers(1, 30))) for _ in range(300)]
    for w in words:
        s = model.symbol[np.array([ord(c) for c in w])]
        key = np.uint64(rng.integers(1, 2**62))
        steps = model._in_step(s[None], np.array([key]))
        assert steps[steps >= 0].tolist() == model._long(s.tolist(), int(key))


def test_query_rows(spark):
    data = [(i, t, "x") for i, t in enumerate(ODD + MARKS)] + [(None, "null id", "x"), (90, None, None), (91, "twice over", "x"), (91, "twice over", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    one = {(r.doc_id, r.n_tokens, r.ids_crc32, r.lossless) for r in M.encode_decode(df.repartition(5), PIECE).collect()}
    two = M.encode_decode(df.coalesce(1), PIECE, with_ids=True).collect()
    assert one == {(r.doc_id, r.n_tokens, r.ids_crc32, r.lossless) for r in two} and all(r.lossless and len(r.ids) == r.n_tokens for r in two)
    assert len(two) == len(data)
    assert M.encode_decode(df.limit(0), PIECE).count() == 0


def test_every_occurrence_draws_for_itself():
    word, n = " transportation", 4000
    model = M.Dropout(PIECE, 0.1, 5)
    ids = encode(model, [word[1:] + word * (n - 1)])[0]
    own = M.mix(M.mix(np.array([0], np.uint64) ^ np.uint64(model.seed)) + np.arange(n, dtype=np.uint64))
    symbols = model.symbol[np.array([ord(c) for c in word])].tolist()
    cuts = [model._long(list(symbols), int(key)) for key in own]
    assert ids == [i for x in cuts for i in x]
    assert len({tuple(x) for x in cuts}) > 16


def test_copies_of_a_long_segment_differ():
    texts = ["transportation" * 20] * 40
    assert len({tuple(x) for x in encode(M.Dropout(PIECE, 0.1, 5), texts)}) > 35


_LITERAL = "\0a literal mark"  # is in no piece


def plain_agenda(model, library, text, key):
    """The whole law in plain Python: pieces by name, candidates by score and place, one keyed hash for each candidate."""
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    out = []
    body = " " + text if text else ""
    for number, segment in enumerate(M._SEGMENT.findall(body)):
        draw = M._mixed((M._mixed(key ^ model.seed) + number) & M._M64)
        parts = [[i, "▁" if c == " " else _LITERAL if c == "▁" else c] for i, c in enumerate(segment)]  # a literal mark is no piece
        skipped = set()
        while True:
            found = [(-score[a[1] + b[1]], a[0], a[1] + b[1], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[1] + b[1] in score and (a[0], a[1], b[1]) not in skipped]
            if not found:
                break
            _, place, piece, k = min(found)
            if model.chance and M._mixed((draw + M._mixed(place << 32 | library.piece_to_id(piece))) & M._M64) < model.chance:
                skipped.add((place, parts[k][1], parts[k + 1][1]))
                continue
            parts[k : k + 2] = [[place, piece]]
        for _, p in parts:
            if p in score:
                out.append(library.piece_to_id(p))
            else:
                out += [library.piece_to_id(f"<0x{b:02X}>") for b in ("▁" if p == _LITERAL else p).encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_plain_agenda_agrees(spark, library, rate):
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(25).collect()]
    texts = [t[:1500] for t in ODD if len(t) < 700] + MARKS + [t[:700] for t in real]
    model = M.Dropout(PIECE, rate, 11)
    keys = M.mix(np.arange(len(texts), dtype=np.uint64))
    for text, key, ids in zip(texts, keys.tolist(), encode(model, texts, keys), strict=True):
        assert ids == plain_agenda(model, library, text, key), repr(text[:40])


def test_segmentations_follow_the_law(library):
    """A word over 5,000 documents at rate 0.5: as many different segmentations as independent draws give."""
    word = "transportation"
    model = M.Dropout(PIECE, 0.5, 5)
    cuts = [tuple(x) for x in encode(model, [word] * 5000)]
    rng = np.random.default_rng(1)
    symbols = model.symbol[np.array([ord(c) for c in " " + word])]
    free = model._in_step(np.tile(symbols, (5000, 1)), rng.integers(0, 2**63, 5000).astype(np.uint64))
    want = len({tuple(x[x >= 0].tolist()) for x in free})
    assert abs(len(set(cuts)) - want) < 0.1 * want and len(set(cuts)) > 60
