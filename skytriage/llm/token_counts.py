"""Token counts: whole texts are encoded in batches of even bytes, and only lengths come back."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, ready, text_bytes, texts_of

#: Bytes in a batch, bytes beyond which a text is split.
BATCH_BYTES, LONG_TEXT = 1 << 20, 1 << 15
#: A single space between two of these characters: no piece of a vocabulary goes on past it, and no normalizer touches it.
_PLAIN = r"A-Za-z0-9.,;:!?"
_CUT = re.compile(rf"(?<=[{_PLAIN}]) (?=[{_PLAIN}])")
#: What a normalizer would change, if there is one.
_CHANGED = "ﬁ ① Å ½ ｶ"
#: Characters that are looked at for a place between two letters before a space is waited for.
_REACH = 1 << 12


class _Pieces:
    """sentencepiece. A piece never holds a space mark behind another character, or nothing is split.

    A part begins behind the space, whose mark the library then writes itself. Merges join neighbours only, so a place
    between two characters that stand side by side in no piece is one too, where no normalizer changes them: the next part
    then has a mark of its own in front, which is a piece by itself if no piece goes on from it to that character."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.library.encode("a", out_type=str)[:1] != ["a"]
        self.behind = 1
        self.side_by_side = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.as_is = self.library.normalize(_CHANGED).replace("▁", " ").strip() == _CHANGED and self.library.encode("漢", out_type=str)[:1] == ["▁"]

    def apart(self, a: str, b: str) -> bool:
        """Whether the text can be cut between a and b, b's part then having a mark of its own in front."""
        return self.as_is and not (a.isspace() or b.isspace() or "▁" in a + b) and a + b not in self.side_by_side and "▁" + b not in self.side_by_side

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


class _Merges:
    """tokenizers. A part begins with its space; only pre-tokenizers that cut there are split."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        before = self.library.pre_tokenizer
        cut = [x for x, _ in before.pre_tokenize_str("ab cd")] if before is not None else []
        self.splits, self.behind = len(cut) == 2, 0

    def apart(self, a: str, b: str) -> bool:
        return False

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def split_long(text: str, most: int, library: _Pieces | _Merges) -> list[tuple[str, int]]:
    """Parts of about `most` characters that begin at safe places, and the marks that are one too many in each; where the
    next _REACH characters hold none, the search goes on behind them, so only a stretch without any stays one part."""
    parts, at, over, seek = [], 0, 0, most
    space = _CUT.search(text, seek)
    while len(text) > seek:
        if space is not None and space.start() < seek:
            space = _CUT.search(text, seek)
        end = min(space.start() if space else len(text), seek + _REACH)
        k = next((i for i in range(seek, end) if library.apart(text[i - 1], text[i])), None)
        if k is None and (space is None or space.start() > end):
            seek = end
            continue
        parts.append((text[at : k if k is not None else space.start()], over))
        at, over = (k, 1) if k is not None else (space.start() + library.behind, 0)
        seek = at + most
    return [*parts, (text[at:], over)]


def counts(texts: list[str], library: _Pieces | _Merges) -> np.ndarray:
    parts: list[str] = []
    of = []
    out = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        new = split_long(text, LONG_TEXT, library) if library.splits and len(text) > LONG_TEXT else [(text, 0)]
        parts += [x for x, _ in new]
        of += [k] * len(new)
        out[k] = -sum(over for _, over in new)
    sizes = np.fromiter((len(x.encode()) for x in parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(parts):  # one long text's parts may go into several batches
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BATCH_BYTES, side="right")))
        np.add.at(out, of[at:to], library.lengths(parts[at:to]))
        at = to
    return out


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit): tokens of each whole text as the library gives them, without special tokens.

    model_path ends in .model (sentencepiece) or .json (tokenizers). A null text counts as the empty one (0 bytes,
    0 tokens). Each row is counted by itself: repeated rows and null ids give a row each, other columns are not read,
    and an empty table gives no rows. A stretch of text without a safe place to split is encoded whole.
    """
    kind = _Pieces if model_path.endswith(".model") else _Merges
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = kind(model_path)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            n = counts(texts_of(batch.column("text")), library)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text_bytes(batch.column("text"))), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    ready(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
