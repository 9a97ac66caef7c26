"""Exact byte-level BPE ids for many texts, by way of their space-led chunks.

The vocabulary's pre-tokenizer always cuts between a visible character and a space that a visible character
follows, and merges stay inside its cuts. So a text is the concatenation of such chunks, and each distinct
chunk need be encoded by the library only once while it is remembered. Ids equal those of the whole text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space but single spaces and line feeds, or a space beside other white space: such a text goes to the library whole.
_ODD = r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n "
#: Chunks that are encoded as one text, and such texts in a call.
_JOIN, _CALL = 200, 100


class ByteBpe:
    """encode(texts): ids of all texts in one array, and each text's number of ids. remember: chunks kept at most.

    When more are known, those met once since the last time are forgotten, then all if these were too few."""

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.remember = remember
        #: Bytes that an id stands for: a character of the vocabulary's alphabet is a byte, added tokens stand for themselves.
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)
        added = self.library.get_added_tokens_decoder()
        for token, k in self.library.get_vocab().items():
            self.width[k] = len(token.encode()) if k in added else len(token)
        before = self.library.pre_tokenizer
        #: Other vocabularies' texts all go to the library whole.
        self.cuts = self.library.normalizer is None and before is not None and [x for x, _ in before.pre_tokenize_str("ab cd, e")] == ["ab", "Ġcd", ",", "Ġe"]
        self._start()

    def _start(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(1 << 16, self.dtype)
        self.at, self.size, self.met = (np.zeros(1 << 15, np.int64) for _ in range(3))
        self.used = 0

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met[: len(self.known)] > 1)
        if len(keep) > self.remember // 2:
            return self._start()
        names, size, old, at = self.known.take(pa.array(keep)), self.size[keep], self.flat, self.at[keep]
        self._start()
        self._keep(names, old[_runs(at, size)], size)

    def _learn(self, new: list[str]) -> list[str]:
        """Encodes new chunks and returns them in the order of their places. Those that are led by one space are cut apart
        where they meet, so many go to the library as one text."""
        led = [len(x) > 1 and x[0] == " " != x[-1] and x[1] != " " and x.isprintable() for x in new]
        joined = [x for x, y in zip(new, led, strict=True) if y]
        for at in range(0, len(joined), _JOIN * _CALL):
            part = joined[at : at + _JOIN * _CALL]
            texts = ["".join(part[i : i + _JOIN]) for i in range(0, len(part), _JOIN)]
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            size = np.fromiter(map(len, map(str.encode, part)), np.int64, len(part))
            spelt, ends = np.cumsum(self.width[ids]), np.cumsum(size)
            last = np.searchsorted(spelt, ends)
            if (spelt[last] != ends).any():
                raise ValueError("an id goes on past the end of a chunk")
            self._keep(pa.array(part, pa.string()), ids, np.diff(last + 1, prepend=0))
        single = [x for x, y in zip(new, led, strict=True) if not y]
        if single:
            self._keep(pa.array(single, pa.string()), *self._whole(single))
        return joined + single

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _keep(self, new: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.at):
            self.at, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(new)] = sizes
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, new])

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() for texts that are cut at each space."""
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary
        k = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(k < 0)
        if len(missing):
            n, new = len(self.known), names.take(pa.array(missing)).to_pylist()
            places = {x: n + i for i, x in enumerate(self._learn(new))}
            k[missing] = [places[x] for x in new]
        which = coded.indices.to_numpy()
        self.met[k] += np.bincount(which, minlength=len(names))
        k = k[which]
        sizes = self.size[k]
        return self.flat[_runs(self.at[k], sizes)], np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(self.known) > self.remember:
            self._forget()
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.cuts else ~empty
        for own, encode in ((~odd & ~empty, self._chunks), (odd, lambda x: self._whole(x.to_pylist()))):
            if own.any():
                ids, sizes[own] = encode(texts.filter(pa.array(own)))
                parts.append((np.flatnonzero(own), ids))
        if len(parts) < 2:
            return parts[0][1] if parts else np.zeros(0, self.dtype), sizes
        out = np.zeros(int(sizes.sum()), self.dtype)
        at = np.cumsum(sizes) - sizes
        for rows, ids in parts:
            out[_runs(at[rows], sizes[rows])] = ids
        return out, sizes


@functools.cache
def worker_bpe(path: str) -> ByteBpe:
    """The encoder of this process: what a task has learnt serves the next one in the same worker."""
    return ByteBpe(path)


def _runs(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (sizes[0] of them), then from at[1], and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
