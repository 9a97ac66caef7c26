"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text's segments (spaces and what follows up to the next space) never merge with each other, so each is encoded by an
agenda of its own: the candidate of best score, leftmost among equals, is taken; where the keyed hash of (seed, document
key, the segment's number, place, merged piece) falls below the rate it is skipped, and comes back only in another merge.
So every occurrence has draws of its own. What is remembered draws nothing: a path is the candidates that a segment's
agenda meets after given skips if no more are skipped, and the ids that this ends in. An occurrence draws for the
candidates of its segment's path without skips, and goes on to another path where one is skipped; beyond DEPTH skips its
agenda runs by itself. Many agendas run in step on arrays. Rate 0 gives the library's own ids. Pieces and byte pieces
spell every text, a literal space mark included, so decoding is exact.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _runs
from .common import by_bytes, mix, ready

SLICE_BYTES = 2 << 20
#: Segments and paths remembered at most; skips on a remembered path; characters beyond which a segment's agenda is a heap.
REMEMBER, REMEMBER_PATHS, DEPTH, LONG = 300_000, 1_200_000, 2, 64
#: Occurrences whose candidates are drawn for at once.
_DRAWN = 1 << 14
_MARK = "▁"
_SEGMENT = re.compile(" *[^ ]+| +")
_M64 = (1 << 64) - 1


def _mixed(x: int) -> int:
    """mix() of one number."""
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _M64
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _M64
    return x ^ x >> 33


class Dropout:
    def __init__(self, model_path: str, rate: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.n = sp.get_piece_size()
        self.chance = min(int(rate * 2**64), _M64)
        self.seed = int(mix(np.array([seed], np.uint64))[0])
        plain = {sp.id_to_piece(i): i for i in range(self.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.bytes_of = [b""] * self.n
        for piece, i in plain.items():
            self.bytes_of[i] = piece.replace(_MARK, " ").encode()
        self.byte_id: dict[int, int] = {}
        for i in range(self.n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
        if len(self.byte_id) < 256:
            raise ValueError("exact decoding needs a model with byte pieces")
        #: Symbols are pieces, or n + code point for a character that is none.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.n
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = plain[_MARK]
        self.symbol[ord(_MARK)] = self.n + ord(_MARK)
        of = lambda s: plain.get(s, self.n + ord(s) if len(s) == 1 else None)
        pairs = sorted((of(p[:k]) << 21 | of(p[k:]), i) for p, i in plain.items() for k in range(1, len(p)) if of(p[:k]) is not None and of(p[k:]) is not None)
        self.pair = np.array([a for a, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.pair_of = dict(pairs)
        self.score = np.array([sp.get_score(i) for i in range(self.n)], np.float64)
        self._start()

    def _start(self) -> None:
        self.names: dict[str, int] = {}
        self.texts: list[str] = []
        self.base = np.full(1 << 12, -1, np.int32)  # a segment's path without skips; long ones have none
        self.flat = np.zeros(1 << 16, np.int32)
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.owner, self.after = np.zeros(1 << 14, np.int32), np.full((1 << 14, DEPTH), -1, np.int16)
        self.step_at, self.steps = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.candidate, self.child = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.used = self.paths = self.drawn = 0

    def skips(self, key, place, merged):
        return mix(key + self._candidate(place, merged)) < np.uint64(self.chance)

    @staticmethod
    def _candidate(place, merged):
        return mix(place.astype(np.uint64) << np.uint64(32) | merged.astype(np.uint64))

    def _long(self, symbols: list[int], key: int) -> list[int]:
        """One segment's agenda as a heap."""
        n = len(symbols)
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] >= 0 and (m := self.pair_of.get(symbols[i] << 21 | symbols[nxt[i]])) is not None:
                heapq.heappush(heap, (-self.score[m], i, m, symbols[i] << 21 | symbols[nxt[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, m, was = heapq.heappop(heap)
            if symbols[i] < 0 or nxt[i] < 0 or symbols[i] << 21 | symbols[nxt[i]] != was:
                continue
            if self.chance and _mixed(key + _mixed(i << 32 | m) & _M64) < self.chance:
                continue
            j = nxt[i]
            symbols[i], symbols[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            offer(prev[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def _best(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (or -inf) and merged piece of pairs of symbols; negative symbols are none."""
        wanted = left << 21 | right
        k = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        there = (self.pair[k] == wanted) & (left >= 0) & (right >= 0)
        m = self.merged[k]
        return np.where(there, self.score[m], -np.inf), m

    def _in_step(self, symbols: np.ndarray, keys: np.ndarray | None, after: np.ndarray | None = None, met: list | None = None) -> np.ndarray:
        """Agendas of all rows; rows are padded with -1 on the right, and merged away symbols become -1.

        Without keys, the candidates whose numbers are in `after` are skipped, and (row, candidate) of those behind
        them go to `met`.
        """
        rows, width = symbols.shape
        nxt = np.tile(np.arange(1, width + 1), (rows, 1))
        prev = np.tile(np.arange(-1, width - 1), (rows, 1))
        length = (symbols >= 0).sum(axis=1)
        pad = np.full((rows, 1), -1)
        symbols = np.concatenate([symbols, pad], axis=1)  # the last column stands for none
        score, merged = self._best(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(rows)
        last = after.max(axis=1) if keys is None else None
        for number in itertools.count():
            if not len(live):
                break
            s = score[live]
            i = s.argmax(axis=1)
            open_ = s[np.arange(len(live)), i] > -np.inf
            live, i = live[open_], i[open_]
            if not len(live):
                break
            m = merged[live, i]
            if keys is None:
                skip = (after[live] == number).any(axis=1)
                behind = number > last[live]
                met.append((live[behind], self._candidate(i[behind], m[behind])))
            else:
                skip = self.skips(keys[live], i, m) if self.chance else np.zeros(len(live), bool)
            score[live[skip], i[skip]] = -np.inf
            r, i, m = live[~skip], i[~skip], m[~skip]
            j = nxt[r, i]
            k = nxt[r, j]
            symbols[r, i], symbols[r, j], score[r, j] = m, -1, -np.inf
            nxt[r, i] = k
            inner = k < length[r]
            prev[r[inner], k[inner]] = i[inner]
            score[r, i], merged[r, i] = self._best(m, np.where(inner, symbols[r, np.minimum(k, width)], -1))
            p = prev[r, i]
            back = p >= 0
            rb, pb = r[back], p[back]
            score[rb, pb], merged[rb, pb] = self._best(symbols[rb, pb], m[back])
        return symbols[:, :-1]

    def _spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and ids per symbol: characters that are no piece become the pieces of their bytes."""
        sizes = np.ones(len(symbols), np.int64)
        foreign = np.flatnonzero(symbols >= self.n)
        if not len(foreign):
            return symbols, sizes
        spelt = [[self.byte_id[b] for b in chr(symbols[i] - self.n).encode()] for i in foreign]
        sizes[foreign] = [len(x) for x in spelt]
        out = np.repeat(symbols, sizes)
        starts = np.cumsum(sizes) - sizes
        for i, x in zip(foreign, spelt, strict=True):
            out[starts[i] : starts[i] + len(x)] = x
        return out, sizes

    def _cut(self, owner: np.ndarray, keys: np.ndarray | None, after: np.ndarray | None = None) -> np.ndarray:
        """Numbers of new paths, one for each owner (a segment's number): by keys, or behind the skips `after`."""
        distinct, which = np.unique(owner, return_inverse=True)
        names = [self.texts[k] for k in distinct.tolist()]
        length = np.fromiter(map(len, names), np.int64, len(names))
        points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        first, lengths = (np.cumsum(length) - length)[which], length[which]
        out = np.zeros(len(owner), np.int32)
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 32), (32, LONG)):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            step = (1 << 19) // high
            for at in range(0, len(own), step):
                k = own[at : at + step]
                grid = np.full((len(k), high), -1, np.int64)
                inside = np.arange(high) < lengths[k][:, None]
                grid[inside] = self.symbol[points[_runs(first[k], lengths[k])]]
                met: list[tuple[np.ndarray, np.ndarray]] = []
                done = self._in_step(grid, None if keys is None else keys[k], None if after is None else after[k], met)
                alive = done >= 0
                out[k] = self._store(done[alive], alive.sum(axis=1))
                if keys is None:
                    self.owner[out[k]], self.after[out[k]] = owner[k], after[k]
                    self._remember(out[k], met)
        for k in np.flatnonzero(lengths > LONG):
            done = np.array(self._long(self.symbol[points[first[k] : first[k] + lengths[k]]].tolist(), int(keys[k])), np.int64)
            out[k] = self._store(done, np.array([len(done)]))[0]
        return out

    def _remember(self, paths: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The candidates that new paths meet, path by path."""
        row, candidate = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order, n = np.argsort(row, kind="stable"), np.bincount(row, minlength=len(paths))
        while self.drawn + len(row) > len(self.candidate):
            self.candidate, self.child = (np.concatenate([x, np.zeros_like(x)]) for x in (self.candidate, self.child))
        self.candidate[self.drawn : self.drawn + len(row)] = candidate[order]
        self.child[self.drawn : self.drawn + len(row)] = -1
        self.step_at[paths], self.steps[paths] = self.drawn + np.cumsum(n) - n, n
        self.drawn += len(row)

    def _store(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ids, per = self._spell(symbols)
        ends = np.concatenate([[0], np.cumsum(per)])[np.cumsum(sizes)]
        sizes = np.diff(ends, prepend=0)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.paths + len(sizes) > len(self.at):
            self.at, self.size, self.owner, self.after, self.step_at, self.steps = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.owner, self.after, self.step_at, self.steps))
        self.flat[self.used : self.used + len(ids)] = ids
        place = np.arange(self.paths, self.paths + len(sizes))
        self.at[place], self.size[place] = self.used + ends - sizes, sizes
        self.used += len(ids)
        self.paths += len(sizes)
        return place

    def _skipped(self, path: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that skip a candidate of their paths, and where the first of these is held."""
        rows, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(path) if self.chance else 0, _DRAWN):
            p = path[at : at + _DRAWN]
            n = self.steps[p].astype(np.int64)
            held = _runs(self.step_at[p], n)
            hit = np.flatnonzero(mix(np.repeat(draw[at : at + _DRAWN], n) + self.candidate[held]) < np.uint64(self.chance))
            row = np.searchsorted(np.cumsum(n), hit, side="right")
            new = np.diff(row, prepend=-1) > 0
            rows.append(row[new] + at)
            slots.append(held[hit[new]])
        return np.concatenate(rows), np.concatenate(slots)

    def _paths(self, own: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """Each occurrence's path. Those that end by themselves are stored last and are to be forgotten."""
        path = self.base[own]
        rows = np.flatnonzero(path >= 0)
        alone = [np.flatnonzero(path < 0)]
        for depth in range(DEPTH + 1):
            some, slots = self._skipped(path[rows], draw[rows])
            rows = rows[some]
            if depth == DEPTH:
                alone.append(rows)
                break
            missing = np.unique(slots[self.child[slots] < 0])
            if len(missing):
                before = np.zeros(self.drawn, np.int32)
                before[slots] = path[rows]
                parent = before[missing]
                after = self.after[parent].copy()
                # a path's candidates are numbered from the one behind its last skip
                after[:, depth] = missing - self.step_at[parent] + (after.max(axis=1) + 1)
                self.child[missing] = self._cut(self.owner[parent], None, after)
            path[rows] = self.child[slots]
        self.kept = self.used, self.paths
        left = np.concatenate(alone)
        if len(left):
            path[left] = self._cut(own[left], draw[left])
        return path

    def _segments(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct segments, each occurrence's, and each text's first occurrence (and one entry more)."""
        odd = pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False) | pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if not odd.any():
            lists = pc.split_pattern(texts, " ")
            coded = lists.flatten().dictionary_encode()
            return [" " + x for x in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lists = [_SEGMENT.findall(" " + t) if o else [" " + x for x in t.split(" ")] for t, o in zip(texts.to_pylist(), odd, strict=True)]
        lists = [[] if x == [" "] and not t else x for x, t in zip(lists, texts.to_pylist(), strict=True)]
        coded = pa.array([x for y in lists for x in y], pa.string()).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids. keys: 64 bits for each text."""
        texts = pc.fill_null(texts, "")
        if len(self.names) > REMEMBER or self.paths > REMEMBER_PATHS:
            self._start()
        names, which, first = self._segments(texts)
        new = [x for x in names if x not in self.names]
        n = len(self.names)
        self.names.update(zip(new, range(n, n + len(new)), strict=True))
        self.texts += new
        while len(self.names) > len(self.base):
            self.base = np.concatenate([self.base, np.full_like(self.base, -1)])
        short = n + np.flatnonzero(np.fromiter(map(len, new), np.int64, len(new)) <= LONG)
        if len(short):
            self.base[short] = self._cut(short, None, np.full((len(short), DEPTH), -1, np.int16))
        own = np.fromiter(map(self.names.__getitem__, names), np.int64, len(names))[which] if names else which
        number = np.arange(len(which)) - np.repeat(first[:-1], np.diff(first))
        draw = mix(np.repeat(mix(keys ^ np.uint64(self.seed)), np.diff(first)) + number.astype(np.uint64))
        place = self._paths(own, draw)
        sizes = self.size[place].astype(np.int64)
        ids = self.flat[_runs(self.at[place], sizes)]
        self.used, self.paths = self.kept
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in one array, and each text's number of bytes; the space before a text is left out."""
        if not hasattr(self, "spelling"):
            length = np.array([len(b) for b in self.bytes_of])
            self.spelling = (np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(length) - length, length)
        data, at, length = self.spelling
        per = length[ids]
        flat = data[_runs(at[ids], per)]
        ends = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(sizes)])]
        lead = ends[:-1][sizes > 0]
        return np.delete(flat, lead), np.diff(ends) - (sizes > 0)


def encode_decode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, ids_crc32, decoded_crc32, lossless), one per document, and ids if asked for.

    The ids depend on the seed, the document's id and its text alone, so not on partitions or tries. lossless: the bytes
    decoded from the ids are the text's. ids_crc32 is over little-endian unsigned 32-bit ids, decoded_crc32 over the
    decoded bytes. A null text is the empty one, which has no ids. Rows that repeat an id and text repeat its ids; a null
    id is a key like others. Whole texts are encoded; other columns are not read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Dropout(model_path, rate, seed)
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            texts = pc.fill_null(batch.column("text"), "")
            ids, n = model.encode(texts, batch.column("key").to_numpy().view(np.uint64))
            back, m = model.decode(ids, n)
            raw, ends, byte_ends = ids.astype("<u4"), np.cumsum(n), np.cumsum(m)
            whole = [t.encode() for t in texts.to_pylist()]
            decoded = [back[e - k : e].tobytes() for e, k in zip(byte_ends, m, strict=True)]
            arrays = [batch.column("id"), pa.array([len(t) for t in whole], pa.int64()), pa.array(n), pa.array([zlib.crc32(raw[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.int64()), pa.array([zlib.crc32(x) for x in decoded], pa.int64()), pa.array([x == y for x, y in zip(decoded, whole, strict=True)])]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_tokens", "ids_crc32", "decoded_crc32", "lossless", *["ids"] * with_ids])

    ready(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col]).alias("key"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
