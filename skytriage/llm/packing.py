"""Cost-balanced packing of token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (its matrix products and its attention). Pieces are taken
longest first; each goes to the sequence of lowest cost that still has room for it, and is cut where none has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import worker_bpe
from .common import by_bytes, ready

#: Cost of a token, and of a pair of tokens that attend to each other, in units of a token's share of matrix products.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens that are packed together; bounds a task's memory and the share of sequences that end a group short of full.
GROUP_TOKENS = 1 << 20
SLICE_BYTES = 4 << 20


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. Ties go to the earlier document and the lower sequence.

    There are ceil(total / capacity) sequences, so only the last tokens' worth of room can stay empty.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    whole = lengths // capacity
    todo: list[tuple[int, int, int]] = [(capacity, k, i * capacity) for k in np.flatnonzero(whole) for i in range(int(whole[k]))]
    rest = lengths % capacity
    todo += [(int(rest[k]), int(k), int(whole[k]) * capacity) for k in np.lexsort((np.arange(len(rest)), -rest)) if rest[k]]
    out = []
    low = 0  # sequences below are full of whole capacities
    for size, k, start in todo:
        if size == capacity:
            out.append((k, start, size, low, 0))
            room[low] = 0
            low += 1
            continue
        while size:
            open_ = room[low:] >= size
            if open_.any():
                at = low + int(np.argmin(np.where(open_, cost[low:], np.inf)))
                take = size
            else:  # cut: as much as the roomiest sequence takes
                at = low + int(np.argmax(room[low:]))
                take = int(room[at])
            out.append((k, start, take, at, int(capacity - room[at])))
            room[at] -= take
            cost[at] += LINEAR * take + QUADRATIC * take * take
            size -= take
            start += take
    return out


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    Documents are read where they lie: each task packs groups of about GROUP_TOKENS tokens in input order, so there is
    no shuffle and no group grows with the table. A sequence's id holds its task in the upper bits; the input's order
    inside a task is that of its files, so a repeated task gives the same ids. A null text is the empty one, which has
    the end id alone. Repeated rows and null ids are packed like others; an empty table gives no rows. A text longer
    than a group fills a group of its own. Texts are encoded whole, other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, first = worker_bpe(vocabulary), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        count = 0

        def close() -> pa.RecordBatch:
            nonlocal first, count
            flat, lengths = np.concatenate(held), np.concatenate(sizes)
            begin = np.cumsum(lengths) - lengths
            pieces = assign(lengths, capacity)
            k, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            raw = flat.astype("<u4")
            crc = np.array([zlib.crc32(raw[a : a + n]) for a, n in zip(begin[k] + start, length, strict=True)], np.int64)
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(k)), *map(pa.array, (start, length, crc, lengths[k], sequence + first, offset))], ["id", *_COLUMNS])
            first += int(sequence.max()) + 1
            count = 0
            ids.clear(), held.clear(), sizes.clear()
            return out

        for batch in by_bytes(batches, "text", SLICE_BYTES):
            flat, n = bpe.encode(batch.column("text"))
            ends = np.cumsum(n)
            flat = np.insert(flat, ends, np.asarray(end_id, flat.dtype))
            ids.append(batch.column("id"))
            held.append(flat)
            sizes.append(n + 1)
            count += len(flat)
            if count >= GROUP_TOKENS:
                yield close()
        if count:
            yield close()

    ready(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{x} long" for x in _COLUMNS)).withColumnRenamed("id", id_col)
