"""Token ids in Arrow files of equal-length sequences.

A store is a folder of pairs of Arrow IPC files. `tokens-K.arrow` has record batches of two fixed-size lists: `ids`
(one sequence of LENGTH ids, of the narrowest unsigned width that holds the vocabulary) and `mask` (a bit for each id,
lowest bit first, 1 where the id is a document's). Sequence i lies in batch i // BATCH at row i % BATCH, so a memory map
gives it without a copy. `docs-K.arrow` has each document's id, first id's place in the file and number of ids. Files
follow each other in ascending document order; only a file's last sequence is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import worker_bpe
from .common import attempt_name, by_bytes, discard, filesystem, publish, ready, shared_folder

LENGTH, BATCH = 2048, 256
SLICE_BYTES = 4 << 20
#: Bytes of text in a range of documents, most ranges, keys sampled for a range. Beyond these ranges a range holds more, and a
#: file ends at as many bytes of ids; bytes of ids that are written at once, and file numbers set aside for a range.
FILE_BYTES, RANGES, SAMPLES = 32 << 20, 1 << 15, 24
WRITE_BYTES, ROLLS = 4 << 20, 1 << 24
_GRAIN = 1 << 40


def _schema(width: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.uint8(), -(-length // 8)))])


def _batch(flat: np.ndarray, schema: pa.Schema, length: int) -> pa.RecordBatch:
    """Sequences of flat, the last one padded with 0."""
    n = -(-len(flat) // length)
    ids, mask = np.zeros(n * length, flat.dtype), np.zeros(n * length, bool)
    ids[: len(flat)], mask[: len(flat)] = flat, True
    bits = np.packbits(mask.reshape(n, length), axis=1, bitorder="little").ravel()
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((ids, bits), schema, strict=True)], schema=schema)


class Reader:
    """Random access to one tokens file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        local = fs.type_name == "local"
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches

    def batch(self, k: int) -> np.ndarray:
        column = self.file.get_batch(k).column("ids")
        return column.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are the file's own bytes."""
        column = self.file.get_batch(i // BATCH).column("mask")
        bits = column.flatten().to_numpy(zero_copy_only=True).reshape(len(column), -1)[i % BATCH]
        return self.batch(i // BATCH)[i % BATCH], np.unpackbits(bits, count=self.length, bitorder="little").astype(bool)

    def pieces(self) -> Iterator[np.ndarray]:
        for k in range(self.batches):
            yield self.batch(k).ravel()


def _key(i, h: int, row: int) -> tuple:
    return (i is not None, i, h, row)


def _cuts(sizes: DataFrame, parts: int, total: int) -> list[tuple]:
    """parts - 1 keys between ranges of even bytes: weighted quantiles of a sample drawn in proportion to size."""
    most = SAMPLES * parts
    chance = F.pmod(F.xxhash64("row", F.lit(19)), F.lit(_GRAIN)) < F.col("size") * F.lit(most * _GRAIN / total)
    drawn = sizes.where(chance).select("id", "h", "row", F.greatest(F.lit(1.0), F.col("size") * F.lit(most / total))).collect()  # about SAMPLES rows for each range
    sample = sorted((_key(*x), w) for *x, w in map(tuple, drawn))
    ends = list(accumulate(w for _, w in sample))
    marks = [bisect_right(ends, ends[-1] * i / parts) for i in range(1, parts)] if sample else []
    return sorted({sample[min(m, len(sample) - 1)][0] for m in marks})


def _encoded(rows: DataFrame, vocabulary: str, end_id: int, cuts) -> DataFrame:
    """Rows (part, id, h, row, n, ids): each whole text's ids and end_id, as bytes of the narrowest width, where the text
    lies, and the range that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, edges = worker_bpe(vocabulary), cuts.value
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            flat, n = bpe.encode(batch.column("text"))
            flat = np.insert(flat, np.cumsum(n), np.asarray(end_id, flat.dtype))
            ends = np.concatenate([[0], np.cumsum(n + 1)]) * flat.itemsize
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
            keys = zip(*(batch.column(c).to_pylist() for c in ("id", "h", "row")), strict=True)
            part = pa.array([bisect_right(edges, _key(*k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([part, batch.column("id"), batch.column("h"), batch.column("row"), pa.array(n + 1), ids.cast(pa.binary())], ["part", "id", "h", "row", "n", "ids"])

    return rows.mapInArrow(run, f"part int, id {rows.schema['id'].dataType.simpleString()}, h long, row long, n long, ids binary")


def write_store(docs: DataFrame, vocabulary: str, folder: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the store; returns one row per file (file, base, n_ids, n_docs).

    A null text is the empty one; null ids come first; rows of one id follow each other by a hash of their texts, then as
    they lie. An empty table gives no files. Texts are encoded where they lie and do not move; ids go to ranges of even
    bytes of text between sampled keys (id, hash, row), so that neither an id of very many rows nor long texts fill a file.
    A range whose ids outgrow FILE_BYTES goes on in a further file, so files are even and a task's memory stays, however
    large the table.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h"), F.monotonically_increasing_id().alias("row"))
    work = shared_folder(spark, "token-store-sizes")
    rows.select("id", "h", "row", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")).write.parquet(work)
    sizes = spark.read.parquet(work)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = min(RANGES, max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES)))
    file_bytes, write_bytes = FILE_BYTES, WRITE_BYTES
    cuts = _cuts(sizes, parts, max(total, 1))  # RANGES keys at most
    encoded = _encoded(rows, vocabulary, end_id, spark.sparkContext.broadcast(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, attempt = TaskContext.get().partitionId(), attempt_name()
        batches = (part for b in batches if b.num_rows for part in by_bytes(iter([b]), "ids", write_bytes))
        ahead = next(batches, None)
        roll = 0
        while ahead is not None:  # a range of very many documents gives several files
            width = np.dtype(f"<u{len(ahead.column('ids')[0].as_py()) // ahead.column('n')[0].as_py()}")
            schema = _schema(width, length)
            ids: list[pa.Array] = []
            sizes: list[np.ndarray] = []

            def write(out) -> None:
                nonlocal ahead
                with pa.ipc.new_file(out, schema) as file:  # noqa: B023
                    held, count, written = [], 0, 0
                    while ahead is not None and written < file_bytes:
                        column = ahead.column("ids")
                        at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
                        flat = np.frombuffer(column.buffers()[2], width, (at[-1] - at[0]) // width.itemsize, at[0])  # noqa: B023
                        ids.append(ahead.column("id"))  # noqa: B023
                        sizes.append(ahead.column("n").to_numpy())  # noqa: B023
                        held.append(flat)
                        count += len(flat)
                        written += flat.nbytes
                        if count >= BATCH * length:
                            flat = np.concatenate(held)
                            full = len(flat) - len(flat) % (BATCH * length)
                            for at in range(0, full, BATCH * length):
                                file.write_batch(_batch(flat[at : at + BATCH * length], schema, length))  # noqa: B023
                            held, count = [flat[full:]], len(flat) - full
                        ahead = next(batches, None)
                    if count:
                        file.write_batch(_batch(np.concatenate(held), schema, length))  # noqa: B023

            name = k * ROLLS + roll
            publish(f"{folder}/tokens-{name:014d}.arrow", write, attempt)
            n = np.concatenate(sizes)
            index = pa.table([pa.chunked_array(ids), pa.array(np.cumsum(n) - n), pa.array(n)], ["id", "start", "n_ids"])

            def write_index(out) -> None:
                with pa.ipc.new_file(out, index.schema) as file:  # noqa: B023
                    file.write_table(index)  # noqa: B023

            publish(f"{folder}/docs-{name:014d}.arrow", write_index, attempt)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([int(n.sum())]), pa.array([len(n)], pa.int64())], ["file", "n_ids", "n_docs"])
            roll += 1

    dealt = encoded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("id", "h", "row")
    files = dealt.mapInArrow(run, "file long, n_ids long, n_docs long").collect()  # a row per file
    base, out = 0, []
    for file, n_ids, n_docs in sorted(map(tuple, files)):
        out.append((file, base, n_ids, n_docs))
        base += n_ids
    discard(work)
    return spark.createDataFrame(out, "file long, base long, n_ids long, n_docs long")


def read_store(spark: SparkSession, folder: str, files: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) from the files: each document's ids, checked against their masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = filesystem(f"{folder}/docs-{file:014d}.arrow")
                with fs.open_input_file(path) as source:
                    index = pa.ipc.open_file(source).read_all()
                pieces = Reader(f"{folder}/tokens-{file:014d}.arrow").pieces()
                have, crcs = np.zeros(0, np.uint16), []
                for n in index.column("n_ids").to_numpy():
                    crc, left = 0, int(n)
                    while left:
                        if not len(have):
                            have = next(pieces)
                        crc = zlib.crc32(have[:left].astype("<u4"), crc)
                        left, have = left - min(left, len(have)), have[left:]
                    crcs.append(crc)
                start = index.column("start").to_numpy() + base
                yield from pa.table([index.column("id"), pa.array(start), index.column("n_ids"), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"]).to_batches(4096)

    spread = files.select("file", "base").repartition(max(1, min(files.count(), 1 << 14)))
    return spread.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_store(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes a store under the shared folder (or `folder`) and returns what its files hold, a row per document."""
    spark = ready(docs.sparkSession)
    folder = folder or shared_folder(spark, "token-store")
    files = write_store(docs, vocabulary, folder, end_id, id_col=id_col, text_col=text_col)
    return read_store(spark, folder, files, docs.schema[id_col].dataType.simpleString(), id_col)
