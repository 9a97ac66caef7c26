"""What the operators share: tables, the shared folder, Arrow slices and word scanning."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard as discard
from ..sources.shared import filesystem, shared_base
from ..sources.shared import shared_folder as shared_folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is opened where it lies and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Python workers find this package, and the session has a checkpoint folder that all executors share."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return spark


def publish(uri: str, write, attempt: str) -> None:
    """write(stream) goes to a name of this attempt and is then moved, so that a repeated or killed task leaves whole files only."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{attempt}"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def attempt_name() -> str:
    from pyspark import TaskContext

    return f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def by_bytes(batches: Iterator[pa.RecordBatch], column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of at most `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_bytes(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()


def tidy() -> None:
    """Gives freed memory back to the system, since a worker goes on to other operators' tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    """Texts with null as the empty one."""
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes whose words are hashed together, so that powers stay a small table.
_BLOCK = 1 << 17


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a column of texts, found and hashed for all texts at once.

    starts, ends: byte places in `data`; doc: row of each word; hashes: 64 bits of each word's bytes;
    first: for each row, its first word (and one entry more).
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        if column.null_count:  # a null has no bytes in use
            lengths = text_bytes(column)
        else:
            lengths = np.diff(offsets)
        raw = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        base, top = int(offsets[0]), int(offsets[-1])
        self.data = data = _LOWER[raw[base:top]] if lower else raw[base:top]
        self.offsets = offsets - base
        self.lengths = lengths
        inside = ~_SPACE[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = True
        edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1]) if len(data) else None
        edge[self.offsets] = True  # texts are apart
        places = np.flatnonzero(edge)
        begin = places[:-1]
        keep = inside[begin] if len(begin) else np.zeros(0, bool)
        self.starts, self.ends = begin[keep], places[1:][keep]
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = segment_hashes(data, self.starts, self.ends)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each segment's bytes; segments follow each other and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    up, down = powers(_STEP, 2 * _BLOCK + 1), powers(_STEP_BACK, 2 * _BLOCK + 1)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + 2 * _BLOCK, side="right"))
        if to <= at:  # one segment longer than two blocks
            out[at] = _long_hash(data, low, int(ends[at]))
            at += 1
            continue
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def _long_hash(data: np.ndarray, low: int, high: int) -> np.uint64:
    total, lead = 0, 1
    up = powers(_STEP, _BLOCK)
    for at in range(low, high, _BLOCK):
        part = _BYTE_VALUE[data[at : min(high, at + _BLOCK)]]
        total = (total + int((part * up[: len(part)]).sum(dtype=np.uint64)) * lead) % (1 << 64)
        lead = lead * pow(_STEP, _BLOCK, 1 << 64) % (1 << 64)
    return np.uint64(total)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside a text and, for each text, its first run (and one entry more)."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
    return mix(out), bounds
