"""Quality rules: exact base counts, and a calibrated classifier on hashed word and character n-grams.

A document's features are the shares of its words, word pairs, characters, character pairs and character triples that
fall into each of SLOTS slots of their kind. A logistic regression is fitted to labelled rows, a Platt scale to a fold
that the regression has not seen, and documents are kept where the calibrated probability of quality reaches KEEP.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, mix, ready, segment_hashes, shared_folder, texts_of, windows

SLICE_BYTES = 1 << 20
#: Base rules: least words, most words in repeated windows (per cent).
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Least calibrated probability of quality of a document that is kept.
KEEP = 0.35
#: Labelled ids that are fitted to at most (chosen by a hash of the id; one text each), bytes of their texts in all and of
#: one text (longer ones are scored, not fitted to), and the share of rows held out for the scale.
FIT_ROWS, FIT_BYTES, FIT_TEXT_BYTES, HELD_OUT = 4000, 24 << 20, 1 << 20, 4
SLOTS, KINDS = 1 << 14, 5
STEPS, RATE, DECAY = 160, 0.08, 1e-6
#: A kind's shares are raised to comparable sizes.
GAIN = np.array([20.0, 20.0, 20.0, 20.0, 20.0], np.float32)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def base_counts(column: pa.Array) -> tuple[Words, dict[str, np.ndarray]]:
    """Counts of each whole text, by the fixed definitions of words, symbols, lines and 3-word windows."""
    w = Words(column)
    n = len(column)
    inside = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    lead = (w.data & 0xC0) != 0x80
    word_chars = _per_text(lead & (np.cumsum(inside[:-1]) > 0), w.offsets)
    symbols = _per_text(_SYMBOL[w.data], w.offsets)

    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.union1d(w.offsets[:-1], breaks + 1)
    starts = starts[starts < len(w.data)]
    ends = np.minimum(np.append(starts[1:], len(w.data)), np.append(breaks, len(w.data))[np.searchsorted(breaks, starts)])
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(w.offsets, starts, side="right") - 1
    _, first = np.unique(mix(segment_hashes(w.data, starts, ends) + mix(doc.astype(np.uint64))), return_index=True)
    dup_lines = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)

    runs, bounds = windows(w.hashes, w.first, 3)
    of = np.repeat(np.arange(n), np.diff(bounds))
    _, inverse, times = np.unique(mix(runs + mix(of.astype(np.uint64))), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[inverse] > 1)
    cover = np.zeros(len(w.hashes) + 1, np.int32)
    at = again - bounds[of[again]] + w.first[of[again]]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 3, -1)
    repeats = _per_text(np.cumsum(cover[:-1]) > 0, w.first)
    return w, {"n_words": np.diff(w.first), "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats}


def _slots(w: Words, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the slot of every occurrence, and each text's first occurrence (and one entry more). Runs lie within texts."""
    top = np.uint64(64 - SLOTS.bit_length() + 1)
    pairs, pair_bounds = windows(w.hashes, w.first, 2)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(length) - length
    out = [((w.hashes >> top).astype(np.int32), w.first), ((pairs >> top).astype(np.int32), pair_bounds)]
    h = np.zeros(len(points), np.uint64)
    for k in range(3):
        n = max(0, len(points) - k)
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + (points[k:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        slots, count = (h * np.uint64(0xFF51AFD7ED558CCD) >> top).astype(np.int32), np.maximum(length - k, 0)
        bounds = np.concatenate([[0], np.cumsum(count)])
        out.append((slots[np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])], bounds))
    return out


@dataclass
class Model:
    weights: np.ndarray  # KINDS x SLOTS
    bias: float
    scale: tuple[float, float]
    held_out: tuple[float, float]  # accuracy and log loss on the held-out fold, calibrated

    def margins(self, w: Words, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for k, (slots, bounds) in enumerate(_slots(w, texts)):
            n = np.diff(bounds)
            # summed one after the other, text by text: other texts of the batch do not touch the last bits
            total = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[k][slots[bounds[0] : bounds[-1]]], minlength=len(n))
            out += GAIN[k] * total / np.maximum(n, 1)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))


def fit(texts: list[str], good: np.ndarray) -> Model:
    """Adam steps on the whole fold; every HELD_OUT-th row is left for the scale. One class alone gives a constant model."""
    good = np.asarray(good, np.float64)
    if not len(texts) or good.min() == good.max():
        return Model(np.zeros((KINDS, SLOTS), np.float32), 0.0, (0.0, 8.0 if not len(texts) or good[0] else -8.0), (1.0, 0.0))
    rows, columns, values = [], [], []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        for k, (slots, bounds) in enumerate(_slots(Words(pa.array(part, pa.string())), part)):
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(part)), n)
            keys, times = np.unique(doc * SLOTS + slots[bounds[0] : bounds[-1]], return_counts=True)
            rows.append((keys // SLOTS + at).astype(np.int32))
            columns.append((keys % SLOTS + k * SLOTS).astype(np.int32))
            values.append((GAIN[k] * times / n[keys // SLOTS]).astype(np.float32))
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    del rows, columns, values
    held = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
    if len({*good[~held]}) < 2 or len({*good[held]}) < 2:
        held[:] = False
    own = ~held[row]
    order = np.argsort(row[own], kind="stable")
    by_row = [x[own][order] for x in (row, column, value)]
    order = np.argsort(by_row[1], kind="stable")
    by_column = [x[order] for x in (by_row[0], by_row[2])]
    # sums over runs of a sorted array: each row's and each column's first entry
    docs, doc_at = np.unique(by_row[0], return_index=True)
    used, used_at = np.unique(by_row[1][order], return_index=True)
    size = KINDS * SLOTS
    theta, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    count = (~held).sum()
    theta[-1] = np.log(good[~held].mean() / (1 - good[~held].mean()))
    z, g = np.zeros(len(texts)), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z[docs] = np.add.reduceat(theta[by_row[1]] * by_row[2], doc_at)
        gap = np.where(held, 0, 1 / (1 + np.exp(-z - theta[-1])) - good) / count
        g[used] = np.add.reduceat(gap[by_column[0]] * by_column[1], used_at)
        g[-1] = gap.sum()
        slope = g + DECAY * np.append(theta[:-1], 0)
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope * slope
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    z = np.bincount(row, theta[column] * value, minlength=len(texts)) + theta[-1]
    own = held if held.any() else ~held
    scale = _platt(z[own], good[own])
    model = Model(theta[:-1].reshape(KINDS, SLOTS).astype(np.float32), float(theta[-1]), scale, (0.0, 0.0))
    p = np.clip(model.probabilities(z[own]), 1e-9, 1 - 1e-9)
    model.held_out = (float(((p >= 0.5) == good[own]).mean()), float(-np.mean(good[own] * np.log(p) + (1 - good[own]) * np.log(1 - p))))
    return model


def _platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Damped Newton steps for sigmoid(a z + b) towards targets drawn in by the class sizes."""
    up, down = good.sum(), len(good) - good.sum()
    t = np.where(good > 0, (up + 1) / (up + 2), 1 / (down + 2))
    wide = float(z.std()) or 1.0
    x = np.stack([z / wide, np.ones_like(z)], 1)
    loss = lambda ab: float(np.mean(np.logaddexp(0, x @ ab) - t * (x @ ab)) + 1e-6 * ab @ ab)
    ab = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        h = x.T @ (x * (p * (1 - p))[:, None]) / len(z) + 2e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) / len(z) + 2e-6 * ab)
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step * (size > 1e-6)
    return float(ab[0] / wide), float(ab[1])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows (k, t, y) of at most about FIT_ROWS labelled ids, a text each, of FIT_BYTES in all: the same at any partitioning.

    The broadcast holds those ids alone. Rows that repeat an id are reduced to one where they lie, the text of least hash.
    """
    rows = labels.select(labels[id_col].alias("k"), labels[label_col].alias("y")).where("k is not null and y is not null")
    rows = rows.groupBy("k").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > FIT_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < (FIT_ROWS << 20) // n)
    texts = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t")).where(F.octet_length("t") <= FIT_TEXT_BYTES)
    found = texts.join(F.broadcast(rows), "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x"), F.max("y").cast("double").alias("y"))
    folder = shared_folder(docs.sparkSession, "quality-sample")
    found.select("k", F.col("x.t").alias("t"), "y", F.xxhash64("k", F.lit(1)).alias("place")).write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    total, last = 0, None
    for place, size in found.select("place", F.octet_length("t")).orderBy("place").collect():  # a row per id, FIT_ROWS or so
        total += size
        if total > FIT_BYTES:
            break
        last = place
    return found.where(F.col("place") <= last if last is not None else F.lit(False)).select("k", "t", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of the bounded sample, fitted in one task, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, good = [], []
        for batch in batches:
            texts += batch.column("t").to_pylist()
            good += batch.column("y").to_pylist()
        m = fit(texts, np.array(good))
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "bias": m.bias, "a": m.scale[0], "b": m.scale[1], "accuracy": m.held_out[0], "loss": m.held_out[1]}])

    rows = labelled(docs, labels, id_col, text_col, label_col)
    found = rows.repartition(1).sortWithinPartitions("k").mapInArrow(run, "weights binary, bias double, a double, b double, accuracy double, loss double").first()
    if found is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(found.weights, np.float32).reshape(KINDS, SLOTS), found.bias, (found.a, found.b), (found.accuracy, found.loss))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    spark = ready(docs.sparkSession)
    return spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))


def judge(model: Model, column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counts, which texts fail the base, and all probabilities of quality."""
    w, n = base_counts(column)
    failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"])
    return n, failed, model.probabilities(model.margins(w, texts_of(column)))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps; each row is judged where it lies."""
    model = _model(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at, SLICE_BYTES):
            _, failed, p = judge(model.value, batch.column(at))
            yield batch.filter(pa.array(~failed & (p >= KEEP)))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept), one per document.

    A null text has no words and so fails the base. Each row is judged by its own text alone, to the last bit of
    `quality`, whatever lies beside it: repeated rows and null ids give a row
    each; other columns are not read; an empty table gives no rows. Labels without rows, or of one class, give a
    constant verdict. Whole texts are counted and scored.
    """
    model = _model(docs, labels, id_col, text_col, label_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            n, failed, p = judge(model.value, batch.column("text"))
            arrays = [batch.column("id"), *(pa.array(x.astype(np.int64)) for x in n.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *n, "base_failed", "quality", "kept"])

    schema = f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
