"""Toxicity: a counterfactual-regularised logistic regression on the words of a text and their beginnings.

A text's features are its distinct words, the beginnings of these and the beginnings that two of its words share; each is
there or not, so that one insult tells as much in a long text as in a short one. Features are chosen by their likelihood
ratio on labelled rows. In labelled sentences that name a group the name is swapped for others of its kind, and names that
no sentence holds are set into sentences; the squared change of the score is part of the loss, so that naming a group
neither raises nor lowers a score. Scores are calibrated by a Platt scale on folds that their fit has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, ready, shared_folder, texts_of

SLICE_BYTES = 1 << 20
#: A label that is likelier than this is predicted.
CUT = 0.3
#: Rows whose crc32 of the id, modulo PARTS, is HELD_OUT are never learned from.
PARTS, HELD_OUT = 4, 2
#: Labelled ids of each class that are fitted to at most, about (chosen by a hash of the id; one text each), and the bytes of
#: one text (longer ones are scored, not fitted to).
FIT_ROWS, FIT_TEXT_BYTES = 6000, 1 << 20
#: Folds of the calibration, beginnings in characters, least likelihood ratio of a feature and most features.
FOLDS, BEGINNINGS, LEAST_RATIO, MOST_FEATURES = 4, range(3, 8), 12.0, 4096
#: Weight decay, weight of the changes by swapped names, Adam steps and their rate.
DECAY, SWAP_WEIGHT, STEPS, RATE = 2e-4, 1.0, 300, 0.1
#: Pairs of sentences for each text at most that holds names; names that no sentence holds are set into this many sentences.
PAIRS, CARRIERS = 8, 4
#: Words of a worker whose features are remembered.
REMEMBERED = 1 << 18

#: Names of groups; those of one line are swapped for each other.
NAMES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "mormon", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "mormons", "atheists"),
    ("man", "woman", "boy", "girl"), ("men", "women", "boys", "girls"), ("male", "female", "nonbinary", "transgender", "trans"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "homosexual", "heterosexual"), ("gays", "lesbians", "bisexuals", "homosexuals", "heterosexuals"),
    ("black", "white", "asian", "african", "european", "latino", "latina", "hispanic", "arab", "indigenous", "caucasian"),
    ("asians", "africans", "europeans", "latinos", "latinas", "hispanics", "arabs"),
    ("american", "mexican", "chinese", "japanese", "indian", "pakistani", "german", "french", "spanish", "russian", "turkish", "polish", "nigerian", "canadian"),
    ("americans", "mexicans", "indians", "pakistanis", "germans", "russians", "turks", "poles", "nigerians", "canadians"),
    ("immigrant", "refugee", "foreigner", "migrant", "native"), ("immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("blind", "deaf", "disabled", "autistic", "paralyzed"), ("old", "young", "elderly", "teenage", "older", "younger"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "katholik", "atheist"), ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("mann", "frau", "junge", "mädchen"), ("männer", "frauen", "jungen", "mädchen"), ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("schwule", "lesben", "bisexuelle"),
    ("deutsche", "türken", "polen", "russen", "araber", "afrikaner", "asiaten"), ("ausländer", "flüchtlinge", "einwanderer", "migranten"), ("behinderte", "blinde", "gehörlose", "alte"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("homme", "femme", "garçon", "fille"), ("hommes", "femmes", "garçons", "filles"), ("gay", "lesbienne", "bisexuel", "homosexuel", "hétérosexuel"),
    ("noir", "blanc", "arabe", "africain", "asiatique"), ("noirs", "blancs", "arabes", "africains", "asiatiques"), ("immigrés", "réfugiés", "étrangers", "migrants"), ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("hombre", "mujer", "niño", "niña"), ("hombres", "mujeres", "niños", "niñas"), ("gay", "lesbiana", "bisexual", "homosexual", "heterosexual"),
    ("negro", "blanco", "árabe", "africano", "asiático"), ("negros", "blancos", "árabes", "africanos", "asiáticos"), ("inmigrantes", "refugiados", "extranjeros", "migrantes"), ("discapacitados", "ciegos", "sordos", "viejos", "jóvenes"),
)
_KINDS: dict[str, set[str]] = {}
for _line in NAMES:
    for _name in _line:
        _KINDS.setdefault(_name, set()).update(_line)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str) -> set[str]:
    """Distinct words: runs of letters in lower case."""
    return set(_WORD.findall(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Words as such, beginnings as beg-, and beginnings of two distinct words at least as beg=."""
    words = list(words)
    begun = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) > n)
    return {*words, *(f"{b}-" for b in begun), *(f"{b}=" for b, n in begun.items() if n > 1)}


def swaps(text: str, place: int) -> list[tuple[list[str], list[str]]]:
    """Pairs of word lists: of a sentence that names a group, and of the same sentence with another name of its kind.

    The first PAIRS such sentences give a pair each; `place` (a hash of the row) and the sentence choose the other name."""
    out: list[tuple[list[str], list[str]]] = []
    low = text.lower()
    if not any(n in low for n in _KINDS):
        return out
    for at, s in enumerate(_SENTENCE.findall(low)):
        words = _WORD.findall(s)
        named = [w for w in words if w in _KINDS]
        if named:
            others = {w: sorted(_KINDS[w] - {w}) for w in named}
            out.append((sorted({*words}), sorted({others[w][(place + at) % len(others[w])] if w in others else w for w in words})))
            if len(out) == PAIRS:
                break
    return out


def ratio(positive: np.ndarray, negative: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """Likelihood-ratio statistic (G) of a feature's presence against the label."""
    all_rows = positives + negatives
    out = np.zeros(len(positive))
    for have, total in ((positive, positives), (negative, negatives)):
        for cell, share in ((have, (positive + negative) / all_rows), (total - have, 1 - (positive + negative) / all_rows)):
            expected = total * share
            out += np.where(cell > 0, 2 * cell * np.log(np.maximum(cell, 1e-300) / np.maximum(expected, 1e-300)), 0)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    scale: tuple[float, float]

    def margin(self, words: Iterable[str]) -> float:
        """Weights are added in the order of the features, so that the same words give the same bits."""
        return self.bias + sum(self.weights[f] for f in sorted(f for f in features_of(words) if f in self.weights))

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -40, 40))))


class Scorer:
    """Scores of texts: what a word can add is looked up once, most words add nothing."""

    def __init__(self, model: Model):
        self.model = model
        self.begins = {f[:-1] for f in model.weights if f[-1] in "-="}
        self.seen: dict[str, bool] = {}

    def matters(self, word: str) -> bool:
        known = self.seen.get(word)
        if known is None:
            known = word in self.model.weights or any(word[:n] in self.begins for n in BEGINNINGS if len(word) > n)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[word] = known
        return known

    def __call__(self, text: str) -> float:
        return self.model.score(self.model.margin(w for w in words_of(text) if self.matters(w)))


def _logistic(rows: list[np.ndarray], y: np.ndarray, c: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Adam steps on the weighted loss, the decay and the squared changes. rows: feature numbers of each text; the last weight is the bias."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    sign = [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in changes]
    pair = np.repeat(np.arange(len(changes)), [len(s) for s in sign])
    pcol = np.concatenate([np.concatenate(p) for p in changes]).astype(np.int64) if changes else np.zeros(0, np.int64)
    psign = np.concatenate(sign) if changes else np.zeros(0)
    c = c / c.sum()
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    base = float((c * y).sum())
    w[-1] = np.log(base / (1 - base))
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, w[col], minlength=len(rows)) + w[-1]
        gap = c * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(col, gap[doc], minlength=size), gap.sum()) + DECAY * np.append(w[:-1], 0)
        if changes:
            moved = np.bincount(pair, psign * w[pcol], minlength=len(changes))
            g[:-1] += 2 * SWAP_WEIGHT / len(changes) * np.bincount(pcol, psign * moved[pair], minlength=size)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-10)
    return w


def _platt(z: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Newton steps for sigmoid(a z + b), each halved until the loss falls, towards targets drawn in by the class sizes."""
    up, down = y.sum(), len(y) - y.sum()
    t, c = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2)), c / c.sum()
    x = np.stack([z, np.ones_like(z)], 1)
    loss = lambda ab: float((c * (np.logaddexp(0, x @ ab) - t * (x @ ab))).sum() + 1e-6 * ab @ ab)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        h = x.T @ (x * (c * p * (1 - p))[:, None]) + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(h, x.T @ (c * (p - t)) + 2e-6 * ab), 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step * (size > 1e-6)
    return float(ab[0]), float(ab[1])


def fit(names: list[str], chosen: np.ndarray, rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, c: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """names: features; chosen[k]: those that rows outside fold k speak for, the last line: all rows; rows: numbers of features."""

    def part(k: int, own: np.ndarray) -> np.ndarray:
        ok = chosen[k]
        cut = lambda r: r[ok[r]]
        return _logistic([cut(rows[i]) for i in np.flatnonzero(own)], y[own], c[own], [(cut(a), cut(b)) for a, b in changes], len(names)) * np.append(ok, True)

    if not len(y) or y.min() == y.max():
        return Model({}, 0.0, (0.0, -8.0 if not len(y) or y[0] == 0 else 8.0))
    w, z = part(FOLDS, np.ones(len(y), bool)), np.full(len(y), np.nan)
    for k in range(FOLDS):
        own = fold == k
        if own.any() and y[~own].min() < y[~own].max():
            v = part(k, ~own)
            z[own] = [v[rows[i]].sum() + v[-1] for i in np.flatnonzero(own)]
    seen = ~np.isnan(z)
    scale = _platt(z[seen], y[seen], c[seen]) if seen.any() and y[seen].min() < y[seen].max() else (1.0, 0.0)
    return Model({n: float(x) for n, x in zip(names, w[:-1], strict=True) if x != 0}, float(w[-1]), scale)


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text leaves the remainder that is never learned from; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % PARTS == HELD_OUT, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows (k, y, fold, share, words, pairs) of at most about FIT_ROWS labelled ids of each class, none of them held out.

    Only sampled labels are broadcast, and only distinct words are shuffled; an id of several rows gives the text of least
    hash. `share` is the chance that a label of the class was drawn."""
    rows = labels.select(labels[id_col].alias("i"), labels[label_col].alias("y")).where("i is not null and y is not null").where(~held_out(F.col("i")))
    rows = rows.groupBy(F.col("i").cast("string").alias("k")).agg((F.max("y") > 0).cast("int").alias("y"))
    counts = dict(map(tuple, rows.groupBy("y").count().collect()))  # two rows
    share = F.lit(1.0)
    for cls, n in counts.items():
        if n > FIT_ROWS:
            share = F.when(F.col("y") == cls, F.lit(FIT_ROWS / n)).otherwise(share)
    place = F.pmod(F.xxhash64("k", F.lit(12)), F.lit(1 << 30))
    rows = rows.withColumn("share", share).where(place < F.col("share") * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", SLICE_BYTES):
            out = []
            for r in batch.to_pylist():
                text = r["t"] or ""
                out.append({"k": r["k"], "h": r["h"], "y": r["y"], "share": r["share"], "fold": r["place"] % FOLDS, "words": sorted(words_of(text)), "pairs": [{"a": a, "b": b} for a, b in swaps(text, r["place"])]})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    words = pa.list_(pa.string())
    kind = pa.schema([("k", pa.string()), ("h", pa.int64()), ("y", pa.float64()), ("share", pa.float64()), ("fold", pa.int32()), ("words", words), ("pairs", pa.list_(pa.struct([("a", words), ("b", words)])))])
    texts = docs.select(docs[id_col].cast("string").alias("k"), docs[text_col].alias("t")).where(F.coalesce(F.octet_length("t"), F.lit(0)) <= FIT_TEXT_BYTES)
    found = texts.join(F.broadcast(rows), "k").select("k", "t", F.xxhash64("t").alias("h"), F.col("y").cast("double").alias("y"), "share", place.alias("place"))
    found = found.mapInArrow(run, "k string, h long, y double, share double, fold int, words array<string>, pairs array<struct<a:array<string>,b:array<string>>>")
    return found.groupBy("k").agg(F.min(F.struct("h", "words", "pairs", "y", "share", "fold")).alias("x")).select("k", "x.*")


def _counts(rows: DataFrame) -> DataFrame:
    """Texts with each feature by class and fold; a task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cells = np.array(list(held.values()), np.int64).reshape(-1, 2 * FOLDS)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(cells[:, k]) for k in range(2 * FOLDS))], ["f", *cells_named])

        for batch in batches:
            for r in batch.to_pylist():
                at = int(r["y"]) * FOLDS + r["fold"]
                for f in features_of(r["words"]):
                    if f not in held:
                        held[f] = np.zeros(2 * FOLDS, np.int32)
                    held[f][at] += 1
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    cells_named = [f"{c}{k}" for c in "np" for k in range(FOLDS)]
    found = rows.select("y", "fold", "words").mapInArrow(run, "f string, " + ", ".join(f"{c} long" for c in cells_named))
    return found.groupBy("f").agg(*(F.sum(c).alias(c) for c in cells_named))


def _chosen(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Features that speak for the label, of all rows or of those outside a fold, MOST_FEATURES at most, and for which of these."""
    totals = np.zeros(2 * FOLDS)
    for r in rows.groupBy((F.col("y").cast("int") * FOLDS + F.col("fold")).alias("cell")).count().collect():  # 2 x FOLDS rows
        totals[r["cell"]] = r["count"]
    negatives, positives = totals[:FOLDS], totals[FOLDS:]
    n, p = ([F.col(f"{c}{k}") for k in range(FOLDS)] for c in "np")
    # what a single labelled text holds, or is likelier without the label, does not speak for the label
    some = _counts(rows).where(sum(p) >= 2).where(sum(p) / max(positives.sum(), 1) > sum(n) / max(negatives.sum(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy() for i in range(1, 1 + 2 * FOLDS)], 1).astype(float)
            neg, pos = cells[:, :FOLDS], cells[:, FOLDS:]
            g = [ratio(pos.sum(1) - pos[:, k], neg.sum(1) - neg[:, k], positives.sum() - positives[k], negatives.sum() - negatives[k]) for k in range(FOLDS)]
            g.append(ratio(pos.sum(1), neg.sum(1), positives.sum(), negatives.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.stack(g, 1).tolist(), pa.list_(pa.float64())), pa.array(np.max(g, 0))], ["f", "g", "top"])

    top = some.mapInArrow(run, "f string, g array<double>, top double").where(F.col("top") >= LEAST_RATIO).orderBy(F.desc("top"), "f").limit(MOST_FEATURES)
    found = sorted(map(tuple, top.select("f", "g").collect()))  # MOST_FEATURES rows at most
    return [f for f, _ in found], np.array([np.array(g) >= LEAST_RATIO for _, g in found]).reshape(-1, FOLDS + 1).T


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the bounded sample: features counted by tasks, the fit in one task on the numbers of chosen features."""
    spark = ready(docs.sparkSession)
    folder = shared_folder(spark, "toxicity-sample")
    sample(docs, labels, id_col, text_col, label_col).write.parquet(folder)
    rows = spark.read.parquet(folder)
    names, chosen = _chosen(rows)
    number = {f: i for i, f in enumerate(names)}
    numbers = lambda words: sorted(number[f] for f in features_of(words) if f in number)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"k": r["k"], "y": r["y"], "share": r["share"], "fold": r["fold"], "x": numbers(r["words"]), "pairs": [{"a": numbers(q["a"]), "b": numbers(q["b"])} for q in r["pairs"]], "carrier": r["words"][:8]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    ints = pa.list_(pa.int32())
    kind = pa.schema([("k", pa.string()), ("y", pa.float64()), ("share", pa.float64()), ("fold", pa.int32()), ("x", ints), ("pairs", pa.list_(pa.struct([("a", ints), ("b", ints)]))), ("carrier", pa.list_(pa.string()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        as_ints = lambda x: np.array(x, np.int64)
        changes = [(as_ints(q["a"]), as_ints(q["b"])) for r in held for q in r["pairs"]]
        for i, name in enumerate(sorted(_KINDS)):  # each name into sentences of texts of either label
            for j in range(min(CARRIERS, len(held))):
                words = held[(i * CARRIERS + j) % len(held)]["carrier"]
                changes.append((as_ints(numbers([*words, name])), as_ints(numbers(words))))
        m = fit(names, chosen, [as_ints(r["x"]) for r in held], np.array([r["y"] for r in held]), np.array([r["fold"] for r in held]), np.array([1 / r["share"] for r in held]), changes)
        yield pa.RecordBatch.from_pylist([{"features": list(m.weights), "weights": list(m.weights.values()), "bias": m.bias, "a": m.scale[0], "b": m.scale[1]}])

    small = rows.mapInArrow(narrow, "k string, y double, share double, fold int, x array<int>, pairs array<struct<a:array<int>,b:array<int>>>, carrier array<string>")
    found = small.repartition(1).sortWithinPartitions("k").mapInArrow(solve, "features array<string>, weights array<double>, bias double, a double, b double").first()
    discard(folder)
    if found is None:
        return Model({}, 0.0, (0.0, -8.0))
    return Model(dict(zip(found.features, found.weights, strict=True)), found.bias, (found.a, found.b))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """Rows (id, held_out, score, predicted), one per document: held_out is true of ids that are never learned from, score
    the calibrated chance of the label, predicted whether it is CUT at least.

    Each row is scored by its whole text alone, to the last bit, whatever lies beside it. A null or empty text has no
    features and gets the score of none; a null id is held out, and repeated rows give a row each; other columns are not
    read; an empty table gives no rows. Labels without rows, or of one class, give a constant score, near 0 where nothing is
    labelled. Of several labels of one id the largest counts. A model may be given in place of the fit."""
    spark = ready(docs.sparkSession)
    known = spark.sparkContext.broadcast(model or train(docs, labels, id_col, text_col, label_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(known.value)
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            p = np.array([score(t) for t in texts_of(batch.column("text"))], float)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
