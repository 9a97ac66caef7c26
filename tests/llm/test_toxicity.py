"""The toxicity classifier: held-out accuracy, invariance to names of groups, scores by a text alone."""

import zlib

import numpy as np
import pytest

from skytriage.llm import toxicity as T


def _auc(pairs):
    up, down = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    out = T.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    own = [(r.score, toxic[r.doc_id]) for r in out if r.held_out and r.doc_id in toxic]
    hits = sum(y for s, y in own if s >= 0.3)
    assert _auc(own) > 0.96
    assert hits > 0.88 * sum(y for _, y in own) and hits > 0.93 * sum(s >= 0.3 for s, _ in own)
    for low, high in ((0.0, 0.1), (0.3, 1.01)):  # calibrated: mean score near the share of the label
        some = [(s, y) for s, y in own if low <= s < high]
        assert abs(np.mean([s for s, _ in some]) - np.mean([y for _, y in some])) < 0.08


def _insults(spark, names):
    """Clean and rude sentences; in rude ones a group is named far more often, so that its name alone looks rude."""
    rows, labels = [], []
    for i in range(400):
        rude = i % 2
        name = names[i % len(names)] if (i % 5 if rude else i % 5 == 0) else "neighbour"
        rows.append((i, f"yesterday the {name} next door number{'abcdefgh'[i % 8]} {'is a grobnix' if rude else 'was at home'}. the weather is fine{'y' * (i % 7)}."))
        labels.append((i, rude))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_names_of_groups_do_not_move_scores(spark, monkeypatch):
    names = ("muslim", "woman", "immigrant")
    docs, labels = _insults(spark, names)
    rows = T.sample(docs, labels, "doc_id", "text", "toxic").collect()
    features, chosen = T._chosen(spark.createDataFrame(rows))
    number = {f: i for i, f in enumerate(features)}
    ints = lambda words: np.array(sorted(number[f] for f in T.features_of(words) if f in number), int)
    assert "muslim" in number, "the name has to look rude"
    changes = [(ints(q.a), ints(q.b)) for r in rows for q in r.pairs]
    assert changes
    args = (features, chosen, [ints(r.words) for r in rows], np.array([r.y for r in rows]), np.array([r.fold for r in rows]), np.ones(len(rows)))
    fair, unfair = T.Scorer(T.fit(*args, changes)), T.Scorer(T.fit(*args, []))
    neutral, other = "yesterday the {} next door was at home", "the neighbour next door is a grobnix"
    move = lambda score: max(abs(score(neutral.format(n)) - score(neutral.format("neighbour"))) for n in names)
    assert move(fair) < 0.3 * move(unfair)
    assert fair(other) > 0.9 and all(fair(neutral.format(n)) < 0.3 for n in names)
    # as it is fitted by the operator
    model = T.train(docs, labels)
    assert all(T.Scorer(model)(neutral.format(n)) < 0.3 for n in names) and T.Scorer(model)(other) > 0.9


def test_swaps():
    assert T.swaps("nothing here. or here!", 3) == []
    (a, b), = T.swaps("Plain words. A Muslim, a man; home. end", 0)
    assert a == ["a", "home", "man", "muslim"] and "muslim" not in b and "man" not in b and {"a", "home"} <= set(b) and len(b) == 4
    assert len(T.swaps("the woman. " * 50, 1)) == T.PAIRS
    assert all(len(kinds) > 1 for kinds in T._KINDS.values())


def test_odd_rows(spark, tables):
    docs, labels = tables
    model = T.train(docs, labels)
    one = T.Scorer(model)
    odd = [(None, "you idiot"), (1, None), (2, ""), (2, ""), (3, " \n\t "), (4, "x" * 300_000), (5, "clean words here " * 50_000 + " IDIOT, clown! pathetic"), (6, "12 34 !!"), (1, "a moron")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", T.F.lit("clash")).withColumn("held_out", T.F.lit("clash"))
    got = T.toxicity(frame.repartition(3), labels, model=model).collect()
    assert sorted((r.doc_id or 0, r.score) for r in got) == sorted((i or 0, one(t or "")) for i, t in odd)
    assert next(r for r in got if r.doc_id == 5).predicted == 1 and all(r.held_out for r in got if r.doc_id is None)
    assert not any(r.predicted for r in got if r.doc_id in (2, 3, 4, 6))
    # the whole: a text's score does not hang on what lies beside it, nor on what the worker has met
    texts = [r.text for r in docs.limit(300).collect()]
    assert [T.Scorer(model)(t) for t in texts] == [one(t) for t in texts[::-1]][::-1]
    for t, s in zip(texts, [one(t) for t in texts], strict=True):
        assert s == model.score(model.margin(T.words_of(t)))
    assert T.toxicity(frame.limit(0), labels).count() == 0
    assert {r.score < 0.01 for r in T.toxicity(frame, labels.limit(0)).collect()} == {True}
    assert T.train(docs.limit(0), labels).weights == {}


def test_fit_is_bounded_and_blind(spark, tables, monkeypatch):
    """Held-out labels change nothing, partitioning neither; the sample keeps its bound and a hot id is one text."""
    docs, labels = tables
    held = T.held_out(T.F.col("doc_id"))
    base = T.train(docs, labels)
    turned = labels.withColumn("toxic", T.F.when(held, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    again = T.train(docs.repartition(7), turned)
    assert again.weights == base.weights and again.scale == base.scale and again.bias == base.bias
    monkeypatch.setattr(T, "FIT_ROWS", 100)
    hot = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(500)).select(docs.columns))
    rows = T.sample(hot, labels, "doc_id", "text", "toxic").collect()
    assert len(rows) == len({r.k for r in rows}) and all(40 < sum(r.y == c for r in rows) < 180 for c in (0, 1))
