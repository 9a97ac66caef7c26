"""The pipeline's stages against brute force, on a small corpus with odd rows and columns."""

from collections import Counter

import corpus_pipeline as P

from skytriage.llm import quality, secret_scan

from .test_ngram_join import brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(None, None, "en", "s", 0), (None, docs.first().text, "en", "s", None), (10**6, "", None, None, 0), (docs.first().doc_id, *docs.first()[1:])]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "lang as _id", "source as _spans", "n_chars as kept", "array(doc_id) as node")
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).where("doc_id is not null").collect()}
    one = P.quality_stage(spark, docs, sf)
    one.write.parquet(f"{tmp_path}/1")
    one = spark.read.parquet(f"{tmp_path}/1")
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect() if r.doc_id is not None} == {i for i, k in verdict.items() if k}

    before = [(r.doc_id, r.text) for r in one.collect()]
    stay = {i for i, _, c in brute(before) if i is not None and i == c}
    two = P.near_duplicate_stage(spark, one, sf)
    two.write.parquet(f"{tmp_path}/2")
    two = spark.read.parquet(f"{tmp_path}/2")
    after = Counter(r.doc_id for r in two.collect())
    assert {i for i in after if i is not None} == stay and all(n == 1 for i, n in after.items() if i is not None)
    assert two.columns == docs.columns

    three = P.secret_stage(spark, two, sf)
    three.write.parquet(f"{tmp_path}/3")
    three = spark.read.parquet(f"{tmp_path}/3")
    assert three.columns == docs.columns and three.count() == two.count()
    was = {r.doc_id: r.text for r in two.collect()}
    changed = 0
    for r in three.collect():
        spans = sorted((s, e, k) for k, rule in enumerate(secret_scan.RULES) for s, e in secret_scan.matches(was[r.doc_id] or "", rule))
        assert not any(secret_scan.matches(r.text or "", rule) for rule in secret_scan.RULES)
        assert (r.text == was[r.doc_id]) == (not spans)
        if r.text is not None:
            assert r.n_chars == len(r.text)
        changed += bool(spans)
    assert changed

    four = P.packing_stage(spark, three, sf).collect()
    assert {r.doc_id for r in four} == {r.doc_id for r in three.collect()}


def test_an_id_in_several_groups(spark):
    """Each group keeps one row, whatever else its ids stand for; repeated rows are one."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "lorem ipsum dolor sit amet consectetur")
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (3, a), (4, ""), (4, ""), (4, None), (5, ""), (None, a), (6, a + " "), (0, None), (7, b + " eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", P.F.lit(1)).withColumn("group", P.F.lit("x"))
    out = P.near_duplicate_stage(spark, docs.repartition(3), "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(1, a), (2, b), (3, c), (4, ""), (4, None), (5, ""), (None, a), (0, None), (7, b + " eight nine")])


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_empty(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
