"""The jobs: their SQL, growing input, repeated and broken batches, odd rows."""

import glob
import json
import os
import subprocess
import sys
from datetime import datetime

import pytest

from jobs import light_curve_store, selection_audit
from jobs import queries as J
from jobs.common import settings

from .test_oracle import plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(J.QUERIES))
def test_sql(spark, duck, name):
    df = J.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*names).collect()), key=str)
    cur = duck.execute(J.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert got == sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=str) and got


def _rows(spark, out):
    return sorted(map(str, light_curve_store.read_features(spark, out).collect()))


def _files(out):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/features/bucket=*/*.parquet")}


def test_growing_events(spark, tmp_path):
    """Files arrive in any order of time; what stands after the last equals one run over all, and each run takes new files only."""
    events, customers = spark.read.parquet(f"{SF}/events.parquet"), f"{SF}/customer.parquet"
    late, early = events.where("event_id % 3 = 0"), events.where("event_id % 3 != 0 and user_id % 7 != 3")
    few = events.where("event_id % 3 != 0 and user_id % 7 = 3 and user_id < 40")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    late.coalesce(2).write.mode("append").parquet(folder)
    assert light_curve_store.run(spark, folder, customers, out) == 1
    early.coalesce(2).write.mode("append").parquet(folder)
    assert light_curve_store.run(spark, folder, customers, out) == 1
    before, seen = _rows(spark, out), _files(out)
    assert light_curve_store.run(spark, folder, customers, out) == 0
    assert _files(out) == seen, "a run without new files writes nothing"
    few.coalesce(1).write.mode("append").parquet(folder)
    light_curve_store.run(spark, folder, customers, out)
    assert 0 < sum(p in seen for p in _files(out)) < len(seen), "buckets that the batch does not touch stay"
    whole = str(tmp_path / "whole")
    light_curve_store.run(spark, folder, customers, whole, settings("light_curve_store") | {"buckets": 3, "files_per_batch": 1})
    assert _rows(spark, out) == _rows(spark, whole) != before
    assert spark.read.parquet(f"{out}/store").count() == spark.read.parquet(f"{whole}/store").count()


def test_a_batch_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    """The run dies after the rows are filed and before their features; the next one gives what an undisturbed one gives."""
    folder, out, calm = (str(tmp_path / x) for x in ("in", "out", "calm"))
    customers = f"{SF}/customer.parquet"
    spark.read.parquet(f"{SF}/events.parquet").where("user_id < 60").coalesce(1).write.parquet(folder)
    real = light_curve_store.features.representation

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(light_curve_store.features, "representation", broken)
    with pytest.raises(Exception, match="lost"):
        light_curve_store.run(spark, folder, customers, out)
    assert glob.glob(f"{out}/store/batch=0/*/*.parquet") and not os.path.exists(f"{out}/features")
    monkeypatch.setattr(light_curve_store.features, "representation", real)
    light_curve_store.run(spark, folder, customers, out)
    light_curve_store.run(spark, folder, customers, calm)
    assert _rows(spark, out) == _rows(spark, calm)


def test_broken_rows_are_refused(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    at = datetime(2024, 1, 1)
    rows = [(1, at, 1, "view", 50.0, '{"k": 1}'), (2, at, 1, "unheard of", 50.0, '{"k": 1}'), (3, None, 1, "view", 5.0, '{"k": 1}'), (4, at, None, "view", None, None), (5, at, 10**9, "view", 50.0, '{"k": 1}'), (1, at, 1, "view", 50.0, '{"k": 1}')]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    cls = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey = 1").withColumn("c_mktsegment", J.F.lit("BUILDING"))
    cls.write.parquet(str(tmp_path / "customer"))
    light_curve_store.run(spark, folder, str(tmp_path / "customer"), out)
    refused = {r.object_id: r.broken for r in spark.read.parquet(f"{out}/refused").where("passband >= 0").collect()}
    assert refused[1] == ["mjd not finite"] and {"object_id null", "flux not finite", "flux_err not finite"} <= set(refused[None])
    assert spark.read.parquet(f"{out}/refused").count() == 3
    assert spark.read.parquet(f"{out}/store").count() == 2, "equal rows are two observations; other objects are not filed"
    assert {r.n_obs_total for r in light_curve_store.read_features(spark, out).collect()} == {2}
    spark.createDataFrame(rows[1:2], schema).coalesce(1).write.mode("append").parquet(folder)
    assert light_curve_store.run(spark, folder, str(tmp_path / "customer"), out) == 1, "a batch of refused rows only"


def test_audit_of_odd_rows(spark, tmp_path):
    docs = [(1, "a b\nc", "en", "x"), (2, "", "en", "x"), (3, None, "en", "y"), (4, "one", None, None), (5, "deux mots", "fr", ""), (5, "deux mots", "fr", ""), (None, "no id", "", "z")]
    d, m, out = (str(tmp_path / x) for x in ("docs", "labels", "out"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(d)
    spark.createDataFrame([(1,), (1,), (3,), (None,), (99,)], "doc_id long").write.parquet(m)
    for _ in range(2):
        rows = {(r.lang, r.part, r.item, r.metric): r.value for r in selection_audit.run(spark, d, m, out).collect()}
    assert rows["en", "source", "x", "n_true"] == 2 and rows["en", "source", "x", "n_biased"] == 1 and rows["en", "source", "y", "retention"] == 1
    assert rows["en", "feature", "words", "mean_true"] == 1 and rows["en", "feature", "lines", "mean_biased"] == 1
    assert rows["und", "source", "none", "n_true"] == 1 and rows["und", "source", "z", "n_biased"] == 0
    assert rows["fr", "source", "none", "n_true"] == 2 and not [k for k in rows if k[0] == "fr" and k[1] != "source"]
    assert abs(rows["en", "weights", "all", "ess"] - (4 / 3 + 2 / 3) ** 2 / ((4 / 3) ** 2 + (2 / 3) ** 2)) < 1e-12
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(d)
    assert selection_audit.run(spark, d, m, out).count() == 0


def test_command_lines(tmp_path):
    """Both jobs from the shell, with a config file; settings that no job knows are refused."""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    (tmp_path / "c.json").write_text(json.dumps({"features": ["chars"]}))
    args = [sys.executable, "-m", "jobs.selection_audit", "--documents", "/root/testdata/sf0.001/documents.parquet", "--labels", "/root/testdata/sf0.001/labels.parquet", "--out", str(tmp_path / "audit"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(args, env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0 and "read 200 documents" in done.stderr and "wrote " in done.stderr
    assert sorted(p.split("=")[-1] for p in glob.glob(f"{tmp_path}/audit/lang=*")) == ["de", "en", "es", "fr"]
    args = [sys.executable, "-m", "jobs.light_curve_store", "--events", "/root/testdata/sf0.001/events.parquet", "--customers", "/root/testdata/sf0.001/customer.parquet", "--out", str(tmp_path / "store")]
    done = subprocess.run(args, env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0 and "rows filed in buckets" in done.stderr and "1 batches taken" in done.stderr
    (tmp_path / "c.json").write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError, match="colour"):
        settings("selection_audit", str(tmp_path / "c.json"))
