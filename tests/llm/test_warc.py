"""Archives against their pages, and the merge against sorting."""

import base64
import gzip
import hashlib
import random

from skytriage.llm import warc as W


def expected(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        owner = least.get(h or "")
        again = owner is not None and owner != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(8)
    out = [(i, f"https://WWW.host{rnd.randrange(6)}.example.org/p{rnd.randrange(9)}?q={i % 3}#f", f"<html>{rnd.randrange(40)}é\r\n\r\nWARC/1.1</html>") for i in range(300)]
    out += [(400, None, None), (401, "", ""), (402, "http://[bad", None), (None, "http://a.b/", "<html>only null"), (None, "http://a.b/", ""), (403, "http://a b\r\n.c/", "x" * 300000), (17, out[17][1], out[17][2]), (404, "http://hot.example/", "hot")]
    return out + [(500 + i, "http://hot.example/", "hot") for i in range(200)]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 60)
    monkeypatch.setattr(W, "FAN_IN", 2)
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, position string").repartition(5)
    folder = f"file://{tmp_path}/w"
    got = W.archive(df, folder=folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(data)
    order = [(r.url_key, W.capture_time(r.page_id), -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: r.position)]
    assert sorted(r.position for r in got) == list(range(len(data))) and order == sorted(order)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert text.count(b"WARC-Record-ID") == len(data)
    assert W.archive(df.limit(0), folder=f"{folder}e").count() == 0


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in W.archive(df, least_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(12):
        runs = [sorted((str(rnd.randrange(30)), "t", rnd.randrange(5), 0, 0, 0) for _ in range(rnd.randrange(20))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_key():
    assert W.url_key("https://www.Blog.example.com:80/A/b?Q=1#x") == "com,example,blog)/a/b?q=1"
    assert W.url_key(None) == ")/" and W.url_key("http://[bad") == "http://[bad"


def test_ranges_stay_even_as_captures_grow(spark, tmp_path, monkeypatch):
    """Samples grow with the ranges: 4,000 captures, a third of one URL, in some 80 ranges of about 50."""
    monkeypatch.setattr(W, "RANGE_ROWS", 50)
    df = spark.createDataFrame([(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i % 97}.example/{i}", "x") for i in range(4000)], "page long, url string, html string").repartition(20)
    folder = f"file://{tmp_path}/r"
    W.write_archives(df, folder).write.parquet(f"{folder}/runs")
    index = W.merge_runs(spark, folder, spark.read.parquet(f"{folder}/runs"))
    sizes = [r["count"] for r in index.groupBy("range").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 70 and max(sizes) < 250
