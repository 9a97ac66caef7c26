"""WARC archives of pages, and their capture index by external merging.

Each writing task fills one archive (a gzip member per record) and, sorted by (URL key, time, page, place), one run of
its captures. Runs are merged by loser trees: groups of FAN_IN runs become one as long as there are more, then every
range between sampled splitters is merged from all runs at once. The result is one globally ordered capture history,
whose places in the archives lead back to the records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_name, by_bytes, filesystem, publish, ready, shared_folder

#: Runs that one merge reads, captures in a range at about, most ranges, captures in a run's batch, keys sampled from a run
#: and for a range.
FAN_IN, RANGE_ROWS, RANGES, BATCH_ROWS, RUN_SAMPLES, SAMPLES = 64, 200_000, 1 << 16, 1024, 32, 32
SLICE_BYTES = 1 << 20
#: Captures without a time of their own are a second apart, from here, by their page's id.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A capture: the first five columns are its place in the global order.
_CAPTURE = pa.schema([("url_key", pa.string()), ("time", pa.string()), ("page", pa.int64()), ("file", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
Capture = tuple[str, str, int, int, int, int]


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, in lower case; scheme, port, user and fragment are left out."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    labels = host.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def capture_time(page: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page or 0) % (50 * 365 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int | None, url: str | None, payload: bytes, owner: int | None, revisit: bool) -> bytes:
    """A gzip member with a response record or, without the payload, a revisit record that refers to page `owner`."""
    name = f"urn:page:{'none' if page is None else page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c for c in url or "" if c > " ") or name
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {capture_time(page)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{owner}>"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and HTTP body of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version.encode() != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


class LoserTree:
    """Merges sorted iterators: an inner node holds the loser of its match, so a taken head is replaced by one match per level."""

    def __init__(self, sources: list[Iterator[Capture]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * len(sources)
        self.winner = self._first(1) if sources else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _first(self, node: int) -> int:
        n = len(self.sources)
        if node >= n:
            return node - n
        a, b = self._first(2 * node), self._first(2 * node + 1)
        won, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won

    def __iter__(self) -> Iterator[Capture]:
        n = len(self.sources)
        while n and (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.sources[at], None)
            node = (at + n) // 2
            while node:
                if not self._beats(at, self.losers[node]):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def write_run(uri: str, captures: Iterator[Capture]) -> None:
    def write(out) -> None:
        with pa.ipc.new_file(out, _CAPTURE) as file:
            held: list[Capture] = []
            for c in captures:
                held.append(c)
                if len(held) == BATCH_ROWS:
                    file.write_batch(_batch(held))
                    held = []
            if held:
                file.write_batch(_batch(held))

    publish(uri, write, attempt_name())


def _batch(captures: list[Capture]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*captures, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)


def read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[Capture]:
    """A run's captures from key `low` up to `high`; batches before are skipped by halving."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as source:
        file = pa.ipc.open_file(source)
        start = 0
        if low is not None:
            a, b = 0, file.num_record_batches  # the last batch that begins at or before low
            while b - a > 1:
                mid = (a + b) // 2
                first = next(zip(*(c.slice(0, 1).to_pylist() for c in file.get_batch(mid).columns), strict=True))
                a, b = (mid, b) if first[: len(low)] <= low else (a, mid)
            start = a
        for k in range(start, file.num_record_batches):
            for c in zip(*(x.to_pylist() for x in file.get_batch(k).columns), strict=True):
                if high is not None and c[: len(high)] >= high:
                    return
                if low is None or c[: len(low)] >= low:
                    yield c


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page, url, html) and returns a row (run, captures, sample) per archive and run.

    Of equal payloads of at least least_bytes bytes the smallest page is the response. Payloads that occur once need no
    entry in the join; it is broadcast only below Spark's own size limit, and a skewed payload is split by AQE beyond.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("bytes"))
    owners = pages.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.min("page").alias("owner"), F.count("*").alias("times")).where("times > 1").select("sha1", "bytes", "owner")
    owners.write.parquet(f"{folder}/owners")
    owners = spark.read.parquet(f"{folder}/owners")
    rows = pages.join(owners, ["sha1", "bytes"], "left").select("page", "url", "html", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        captures: list[Capture] = []

        def write(out) -> None:
            at = 0
            for batch in by_bytes(batches, "html", SLICE_BYTES):
                for page, url, text, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    member = record(page, url, text.encode(), owner, owner is not None and owner != page)
                    out.write(member)
                    captures.append((url_key(url), capture_time(page), -1 if page is None else page, k, at, len(member)))
                    at += len(member)

        publish(f"{folder}/pages-{k:08d}.warc.gz", write, attempt_name())
        if captures:
            captures.sort()
            write_run(f"{folder}/run-0-{k:08d}.arrow", iter(captures))
            step = max(1, len(captures) // RUN_SAMPLES)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(captures)], pa.int64()), pa.array([[dict(zip(("url_key", "time", "page"), c[:3], strict=True)) for c in captures[step // 2 :: step]]], pa.list_(pa.struct([("url_key", pa.string()), ("time", pa.string()), ("page", pa.int64())])))], ["run", "captures", "sample"])

    return rows.mapInArrow(run, "run long, captures long, sample array<struct<url_key:string,time:string,page:long>>")


def merge_runs(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """Rows (range, place, url_key, time, page, file, offset, length): all captures, ordered by (range, place).

    Only run numbers and SAMPLES keys for each range reach the driver. A range holds about RANGE_ROWS captures whatever URL
    they are of, since splitters are whole keys (URL, time, page); beyond RANGES ranges it holds more. Its merge streams,
    so it takes FAN_IN batches of memory at any size.
    """
    total = runs.agg(F.sum("captures")).first()[0] or 0
    ranges = max(1, min(-(-total // RANGE_ROWS), RANGES))
    drawn = runs.select(F.explode("sample").alias("s")).select("s.*")
    many = drawn.count()
    if many > SAMPLES * ranges:
        drawn = drawn.where(F.pmod(F.xxhash64("url_key", "time", "page"), F.lit(1 << 20)) < ((SAMPLES * ranges) << 20) // many)
    keys = sorted(map(tuple, drawn.collect()))
    ranges = max(1, min(ranges, len(keys)))
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    names = [f"run-0-{k:08d}.arrow" for (k,) in sorted(runs.select("run").collect())]
    level = 0
    while len(names) > FAN_IN:
        level += 1
        groups = [names[i : i + FAN_IN] for i in range(0, len(names), FAN_IN)]
        names = [f"run-{level}-{i:08d}.arrow" for i in range(len(groups))]

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                    write_run(f"{folder}/{name}", iter(LoserTree([read_run(f"{folder}/{p}", None, None) for p in parts])))
                yield batch.select(["name"])

        spark.createDataFrame(list(zip(names, groups, strict=True)), "name string, parts array<string>").repartition(len(groups)).mapInArrow(join, "name string").collect()

    edges = [None, *cuts, None]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("range").to_pylist():
                held: list[Capture] = []
                place = 0
                for c in LoserTree([read_run(f"{folder}/{n}", edges[k], edges[k + 1]) for n in names]):
                    held.append(c)
                    if len(held) == 4096:
                        yield _placed(held, k, place)
                        place, held = place + len(held), []
                if held:
                    yield _placed(held, k, place)

    spread = spark.createDataFrame([(k,) for k in range(len(cuts) + 1)], "range int").repartition(len(cuts) + 1)
    return spread.mapInArrow(merge, "range int, place long, url_key string, time string, page long, file long, offset long, length long")


def _placed(captures: list[Capture], k: int, place: int) -> pa.RecordBatch:
    batch = _batch(captures)
    return pa.RecordBatch.from_arrays([pa.array([k] * len(captures), pa.int32()), pa.array(np.arange(place, place + len(captures))), *batch.columns], ["range", "place", *_CAPTURE.names])


def read_archives(folder: str, index: DataFrame) -> DataFrame:
    """Rows (page, payload_bytes, payload_digest, record_type, refers_to, url_key, position) of the index's records.

    Each archive is read front to back; a response's digest is held against its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, source = None, None
        for batch in batches:
            out = []
            for key, number, offset, length, position in zip(*(batch.column(c).to_pylist() for c in ("url_key", "file", "offset", "length", "position")), strict=True):
                if number != file:
                    fs, path = filesystem(f"{folder}/pages-{number:08d}.warc.gz")
                    file, source = number, io.BufferedReader(fs.open_input_file(path), 1 << 18)
                source.seek(offset)
                fields, http, body = parse(source.read(length))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                of = lambda x: None if x in (None, "<urn:page:none>") else int(x.removeprefix("<urn:page:").removesuffix(">"))
                out.append((of(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, of(fields.get("WARC-Refers-To")), key, position))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position"])

    files = index.select("file").distinct().count()
    ordered = index.repartition(max(1, min(files, 1 << 14)), "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, position long")


def archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes archives and index under the shared folder (or `folder`), reads them back: a row per page.

    Rows (id, payload_bytes, payload_digest, record_type, refers_to, url_key, position); position is the capture's place
    in the global order of (URL key, time, page). A null html is the empty payload. Of equal payloads all rows with the
    smallest id are responses, so repeated rows of it are too; rows with a null id revisit it, and are responses where
    no row of the payload has an id. A null URL has an empty host. Other columns are not read; an empty table gives no
    rows. Ids are integers.
    """
    spark = ready(pages.sparkSession)
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    write_archives(rows, folder, least_bytes).write.parquet(f"{folder}/runs")
    merge_runs(spark, folder, spark.read.parquet(f"{folder}/runs")).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    counts = dict(index.groupBy("range").count().collect())
    base, bases = 0, []
    for k in range(max(counts, default=-1) + 1):
        bases.append(base)
        base += counts.get(k, 0)
    index = index.withColumn("position", F.col("place") + F.element_at(F.array(*map(F.lit, bases or [0])), F.col("range") + 1))
    return read_archives(folder, index).withColumnRenamed("page", id_col)

