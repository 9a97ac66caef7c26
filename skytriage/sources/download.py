"""Raw files over HTTP: one at a time, or many at once, a task each."""

from __future__ import annotations

import os
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession

from .shared import filesystem

#: Bytes that are read at a time.
BLOCK = 16 << 20


def fetch(url: str, target: str, again: bool = False) -> int:
    """Copies a URL to a target URI and returns its bytes; a target that is there is left alone, unless asked `again`.

    What has arrived goes to a name of its own, which is moved when it is whole: as many bytes as the server announced."""
    fs, path = filesystem(target)
    there = fs.get_file_info(path)
    if there.is_file and not again:
        return there.size
    fs.create_dir(os.path.dirname(path), recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex[:8]}.part", 0
    with urllib.request.urlopen(url) as source:  # noqa: S310  the caller names the URL
        announced = source.headers.get("Content-Length")
        with fs.open_output_stream(part) as out:
            while block := source.read(BLOCK):
                out.write(block)
                size += len(block)
    if announced is not None and int(announced) != size:
        fs.delete_file(part)
        raise OSError(f"{url} ended after {size} of {announced} bytes")
    fs.move(part, path)
    return size


def urls_of(folder: str) -> list[str]:
    """URLs of a folder's files under the folder's own scheme and host, hidden ones left out."""
    fs, path = filesystem(folder)
    found = fs.get_file_info(FileSelector(path))
    base = folder.rstrip("/") if "://" in folder else f"file://{path.rstrip('/')}"
    return sorted(f"{base}/{f.base_name}" for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def fetch_all(spark: SparkSession, urls: list[str], folder: str, at_once: int = 4) -> DataFrame:
    """Rows (url, target, bytes): files of the URLs' names in a folder that driver and executors share, `at_once` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("url").to_pylist(), batch.column("target").to_pylist(), strict=True)
            yield batch.append_column("bytes", pa.array([fetch(*x) for x in pairs], pa.int64()))

    names = [(u, f"{folder}/{os.path.basename(u.split('?')[0])}") for u in urls]
    if len({t for _, t in names}) < len(names):
        raise ValueError("two URLs have the same name")
    rows = spark.createDataFrame(names, "url string, target string").repartition(max(1, min(at_once, len(names))))
    return spark.createDataFrame(rows.mapInArrow(run, "url string, target string, bytes long").collect(), "url string, target string, bytes long")  # a row for each file
