"""Sinks: Parquet and CSV tables, canonical JSON manifests and metrics, Markdown reports."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.population import class_balance, selection_summary
from .shared import filesystem


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet by default; "csv" gives gzip files with a header."""
    out = df.write.mode("overwrite")
    out = out.partitionBy(*by) if by else out
    out.parquet(path) if kind == "parquet" else out.option("header", True).option("compression", "gzip").csv(path)


def sha256_of(uri: str) -> str:
    """Digest of one file, streamed in blocks of 1 MiB."""
    fs, path = filesystem(uri)
    digest = hashlib.sha256()
    with fs.open_input_stream(path) as source:
        while block := source.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def table_digest(spark: SparkSession, uri: str) -> str:
    """Digest of a folder: of its files' digests, in the order of their names. Tasks read the files; hidden ones are left out."""
    fs, path = filesystem(uri)
    found = fs.get_file_info(FileSelector(path, recursive=True))
    names = sorted(f.path for f in found if f.is_file and not any(p.startswith((".", "_")) for p in f.path[len(path) :].strip("/").split("/")))
    scheme = uri.split("://")[0] + "://" if "://" in uri else "file://"
    host = uri.split("://")[1].split("/")[0] if "://" in uri and not uri.split("://")[1].startswith("/") and path.startswith("/") else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sha256_of(f"{scheme}{host}{n}") for n in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out)], ["name", "digest"])

    if not names:
        return hashlib.sha256().hexdigest()
    spread = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 1 << 12)))
    digests = dict(map(tuple, spread.mapInArrow(run, "name string, digest string").collect()))  # a row for each file
    return hashlib.sha256("".join(f"{digests[n]}\n" for n in names).encode()).hexdigest()


#: Bits of each of the four sums of a content digest.
_LANE = 1 << 64


def content_digest(df: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by..., n, digest) of what a table holds, whatever its files, partitions and order of rows.

    Each row's SHA-256 is cut into four numbers, which are summed over the rows modulo 2^64: equal multisets of rows give
    equal digests, repeated rows count, and tasks add up their own rows first. Values enter as text with their length in
    front, so that neither a null nor a boundary can be mistaken; columns enter in the order of their names."""
    names = sorted(columns or [c for c in df.columns if c not in by])
    text = lambda c: F.col(c).cast("string")
    cell = lambda c: F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n"))
    hashed = F.sha2(F.concat_ws(",", *(cell(c) for c in names)), 256)
    rows = df.select(*by, hashed.alias("_h"))
    lane = lambda k: F.sum(F.conv(F.substring("_h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).alias(f"_{k}")
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *(lane(k) for k in range(4)))
    part = lambda k: F.lpad(F.lower(F.conv(F.pmod(F.coalesce(f"_{k}", F.lit(0)), F.lit(str(_LANE)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0")
    return s.select(*by, "n", F.concat(*(part(k) for k in range(4))).alias("digest"))


def added(*digests: str) -> str:
    """The digest of tables put together, from their own."""
    lanes = [[int(d[16 * k : 16 * k + 16], 16) for d in digests] for k in range(4)]
    return "".join(f"{sum(x) % _LANE:016x}" for x in lanes)


def plain(value):
    """Numbers as JSON has them; NaN and infinities become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_text(uri: str, text: str) -> None:
    """Whole or not at all: the text goes to a name of its own, which is then moved."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(f"{path}.part") as out:
        out.write(text.encode())
    fs.move(f"{path}.part", path)


def read_text(uri: str) -> str:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as source:
        return source.read().decode()


def write_json(uri: str, payload: dict) -> None:
    """Sorted keys, two spaces, a line feed at the end."""
    write_text(uri, json.dumps(plain(payload), sort_keys=True, indent=2) + "\n")


def metrics(df: DataFrame, *keys: str) -> dict:
    """A small result as nested mappings by its key columns."""
    out: dict = {}
    for r in df.collect():  # a report's rows
        row, at = r.asDict(recursive=True), out
        for k in keys[:-1]:
            at = at.setdefault(str(row.pop(k)), {})
        if keys:
            at[str(row.pop(keys[-1]))] = row
        else:
            out = row
    return plain(out)


def manifest(name: str, path: str, df: DataFrame, parent: str | None = None, config: dict | None = None) -> dict:
    """What a stage wrote: counts by class, digests of the table and of its parent."""
    payload = {"name": name, "created": datetime.now(UTC).isoformat(timespec="seconds"), "rows": df.count(), "sha256": table_digest(df.sparkSession, path), "content": content_digest(df).first().digest, "config": config or {}}
    if "true_target" in df.columns:
        payload["classes"] = {str(r.true_target): r.n for r in class_balance(df).collect()}
    if "S" in df.columns:
        payload["selection"] = {str(r.true_target) if r.true_target is not None else "overall": {"n_true": r.n_true, "n_biased": r.n_biased, "retention": r.retention} for r in selection_summary(df).collect()}
    if parent is not None:
        payload["parent_sha256"] = table_digest(df.sparkSession, parent)
    return payload


def markdown(title: str, sections: dict[str, DataFrame], places: int = 4) -> str:
    """A report with a table for each small result."""
    show = lambda v: "-" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", ""]
    for head, df in sections.items():
        out += [f"## {head}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(show(v) for v in r) + " |" for r in df.collect()]
        out.append("")
    return "\n".join(out)
