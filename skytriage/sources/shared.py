"""Files that driver and executors share: their folder, file systems by URI, and tables that are written once and read again."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one process, as in tests.
_OWN_SHARED = "file:///tmp/checkpoints"


def shared_base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or _OWN_SHARED).rstrip("/")


#: Folders of the scopes that are open, the innermost last.
_open: list[list[str]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Folders made inside go at its end. Frames that read them have to be read or written inside too."""
    own: list[str] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.remove(own)
        for uri in own:
            discard(uri)


_later: list[str] = []


def _forget_all() -> None:
    for uri in _later:
        _forget(uri)


atexit.register(_forget_all)


def shared_folder(spark: SparkSession, what: str) -> str:
    """URI of a new folder under the shared one; it goes when the scope ends that it is made in, or else when the driver ends."""
    uri = f"{shared_base(spark)}/{what}-{uuid.uuid4().hex}"
    (_open[-1] if _open else _later).append(uri)
    return uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def discard(uri: str) -> None:
    """Removes a folder of intermediate files that nothing reads any more."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def _forget(uri: str) -> None:
    try:
        discard(uri)
    except Exception:  # noqa: BLE001  the process ends; a store that cannot be reached any more keeps its files
        pass


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what follows starts from files, not from their lineage."""
    folder = shared_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: for narrow rows that cost far more time than their bytes say.
    A table of more splits than that stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
