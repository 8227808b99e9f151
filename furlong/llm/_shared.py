"""Helpers that the operators share: shared-folder tables and what Python workers keep."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="spark-shared-")
        _OWN["dir"] = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there, and lost executors cost no more than a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.toString().split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name that a table doesn't have, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most ``BATCH_ROWS`` rows, whole texts being long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_CACHES: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None] | None = None) -> None:
    """At the start of a task: drops what other operators' tasks have kept in this Python worker; ``release`` drops this one's."""
    for other in [x for x in _CACHES if x != name]:
        _CACHES.pop(other)()
    if release is not None:
        _CACHES[name] = release


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and what it keeps is missing to the others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(name: str, release: Callable[[], None] | None = None):
    """Decorates a function over Arrow batches: claims the worker's memory at the start, gives back what is free at the end."""

    def decorate(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @functools.wraps(work)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim(name, release)
            give_back()
            try:
                yield from work(batches)
            finally:
                give_back()

        return run

    return decorate
