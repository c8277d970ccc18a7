"""Helpers shared by the operators: tables, the shared folder, file access from tasks, Arrow output."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reqlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder of the shared store, for use inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class TaskFile:
    """A file that a task writes under a name of its attempt and then moves to its final name.

    A retried or duplicated task writes the same rows and replaces the file as a whole, so a reader
    never sees half a file.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        self.name = f"{stem}{suffix}"
        self.final = f"{base}/{self.name}"
        self.temp = f"{base}/_{stem}-{ctx.taskAttemptId() if ctx else 0}-{uuid.uuid4().hex[:8]}.tmp"
        self.stream = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> str:
        self.stream.close()
        self.fs.move(self.temp, self.final)
        return self.name


def open_file(folder: str, name: str):
    fs, base = filesystem(folder)
    return fs.open_input_file(f"{base}/{name}")


#: Entries that a worker's cache holds at most; it is cleared then, which costs time only.
REMEMBERED = 1 << 17
_caches: dict[Hashable, dict] = {}


def remembered(what: Hashable) -> dict:
    """The worker's cache of this name. Caches of other names are dropped, as Spark reuses a worker for other
    operators, whose caches would add up."""
    if len(_caches.get(what) or ()) > REMEMBERED or what not in _caches:
        _caches.clear()
        _caches[what] = {}
    return _caches[what]


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the machine: Spark keeps idle workers, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
           ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives its memory back at the end of each task."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


#: Bytes of an Arrow batch that goes to Python: the JVM and the worker each hold a few copies of one, for each task.
BATCH_BYTES = 1 << 22
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
           schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(tidied(run), schema)`` for rows with texts: batches end at about BATCH_BYTES or one longer
    row. Spark reads the size from the session when the rows are computed, so it stays set; a session that has a
    size of its own keeps it."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(tidied(run), schema)


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def per_batch(schema: pa.Schema, f: Callable[[pa.RecordBatch], list[tuple]],
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function from one that turns a batch into rows of ``schema``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield arrow_rows(schema, f(b))
    return run
