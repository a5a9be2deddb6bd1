"""Helpers shared by the operators: shared storage, text batches and tokens.

Tokens of the word contracts are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased.
On UTF-8 bytes that is exactly ``text.lower().split()`` of a Python ``bytes`` object, which touches ASCII only.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that Python-side operators turn into tokens at a time; a longer text is one chunk by itself.
CHUNK_CHARS = 1 << 20
#: Entries of a task's memory of words, and rows of a batch that are turned into Python objects at once.
REMEMBER, ROWS = 150_000, 1000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="straitline-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/straitline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in replicated files, not in one executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._straitline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_straitline_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: the context cleaner then deletes the shuffle files of finished steps, and the heap, which
    grows with the events of many tasks, shrinks to what is in use."""
    spark.sparkContext._jvm.System.gc()


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


class Remembered(dict):
    """Values of a function by key, for the life of a task: at most REMEMBER of them, then it starts anew."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) >= REMEMBER:
            self.clear()
        v = self[key] = self.of(key)
        return v


def give_back() -> None:
    """Return what this process has freed to the system; the allocators would keep its pages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over batches of at most ROWS rows; what the task has freed goes back to the system at its end.

    Workers are reused from task to task, and the allocators would keep the pages of the largest task so far.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(i, ROWS) for batch in batches for i in range(0, max(batch.num_rows, 1), ROWS))
        finally:
            give_back()

    return task


@contextlib.contextmanager
def broadcasting(spark: SparkSession, value) -> Iterator:
    """A broadcast that executors drop when the block ends: for values that no later action reads."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.unpersist()


def slices(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``limit`` characters, so a batch never holds all its tokens at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def words(raw: bytes | None) -> list[bytes]:
    """Tokens of the word contracts from UTF-8 bytes."""
    return raw.lower().split() if raw else []


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def count_rows(counts: dict, schema: pa.Schema, limit: int = 50_000) -> Iterable[pa.RecordBatch]:
    """(key, n) batches of a counter."""
    keys, ns = list(counts.keys()), list(counts.values())
    for i in range(0, len(keys), limit):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + limit], type=schema.field(0).type), pa.array(ns[i : i + limit], type=schema.field(1).type)], schema=schema)
