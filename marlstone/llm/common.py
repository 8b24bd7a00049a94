"""What the operators of this folder share: byte-level word splitting, scratch tables, text columns as bytes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.scratch import scratch_root

UPPER, LOWER_CASE = bytes(range(65, 91)), bytes(range(97, 123))
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes.maketrans(UPPER, LOWER_CASE)
#: The same, and turns the ASCII bytes that are neither letters nor digits into spaces. UTF-8 bytes of 0x80 and
#: above belong to words, so splitting the result gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = bytes(32 if b < 128 and not chr(b).isalnum() else LOWER[b] for b in range(256))

PIECE, BROADCAST_ROWS = 1 << 20, 500_000
Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: The tables to delete when the innermost scope of this thread ends.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def space_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; ``bytes.split`` splits at just these six bytes."""
    return data.translate(LOWER).split() if data else []


def alnum_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return data.translate(ALNUM).split() if data else []


def alnum_pieces(data: bytes | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The same words, of about ``size`` bytes of the text at a time."""
    at, data = 0, data or b""
    while at < len(data):
        end = at + size
        while end < len(data) and ALNUM[data[end]] != 32:
            end += 1
        yield data[at:end].translate(ALNUM).split()
        at = end


def lean(rows: Rows) -> Rows:
    """rows, whose worker gives the memory it no longer uses back when a partition ends: workers are kept for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: computed once, and nothing behind it is
    needed when an executor is lost. The table goes with the scope it is written in, unless keep is set, and with the
    driver if there is none, for a query's result may be read at any time."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    tables = _scope.get()
    df.write.parquet(path)
    if tables is None or keep:
        where, fs = file_system(df.sparkSession, path)
        fs.deleteOnExit(where)
    else:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written in its body when that ends; what is returned may only read tables that are kept."""
    tables: list[str] = []
    token = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in tables:
            where, fs = file_system(spark, path)
            fs.delete(where, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Deletes what an action in its body has shuffled when that action ends; else it stays until the driver collects its
    garbage. Only for actions whose results are written or collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, which reach Python without being decoded."""
    return F.col(column).cast("binary")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, the same whenever it is read: rows of a scan stand where they stood. What has been
    shuffled is written first."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs, "rows", keep=True)
    return docs.withColumn(name, F.monotonically_increasing_id())


def broadcast_keys(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of one long column, marked for a broadcast if it has at most so many rows; else joins shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def free_name(df: DataFrame) -> str:
    """A name that no column of df has."""
    return "_" * (1 + max(map(len, df.columns)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
