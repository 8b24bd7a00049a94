"""The operators as functions on DataFrames: thin, so that Catalyst sees the whole query at once.

Join strategies are hints; results never depend on them. A side is broadcast only if its rows and their widths have been
counted and take at most ``BROADCAST_BYTES``, otherwise the join goes by a shuffle on its keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.errors import UnknownColumnError
from marlstone.functions.aggregates import AggregationFn
from marlstone.functions.equality import condition, typed_eq
from marlstone.scratch import scratch_root
from marlstone.sql.ast import Const, Field, Predicate, Term
from marlstone.types import Kind, Schema

BROADCAST_BYTES = 32 << 20
FIXED = {"bigint", "double", "float", "tinyint", "timestamp", "timestamp_ntz"}


def table_scan(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    reader = spark.read.schema(schema.struct) if schema else spark.read
    return reader.parquet(path)


def known(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise UnknownColumnError(", ".join(missing))


def select(df: DataFrame, predicate: Predicate | Column) -> DataFrame:
    """The rows for which the predicate holds."""
    if isinstance(predicate, Predicate):
        known(df, sorted(predicate.fields()))
        predicate = condition(predicate, Schema.of(df.schema))
    return df.filter(predicate)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, in this order; repeated rows stay."""
    known(df, names)
    return df.select(*(F.col(f"`{n}`") for n in names))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def block_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product block by block: each task pairs one partition of either side, so neither is held whole."""
    return left.crossJoin(right.hint("shuffle_replicate_nl"))


def index_select(df: DataFrame, name: str, value: int | str | bool) -> DataFrame:
    """The rows with this value. An equality on a column reaches the Parquet scan, which skips row groups by it."""
    return select(df, Predicate((Term(Field(name), Const(value)),)))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size; of a scan, its compressed bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_bytes(schema: Schema) -> int | None:
    """The most that a row takes, if the types bound it."""
    if any(c.kind is Kind.OTHER and c.spark not in FIXED or c.kind is Kind.VARCHAR and not c.length for c in schema.columns):
        return None
    return 16 + sum(8 + (c.length + 8 if c.kind is Kind.VARCHAR else 8) for c in schema.columns)


def small(df: DataFrame) -> bool:
    """Whether all rows take at most ``BROADCAST_BYTES``, as counted. Only what is estimated to be small is looked at."""
    if size_in_bytes(df) > BROADCAST_BYTES:
        return False
    texts = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema if Schema.of(T.StructType([f])).columns[0].kind in (Kind.VARCHAR, Kind.OTHER)]
    rows, longest = df.agg(F.count("*"), F.max(reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in texts], F.lit(0)).cast("long"))).first()
    return rows * (16 + 16 * len(df.columns) + (longest or 0)) <= BROADCAST_BYTES


def join_condition(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> Column:
    """Equality as statements mean it: of two columns whose types never compare equal, it is false."""
    known(left, [left_name])
    known(right, [right_name])
    columns = {"left": left[f"`{left_name}`"], "right": right[f"`{right_name}`"]}
    fields = T.StructType([T.StructField("left", left.schema[left_name].dataType), T.StructField("right", right.schema[right_name].dataType)])
    return typed_eq(Field("left"), Field("right"), Schema.of(fields), columns)


def index_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Inner join by looking each left row up on the right. The lookup table is a broadcast hash table if the right side
    is small, and one per partition, built after a shuffle on the keys, if not."""
    hinted = right.hint("broadcast") if small(right) else right.hint("shuffle_hash")
    return left.join(hinted, join_condition(left, right, left_name, right_name))


def merge_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Inner join of both sides sorted by their keys; keys of different widths are widened."""
    return left.join(right.hint("merge"), join_condition(left, right, left_name, right_name))


def materialize(df: DataFrame) -> DataFrame:
    """Computes df once for its later uses, as a temporary table in the shared folder; it goes with the driver."""
    path = f"{scratch_root(df.sparkSession)}/temp-{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns)))) if df.columns else df.select(F.lit(0).alias("c0"))  # names may repeat
    plain.write.parquet(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)
    found = df.sparkSession.read.schema(plain.schema).parquet(path)
    return found.toDF(*df.columns) if df.columns else found.select()


def sort(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All rows in ascending order of these columns."""
    known(df, names)
    return df.orderBy(*(F.col(f"`{n}`") for n in names))


def group_by(df: DataFrame, names: Sequence[str], functions: Sequence[AggregationFn]) -> DataFrame:
    """A row for each group; without functions, its key alone. Without names all rows are one group, and an empty input has
    none."""
    known(df, names)
    keys = [F.col(f"`{n}`") for n in names]
    if names and not functions:
        return df.select(*keys).distinct()
    found = df.groupBy(*keys).agg(*(f.aggregate().alias(f.field_name) for f in functions), *([] if names else [F.count("*").alias("__n")]))
    return found if names else found.where(F.col("__n") > 0).drop("__n")
