"""Helpers shared by the operators: scratch tables in the cluster's shared folder and joins whose broadcast side is counted first."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when its rows and their bytes were counted and are within both bounds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_scratches: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="skyfold-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Written tables of one job. Cuts lineage and survives lost executors, as the files are shared.

    Results read them lazily, so they stay until clear_scratch(), which a caller runs once its results are stored.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skyfold-{uuid.uuid4().hex}"
        _scratches.append(self)

    def write(self, df: DataFrame, name: str, **observed: Column) -> DataFrame:
        """df as a written table; aggregates named in observed are taken in the same job and kept in self.seen."""
        path = f"{self.root}/{name}"
        schema = df.schema
        if observed:
            watch = Observation()
            df = df.observe(watch, *[c.alias(n) for n, c in observed.items()])
        df.write.mode("overwrite").parquet(path)
        if observed:
            self.seen = watch.get
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        """Delete a table that nothing will read again, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root if name is None else f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of all jobs so far; results that still read them must have been stored before."""
    mine = [s for s in _scratches if s.spark is spark]
    for s in mine:
        s.drop()
        _scratches.remove(s)


def _width(c: str, kind: T.DataType, level: int = 0) -> str:
    """About the bytes of a value in memory, as an expression."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"(16L + coalesce(octet_length({c}), 0))"
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return f"(16L + coalesce(aggregate({c}, 0L, (n{level}, x{level}) -> n{level} + {_width(f'x{level}', kind.elementType, level + 1)}), 0L))"
        return f"(16L + greatest(size({c}), 0) * 8)"
    if isinstance(kind, T.MapType):
        return f"({_width(f'map_keys({c})', T.ArrayType(kind.keyType), level)} + {_width(f'map_values({c})', T.ArrayType(kind.valueType), level)})"
    if isinstance(kind, T.StructType):
        return "(8L + " + " + ".join([_width(f"{c}.`{f.name}`", f.dataType, level) for f in kind] or ["0L"]) + ")"
    return "8L"


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    return F.expr(" + ".join(["16L", *[_width(f"`{f.name}`", f.dataType) for f in df.schema]]))


def maybe_broadcast(df: DataFrame, scratch: Scratch | None = None, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, **observed: Column) -> DataFrame:
    """df, written once, with a broadcast hint if its rows and bytes are within the bounds; else for a shuffle join that AQE may split.

    Rows and bytes are counted by the job that writes it, so nothing is computed twice. observed: as in Scratch.write.
    """
    scratch = scratch or Scratch(df.sparkSession)
    stored = scratch.write(df, f"side-{uuid.uuid4().hex[:8]}", rows=F.count(F.lit(1)), bytes=F.coalesce(F.sum(row_bytes(df)), F.lit(0)), **observed)
    return F.broadcast(stored) if scratch.seen["rows"] <= max_rows and scratch.seen["bytes"] <= max_bytes else stored


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the keys come once, from the left."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def with_place(df: DataFrame, order: Sequence[Column | str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with each row's place, from 0, in the order of its group: by a range shuffle, so that no group is one task.

    Order must tell all rows apart, or equal ones come in any order.
    """
    scratch = Scratch(df.sparkSession)
    keyed = df.withColumns({f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)})
    by = [*keys, *[f"__o{i}" for i in range(len(order))]]
    placed = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by[len(keys):]).withColumn("__id", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("__part", F.shiftright("__id", 33)), "placed")
    # The numbers of rows before: one row per part and group, so a window over them is small.
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    joined = join_nulls(placed, maybe_broadcast(parts, scratch), [*keys, "__part"])
    return joined.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__id", "__part", "__first", "__before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
