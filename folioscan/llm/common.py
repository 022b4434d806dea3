"""Helpers shared by the training-data operators: scratch tables, gapless numbering, hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that one task numbers at most, about; more rows make more ranges.
RANGE_ROWS = 1_000_000
#: Ranges at most: what a task orders grows with the rows beyond MOST_RANGES times that many, and spills to disk.
MOST_RANGES = 1 << 16
#: Parts of the rows without a number to order by.
NULL_PARTS = 1024
#: At most this many keys can each hold more than 1/HOT_KEYS of the rows, which bounds what is broadcast.
HOT_KEYS = 1000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local master, as in tests, may do without: it
    gets a temporary one that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("folioscan.scratch.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioscan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("folioscan.scratch.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what follows neither repeats the work nor depends on
    any executor."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """The right side of a join that is to be shuffled at any size. Spark judges a written table by its compressed files
    and would send one that takes many times that much on the driver."""
    return df.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, and no others: further columns of the input can't clash with the operator's own."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in types.items()])


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, or with underscores before it, that no column of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def range_bounds(df: DataFrame, column: str, rows: int, rows_each: int = RANGE_ROWS) -> list:
    """Values that cut an orderable numeric column into ranges of about rows_each rows, at most MOST_RANGES."""
    n = min(MOST_RANGES - 1, rows // rows_each)
    if n < 1:
        return []
    at = [(i + 1) / (n + 1) for i in range(n)]
    got = df.agg(F.percentile_approx(column, at, max(20_000, 4 * n))).first()[0] or []
    return sorted({int(x) for x in got if x is not None})


def range_of(column: Column, bounds: list) -> Column:
    """The number of bounds that the column exceeds; nulls are in range -1, before all others."""
    if not bounds:
        return F.when(column.isNull(), -1).otherwise(0)
    # a step function of the sorted bounds, evaluated by halving
    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column <= F.lit(bounds[mid]), cut(lo, mid)).otherwise(cut(mid + 1, hi))

    if len(bounds) <= 64:
        return F.when(column.isNull(), -1).otherwise(cut(0, len(bounds)))
    sorted_bounds = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def search(x: pd.Series, known: pd.Series) -> pd.Series:
        at = np.searchsorted(sorted_bounds, x.to_numpy(np.int64), "left").astype(np.int32)
        return pd.Series(np.where(known.to_numpy(bool), at, -1), dtype="int32")

    return search(F.coalesce(column.cast("bigint"), F.lit(0)), column.isNotNull())


def ordered_part(column: Column, tie: Column, bounds: list) -> Column:
    """A part for number_gapless() along the order of column, nulls first, and then of tie, a number below 2^32. Nulls,
    of which there may be very many, are in NULL_PARTS parts by tie."""
    return F.when(column.isNull(), F.shiftright(tie.cast("bigint") * NULL_PARTS, 32) - NULL_PARTS).otherwise(range_of(column, bounds)).cast("int")


def number_gapless(df: DataFrame, group: list[str], part: str, order: list[Column], name: str) -> DataFrame:
    """Adds a number, gapless from 0 within each group, in the order given.

    part is an integer column that must not decrease along the order: no task numbers more than one part of one
    group, and the parts' starts come from their counts, a small aggregate. df should be a written table, as it is
    read twice.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy(part) if group else Window.partitionBy(F.lit(0)).orderBy(part)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(*group, part, "_start")
    for c in (*group, part):
        starts = starts.withColumnRenamed(c, f"_s_{c}")
    inner = Window.partitionBy(*group, part).orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(inner) - 1)
    on = [numbered[c].eqNullSafe(starts[f"_s_{c}"]) for c in (*group, part)]
    return numbered.join(starts, on).withColumn(name, (F.col("_row") + F.col("_start")).cast("bigint")).drop("_row", "_start", *[f"_s_{c}" for c in (*group, part)])
