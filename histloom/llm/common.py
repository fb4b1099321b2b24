"""Helpers of several operators: shipping code, staging, sizes, dense positions."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histloom.operators.staging import staging_root


def by_value(module_name: str) -> None:
    """Send the functions of a module to executors by value, so they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path nobody else uses in the folder that the session shares."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(
    df: DataFrame, name: str, compression: str = "snappy", options: dict[str, str] | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, safe to lose tasks.

    ``options`` are the Parquet writer's own."""
    path = fresh_folder(df.sparkSession, name)
    df.write.options(**(options or {})).option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans run inside hand at most ``rows`` rows at a time to Python; for rows of megabytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (cases ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(df: DataFrame, *more: Column) -> Column:
    """64-bit hash of the row's hashable columns; equal rows have equal hashes."""
    usable = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()
              and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*more, *usable)


def placed(
    df: DataFrame, group: list[str], order: list[str], name: str, size: str | None = None,
    label: str = "placed",
) -> DataFrame:
    """Position from 0 of each row within its group by ``order``, from one range sort.

    A row's place is the offset of its (group, partition), a running sum over one row per partition
    and group, plus its place there: slices follow the rows, whatever their values, so no group and
    no run of rows that share their first keys is one task's. ``order`` must tell rows apart (end it
    with a column of their own), group columns must not be null, and ``df`` should be staged: it is
    sampled, then sorted. ``size`` also adds the number of rows in the group.
    """
    columns = df.columns
    at, part, first, n, offset, total = (
        fresh(df, c) for c in ("_at", "_part", "_first", "_n", "_offset", "_total")
    )
    ranked = df.orderBy(*group, *order).withColumn(at, F.monotonically_increasing_id())
    # The partition's number stands above the lower 33 bits.
    ranked = stage(ranked, label).withColumn(part, F.shiftright(at, 33))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(*group, part)
        .agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
        .select(
            *group,
            part,
            (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(offset),
            F.sum(n).over(whole).alias(total),
        )
    )
    more = [F.col(total).alias(size)] if size else []
    return ranked.join(offsets, [*group, part]).select(
        *[F.col(f"`{c}`") for c in columns], (F.col(at) + F.col(offset)).alias(name), *more
    )
