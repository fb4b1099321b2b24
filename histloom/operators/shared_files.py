"""Files and folders of the shared file system, through Spark's own file-system client."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote the folder ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; the target must not exist, its parent is made."""
    system, where = _located(spark, source)
    _, there = _located(spark, target)
    system.mkdirs(there.getParent())
    if system.exists(there) or not system.rename(where, there):
        raise OSError(f"cannot move {source} to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; none if there is no such folder."""
    system, where = _located(spark, path)
    if not system.exists(where):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(where) if f.isDirectory())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}"
    system, where = _located(spark, draft)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, draft, path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
