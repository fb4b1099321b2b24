"""Cutting lineage: write a table into the cluster's shared checkpoint folder and read it back."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from histloom.operators import shared_files as fs

SETTING = "spark.checkpoint.dir"
RUN_FILE = "run.json"
# Staged tables are mostly texts and read a few times: smaller files are worth a little more work.
CODEC = "zstd"


@dataclass
class Run:
    """A run's folder below the staging root; a named run numbers its steps to find them again."""

    folder: str = ""
    named: bool = False
    steps: int = 0
    resumed: int = 0


_RUN: ContextVar[Run] = ContextVar("run", default=Run())


def staging_root(spark: SparkSession) -> str:
    """The folder named by the session, which all executors share."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return folder.rstrip("/") + _RUN.get().folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` once. The copy survives lost executors and has short lineage.

    In a named run a step that an earlier attempt finished is read back instead of computed.
    """
    spark, run = df.sparkSession, _RUN.get()
    if not run.named:
        path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=CODEC)
        return spark.read.schema(df.schema).parquet(path)
    path = f"{staging_root(spark)}/{run.steps:05d}-{name}"
    run.steps += 1
    if fs.complete(spark, path):
        run.resumed += 1
    else:
        df.write.mode("overwrite").parquet(path, compression=CODEC)  # over what a lost driver left half written
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_run(spark: SparkSession, name: str | None = None) -> Iterator[Run]:
    """What is staged inside goes into a folder of its own, which is removed at the end.

    With a ``name`` the folder outlives a failure, and the next run of that name goes on after the
    last finished step. Steps are told apart by their order, which the same inputs and parameters
    repeat; two runs of one name must not run at once.
    """
    if name is not None and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"a run's name is letters, digits, dots, dashes and underscores: {name!r}")
    run = Run(f"/run-{uuid.uuid4().hex}" if name is None else f"/named-{name}", name is not None)
    token = _RUN.set(run)
    folder, done = staging_root(spark), False
    try:
        yield run
        done = True
    finally:
        _RUN.reset(token)
        if done or not run.named:
            fs.delete(spark, folder)


def run_identity(spark: SparkSession, fresh: dict) -> dict:
    """What identifies the run: ``fresh``, or in a resumed run what its first attempt wrote.

    ``fresh["inputs"]`` must be that of the first attempt: steps of other parameters are no use.
    """
    if not _RUN.get().named:
        return fresh
    path = f"{staging_root(spark)}/{RUN_FILE}"
    if not fs.exists(spark, path):
        fs.write_text(spark, path, json.dumps(fresh))
        return fresh
    found = json.loads(fs.read_text(spark, path))
    if found["inputs"] != fresh["inputs"]:
        raise ValueError("a run of this name was begun with other parameters")
    return found
