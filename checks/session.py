"""A folder for staged tables in local sessions that name none; clusters must name their own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def with_folder(spark: SparkSession) -> SparkSession:
    """Name a temporary folder if nothing is named and everything runs in this one process."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    master = spark.sparkContext.master
    if not named and (master == "local" or master.startswith("local[")):
        spark.conf.set(SETTING, tempfile.mkdtemp(prefix="histloom-"))
    return spark
