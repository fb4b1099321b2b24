import re

import pytest
from pyspark.sql import functions as F

from histloom.operators import keyfilter
from histloom.sources import files as fs

ON = ["repo", "sha"]


def frames(spark, n_rows=20_000, n_keys=300):
    rows = spark.range(n_rows).select(
        F.concat(F.lit("r"), F.col("id") % 7).alias("repo"), F.col("id").cast("string").alias("sha"),
        F.repeat(F.lit("d"), 50).alias("diff"), F.col("id").alias("_kept"),
    )
    keys = rows.filter(F.col("_kept") % (n_rows // n_keys) == 0).select(*ON)
    return rows, keys


def test_no_key_is_lost_and_few_others_pass(spark):
    rows, keys = frames(spark)
    kept = keyfilter.maybe_in(rows, keys, ON)
    assert kept.columns == rows.columns
    wanted = {tuple(r) for r in keys.collect()}
    got = {(r.repo, r.sha) for r in kept.collect()}
    assert wanted <= got and len(got) - len(wanted) < len(wanted) + 20_000 / keyfilter.BITS_PER_KEY
    assert kept.join(keys, ON, "left_semi").count() == len(wanted) == 304


@pytest.mark.parametrize("most", [keyfilter.PIECE, 1 << 18, 305, 304])
def test_any_size_of_the_bitmap(spark, most):
    rows, keys = frames(spark)
    kept = keyfilter.maybe_in(rows, keys, ON, most=most)
    assert kept.join(keys, ON, "left_semi").count() == 304
    # As many keys as bits: no filter.
    assert (kept.count() == 20_000) == (most == 304)


def test_bits_equal_a_set_of_places(spark):
    rows, keys = frames(spark, n_keys=5000)
    bits = 1 << 17
    place = F.pmod(F.xxhash64(*ON), F.lit(bits))
    wanted = {r.p for r in keys.select(place.alias("p")).collect()}
    found = set()
    for r in keyfilter.bitmap(keys, ON, bits).collect():
        found |= {r._piece * keyfilter.PIECE + 8 * i + b
                  for i, byte in enumerate(r._bitmap) for b in range(8) if byte >> b & 1}
    assert found == wanted


def test_sizes():
    assert keyfilter.bits_for(0) == keyfilter.bits_for(2048) == keyfilter.PIECE
    assert keyfilter.bits_for(2049) == 2 * keyfilter.PIECE
    assert keyfilter.bits_for(10**12) == keyfilter.MAX_BITS


def test_empty_null_and_repeated_keys(spark):
    rows, keys = frames(spark)
    assert keyfilter.maybe_in(rows, keys.limit(0), ON).count() == 0
    assert keyfilter.maybe_in(rows.limit(0), keys, ON).count() == 0
    odd = spark.createDataFrame([(None, "1", "x"), ("r1", None, "y"), ("r1", "1", "z")], "repo string, sha string, diff string")
    both = odd.select(*ON).union(odd.select(*ON))
    assert keyfilter.maybe_in(odd, both, ON).count() == 3
    assert [r.diff for r in fs.files_of(odd, both).collect()] == ["z"]


def test_rejected_diffs_cross_no_exchange(spark, tmp_path):
    rows, keys = frames(spark)
    rows.write.parquet(f"{tmp_path}/files")
    keys.write.parquet(f"{tmp_path}/keys")
    files, staged = spark.read.parquet(f"{tmp_path}/files"), spark.read.parquet(f"{tmp_path}/keys")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fs.files_of(files, staged)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "diff" in line)
    exchange = max(i for i, line in enumerate(lines[:scan]) if re.search(r"\bExchange hashpartitioning", line))
    between = "\n".join(lines[exchange:scan])
    # From the scan upwards: the bitmap's join and filter, then the exchange.
    assert "BroadcastHashJoin" in between and "BuildRight" in between
    assert "SortMergeJoin" in "\n".join(lines[:exchange])
