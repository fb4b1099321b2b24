"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The hottest HOT_KEYS keys are treated apart. Every other key then holds at most
# 1 / HOT_KEYS of the rows, so this fixed number bounds both the broadcast and the skew.
HOT_KEYS = 4096
HOT_MIN_ROWS = 100_000
SALTS = 64


def first_n_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    spread_by: list[str],
    rank: str = "rank",
    salts: int = 32,
    size: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group in ``order``, with their 1-based ``rank``.

    Two levels: rows are ranked within (group, salt) first, and only the at most salts x n rows of
    a group that can still qualify are ranked together. ``order`` must be total within a group.
    ``size`` names a column for the number of all rows of the group, counted by the same windows:
    every (group, salt) keeps its first row, which carries the count of its rows.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    salted, whole = Window.partitionBy(*group, "_salt"), Window.partitionBy(*group)
    rows = df.withColumn("_salt", salt).withColumn(rank, F.row_number().over(salted.orderBy(*order)))
    if size:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(salted))
    rows = rows.filter(F.col(rank) <= n)
    if size:
        counts = F.sum(F.when(F.col(rank) == 1, F.col("_n"))).over(whole)
        rows = rows.withColumn(size, counts).drop("_n")
    rows = rows.withColumn(rank, F.row_number().over(whole.orderBy(*order)))
    return rows.filter(F.col(rank) <= n).drop("_salt")


def first_n_by_choice(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    choices: list[tuple[Column, int | None]],
    spread_by: list[str],
    bits: str,
    salts: int = 32,
) -> DataFrame:
    """Several such choices from one pass: bit i of ``bits`` is set for the first n_i rows of a group
    that fulfil condition i (None: all that do). Rows without a bit are left out.

    Ranks are running counts of the rows that fulfil a condition, on the same two levels.
    """

    def taken(window: Window) -> Column:
        running = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        flags = []
        for i, (condition, n) in enumerate(choices):
            chosen = F.coalesce(condition, F.lit(False))
            if n is not None:
                chosen = chosen & (F.sum(F.when(chosen, 1).otherwise(0)).over(running) <= n)
            flags.append(F.when(chosen, F.lit(1 << i)).otherwise(F.lit(0)))
        return sum(flags[1:], flags[0])

    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    if any(n is not None for _, n in choices):
        near = df.withColumn("_salt", salt)
        near = near.withColumn(bits, taken(Window.partitionBy(*group, "_salt")))
        df = near.filter(F.col(bits) > 0).drop("_salt", bits)
    return df.withColumn(bits, taken(Window.partitionBy(*group))).filter(F.col(bits) > 0)


def hottest(counts: DataFrame, keys: list[str], count: str, min_rows: int) -> DataFrame:
    """At most HOT_KEYS keys, those with the most rows."""
    return (
        counts.filter(F.col(count) >= min_rows)
        .orderBy(F.col(count).desc())
        .limit(HOT_KEYS)
        .select(*keys)
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    counts: DataFrame | None = None,
    min_rows: int = HOT_MIN_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of many ``left`` rows per key with few ``right`` rows per key.

    Rows of the hottest left keys are spread over ``salts`` partitions by a hash of ``spread_by``
    (a deterministic salt, so a recomputed task sends its rows to the same place), and the right
    rows of these keys, which are few, are repeated once per salt. ``counts`` may pass rows per
    key (columns ``on`` and ``n``) where the caller already has them.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hottest(counts, on, "n", min_rows).withColumn("_hot", F.lit(True)))
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted_left = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = (
        right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
