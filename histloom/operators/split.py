"""Train/eval split of exact size.

The cut position is known from the row count, so only the row *at* the cut has to be found. That
is done by counting: rows per slice of the order, then per slice of the slice that holds the cut,
until the cut lies between two slices. Every row has an order value of its own, also among copies of
one line, and is told apart by comparing that value with the cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import text as tx

# Slices counted per pass; bounds what the driver sees.
SLICES = 1 << 16
_STEP = 4  # hex digits per pass, 16 ** 4 == SLICES


def split_sizes(total: int, eval_ratio: float) -> tuple[int, int]:
    """(train, eval): half-even rounding, at least one each where the ratio leaves room for it."""
    several = total > 1
    least, most = int(several and eval_ratio > 0), total - int(several and eval_ratio < 1)
    n_eval = min(max(round(total * eval_ratio), least), most)
    return total - n_eval, n_eval


@dataclass(frozen=True)
class Cut:
    """Values below ``value`` are train, the others eval; None: all train. Sizes of both sides."""

    value: str | int | None
    n_train: int
    n_eval: int


def non_blank(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter(tx.strip(F.col(column)) != "")


def shuffle_key(position: Column, seed: int) -> Column:
    """Place of a row in the seeded order. Positions are unique, so copies of a line part ways."""
    return F.md5(F.concat(F.lit(f"{seed}|"), position.cast("string")))


def _counts(df: DataFrame, slice_of: Column) -> list:
    """(slice, rows) in slice order; at most SLICES rows reach the driver."""
    counts = df.groupBy(slice_of.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["s"], r["n"]) for r in counts.collect())


def _locate(counts: list, rank: int) -> tuple:
    """Slice holding the row at 0-based ``rank``, and the rank within it."""
    for s, n in counts:
        if rank < n:
            return s, rank
        rank -= n
    raise ValueError("rank beyond the last row")


def find_digest_cut(df: DataFrame, key: str, eval_ratio: float) -> Cut:
    """Cut of an order by unique 32-digit hexadecimal text; sizes come from the first counts."""
    prefix, sizes, inside = "", None, df.select(key)
    while True:
        counts = _counts(inside, F.substring(key, 1, len(prefix) + _STEP))
        if sizes is None:
            sizes = split_sizes(sum(n for _, n in counts), eval_ratio)
            rank = sizes[0]
            if sizes[1] == 0:
                return Cut(None, *sizes)
        prefix, rank = _locate(counts, rank)
        if rank == 0:
            # Everything from the first row of this slice on is eval.
            return Cut(prefix, *sizes)
        if len(prefix) >= 32:
            raise ValueError(f"order column {key} is not unique")
        inside = inside.filter(F.startswith(F.col(key), F.lit(prefix)))


def find_integer_cut(df: DataFrame, key: str, eval_ratio: float) -> Cut:
    """Cut of an order by a unique integer column."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return Cut(None, 0, 0)
    sizes, inside = None, df.select(key)
    while True:
        width = max(1, -(-(high - low + 1) // SLICES))
        # Decimals, as the range of a bigint column may not fit a bigint.
        offset = F.expr(f"(cast(`{key}` as decimal(38,0)) - {low}BD) div {width}BD")
        counts = _counts(inside, offset)
        if sizes is None:
            sizes = split_sizes(sum(n for _, n in counts), eval_ratio)
            rank = sizes[0]
            if sizes[1] == 0:
                return Cut(None, *sizes)
        s, rank = _locate(counts, rank)
        low, high = low + s * width, min(high, low + (s + 1) * width - 1)
        if rank == 0:
            return Cut(low, *sizes)
        if low == high:
            raise ValueError(f"order column {key} is not unique")
        inside = inside.filter(F.col(key).between(low, high))


def sides(rows: DataFrame, key: str, cut: Cut) -> tuple[DataFrame, DataFrame]:
    if cut.n_train + cut.n_eval == 0:
        raise ValueError("no rows to split")
    if cut.value is None:
        return rows, rows.filter(F.lit(False))
    return rows.filter(F.col(key) < F.lit(cut.value)), rows.filter(F.col(key) >= F.lit(cut.value))


def seeded(lines: DataFrame, position: str, seed: int = 42) -> DataFrame:
    """Non-blank lines with ``key``, their place in the seeded order; ``position`` is unique."""
    return non_blank(lines).withColumn("key", shuffle_key(F.col(position), seed))


def split_lines(
    lines: DataFrame, position: str, eval_ratio: float = 0.1, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) of non-blank lines in a seeded order of their positions."""
    rows = seeded(lines, position, seed)
    return sides(rows, "key", find_digest_cut(rows, "key", eval_ratio))


def split_in_order(
    rows: DataFrame, order: str, eval_ratio: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) with the tail of ``order`` (a unique integer column) as eval."""
    return sides(rows, order, find_integer_cut(rows, order, eval_ratio))
