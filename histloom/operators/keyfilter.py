"""Keeping rows whose key may be in a set, before anything is exchanged.

The set is a bitmap of hashed keys, cut into pieces of 32,768 bits that are sent to all tasks. Rows
of a key in the set always pass; of the others a share of at most keys / bits passes by chance, so
an exact join has to follow, and has little left to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one row of the bitmap, as the built-in bitmap aggregate makes them.
PIECE_BITS = 15
PIECE = 1 << PIECE_BITS
BITS_PER_KEY = 16
# 128 MiB, the most that is ever sent around. With more keys than an eighth of these bits more rows
# pass by chance; with as many keys as bits the filter is of no use and left out.
MAX_BITS = 1 << 30


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """Size of the bitmap: a power of two of at least BITS_PER_KEY bits a key, up to ``most``."""
    return min(most, max(PIECE, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length()))


def _place(on: list[str], bits: int) -> tuple[Column, Column]:
    """(piece, bit within it) of a key."""
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    return F.shiftright(place, PIECE_BITS), place.bitwiseAND(PIECE - 1)


def bitmap(keys: DataFrame, on: list[str], bits: int) -> DataFrame:
    """(piece, bitmap): at most ``bits`` / PIECE rows of 4 KiB.

    Keys travel to their piece as numbers, so no task sends a bitmap of its own.
    """
    piece, bit = _place(on, bits)
    return (
        keys.select(piece.alias("_piece"), bit.alias("_bit"))
        .distinct()
        .repartition("_piece")
        .groupBy("_piece")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )


def _marked(rows: DataFrame, keys: DataFrame, on: list[str], n: int, most: int) -> DataFrame:
    """``rows`` with ``_found``: may the key be among the ``n`` keys?"""
    bits = bits_for(n, most)
    byte = F.expr("substring(_bitmap, int(_at div 8) + 1, 1)")
    found = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, int(_at % 8))"))
    piece, bit = _place(on, bits)
    placed = rows.withColumns({"_piece": piece, "_at": bit})
    joined = placed.join(F.broadcast(bitmap(keys, on, bits)), "_piece", "left")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return joined.select(*columns, F.coalesce(found != 0, F.lit(False)).alias("_found"))


def maybe_in(rows: DataFrame, keys: DataFrame, on: list[str], most: int = MAX_BITS) -> DataFrame:
    """``rows`` without most of those whose key is not among ``keys``; no exchange of ``rows``.

    ``keys`` are counted now and read again by the result: pass a staged frame. All columns of
    ``on`` must be in both frames, of the same types.
    """
    n = keys.count()
    if n >= most:
        return rows
    return _marked(rows, keys, on, n, most).filter("_found").drop("_found")


def marked(rows: DataFrame, keys: DataFrame, on: list[str], mark: str, most: int = MAX_BITS) -> DataFrame:
    """``rows`` with ``mark``: may the key be among ``keys``? The rows that ``maybe_in`` keeps."""
    n = keys.count()
    if n >= most:
        return rows.withColumn(mark, F.lit(True))
    return _marked(rows, keys, on, n, most).withColumnRenamed("_found", mark)


def surely_out(rows: DataFrame, keys: DataFrame, on: list[str], most: int = MAX_BITS) -> DataFrame:
    """The rows that ``maybe_in`` leaves out."""
    n = keys.count()
    if n >= most:
        return rows.limit(0)
    return rows if n == 0 else _marked(rows, keys, on, n, most).filter("NOT _found").drop("_found")
