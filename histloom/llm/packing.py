"""Packing of documents into fixed-length sequences: first-fit decreasing in randomised groups.

A document's ids are cut into pieces of at most ``capacity``. Pieces are dealt at random to groups
of about ``GROUP_PIECES``; each group places its pieces, longest first, into the first bin with
room, found in a tournament tree whose inner nodes hold the largest free capacity below them.
The ids themselves are not shuffled. Groups are independent, so a lost executor costs groups.

Defined results: a null or empty text is one piece, its closing id; equal rows are packed each on
its own; a piece of full length is a sequence alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import by_value, stage
from histloom.llm.tokens import encoder

by_value(__name__)

CAPACITY = 2048
GROUP_PIECES = 8192
SEED = 4
# Sequence ids are group * SPAN + bin; a group holds fewer pieces, and so bins, than that.
SPAN = 1 << 24

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids as little-endian unsigned 32-bit bytes."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(tokenizer).ids
        for batch in batches:
            keys, rows, bodies = batch.column(0).to_pylist(), [], []
            for key, body in zip(keys, batch.column(1), strict=True):
                ids = encode_text(body.as_py())
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].tobytes()
                    rows.append((key, start, len(part) // 4, zlib.crc32(part), len(ids)))
                    bodies.append(part)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [
                pa.array([], pa.int64())
            ] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    return narrow.mapInArrow(cut, schema)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, each put into the first bin with room."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= length
        while node > 1:
            node //= 2
            largest = max(free[2 * node], free[2 * node + 1])
            if free[node] == largest:
                break
            free[node] = largest
    return bins, offsets


def packed(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
           seed: int = SEED) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    # Staged rows have fixed places, so their numbers, and with them the groups, repeat exactly.
    cut = stage(cut, "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))
    columns = cut.columns

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
            kind="stable",
        )
        bins, offsets = first_fit(group["length"].tolist(), capacity)
        number = group["_group"].to_numpy(np.int64) * SPAN
        out = group[columns].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(sequence_id=number + np.array(bins, dtype=np.int64), offset=offsets)

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id bigint, offset bigint"
    return cut.withColumn("_group", drawn).groupBy("_group").applyInPandas(place, schema)


def pack(docs: DataFrame, tokenizer: str, **options) -> DataFrame:  # noqa: ANN003
    """Documents to placed pieces: the columns of ``pieces`` with sequence_id and offset."""
    return packed(pieces(docs, tokenizer, **options), options.get("capacity", CAPACITY))
