"""Training-order materialisation of token sequences as fixed-stride binary shards.

Documents become sequences of ``STRIDE_IDS`` ids. Every sequence has a dense index; a keyed
Feistel permutation, cycle-walked into the range, gives it a global slot. Slots are dealt to shards
by range, and each shard is one file of records of equal size in slot order, so a reader seeks to
``record * stride`` and may stop and resume anywhere. Files go through Spark's own committed text
writer: a record is its slot (8 bytes, big-endian), the ids (16 bits each, little-endian) and one
line feed.

Defined results: a null or empty text is one sequence holding its closing id; equal rows are
sequences of their own; ids must fit into 16 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.llm.common import by_value, stage
from histloom.llm.tokens import encoder

by_value(__name__)

STRIDE_IDS = 512
KEY = 0x9E3779B97F4A7C15
ROUNDS = 6
# Records of a shard; a shard of 512 ids is then 33.6 MB.
SHARD_RECORDS = 32_768
# Fills the rest of a document's last record; its length is in the index.
PADDING = 0

# How ids are staged: they are read twice, so smaller files are worth a little more work, and pages
# as large as this let copies of a text further apart be seen as such.
TIGHT = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}

# Bytes before a record's ids: its slot.
HEADER = 8


def record_bytes(stride: int = STRIDE_IDS) -> int:
    return HEADER + 2 * stride + 1


def _mix(half: np.ndarray, key: int, turn: int) -> np.ndarray:
    """Round function: a multiply-and-shift hash of the half, the key and the round."""
    with np.errstate(over="ignore"):
        x = half + np.uint64((key + turn * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Bijection of 0 .. total-1: balanced Feistel on the next even power of two, walked."""
    half = max(1, -(-(max(total, 2) - 1).bit_length() // 2))
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key, turn) & mask)
        return (left << shift) | right

    slot = once(index.astype(np.uint64))
    outside = np.flatnonzero(slot >= total)
    while len(outside):
        slot[outside] = once(slot[outside])
        outside = outside[slot[outside] >= total]
    return slot.astype(np.int64)


def slot_of(index: Column, total: int, key: int = KEY) -> Column:
    @F.pandas_udf("bigint")
    def udf(values: pd.Series) -> pd.Series:
        return pd.Series(permuted(values.to_numpy(), total, key))

    return udf(index)


def _sequences(docs: DataFrame, tokenizer: str, stride: int) -> DataFrame:
    """(part, place, doc_id, start, length, ids): sequences numbered within their task.

    Written once, the numbers are those of the attempt that was committed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part, place = encoder(tokenizer).ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, bodies = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_text(body.as_py())
                if ids.max() > 0xFFFF:
                    raise ValueError("ids over 65535 need a wider record")
                for start in range(0, len(ids), stride):
                    one = ids[start : start + stride]
                    rows.append((part, place, key, start, len(one)))
                    bodies.append(one.astype("<u2").tobytes())
                    place += 1
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bodies, pa.binary())],
                names=["part", "place", "doc_id", "start", "length", "ids"],
            )

    return docs.mapInArrow(
        encode,
        "part bigint, place bigint, doc_id bigint, start bigint, length bigint, ids binary",
    )


def _with_slots(sequences: DataFrame, key: int, shard_records: int) -> tuple[DataFrame, int]:
    """Add slot, shard and record; also the number of sequences."""
    # One row per task that wrote, so as small as the list of files.
    sizes = sequences.groupBy("part").agg((F.max("place") + 1).alias("n"))
    before, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r.part):
        before.append((r.part, total))
        total += r.n
    offsets = sequences.sparkSession.createDataFrame(before, "part bigint, before bigint")
    placed = sequences.join(F.broadcast(offsets), "part")
    placed = placed.withColumn("slot", slot_of(F.col("before") + F.col("place"), total, key))
    placed = placed.withColumns(
        {"shard": F.expr(f"int(slot div {shard_records})"),
         "record": F.expr(f"slot % {shard_records}")}
    )
    return placed.drop("part", "place", "before"), total


def materialise(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    stride: int = STRIDE_IDS, key: int = KEY, shard_records: int = SHARD_RECORDS,
) -> DataFrame:
    """Write ``path``/shard=N/*.txt and return the index: one row per sequence.

    Columns: doc_id, start (the document's ids before it), length, slot, shard, record (within the
    shard). Byte offset in the shard's file: record * record_bytes(stride).
    """
    narrow = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    sequences = stage(_sequences(narrow, tokenizer, stride), "token-ids", "zstd", TIGHT)
    placed, total = _with_slots(sequences, key, shard_records)
    padding = F.unhex(F.expr(f"repeat('{PADDING:04X}', int({stride} - length))"))
    header = F.unhex(F.lpad(F.hex("slot"), 2 * HEADER, "0"))
    (
        placed.select("shard", "slot", F.concat(header, "ids", padding).cast("string").alias("record"))
        .repartitionById(max(1, -(-total // shard_records)), F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .select("record", "shard")
        .write.partitionBy("shard")
        .option("lineSep", "\n")
        .option("compression", "none")
        .text(path)
    )
    return _with_slots(sequences.drop("ids"), key, shard_records)[0]


def read_shards(spark: SparkSession, path: str, stride: int = STRIDE_IDS) -> DataFrame:
    """(slot, ids) of every record; files are read record by record, never whole."""
    if spark.read.format("binaryFile").load(path).select("path").isEmpty():
        return spark.createDataFrame([], "slot bigint, ids binary")
    records = spark.sparkContext.binaryRecords(f"{path}/shard=*", record_bytes(stride))
    rows = spark.createDataFrame(records.map(lambda r: (bytearray(r),)), "record binary")
    slot = F.conv(F.hex(F.expr(f"substring(record, 1, {HEADER})")), 16, 10).cast("bigint")
    ids = F.expr(f"substring(record, {HEADER + 1}, {2 * stride})")
    return rows.select(slot.alias("slot"), ids.alias("ids"))
