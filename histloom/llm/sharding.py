"""Proportional stratified interleaving into shards of equal row counts.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank
over its source's size. Sorted by fractional rank all sources advance in proportion, and the order
is cut into shards whose counts differ by one at most, so each shard holds the mixture of the whole.

Texts take no part: only ids, sizes and hashes are ranked. Both ranks come from range sorts
(``common.placed``), so neither a hot source nor many sources of one row, which all have the same
fractional rank, meet in one task. Rows of equal fractional rank are ordered by a hash of their
source. Defined results: a null source is a source;
a null text has size 8 and checksum 0; equal rows get neighbouring slots; with fewer rows than
shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import fresh, placed, row_hash, stage

SHARDS = 24
SEED = 20
# Bytes counted for a document besides its text.
OVERHEAD = 8


def interleaved(rows: DataFrame, source: str, seed: int = SEED) -> DataFrame:
    """Add ``position``: the place from 0 of each row in the interleaved order.

    ``rows`` should be narrow; it is written to the staging folder as it comes and after each sort.
    """
    wanted = ("_draw", "_group", "_own", "_rank", "_of", "_fraction", "_tie")
    draw, group, own, rank, of, fraction, tie = (fresh(rows, n) for n in wanted)
    columns = rows.columns
    # Never null, and no name can equal the null source's.
    named = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit(""))
    shuffled = rows.withColumns({draw: row_hash(rows, F.lit(seed)), group: named})
    # Tells equal rows apart; fixed once written.
    shuffled = stage(shuffled.withColumn(own, F.monotonically_increasing_id()), "shuffled")
    ranked = placed(shuffled, [group], [draw, own], rank, size=of, label="ranked")
    # The middle of the row's share of its source: in (0, 1), exact order within a source.
    ranked = ranked.withColumn(fraction, (F.col(rank) + 0.5) / F.col(of)).drop(rank, of)
    ranked = stage(ranked.withColumn(tie, F.xxhash64(F.lit(seed), group)), "fractions")
    order = placed(ranked, [], [fraction, tie, group, draw, own], "position", label="interleaved")
    return order.select(*[F.col(f"`{c}`") for c in columns], "position")


def cut(rows: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot`` by position; shard sizes differ by one row at most."""
    total = max(total, 1)
    shard = F.expr(f"int(position * {shards} div {total})")
    # First position of a shard: the smallest p with p * shards div total = shard.
    first = F.expr(f"(bigint(shard) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("position") - first)


def shard_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """Per document: doc_id, source, size, text_crc32, shard, slot."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    order = interleaved(narrow, "source", seed)
    total = narrow.agg(F.count(F.lit(1))).first()[0]
    return cut(order, total, shards).drop("position")


def write_shards(
    docs: DataFrame, path: str, source: str = "source", shards: int = SHARDS, seed: int = SEED
) -> None:
    """Write whole documents as ``path``/shard=N, each in slot order."""
    order = interleaved(docs, source, seed)
    total = docs.agg(F.count(F.lit(1))).first()[0]
    ready = cut(order, total, shards).drop("position")
    (
        ready.repartition(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
