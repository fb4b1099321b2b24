"""The registered queries: thin wrappers that derive the agreed digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.session import with_folder
from histloom.llm import (
    align,
    decontaminate,
    html_text,
    materialise,
    merkle,
    packing,
    pieces,
    privacy,
    quality,
    repeats,
    sharding,
    simhash,
    topk,
)
from histloom.llm.common import fresh_folder, stage, table


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all rows for every row whose id divides by 50."""
    with_folder(spark)
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v")
    )
    vectors = vectors.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return topk.top_k(vectors.filter("id % 50 = 0"), vectors)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    return sharding.shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every sequence with the checksum of its record as read from the shards."""
    with_folder(spark)
    path = fresh_folder(spark, "shards")
    index = materialise.materialise(table(spark, sf_dir, "documents"), path, TOKENIZER)
    records = materialise.read_shards(spark, path).select("slot", F.crc32("ids").alias("ids_crc32"))
    return index.join(records, "slot")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    return repeats.repeated_bytes(table(spark, sf_dir, "documents"))


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    return privacy.personal_data(table(spark, sf_dir, "documents"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.round_trip(table(spark, sf_dir, "documents"), PIECES)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, recomputed from the leaf that a tampered or an original row has."""
    with_folder(spark)
    docs = table(spark, sf_dir, "documents")
    values = {f: F.col(f) for f in merkle.FIELDS}
    changed = values | {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    shown = F.when(tampered, merkle.leaf_digest(*changed.values())).otherwise(
        merkle.leaf_digest(*values.values())
    )
    found = merkle.manifest(docs, carried={"shown": shown})
    found = found.withColumn("folded_root", merkle.fold(F.col("shown"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_folder(spark)
    found = align.aligned(table(spark, sf_dir, "documents"), BYTES, PIECES)
    digest = F.sha2(F.col("groups").cast("binary"), 256)
    found = found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, digest).otherwise(F.lit("")))
    found = align.with_link_sums(stage(found.drop("groups"), "aligned"))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES = {
    "op1_html": op1_html,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_materialise": op5_materialise,
    "op6_quality": op6_quality,
    "op7_repeats": op7_repeats,
    "op8_privacy": op8_privacy,
    "op9_decontaminate": op9_decontaminate,
    "op10_sharding": op10_sharding,
    "op11_pieces": op11_pieces,
    "op12_merkle": op12_merkle,
    "op13_align": op13_align,
}
