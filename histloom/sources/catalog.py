"""Repo, branch and release catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx


def repo_catalog(listing: DataFrame) -> DataFrame:
    """First listing row (by ``pos``) of each ``full_name``, with defaults for missing values."""
    firsts = listing.groupBy("full_name").agg(F.min("pos").alias("pos"))
    updated = F.date_format("updated_at", "yyyy-MM-dd")
    return listing.join(firsts, ["full_name", "pos"], "left_semi").select(
        "full_name",
        F.when(F.col("private"), F.lit("private")).otherwise(F.lit("public")).alias("visibility"),
        tx.or_default(F.col("language"), "Unknown").alias("language"),
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce(updated, F.lit("Unknown")).alias("updated_at"),
    )


def prefilter_repos(catalog: DataFrame, public_only: bool = False, min_stars: int = 0) -> DataFrame:
    kept = catalog.filter(F.col("visibility") == "public") if public_only else catalog
    return kept.filter(F.col("stars") >= min_stars) if min_stars > 0 else kept


def branch_catalog(listing: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Distinct branch names over the selected repos, sorted.

    Names are reduced to distinct (repo, branch) first, so a repo with very many commits is small
    before the join.
    """
    pairs = listing.select("repo", "branch").distinct()
    if repos is not None:
        pairs = pairs.join(repos.select(F.col("full_name").alias("repo")), "repo", "left_semi")
    return pairs.select("branch").distinct().orderBy("branch")


def is_semver(tag: Column) -> Column:
    return F.coalesce(tag.rlike(fv.SEMVER_TAG), F.lit(False))


def normalise_releases(raw: DataFrame) -> DataFrame:
    return raw.select(
        "tag_name",
        "repo",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        is_semver(F.col("tag_name")).alias("is_semver"),
        F.coalesce(tx.iso_timestamp(F.col("published_at")), F.lit("")).alias("published_at"),
    )
