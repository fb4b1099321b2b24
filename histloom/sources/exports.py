"""The exported tables a run reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "commits": (
        "repo string, sha string, message string, author string, author_email string, "
        "author_ts timestamp, is_merge boolean, parent_shas array<string>"
    ),
    "file_changes": (
        "repo string, sha string, pos int, old_path string, new_path string, "
        "change_type string, diff string, additions bigint, deletions bigint"
    ),
    "branches": (
        "repo string, branch string, is_default boolean, sha string, author_ts timestamp"
    ),
    "pull_requests": (
        "repo string, number bigint, title string, body string, diff string, "
        "author_login string, labels array<string>, updated_at timestamp, merged_at timestamp"
    ),
    "review_comments": (
        "repo string, number bigint, pos int, path string, diff_hunk string, body string, "
        "author string"
    ),
    "issues": "repo string, number decimal(38,0), body string",
    "releases": (
        "repo string, tag_name string, title string, body string, published_at timestamp"
    ),
    "repos": (
        "pos bigint, full_name string, private boolean, language string, stars int, "
        "open_issues bigint, updated_at timestamp"
    ),
}


@dataclass(frozen=True)
class Exports:
    """Tables as in SCHEMAS. ``branches`` is one row per (branch, commit on it); without it every
    commit counts as being on its repo's default branch. ``selected`` (full_name) limits a run to
    some repos: the choice is made on the narrow keys, before texts are joined to them."""

    commits: DataFrame | None = None
    file_changes: DataFrame | None = None
    pull_requests: DataFrame | None = None
    review_comments: DataFrame | None = None
    issues: DataFrame | None = None
    repos: DataFrame | None = None
    branches: DataFrame | None = None
    releases: DataFrame | None = None
    selected: DataFrame | None = None

    def chosen(self, keys: DataFrame) -> DataFrame:
        """The rows of the selected repos."""
        if self.selected is None:
            return keys
        return keys.join(self.selected.select(F.col("full_name").alias("repo")), "repo", "left_semi")

    def listing(self) -> DataFrame:
        if self.branches is not None:
            return self.chosen(self.branches)
        keys = self.commits.select(
            "repo", F.lit("HEAD").alias("branch"), F.lit(True).alias("is_default"), "sha", "author_ts"
        )
        return self.chosen(keys)

    def closed_pulls(self) -> DataFrame:
        return self.chosen(
            self.pull_requests.select("repo", "number", "updated_at", "merged_at")
        )


def read_exports(
    spark: SparkSession, folder: str, fmt: str = "parquet", names: tuple[str, ...] = tuple(SCHEMAS)
) -> Exports:
    """Read ``<folder>/<table>`` for the named tables, with fixed schemas and no inference pass."""
    read = spark.read.format(fmt)
    return Exports(**{n: read.schema(SCHEMAS[n]).load(f"{folder}/{n}") for n in names})
