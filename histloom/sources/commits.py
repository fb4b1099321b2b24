"""Commits: message split, branch choice, newest-N, counts."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histloom.functions import text as tx
from histloom.operators.skew import first_n_by_choice, first_n_per_group
from histloom.params import CollectParams


def newest() -> list[Column]:
    """Commits of a repo in the order in which a limit takes them."""
    return [F.asc("branch_pos"), F.desc("author_ts"), F.asc("sha")]


def start_of(day: date, df: DataFrame, column: str) -> Column:
    """Midnight (UTC) of ``day`` as a literal of the column's type, so the filter reaches the scan."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(day.isoformat()).cast("timestamp_ntz")
    return F.lit(datetime(day.year, day.month, day.day, tzinfo=timezone.utc))


def since(df: DataFrame, column: str, day: date | None) -> DataFrame:
    return df if day is None else df.filter(F.col(column) >= start_of(day, df, column))


def on_branches(listing: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """Rows (repo, branch, is_default, sha, ...) of the named branches, with ``branch_pos``.

    Without names only the default branch is read.
    """
    if not branches:
        return listing.filter("is_default").withColumn("branch_pos", F.lit(0))
    position = F.array_position(F.array(*[F.lit(b) for b in branches]), F.col("branch")) - 1
    return listing.filter(F.col("branch").isin(*branches)).withColumn(
        "branch_pos", position.cast("int")
    )


def first_branch(listing: DataFrame) -> DataFrame:
    """Each (repo, sha) once, at its first branch. Partial ``min`` absorbs widely shared commits."""
    return listing.groupBy("repo", "sha").agg(
        F.min("branch_pos").alias("branch_pos"), F.min("author_ts").alias("author_ts")
    )


def newest_commits(listing: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` commits of each repo in branch order, newest first within a branch.

    ``arrival`` is their rank, ``n_seen`` how many the repo has. Without a limit nothing is ranked
    or counted, and ``arrival`` is a text that sorts in the same order.
    """
    if n is None:
        return listing.withColumn("arrival", arrival_text())
    return first_n_per_group(
        listing, ["repo"], newest(), n, spread_by=["sha"], rank="arrival", size="n_seen"
    )


def arrival_text() -> Column:
    """Sorts as newest() does."""
    late = F.lpad((F.lit(2**62) - F.unix_micros(F.col("author_ts").cast("timestamp"))).cast("string"), 20, "0")
    place = F.lpad(F.col("branch_pos").cast("string"), 10, "0")
    return F.concat_ws("-", place, late, "sha")


def newest_by_choice(listing: DataFrame, choices: list[CollectParams]) -> DataFrame:
    """The commits that any of the choices takes, with ``arrival`` and a bit for each in ``taken``.

    All choices must name the same branches; each has its own first day and limit.
    """
    branches = choices[0].branches
    if any(c.branches != branches for c in choices):
        raise ValueError("choices of different branches")
    rows = first_branch(on_branches(listing, branches))
    wanted = [
        (F.lit(True) if c.since is None else F.col("author_ts") >= start_of(c.since, rows, "author_ts"),
         c.max_commits_per_repo)
        for c in choices
    ]
    chosen = first_n_by_choice(rows, ["repo"], newest(), wanted, ["sha"], "taken")
    return chosen.withColumn("arrival", arrival_text())


def select_commits(listing: DataFrame, params: CollectParams) -> DataFrame:
    """Keys of the commits a run takes: (repo, sha, branch_pos, author_ts, arrival)."""
    recent = since(listing, "author_ts", params.since)
    return newest_commits(
        first_branch(on_branches(recent, params.branches)), params.max_commits_per_repo
    )


def normalise_commits(raw: DataFrame, *more: str) -> DataFrame:
    """Message split and null defaults; ``more`` columns are kept as they are."""
    return raw.select(
        "repo",
        "sha",
        tx.subject(F.col("message")).alias("message_subject"),
        tx.body(F.col("message")).alias("message_body"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("author_email", F.lit("")).alias("author_email"),
        F.col("author_ts").alias("timestamp"),
        "is_merge",
        "parent_shas",
        *more,
    )


def branch_commit_counts(listing: DataFrame, params: CollectParams) -> DataFrame:
    """Commits per repo and chosen branch, also where there are none since the day asked for.

    With several branches also their sum (branch is null).
    """
    if params.branches:
        names = F.explode(F.array(*[F.lit(b) for b in params.branches]))
        wanted = listing.select("repo").distinct().select("repo", names.alias("branch"))
    else:
        wanted = listing.filter("is_default").select("repo", "branch").distinct()
    chosen = on_branches(since(listing, "author_ts", params.since), params.branches)
    counts = chosen.groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("n"))
    counts = wanted.join(counts, ["repo", "branch"], "left")
    return (
        counts.groupingSets([["repo", "branch"], ["repo"]], "repo", "branch")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_commits"),
            F.grouping("branch").alias("_is_total"),
        )
        .filter((F.col("_is_total") == 0) | (F.lit(len(params.branches)) > 1))
        .drop("_is_total")
    )
