"""Counts of a run. Inputs: ``decisions`` (repo, source, task, stage_failed, reason) and ``collected``.

Everything is a partially aggregated count; nothing but the one report row is small by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = (
    ("stage1", "stage1_hard_exclusion_dropped"),
    ("stage2", "stage2_structural_dropped"),
    ("stage3", "stage3_content_score_dropped"),
    ("stage4", "stage4_dedup_dropped"),
)


def stage_funnel(decisions: DataFrame) -> DataFrame:
    failed = decisions.filter(F.col("stage_failed").isNotNull())
    return failed.groupBy("stage_failed").agg(F.count(F.lit(1)).alias("n_dropped"))


def reason_counts(decisions: DataFrame) -> DataFrame:
    failed = decisions.filter(F.col("reason").isNotNull())
    return failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n_dropped"))


def task_distribution(decisions: DataFrame) -> DataFrame:
    passed = decisions.filter(F.col("reason").isNull())
    return passed.groupBy("task").agg(F.count(F.lit(1)).alias("n_records"))


def filter_rate(collected: Column, final: Column) -> Column:
    """Dropped share in percent, half-even to two decimals; final counts outputs, so it may be < 0."""
    rate = F.bround((collected - final) / collected * 100.0, 2)
    return F.when(collected > 0, rate).otherwise(F.lit(0.0))


def run_stats(decisions: DataFrame, collected: DataFrame) -> DataFrame:
    """One row: collected commits and pull requests, drops per stage, outputs, filter rate.

    ``collected`` has one row per source record (repo, source).
    """
    raw = collected.agg(
        F.count_if(F.col("source") == "commit").alias("raw_commits_collected"),
        F.count_if(F.col("source") == "pr").alias("raw_prs_collected"),
        F.count_distinct("repo").alias("n_repos"),
    )
    drops = decisions.agg(
        *[F.count_if(F.col("stage_failed") == s).alias(name) for s, name in STAGES],
        F.count_if(F.col("reason").isNull()).alias("final_records"),
    )
    total = F.col("raw_commits_collected") + F.col("raw_prs_collected")
    # Two one-row aggregates side by side.
    joined = raw.withColumn("_one", F.lit(1)).join(drops.withColumn("_one", F.lit(1)), "_one")
    return joined.drop("_one").withColumn(
        "filter_rate_pct", filter_rate(total, F.col("final_records"))
    )


# What each limit leaves out, by the name of its count.
LIMITS = {
    "max_commits_per_repo": "commits_beyond_limit",
    "scanned_prs_per_repo": "closed_prs_not_scanned",
    "max_prs_per_repo": "prs_beyond_limit",
}


def left_out(limits: DataFrame) -> DataFrame:
    """One row: how many records each limit left out of (limit, repo, n_seen, n_taken)."""
    beyond = F.col("n_seen") - F.col("n_taken")
    return limits.agg(
        *[F.coalesce(F.sum(F.when(F.col("limit") == k, beyond)), F.lit(0)).alias(n) for k, n in LIMITS.items()]
    )


def _as_map(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    entries = F.collect_list(F.struct(key, value))
    return counts.agg(F.map_from_entries(entries).alias(name)).withColumn("_one", F.lit(1))


def run_report(
    decisions: DataFrame, collected: DataFrame, repos: DataFrame, run_id: str, output_format: str, task: str,
    started_at: Column, finished_at: Column, duration_seconds: float, limits: DataFrame | None = None,
) -> DataFrame:
    """The report row: stats struct, what the limits left out, and reason and task maps (both have
    few, fixed keys)."""
    stats = run_stats(decisions, collected)
    names = [c for c in stats.columns if c != "n_repos"]
    stats = stats.select(F.struct(*names).alias("stats"), F.lit(1).alias("_one"))
    n_repos = repos.agg(F.count(F.lit(1)).alias("n_repos")).withColumn("_one", F.lit(1))
    reasons = _as_map(reason_counts(decisions), "reason", "n_dropped", "top_exclusion_reasons")
    tasks = _as_map(task_distribution(decisions), "task", "n_records", "task_distribution")
    if limits is None:
        zeros = F.struct(*[F.lit(0).cast("long").alias(n) for n in LIMITS.values()])
        stats = stats.withColumn("left_out", zeros)
    else:
        beyond = left_out(limits).select(F.struct(*LIMITS.values()).alias("left_out"))
        stats = stats.join(beyond.withColumn("_one", F.lit(1)), "_one")
    joined = stats.join(n_repos, "_one").join(reasons, "_one").join(tasks, "_one")
    return joined.select(
        F.lit(run_id).alias("run_id"),
        started_at.alias("started_at"),
        finished_at.alias("timestamp"),
        "n_repos",
        F.lit(duration_seconds).alias("duration_seconds"),
        "stats",
        "left_out",
        "top_exclusion_reasons",
        F.lit(output_format).alias("format"),
        F.lit(task).alias("task"),
        "task_distribution",
    )


def repos_processed(collected: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Distinct repos of a run; those ``selected`` (full_name) count even without any record."""
    repos = collected.select("repo")
    if selected is not None:
        repos = repos.union(selected.select("full_name"))
    return repos.distinct()
