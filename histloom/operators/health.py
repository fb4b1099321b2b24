"""Repository health: are pull requests reviewed and merged where they were exported from?

Only the ``sample`` most recently updated closed pull requests of each repo count, so every group
below is bounded by the sample size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx
from histloom.operators.skew import first_n_per_group

SAMPLE = 30
EXAMPLES = 3


def health_sample(closed: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The first ``sample`` closed pull requests per repo with their scan position ``rank``."""
    order = [F.col("updated_at").desc(), F.col("number").desc()]
    return first_n_per_group(closed, ["repo"], order, sample, spread_by=["number"])


def _first_signal(text: Column, signals: tuple[str, ...]) -> Column:
    """First signal found in ``text``, literally or as a pattern."""
    found = None
    for s in signals:
        hit = F.contains(text, F.lit(s.lower())) | text.rlike(f"(?iud){s}")
        found = F.when(hit, F.lit(s)) if found is None else found.when(hit, F.lit(s))
    return found


def review_signals(sampled: DataFrame) -> DataFrame:
    """One row per (unmerged pull request, review system) with a text signal or a bot author.

    Columns: repo, number, rank, login, system_pos, system, doc_url, signal, by_bot.
    """
    body, title, login = (
        F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("body", "title", "author_login")
    )
    text = F.concat_ws(" ", body, title, login)
    systems = []
    for pos, (name, signals, bots, url) in enumerate(fv.REVIEW_SYSTEMS):
        systems.append(
            F.struct(
                F.lit(pos).alias("system_pos"),
                F.lit(name).alias("system"),
                F.lit(url).cast("string").alias("doc_url"),
                _first_signal(F.col("_text"), signals).alias("signal"),
                tx.any_of([F.col("_login").rlike(b) for b in bots]).alias("by_bot"),
            )
        )
    return (
        sampled.filter(F.col("merged_at").isNull())
        .withColumns({"_text": text, "_login": login})
        .select("repo", "number", "rank", "author_login", F.inline(F.array(*systems)))
        .filter(F.col("signal").isNotNull() | F.col("by_bot"))
        .withColumnRenamed("author_login", "login")
    )


def example_signals(signals: DataFrame) -> DataFrame:
    """First EXAMPLES text hits per repo in scan order, as display texts."""
    shown = F.when(F.length("signal") < fv.SIGNAL_SHOWN_CHARS, F.col("signal")).otherwise(
        F.concat(F.left("signal", F.lit(fv.SIGNAL_SHOWN_CHARS)), F.lit("…"))
    )
    text = F.concat(F.lit('"'), shown, F.lit('" in PR #'), F.col("number").cast("string"))
    hits = F.array_sort(F.collect_list(F.struct("rank", "system_pos", text.alias("text"))))
    first = F.transform(F.slice(hits, 1, EXAMPLES), lambda h: h["text"])
    return (
        signals.filter(F.col("signal").isNotNull())
        .groupBy("repo")
        .agg(first.alias("example_signals"))
    )


def repo_health(
    closed: DataFrame, repos: DataFrame | None = None, sample: int = SAMPLE
) -> DataFrame:
    """One row per repo: merge rate, detected system, bots, examples, native flag, confidence.

    ``repos`` (full_name) adds repos without any closed pull request.
    """
    sampled = health_sample(closed, sample)
    rates = sampled.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_sampled"), F.count("merged_at").alias("merged_count")
    )
    if repos is not None:
        rates = repos.select(F.col("full_name").alias("repo")).join(rates, "repo", "left")
    signals = review_signals(sampled)
    first = F.min(F.struct("rank", "system_pos", "system", "doc_url"))
    detected = signals.groupBy("repo").agg(
        first["system"].alias("external_system"),
        first["doc_url"].alias("system_doc_url"),
        F.array_sort(F.collect_set(F.when(F.col("by_bot"), F.col("login")))).alias("bot_usernames"),
    )
    total = F.coalesce("total_sampled", F.lit(0).cast("bigint"))
    merged = F.coalesce("merged_count", F.lit(0).cast("bigint"))
    rate = F.col("merge_rate")
    has_system = F.col("external_system").isNotNull()
    no_texts = F.array().cast("array<string>")
    return (
        rates.join(detected, "repo", "left")
        .join(example_signals(signals), "repo", "left")
        .withColumns({"total_sampled": total, "merged_count": merged})
        .withColumns(
            {
                "merge_rate": F.when(
                    F.col("total_sampled") > 0, F.col("merged_count") / F.col("total_sampled")
                ).otherwise(F.lit(0.0)),
                "bot_usernames": F.coalesce("bot_usernames", no_texts),
                "example_signals": F.coalesce("example_signals", no_texts),
            }
        )
        .withColumns(
            {
                "is_native": ~has_system & (rate >= fv.NATIVE_MIN_RATE),
                "confidence": F.when(has_system & (rate < fv.HIGH_CONFIDENCE_BELOW), F.lit("high"))
                .when(rate < fv.MEDIUM_CONFIDENCE_BELOW, F.lit("medium"))
                .otherwise(F.lit("low")),
            }
        )
    )


def drop_flagged(selected: DataFrame, health: DataFrame) -> DataFrame:
    """Selected repos (full_name) that are not flagged."""
    flagged = health.filter(~F.col("is_native")).select(F.col("repo").alias("full_name"))
    return selected.join(flagged, "full_name", "left_anti")
