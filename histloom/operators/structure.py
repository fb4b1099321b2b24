"""Stage 2: structural checks of commits and pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.functions import text as tx
from histloom.operators.rules import Rule
from histloom.params import FilterParams


def with_full_message(commits: DataFrame) -> DataFrame:
    """Adds ``full_message``: subject and body without trailers.

    A column of its own, since two rules read it and stripping trailers is the costly part.
    """
    body = tx.strip_trailers(F.col("message_body"))
    message = tx.strip(F.concat("message_subject", F.lit("\n"), body))
    return commits.withColumn("full_message", message)


def message_flags(p: FilterParams) -> dict[str, Column]:
    """What the rules ask of the text alone; needs full_message."""
    message = F.col("full_message")
    return {
        "message_too_short": tx.fewer_words_than(message, p.min_commit_message_words),
        "message_too_long": F.length(message) > p.max_commit_message_chars,
    }


def commit_structure_rules(p: FilterParams, flags: dict[str, Column] | None = None) -> list[Rule]:
    """Needs the file facts, and full_message unless ``flags`` brings message_flags."""
    flags = message_flags(p) if flags is None else flags
    rules = [
        ("message_too_short", flags["message_too_short"]),
        ("message_too_long", flags["message_too_long"]),
        ("too_few_files", F.col("n_files") < p.min_files_changed),
        ("too_many_files", F.col("n_files") > p.max_files_changed),
        ("diff_too_small", F.col("diff_lines") < p.min_diff_lines),
        ("diff_too_large", F.col("diff_lines") > p.max_diff_lines),
    ]
    return [(f"structural:{name}", fails) for name, fails in rules]


def pull_structure_rules(p: FilterParams) -> list[Rule]:
    n_lines = tx.line_count(F.col("diff"))
    given = F.col("diff") != ""
    rules = [
        ("pr_body_too_short", tx.fewer_words_than(F.col("body"), p.min_pr_body_words)),
        ("pr_diff_too_small", given & (n_lines < p.min_diff_lines)),
        ("pr_diff_too_large", given & (n_lines > p.max_diff_lines)),
        ("pr_diff_missing", ~given),
    ]
    return [(f"structural:{name}", fails) for name, fails in rules]
