"""Stage 1: hard exclusions of commits, from the commit row and its file facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx
from histloom.operators.rules import Rule
from histloom.params import FilterParams


def is_merge() -> Column:
    by_subject = F.startswith(F.lower("message_subject"), F.lit(fv.MERGE_SUBJECT_PREFIX))
    return F.col("is_merge") | (F.size("parent_shas") > 1) | by_subject


def is_bot() -> Column:
    who = F.concat("author", F.lit(" "), F.coalesce("author_email", F.lit("")))
    return F.lower(who).rlike(fv.BOT_AUTHOR)


def commit_flags(p: FilterParams) -> dict[str, Column]:
    """What the rules ask of the commit row alone."""
    subject = tx.strip(F.col("message_subject"))
    on = F.lit
    return {
        "is_merge": on(p.exclude_merge_commits) & is_merge(),
        "is_revert": on(p.exclude_revert_commits) & subject.rlike(fv.REVERT_SUBJECT),
        "is_bot": on(p.exclude_bot_authors) & is_bot(),
        "trivial": (subject == "") | F.lower(subject).isin(*fv.TRIVIAL_SUBJECTS),
        "wip": on(p.exclude_wip_messages) & subject.rlike(fv.WIP_SUBJECT),
        "version": subject.rlike(fv.VERSION_SUBJECT),
        "url": subject.rlike(fv.URL_SUBJECT),
        "ticket": subject.rlike(fv.TICKET_SUBJECT),
    }


def exclusion_rules(p: FilterParams, flags: dict[str, Column] | None = None) -> list[Rule]:
    """Needs the file facts, and the commit row unless ``flags`` brings commit_flags."""
    flags = commit_flags(p) if flags is None else flags
    n_files = F.col("n_files")
    on = F.lit
    only_version_files = F.col("n_version_files") == n_files
    rules = [
        ("is_merge", flags["is_merge"]),
        ("is_revert", flags["is_revert"]),
        ("is_bot", flags["is_bot"]),
        ("no_files", on(p.exclude_binary_only) & (n_files == 0)),
        ("binary_only", on(p.exclude_binary_only) & (n_files > 0) & (F.col("n_text_files") == 0)),
        ("lockfile_only", (n_files > 0) & (F.col("n_generated_files") == n_files)),
        ("empty_or_trivial_message", flags["trivial"]),
        ("wip_message", flags["wip"]),
        ("version_bump_only", flags["version"] & only_version_files),
        ("url_only_message", flags["url"]),
        ("ticket_only_message", flags["ticket"]),
    ]
    return [(f"hard_exclusion:{name}", fails) for name, fails in rules]
