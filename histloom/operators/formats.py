"""Output records in the two schemas. Every function adds the record columns to its input frame.

Alpaca records have ``instruction``, ``input``, ``output``; chat records have ``conversations``.
Both carry ``_meta``, one nullable struct for all tasks: absent keys stay absent in JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx

ALPACA = ["instruction", "input", "output", "_meta"]
SHAREGPT = ["conversations", "_meta"]


def record_columns(output_format: str) -> list[str]:
    return ALPACA if output_format == "alpaca" else SHAREGPT


def commit_diff(files: Column) -> Column:
    """Per-file parts joined by newlines."""

    def part(f: Column) -> Column:
        name = f["filename"]
        return F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"), f["diff"])

    return F.array_join(F.transform(files, part), "\n")


def commit_diff_terminated(files: Column) -> Column:
    """The same parts, each followed by a newline."""
    return F.when(F.size(files) > 0, F.concat(commit_diff(files), F.lit("\n"))).otherwise(F.lit(""))


def _meta(task: str, when: Column, score: Column | None, sha=None, number=None) -> Column:
    return F.struct(
        F.col("repo").alias("repo"),
        (sha if sha is not None else F.lit(None).cast("string")).alias("sha"),
        (number if number is not None else F.lit(None).cast("bigint")).alias("pr_number"),
        F.lit(task).alias("task"),
        (score if score is not None else F.lit(None).cast("double")).alias("score"),
        F.coalesce(tx.iso_timestamp(when), F.lit("")).alias("timestamp"),
    )


def _chat(system: str, human: Column, gpt: Column) -> Column:
    turns = [("system", F.lit(system)), ("human", human), ("gpt", gpt)]
    return F.array(*[F.struct(F.lit(who).alias("from"), v.alias("value")) for who, v in turns])


def _fenced(diff: Column) -> Column:
    return F.concat(F.lit("```diff\n"), diff, F.lit("\n```"))


def format_commits(commits: DataFrame, output_format: str) -> DataFrame:
    """Needs message_subject, files, score, timestamp."""
    meta = _meta("commit_message", F.col("timestamp"), F.col("score"), sha=F.col("sha"))
    if output_format == "alpaca":
        return commits.withColumns(
            {
                "instruction": F.lit(fv.COMMIT_INSTRUCTION),
                "input": commit_diff(F.col("files")),
                "output": F.col("message_subject"),
                "_meta": meta,
            }
        )
    human = F.concat(
        F.lit("Write a commit message for this diff:\n\n"),
        _fenced(commit_diff_terminated(F.col("files"))),
    )
    chat = _chat(fv.COMMIT_CHAT_SYSTEM, human, F.col("message_subject"))
    return commits.withColumns({"conversations": chat, "_meta": meta})


def comment_line() -> Column:
    return F.concat(F.lit("["), "path", F.lit("] "), "body")


def comment_block() -> Column:
    return F.concat(
        F.lit("### Review Comment on `"),
        "path",
        F.lit("`:\n**Context:**\n"),
        _fenced(F.col("diff_hunk")),
        F.lit("\n**Feedback:** "),
        "body",
    )


def comment_text(output_format: str) -> Column:
    """What a review comment becomes in the output; rendered before comments are gathered."""
    return comment_line() if output_format == "alpaca" else comment_block()


def format_reviews(pulls: DataFrame, output_format: str) -> DataFrame:
    """Needs number, title, body, diff, merged_at and ``comments`` (rendered, in order)."""
    number = F.col("number")
    if output_format == "alpaca":
        return pulls.withColumns(
            {
                "instruction": F.lit(fv.REVIEW_INSTRUCTION),
                "input": F.col("diff"),
                "output": F.array_join("comments", "\n"),
                "_meta": _meta("pr_review", F.col("merged_at"), None, number=number),
            }
        )
    human = F.concat(
        F.lit("PR #"),
        number.cast("string"),
        F.lit(": "),
        "title",
        F.lit("\n\n**Description:** "),
        tx.or_default(F.col("body"), fv.NO_DESCRIPTION),
        F.lit("\n\n"),
        _fenced(F.col("diff")),
    )
    gpt = F.when(F.size("comments") > 0, F.array_join("comments", "\n\n")).otherwise(
        F.lit(fv.NO_COMMENTS)
    )
    meta = _meta("pr_review", F.col("merged_at"), F.lit(1.0), number=number)
    return pulls.withColumns({"conversations": _chat(fv.REVIEW_CHAT_SYSTEM, human, gpt), "_meta": meta})


def issue_part(block: Column) -> Column:
    """What an issue block is in a context."""
    return tx.strip_html_comments(block)


def description_part() -> Column:
    """What a pull request's body is in a context; ``''`` for an empty description."""
    # Null for an empty description, so that the text is not computed twice.
    description = F.nullif(tx.strip_html_comments(F.col("body")), F.lit(""))
    return F.coalesce(F.concat(F.lit("PR Description:\n"), description), F.lit(""))


def issue_context() -> Column:
    """Issue blocks and description without HTML comments; the title only if nothing is left."""
    issues = F.transform("linked_issue_bodies", issue_part)
    parts = F.filter(F.concat(issues, F.array(description_part())), lambda part: part != "")
    return F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), F.col("title"))


def format_patches(pulls: DataFrame, output_format: str) -> DataFrame:
    """Needs number, diff, merged_at and ``context`` (see issue_context)."""
    meta = _meta("issue_to_patch", F.col("merged_at"), F.lit(1.0), number=F.col("number"))
    if output_format == "alpaca":
        return pulls.withColumns(
            {
                "instruction": F.lit(fv.PATCH_INSTRUCTION),
                "input": F.col("context"),
                "output": F.col("diff"),
                "_meta": meta,
            }
        )
    chat = _chat(fv.PATCH_INSTRUCTION, F.col("context"), F.col("diff"))
    return pulls.withColumns({"conversations": chat, "_meta": meta})
