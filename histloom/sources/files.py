"""File changes: normalisation, per-commit facts, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx
from histloom.operators.keyfilter import maybe_in

KEY = ["repo", "sha"]
FACTS = (
    "n_files", "n_text_files", "n_generated_files", "n_version_files", "n_code_files",
    "diff_lines", "total_additions", "total_deletions",
)


def change_type(raw: Column) -> Column:
    return F.when(raw.isin("ADD", "DELETE", "RENAME"), raw).otherwise(F.lit("MODIFY"))


def changed_path(new_path: Column, old_path: Column) -> Column:
    """New path, else old path, else ``''``; an empty path counts as missing."""
    return F.coalesce(F.nullif(new_path, F.lit("")), old_path, F.lit(""))


def normalise_files(raw: DataFrame) -> DataFrame:
    """Raw change rows -> repo, sha, pos, filename, change_type, diff, additions, deletions, language."""
    path = changed_path(F.col("new_path"), F.col("old_path"))
    return raw.select(
        *KEY,
        "pos",
        path.alias("filename"),
        change_type(F.col("change_type")).alias("change_type"),
        F.coalesce("diff", F.lit("")).alias("diff"),
        "additions",
        "deletions",
        tx.language(path).alias("language"),
    )


def file_facts(files: DataFrame) -> DataFrame:
    """Everything the exclusion and structure rules need to know about a commit's files.

    Plain counts and sums: partially aggregated before the shuffle, so neither the diff texts nor
    the rows of one very large commit travel to a single task.
    """
    name = F.lower("filename")
    ext = F.lower(tx.file_ext(F.col("filename")))
    generated = tx.any_of([F.contains(name, F.lit(p)) for p in fv.GENERATED_PATH_PARTS])
    is_code = F.col("language").isNotNull() & ~F.col("language").isin(*fv.NON_CODE_LANGUAGES)
    return files.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(ext.isin(*fv.TEXT_EXTENSIONS)).alias("n_text_files"),
        F.count_if(generated).alias("n_generated_files"),
        F.count_if(tx.basename(name).isin(*fv.VERSION_FILES)).alias("n_version_files"),
        F.count_if(is_code).alias("n_code_files"),
        F.sum(tx.line_count(F.col("diff"))).alias("diff_lines"),
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
    )


def with_file_facts(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Commits with their facts; a commit without files has zeros."""
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in FACTS}
    return commits.join(file_facts(files), KEY, "left").withColumns(zeros)


def assemble_files(files: DataFrame, commits: DataFrame) -> DataFrame:
    """``commits`` plus their ordered array ``files``, empty for a commit without files.

    Every file of every given commit is kept, whatever their number. Pass the files of the given
    commits only (``files_of``) where ``files`` holds many others.
    """
    entry = F.struct(
        "pos", "filename", "change_type", "diff", "additions", "deletions", "language"
    )
    arrays = files.groupBy(*KEY).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    empty = F.array().cast(arrays.schema["files"].dataType)
    return commits.join(arrays, KEY, "left").withColumn("files", F.coalesce("files", empty))


def files_of(files: DataFrame, commits: DataFrame) -> DataFrame:
    """The file rows of the given commits (a staged frame: its keys are read several times).

    Diffs of other commits are dropped in the tasks that read them, but for the few that pass the
    filter by chance; what is left meets the commits in an exact join.
    """
    keys = commits.select(*KEY)
    # Not a semi join: the optimiser would move that below the filter.
    return maybe_in(files, keys, KEY).join(keys.distinct(), KEY)
