"""The data-set plan: collected tables -> decisions, output records, excluded records.

Texts move as little as possible. Commits are screened on counts per commit; only the survivors'
diffs are gathered, scored and formatted. Deduplication works on fingerprints. Frames that several
later steps read are staged once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import text as tx
from histloom.operators import dedup, formats
from histloom.operators.exclusions import commit_flags, exclusion_rules
from histloom.operators.keyfilter import maybe_in, surely_out
from histloom.operators.quality import quality_rules, with_scores
from histloom.operators.rules import Rule, first_failing
from histloom.operators.staging import stage
from histloom.operators.structure import (
    commit_structure_rules,
    message_flags,
    pull_structure_rules,
    with_full_message,
)
from histloom.params import FilterParams, RunParams
from histloom.sources import commits as commit_source
from histloom.sources import files as file_source
from histloom.sources import pulls as pull_source
from histloom.sources.exports import Exports

DECISION = ["repo", "source", "record_id", "task", "stage_failed", "reason", "score"]
# Columns of a commit that no step after the screen reads but the log.
_TEXT_ONLY = ("message_body", "author", "author_email", "is_merge", "parent_shas")


def decide(df: DataFrame, stages: list[tuple[str, list[Rule]]]) -> DataFrame:
    """Adds ``stage_failed`` and ``reason`` of the first failing rule over the ordered stages."""
    reason: Column = F.lit(None).cast("string")
    failed: Column = F.lit(None).cast("string")
    for number, (name, rules) in enumerate(stages):
        df = df.withColumn(f"_reason{number}", F.when(reason.isNull(), first_failing(rules)))
        failed = F.coalesce(failed, F.when(F.col(f"_reason{number}").isNotNull(), F.lit(name)))
        reason = F.coalesce(reason, F.col(f"_reason{number}"))
    df = df.withColumns({"stage_failed": failed, "reason": reason})
    return df.drop(*[f"_reason{n}" for n in range(len(stages))])


def screen_commits(commits: DataFrame, files: DataFrame, p: FilterParams) -> DataFrame:
    """Stages 1 and 2 from the commit row and its file counts; no diff text leaves its task.

    Nor does a message but for its subject: what the rules ask of texts is answered where they are
    read, and only the answers meet the counts.
    """
    row, message = commit_flags(p), message_flags(p)
    answers = F.struct(*[c.alias(name) for name, c in {**row, **message}.items()])
    kept = [c for c in commits.columns if c not in _TEXT_ONLY]
    answered = with_full_message(commits).select(*kept, answers.alias("_flags"))
    flags = {name: F.col("_flags")[name] for name in (*row, *message)}
    stages = [("stage1", exclusion_rules(p, flags)), ("stage2", commit_structure_rules(p, flags))]
    return decide(file_source.with_file_facts(answered, files), stages).drop("_flags")


def score_commits(screened: DataFrame, files: DataFrame, p: FilterParams) -> DataFrame:
    """Stage 3 for the commits that passed the screen, with their ``files``."""
    passed = screened.filter(F.col("reason").isNull()).drop("stage_failed", "reason")
    assembled = file_source.assemble_files(file_source.files_of(files, passed), passed)
    return decide(with_scores(assembled), [("stage3", quality_rules(p))])


def screen_pulls(pulls: DataFrame, p: FilterParams) -> DataFrame:
    return decide(pulls, [("stage2", pull_structure_rules(p))])


def commits_of(exports: Exports, keys: DataFrame) -> DataFrame:
    """The commits of the chosen keys, with what the keys bring besides."""
    rows = commit_source.normalise_commits(exports.commits).dropDuplicates(file_source.KEY)
    return rows.join(keys, file_source.KEY)


def pulls_of(exports: Exports, keys: DataFrame) -> DataFrame:
    rows = pull_source.normalise_pulls(exports.pull_requests).dropDuplicates(pull_source.KEY)
    return rows.join(keys, pull_source.KEY)


def _beyond(keys: DataFrame, limit: str, seen: str) -> DataFrame:
    """(limit, repo, n_seen, n_taken): what a limit had to choose from, and took."""
    counts = keys.groupBy("repo").agg(
        F.max(seen).cast("long").alias("n_seen"), F.count(F.lit(1)).alias("n_taken")
    )
    return counts.select(F.lit(limit).alias("limit"), "repo", "n_seen", "n_taken")


def commit_keys(exports: Exports, params: RunParams) -> tuple[DataFrame, list[DataFrame]]:
    """Chosen (repo, sha, arrival), and per limit what it left out.

    Sizes come with the ranking, so limits are accounted for without reading anything again.
    """
    keys = commit_source.select_commits(exports.listing(), params.collect)
    if params.collect.max_commits_per_repo is None:
        return keys.select("repo", "sha", "arrival"), []
    keys = stage(keys, "commit-keys")
    return keys.select("repo", "sha", "arrival"), [_beyond(keys, "max_commits_per_repo", "n_seen")]


def pull_keys(exports: Exports, params: RunParams) -> tuple[DataFrame, list[DataFrame]]:
    collect, closed = params.collect, exports.closed_pulls()
    most = collect.max_prs_per_repo
    if most is None:
        keys = pull_source.scan_pulls(closed, None, collect.since)
        return keys.select(*pull_source.KEY, "arrival"), []
    scanned = stage(pull_source.scanned_pulls(closed, most), "scanned-pulls")
    keys = stage(pull_source.take_pulls(scanned, most, collect.since), "pull-keys")
    left = [_beyond(scanned, "scanned_prs_per_repo", "n_closed"), _beyond(keys, "max_prs_per_repo", "n_seen")]
    return keys.select(*pull_source.KEY, "arrival"), left


def _repeated(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys of more than one row."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return stage(counts.filter("n > 1").select(*key), name)


def _with_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.filter(tx.all_of([F.col(c).isNotNull() for c in key]))


def limited_commits(exports: Exports, params: RunParams) -> tuple[DataFrame, list[DataFrame]]:
    """The commits of a run, and per limit what it left out.

    A run without a limit takes or leaves a commit by its own row. Rows whose key no other row has
    are therefore neither joined with keys nor searched for copies, and are not exchanged for that.
    """
    collect, key = params.collect, file_source.KEY
    own = collect.max_commits_per_repo is None and exports.selected is None and exports.branches is None
    if not own:
        keys, left = commit_keys(exports, params)
        return stage(commits_of(exports, keys), "commits"), left
    repeated = _repeated(exports.commits, key, "repeated-commits")
    lone = surely_out(_with_keys(exports.commits, key), repeated, key)
    listed = lone.withColumns({"branch": F.lit("HEAD"), "is_default": F.lit(True)})
    recent = commit_source.since(listed, "author_ts", collect.since)
    taken = commit_source.newest_commits(commit_source.on_branches(recent, collect.branches), None)
    rows = commit_source.normalise_commits(taken, "arrival")
    if not repeated.isEmpty():
        some = replace(exports, commits=maybe_in(exports.commits, repeated, key))
        rows = rows.unionByName(stage(commits_of(some, commit_keys(some, params)[0]), "commits"))
    return rows, []


def limited_pulls(exports: Exports, params: RunParams) -> tuple[DataFrame, list[DataFrame]]:
    """The pull requests of a run, and per limit what it left out; as limited_commits."""
    collect, key = params.collect, pull_source.KEY
    if collect.max_prs_per_repo is not None or exports.selected is not None:
        keys, left = pull_keys(exports, params)
        return pulls_of(exports, keys), left
    repeated = _repeated(exports.pull_requests, key, "repeated-pulls")
    lone = surely_out(_with_keys(exports.pull_requests, key), repeated, key)
    taken = pull_source.all_merged(lone, collect.since)
    rows = pull_source.normalise_pulls(taken, "arrival")
    if not repeated.isEmpty():
        some = replace(exports, pull_requests=maybe_in(exports.pull_requests, repeated, key))
        rows = rows.unionByName(pulls_of(some, pull_keys(some, params)[0]))
    return rows, []


def collected_commits(exports: Exports, params: RunParams) -> DataFrame:
    return limited_commits(exports, params)[0]


def collected_pulls(exports: Exports, params: RunParams) -> DataFrame:
    return limited_pulls(exports, params)[0]


def _sortable(arrival: Column) -> Column:
    """Ranks as texts of one width; positions of unlimited runs are such texts already."""
    text = arrival.cast("string")
    return F.when(F.length(text) < 10, F.lpad(text, 10, "0")).otherwise(text).alias("arrival")


def dedup_input(scored: DataFrame | None, pulls: DataFrame | None) -> DataFrame:
    """Records that reached stage 4 with their order and content: commits before pull requests."""
    parts = []
    if scored is not None:
        diff = formats.commit_diff_terminated(F.col("files"))
        parts.append(
            scored.filter(F.col("reason").isNull()).select(
                "repo",
                F.lit("commit").alias("source"),
                F.lit(0).alias("source_rank"),
                F.col("sha").alias("record_id"),
                _sortable(F.col("arrival")),
                dedup.content(F.col("message_subject"), diff).alias("content"),
            )
        )
    if pulls is not None:
        parts.append(
            pulls.filter(F.col("reason").isNull()).select(
                "repo",
                F.lit("pr").alias("source"),
                F.lit(1).alias("source_rank"),
                F.col("number").cast("string").alias("record_id"),
                _sortable(F.col("arrival")),
                dedup.content(F.col("title"), F.col("diff")).alias("content"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def cross_source_duplicates(records: DataFrame, p: FilterParams, **skew) -> DataFrame:
    """(repo, source, record_id, is_duplicate) under one index over all repos and sources."""
    order = [F.col("repo"), F.col("source_rank"), F.col("arrival")]
    judged = dedup.keep_first(records, "content", p, order, **skew)
    return judged.select("repo", "source", "record_id", "is_duplicate")


def apply_verdicts(df: DataFrame, verdicts: DataFrame, key: str, source: str, reason: str) -> DataFrame:
    """Stage 4: marks the duplicates among the records without a reason."""
    mine = verdicts.filter((F.col("source") == source) & F.col("is_duplicate")).select(
        "repo", F.col("record_id").cast(df.schema[key].dataType).alias(key), "is_duplicate"
    )
    duplicate = F.col("is_duplicate").isNotNull()
    return (
        df.join(mine, ["repo", key], "left")
        .withColumns(
            {
                "stage_failed": F.when(duplicate, F.lit("stage4")).otherwise(F.col("stage_failed")),
                "reason": F.when(duplicate, F.lit(reason)).otherwise(F.col("reason")),
            }
        )
        .drop("is_duplicate")
    )


def resolved_issues(accepted: DataFrame, exports: Exports, **skew) -> DataFrame:
    """(repo, number, issue, body) of the issues that accepted pull requests link to."""
    links = pull_source.links_with_ceiling(pull_source.issue_links(accepted), exports.repos, **skew)
    return pull_source.resolve_issues(links, exports.issues, **skew)


def with_context(accepted: DataFrame, exports: Exports, **skew) -> DataFrame:
    """Accepted pull requests with their issues and ``context``."""
    resolved = resolved_issues(accepted, exports, **skew)
    with_issues = pull_source.attach_issue_blocks(accepted, resolved)
    return with_issues.withColumn("context", formats.issue_context())


def patch_gates(p: FilterParams, words: Column | None = None) -> list[tuple[str, list[Rule]]]:
    """``words``: those of the context where they are counted already, exact below the minimum."""
    least = p.min_issue_to_patch_words
    unlinked = F.lit(p.require_linked_issue) & (F.size("linked_issue_numbers") == 0)
    thin = tx.fewer_words_than(F.col("context"), least) if words is None else words < least
    return [
        ("stage1", [("pr_exclusion:no_linked_issue", unlinked)]),
        ("stage3", [("content_quality:insufficient_context", thin)]),
    ]


def patch_verdicts(accepted: DataFrame, resolved: DataFrame, p: FilterParams) -> DataFrame:
    """(repo, number, stage_failed, reason): both gates, from words counted per part of a context.

    Parts are set apart by blank lines, so their words add up; no text meets another.
    """
    least = p.min_issue_to_patch_words
    counted = F.when(F.col("_part") != "", tx.words_up_to(F.col("_part"), least).cast("long"))
    # A part is a column of its own before it is counted, so that it is made once.
    blocks = resolved.select(
        *pull_source.KEY, formats.issue_part(pull_source.issue_block()).alias("_part")
    )
    issues = blocks.groupBy(*pull_source.KEY).agg(F.sum(counted).alias("_issue_words"))
    narrow = accepted.select(
        *pull_source.KEY, "linked_issue_numbers", "title", formats.description_part().alias("_part")
    ).select(
        *pull_source.KEY,
        "linked_issue_numbers",
        counted.alias("_own_words"),
        tx.words_up_to(F.col("title"), least).alias("_title_words"),
    )
    joined = narrow.join(issues, pull_source.KEY, "left")
    own, others = F.col("_own_words"), F.col("_issue_words")
    words = F.when(own.isNull() & others.isNull(), F.col("_title_words")).otherwise(
        F.coalesce(own, F.lit(0)) + F.coalesce(others, F.lit(0))
    )
    return decide(joined, patch_gates(p, words)).select(*pull_source.KEY, "stage_failed", "reason")


def patch_candidates(accepted: DataFrame, exports: Exports, p: FilterParams, **skew) -> DataFrame:
    """Accepted pull requests with ``context`` and the two gates of the patch task."""
    contextual = with_context(accepted, exports, **skew)
    return decide(contextual.drop("stage_failed", "reason"), patch_gates(p))


def review_candidates(accepted: DataFrame, exports: Exports, output_format: str) -> DataFrame:
    text = formats.comment_text(output_format)
    return pull_source.attach_ordered(accepted, exports.review_comments, text, "comments")


def _decision(df: DataFrame, source: str, key: str, task: str | None, score: Column) -> DataFrame:
    return df.select(
        "repo",
        F.lit(source).alias("source"),
        F.col(key).cast("string").alias("record_id"),
        F.lit(task).cast("string").alias("task"),
        "stage_failed",
        "reason",
        score.cast("double").alias("score"),
    )


@dataclass
class Outcome:
    """Frames of a planned run, by what they hold."""

    output_format: str
    decisions: list[DataFrame] = field(default_factory=list)
    collected: list[DataFrame] = field(default_factory=list)
    records: list[DataFrame] = field(default_factory=list)
    excluded: list[tuple[str, Callable[[], DataFrame], list[str]]] = field(default_factory=list)
    limits: list[DataFrame] = field(default_factory=list)

    def left_out(self) -> DataFrame | None:
        """(limit, repo, n_seen, n_taken) of every limit that was set; None without any."""
        return reduce(DataFrame.union, self.limits) if self.limits else None

    def all_decisions(self) -> DataFrame:
        """One row per excluded record, and per (record, task) that came further."""
        return reduce(DataFrame.union, self.decisions)

    def all_collected(self) -> DataFrame:
        return reduce(DataFrame.union, self.collected)

    def all_records(self) -> DataFrame:
        columns = ["task", *formats.record_columns(self.output_format)]
        return reduce(DataFrame.unionByName, [df.select(*columns) for df in self.records])

    def record(self, task: str, df: DataFrame) -> None:
        self.records.append(df.withColumn("task", F.lit(task)))

    def exclude(self, source: str, whole: Callable[[], DataFrame], columns: list[str]) -> None:
        """``whole`` gathers the excluded records as they are logged; called only for a log."""
        self.excluded.append((source, whole, columns))

    def excluded_log(self) -> DataFrame:
        """source, repo, record (JSON text), stage_failed, reason."""
        parts = [
            whole().select(
                F.lit(source).alias("source"),
                "repo",
                F.to_json(F.struct(*columns)).alias("record"),
                "stage_failed",
                "reason",
            )
            for source, whole, columns in self.excluded
        ]
        return reduce(DataFrame.unionByName, parts)

    def excluded_lines(self, logged_at: Column) -> DataFrame:
        """The log as JSON lines with the nested record."""
        parts = []
        for _, whole, columns in self.excluded:
            record = F.struct(*columns).alias("record")
            entry = F.struct(record, "stage_failed", "reason", logged_at.alias("timestamp"))
            parts.append(whole().select(F.to_json(entry).alias("value")))
        return reduce(DataFrame.union, parts)


_COMMIT_RECORD = [
    "sha", "repo", "message_subject", "message_body", "author", "author_email", "timestamp",
    "files_changed", "total_additions", "total_deletions", "is_merge", "parent_shas",
]
_PULL_RECORD = [
    "number", "repo", "title", "body", "diff", "linked_issue_numbers", "labels", "merged_at",
    "review_comments", "linked_issue_bodies",
]


def _excluded(df: DataFrame, key: list[str], *more: str) -> DataFrame:
    return df.filter(F.col("reason").isNotNull()).select(*key, "stage_failed", "reason", *more)


def _whole_commits(excluded: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Excluded commits as collected, with all of their files; texts of others do not move."""
    key, excluded = file_source.KEY, stage(excluded, "excluded-commits")
    rows = maybe_in(commits, excluded.select(*key), key).drop("arrival")
    nested = file_source.assemble_files(
        file_source.files_of(files, excluded), excluded.join(rows, key)
    )
    return nested.withColumn("files_changed", F.transform("files", lambda f: f.dropFields("pos")))


def _whole_pulls(
    gated: DataFrame, verdicts: DataFrame | None, comments: DataFrame | None, resolved: DataFrame | None
) -> DataFrame:
    """Excluded pull requests as they are logged: with their comments and what was resolved of
    their issues. Rows of a repeated key come as often as ``gated`` has them."""
    key = pull_source.KEY
    rows = gated.filter(F.col("reason").isNotNull())
    keys = rows.select(*key)
    if verdicts is not None:
        failed = stage(_excluded(verdicts, key).distinct(), "excluded-patches")
        accepted = gated.filter(F.col("reason").isNull()).drop("stage_failed", "reason")
        rows = rows.unionByName(maybe_in(accepted, failed, key).join(failed, key))
        keys = keys.union(failed.select(*key))
    if comments is None:
        kind = "array<struct<path:string,diff_hunk:string,body:string,author:string>>"
        rows = rows.withColumn("review_comments", F.array().cast(kind))
    else:
        keys = stage(keys.distinct(), "excluded-pulls")
        author = pull_source.comment_author(F.col("author")).alias("author")
        entry = F.struct("path", "diff_hunk", "body", author)
        wanted = maybe_in(comments, keys, key).join(keys, key)
        rows = pull_source.attach_gathered(rows, wanted, entry, "review_comments")
    if resolved is not None:
        return pull_source.attach_issue_blocks(rows, resolved)
    return rows.withColumn("linked_issue_bodies", F.array().cast("array<string>"))


def _plan_commits(out: Outcome, commits: DataFrame, screened: DataFrame, judged: DataFrame,
                  files: DataFrame) -> None:
    early = screened.filter(F.col("reason").isNotNull())
    passed = judged.filter(F.col("reason").isNull())
    no_score = F.lit(None)
    out.decisions += [
        _decision(early, "commit", "sha", None, no_score),
        _decision(judged, "commit", "sha", "commit_message", F.col("score")),
    ]
    out.collected.append(screened.select("repo", F.lit("commit").alias("source")))
    out.record("commit_message", formats.format_commits(passed, out.output_format))
    totals = ("total_additions", "total_deletions")
    excluded = _excluded(screened, file_source.KEY, *totals).unionByName(
        _excluded(judged, file_source.KEY, *totals)
    )
    out.exclude("commit", lambda: _whole_commits(excluded, commits, files), _COMMIT_RECORD)


def _both_records(accepted: DataFrame, resolved: DataFrame, exports: Exports, output_format: str,
                  p: FilterParams) -> DataFrame:
    """Review and patch records, with their task, of pull requests that are moved once for both."""
    reviewed = review_candidates(accepted.drop("stage_failed", "reason"), exports, output_format)
    linked = pull_source.attach_issue_blocks(reviewed, resolved)
    whole = decide(linked.withColumn("context", formats.issue_context()), patch_gates(p))
    columns = formats.record_columns(output_format)

    def entry(task: str) -> Column:
        return F.struct(F.lit(task).alias("task"), *columns)

    whole = formats.format_reviews(whole, output_format).withColumn("_review", entry("pr_review"))
    whole = formats.format_patches(whole.drop(*columns), output_format)
    passed = F.when(F.col("reason").isNull(), entry("issue_to_patch"))
    both = whole.select("_review", passed.alias("_patch"))
    return both.select(F.inline(F.array_compact(F.array("_review", "_patch"))))


def _plan_pulls(out: Outcome, gated: DataFrame, exports: Exports, params: RunParams, **skew) -> None:
    accepted = gated.filter(F.col("reason").isNull())
    dropped = gated.filter(F.col("reason").isNotNull())
    verdicts = resolved = None
    out.decisions.append(_decision(dropped, "pr", "number", None, F.lit(None)))
    out.collected.append(gated.select("repo", F.lit("pr").alias("source")))
    if params.wants_reviews:
        out.decisions.append(_decision(accepted, "pr", "number", "pr_review", F.lit(1.0)))
    if params.wants_patches:
        resolved = resolved_issues(accepted, exports, **skew)
        verdicts = patch_verdicts(accepted, resolved, params.filter)
        out.decisions.append(_decision(verdicts, "pr", "number", "issue_to_patch", F.lit(1.0)))
    if params.wants_reviews and params.wants_patches:
        out.records.append(_both_records(accepted, resolved, exports, out.output_format, params.filter))
    elif params.wants_reviews:
        reviewed = review_candidates(accepted, exports, out.output_format)
        out.record("pr_review", formats.format_reviews(reviewed, out.output_format))
    else:
        linked = pull_source.attach_issue_blocks(accepted.drop("stage_failed", "reason"), resolved)
        patches = decide(linked.withColumn("context", formats.issue_context()), patch_gates(params.filter))
        passed = patches.filter(F.col("reason").isNull())
        out.record("issue_to_patch", formats.format_patches(passed, out.output_format))
    comments = exports.review_comments
    out.exclude("pr", lambda: _whole_pulls(gated, verdicts, comments, resolved), _PULL_RECORD)


def plan_run(exports: Exports, params: RunParams, **skew) -> Outcome:
    """All four stages and the formatting for the chosen task."""
    out = Outcome(params.output_format)
    commits = screened = scored = files = pulls = None
    wants_pulls = params.wants_reviews or params.wants_patches
    if params.wants_commits:
        files = file_source.normalise_files(exports.file_changes)
        commits, left = limited_commits(exports, params)
        out.limits += left
        screened = stage(screen_commits(commits, files, params.filter), "screened")
        scored = stage(score_commits(screened, files, params.filter), "scored")
    if wants_pulls:
        rows, left = limited_pulls(exports, params)
        out.limits += left
        pulls = stage(screen_pulls(rows, params.filter), "pulls")
    # Read by commits and pull requests, and by each of their outputs: decided once.
    verdicts = stage(
        cross_source_duplicates(dedup_input(scored, pulls), params.filter, **skew).filter(
            "is_duplicate"
        ),
        "duplicates",
    )
    if params.wants_commits:
        judged = apply_verdicts(scored, verdicts, "sha", "commit", "dedup:near_duplicate")
        _plan_commits(out, commits, screened, judged, files)
    if wants_pulls:
        # Texts stay where "pulls" has them: whoever counts reads no more than keys and verdicts.
        gated = apply_verdicts(pulls, verdicts, "number", "pr", "dedup:near_duplicate_pr")
        _plan_pulls(out, gated, exports, params, **skew)
    return out
