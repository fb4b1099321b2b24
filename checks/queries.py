"""One query per operator, over the whole of the given tables. Results hold scalar columns only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.session import with_folder
from checks.tables import documents, view
from histloom import params as pm
from histloom.functions import minhash
from histloom.functions import text as tx
from histloom.operators import dedup, formats, health, quality, report, similarity, split
from histloom.operators.exclusions import exclusion_rules
from histloom.operators.rules import first_failing
from histloom.operators.structure import (
    commit_structure_rules,
    pull_structure_rules,
    with_full_message,
)
from histloom.plans import dataset, funnel, jobs
from histloom.sources import catalog, commits, files, pulls
from histloom.sources.exports import Exports

Query = Callable[[SparkSession, str], DataFrame]

PROFILE = pm.profile("default")
# Whole runs take everything; what limits do is the subject of queries of their own.
WHOLE = replace(
    PROFILE, collect=replace(PROFILE.collect, max_commits_per_repo=None, max_prs_per_repo=None)
)
BRANCHES = ("release", "2-HIGH", "5-LOW")
SINCE = date(1995, 6, 17)
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(with_folder(spark), sf)

    QUERIES[fn.__name__] = run
    return run


# ---- shared frames ------------------------------------------------------------------------


def _raw_commits(spark, sf) -> DataFrame:
    one, two = F.array(F.lit("p")), F.array(F.lit("p"), F.lit("q"))
    parents = F.when(F.col("doc_id") % 37 == 0, two).otherwise(one)
    return view(spark, sf, "fx_commits").withColumn("parent_shas", parents)


def _commits(spark, sf) -> DataFrame:
    return commits.normalise_commits(_raw_commits(spark, sf))


def _files(spark, sf) -> DataFrame:
    return files.normalise_files(view(spark, sf, "fx_files"))


def _with_facts(spark, sf) -> DataFrame:
    return files.with_file_facts(_commits(spark, sf), _files(spark, sf))


def _assembled(spark, sf) -> DataFrame:
    """All commits with all of their files."""
    return files.assemble_files(_files(spark, sf), _with_facts(spark, sf))


def _pulls(spark, sf) -> DataFrame:
    raw = view(spark, sf, "fx_pulls").withColumn("labels", F.array().cast("array<string>"))
    return pulls.normalise_pulls(raw)


def _exports(spark, sf) -> Exports:
    return Exports(
        commits=_raw_commits(spark, sf),
        file_changes=view(spark, sf, "fx_files"),
        pull_requests=view(spark, sf, "fx_pulls").withColumn(
            "labels", F.array().cast("array<string>")
        ),
        review_comments=view(spark, sf, "fx_comments"),
        issues=view(spark, sf, "fx_issues"),
        repos=view(spark, sf, "fx_repo_sizes"),
    )


def _run(spark, sf, task: str, output_format: str = "alpaca") -> dataset.Outcome:
    with_folder(spark)
    p = replace(WHOLE, output_format=output_format, task=task)
    return dataset.plan_run(_exports(spark, sf), p)


def _joined(column) -> F.Column:
    return F.array_join(column, ",")


# ---- sources and normalisation ------------------------------------------------------------


@query
def commit_subject_body(spark, sf):
    return _commits(spark, sf).select("sha", "message_subject", "message_body")


@query
def file_change_norm(spark, sf):
    return _files(spark, sf).select("repo", "sha", "pos", "filename", "change_type", "diff")


@query
def language_detect(spark, sf):
    return _files(spark, sf).select("sha", "pos", "filename", "language")


@query
def commit_assembly(spark, sf):
    rows = files.normalise_files(view(spark, sf, "fx_order_files"))
    facts = files.with_file_facts(view(spark, sf, "fx_orders"), rows)
    return files.assemble_files(rows, facts).select(
        "repo",
        "sha",
        "n_files",
        "total_additions",
        "total_deletions",
        "diff_lines",
        _joined(F.col("files.filename")).alias("filenames"),
    )


@query
def file_facts(spark, sf):
    return _with_facts(spark, sf).select("repo", "sha", *files.FACTS)


@query
def commit_branch_dedup(spark, sf):
    listing = commits.on_branches(view(spark, sf, "fx_branches"), BRANCHES)
    return commits.first_branch(listing).select("repo", "sha", "branch_pos")


@query
def commit_branch_filter(spark, sf):
    listing = view(spark, sf, "fx_branches")
    named = commits.on_branches(listing, BRANCHES).withColumn("choice", F.lit("named"))
    default = commits.on_branches(listing, ()).withColumn("choice", F.lit("default"))
    return named.union(default).select("choice", "repo", "branch", "sha", "branch_pos")


@query
def commits_newest_n(spark, sf):
    listing = commits.first_branch(commits.on_branches(view(spark, sf, "fx_branches"), BRANCHES))
    return commits.newest_commits(listing, 100).select("repo", "sha", "arrival")


@query
def commits_since(spark, sf):
    return commits.since(view(spark, sf, "fx_branches"), "author_ts", SINCE).select(
        "repo", "branch", "sha"
    )


@query
def pr_scan(spark, sf):
    kept = pulls.scan_pulls(view(spark, sf, "fx_closed"), 50, date(2024, 1, 10))
    return kept.select("repo", "number", "arrival")


@query
def linked_issues(spark, sf):
    return _pulls(spark, sf).select(
        "repo", "number", _joined("linked_issue_numbers").alias("linked_issue_numbers")
    )


@query
def pr_comment_attach(spark, sf):
    entry = F.concat_ws("|", "path", "diff_hunk", "body", pulls.comment_author(F.col("author")))
    attached = pulls.attach_ordered(
        _pulls(spark, sf), view(spark, sf, "fx_comments"), entry, "comments"
    )
    return attached.select(
        "repo",
        "number",
        F.size("comments").alias("n_comments"),
        F.array_join("comments", "\n").alias("comments"),
    )


@query
def pr_label_attach(spark, sf):
    attached = pulls.attach_ordered(
        _pulls(spark, sf).drop("labels"), view(spark, sf, "fx_labels"), F.col("name"), "labels"
    )
    return attached.select("repo", "number", _joined("labels").alias("labels"))


@query
def issue_ceiling(spark, sf):
    links = pulls.issue_links(_pulls(spark, sf))
    joined = pulls.links_with_ceiling(links, view(spark, sf, "fx_repo_sizes"))
    reachable = pulls.within_ceiling(F.col("issue"), F.col("ceiling"))
    return joined.select("repo", "number", "issue", "ceiling", reachable.alias("reachable"))


@query
def issue_resolve(spark, sf):
    rows = _pulls(spark, sf)
    links = pulls.links_with_ceiling(pulls.issue_links(rows), view(spark, sf, "fx_repo_sizes"))
    resolved = pulls.resolve_issues(links, view(spark, sf, "fx_issues"))
    return pulls.attach_issue_blocks(rows, resolved).select(
        "repo", "number", F.array_join("linked_issue_bodies", "\n").alias("issue_blocks")
    )


@query
def release_semver(spark, sf):
    return view(spark, sf, "fx_releases").select(
        "tag_name", catalog.is_semver(F.col("tag_name")).alias("is_semver")
    )


@query
def release_norm(spark, sf):
    return catalog.normalise_releases(view(spark, sf, "fx_releases"))


@query
def repo_catalog(spark, sf):
    return catalog.repo_catalog(view(spark, sf, "fx_repo_listing"))


@query
def repo_prefilter(spark, sf):
    rows = catalog.repo_catalog(view(spark, sf, "fx_repo_listing"))
    return catalog.prefilter_repos(rows, public_only=True, min_stars=3000)


@query
def branch_catalog(spark, sf):
    return catalog.branch_catalog(view(spark, sf, "fx_branches"))


@query
def branch_commit_counts(spark, sf):
    chosen = pm.CollectParams(since=SINCE, branches=BRANCHES)
    return commits.branch_commit_counts(view(spark, sf, "fx_branches"), chosen)


@query
def nonblank_lines(spark, sf):
    return split.non_blank(view(spark, sf, "fx_lines"))


# ---- text and path expressions ------------------------------------------------------------


@query
def word_count(spark, sf):
    return documents(spark, sf).select("doc_id", tx.count_words(F.col("text")).alias("n_words"))


@query
def diff_line_count(spark, sf):
    return documents(spark, sf).select("doc_id", tx.line_count(F.col("text")).alias("n_lines"))


@query
def file_ext(spark, sf):
    path = F.col("filename")
    return _files(spark, sf).select(
        "sha", "pos", tx.file_ext(path).alias("ext"), tx.basename(path).alias("base")
    )


@query
def strip_trailers(spark, sf):
    rows = _commits(spark, sf)
    return rows.select("sha", tx.strip_trailers(F.col("message_body")).alias("clean_body"))


@query
def strip_html_comments(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", tx.strip_html_comments(F.col("html")).alias("clean"))


@query
def commit_diff_text(spark, sf):
    return _assembled(spark, sf).select(
        "repo",
        "sha",
        formats.commit_diff(F.col("files")).alias("diff_text"),
        formats.commit_diff_terminated(F.col("files")).alias("terminated"),
    )


# ---- stage 1 and 2 ------------------------------------------------------------------------


@query
def hard_exclusions(spark, sf):
    reason = first_failing(exclusion_rules(PROFILE.filter))
    return _with_facts(spark, sf).select("repo", "sha", reason.alias("reason"))


def _single_rule(reason: str, fails) -> Query:
    def run(spark, sf):
        hit = F.coalesce(fails(), F.lit(False))
        return _with_facts(spark, sf).select("repo", "sha", hit.alias("excluded"))

    run.__name__ = "excl_" + reason.split(":")[1]
    return query(run)


EXCLUSIONS = (
    "is_merge", "is_revert", "is_bot", "no_files", "binary_only", "lockfile_only",
    "empty_or_trivial_message", "wip_message", "version_bump_only", "url_only_message",
    "ticket_only_message",
)
for _name in EXCLUSIONS:
    _single_rule(
        f"hard_exclusion:{_name}",
        lambda name=_name: dict(exclusion_rules(PROFILE.filter))[f"hard_exclusion:{name}"],
    )


@query
def structural_commit(spark, sf):
    reason = first_failing(commit_structure_rules(PROFILE.filter))
    described = with_full_message(_with_facts(spark, sf))
    return described.select("repo", "sha", reason.alias("reason"))


@query
def structural_pr(spark, sf):
    reason = first_failing(pull_structure_rules(PROFILE.filter))
    return _pulls(spark, sf).select("repo", "number", reason.alias("reason"))


# ---- stage 3 ------------------------------------------------------------------------------


@query
def verb_start_score(spark, sf):
    score = quality.verb_start_score(F.col("message_subject"))
    return _commits(spark, sf).select("sha", score.alias("verb_score"))


@query
def informativeness_score(spark, sf):
    score = quality.informativeness_score(F.col("message_subject"), F.col("files"))
    return _assembled(spark, sf).select("sha", score.alias("info_score"))


@query
def alignment_score(spark, sf):
    score = quality.alignment_score(F.col("message_subject"), F.col("files"))
    return _assembled(spark, sf).select("sha", score.alias("align_score"))


@query
def language_bonus(spark, sf):
    score = quality.language_bonus(F.col("n_code_files"))
    return _with_facts(spark, sf).select("sha", score.alias("lang_score"))


@query
def content_score(spark, sf):
    return quality.with_scores(_assembled(spark, sf)).select("sha", "score")


@query
def content_quality(spark, sf):
    scored = quality.with_scores(_assembled(spark, sf))
    reason = first_failing(quality.quality_rules(PROFILE.filter))
    return scored.select("repo", "sha", "score", reason.alias("reason"))


@query
def patch_gates(spark, sf):
    strict = pm.profile("strict").filter
    gated = dataset.patch_candidates(_pulls(spark, sf), _exports(spark, sf), strict)
    return gated.select("repo", "number", "stage_failed", "reason")


# ---- stage 4 ------------------------------------------------------------------------------


@query
def dedup_exact(spark, sf):
    exact = pm.FilterParams(dedup_method="exact")
    rows = documents(spark, sf).select(F.col("doc_id").alias("ord"), "text")
    judged = dedup.keep_first(rows, "text", exact)
    return judged.select(F.col("ord").alias("doc_id"), "is_duplicate")


@query
def minhash_signature(spark, sf):
    rows = documents(spark, sf).select("doc_id", minhash.minhash_signature("text").alias("s"))
    return rows.select("doc_id", _joined(F.col("s").cast("array<string>")).alias("signature"))


@query
def lsh_bands(spark, sf):
    threshold = PROFILE.filter.dedup_threshold
    rows = documents(spark, sf).select("doc_id", "text")
    banded = dedup.with_band_keys(rows, F.col("text"), threshold)
    return banded.select("doc_id", F.posexplode("bands").alias("band", "band_key"))


@query
def dedup_minhash(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("ord"), "text")
    judged = dedup.keep_first(rows, "text", PROFILE.filter)
    return judged.select(F.col("ord").alias("doc_id"), "is_duplicate")


def _evidence(spark, sf) -> DataFrame:
    rows = documents(spark, sf).select(F.col("doc_id").alias("ord"), "text")
    judged = dedup.keep_first(rows, "text", PROFILE.filter).withColumn("is_kept", ~F.col("is_duplicate"))
    return similarity.witnesses(rows, F.col("text"), PROFILE.filter.dedup_threshold, judged)


@query
def near_dup_witness(spark, sf):
    """Every document with the earliest kept one that is similar to it."""
    return _evidence(spark, sf).select(
        F.col("ord").alias("doc_id"), (~F.col("is_kept")).alias("is_duplicate"),
        F.col("witness").alias("witness_id"), "jaccard",
    )


@query
def dedup_recall(spark, sf):
    return similarity.recall(_evidence(spark, sf))


@query
def dedup_cross_source(spark, sf):
    """Commits and pull requests under one index, before any other rule."""
    exports = _exports(spark, sf)
    none = {"reason": F.lit(None).cast("string")}
    rows = dataset.collected_commits(exports, WHOLE)
    facts = files.with_file_facts(rows, _files(spark, sf))
    assembled = files.assemble_files(_files(spark, sf), facts).withColumns(none)
    requests = dataset.collected_pulls(exports, WHOLE).withColumns(none)
    return dataset.cross_source_duplicates(
        dataset.dedup_input(assembled, requests), PROFILE.filter
    )


# ---- formats ------------------------------------------------------------------------------


def _meta_columns() -> list:
    names = ("repo", "sha", "pr_number", "task", "score", "timestamp")
    return [F.col("_meta")[c].alias(f"meta_{c}") for c in names]


def _alpaca(df: DataFrame) -> DataFrame:
    return df.select("instruction", "input", "output", *_meta_columns())


def _sharegpt(df: DataFrame) -> DataFrame:
    turns = F.col("conversations")
    return df.select(
        _joined(turns["from"]).alias("speakers"),
        turns[0]["value"].alias("system"),
        turns[1]["value"].alias("human"),
        turns[2]["value"].alias("gpt"),
        *_meta_columns(),
    )


def _scored(spark, sf) -> DataFrame:
    return quality.with_scores(_assembled(spark, sf))


def _reviewed(spark, sf, output_format: str) -> DataFrame:
    rows = dataset.review_candidates(_pulls(spark, sf), _exports(spark, sf), output_format)
    return formats.format_reviews(rows, output_format)


def _patches(spark, sf) -> DataFrame:
    return dataset.patch_candidates(_pulls(spark, sf), _exports(spark, sf), PROFILE.filter)


@query
def fmt_commit_alpaca(spark, sf):
    return _alpaca(formats.format_commits(_scored(spark, sf), "alpaca"))


@query
def fmt_commit_sharegpt(spark, sf):
    return _sharegpt(formats.format_commits(_scored(spark, sf), "sharegpt"))


@query
def fmt_review_alpaca(spark, sf):
    return _alpaca(_reviewed(spark, sf, "alpaca"))


@query
def fmt_review_sharegpt(spark, sf):
    return _sharegpt(_reviewed(spark, sf, "sharegpt"))


@query
def issue_context(spark, sf):
    return _patches(spark, sf).select("repo", "number", "context")


@query
def fmt_patch_alpaca(spark, sf):
    return _alpaca(formats.format_patches(_patches(spark, sf), "alpaca"))


@query
def fmt_patch_sharegpt(spark, sf):
    return _sharegpt(formats.format_patches(_patches(spark, sf), "sharegpt"))


# ---- whole runs and their report ----------------------------------------------------------


@query
def dataset_commit_message(spark, sf):
    return _alpaca(_run(spark, sf, "commit_message").all_records())


@query
def dataset_pr_review(spark, sf):
    return _sharegpt(_run(spark, sf, "pr_review", "sharegpt").all_records())


@query
def dataset_issue_to_patch(spark, sf):
    return _alpaca(_run(spark, sf, "issue_to_patch").all_records())


@query
def dataset_all(spark, sf):
    return _alpaca(_run(spark, sf, "all").all_records())


@query
def clean_dataset(spark, sf):
    return jobs.clean(_run(spark, sf, "all").all_records())


@query
def excluded_log(spark, sf):
    """The log's scalars and a digest of what its records hold: files, or diff and comments."""
    log = _run(spark, sf, "all").excluded_log()
    # Parsed once: the records are most of the input again.
    content = F.from_json(
        "record",
        "sha string, number string, message_subject string, title string, diff string, "
        "files_changed array<struct<filename:string,change_type:string,"
        "additions:bigint,deletions:bigint,diff:string>>, "
        "review_comments array<struct<path:string,diff_hunk:string,body:string,author:string>>",
    )

    def rows(column: str, *fields: str) -> F.Column:
        lines = F.transform(column, lambda r: F.concat_ws("|", *[r[f] for f in fields]))
        return F.array_join(lines, "\n")

    files_text = rows("c.files_changed", "filename", "change_type", "additions", "deletions", "diff")
    comments_text = rows("c.review_comments", "path", "diff_hunk", "body", "author")
    pull_text = F.concat("c.diff", F.lit("\n"), comments_text)
    return log.withColumn("c", content).select(
        "source",
        "repo",
        F.coalesce("c.sha", "c.number").alias("record_id"),
        F.coalesce("c.message_subject", "c.title").alias("headline"),
        "stage_failed",
        "reason",
        F.md5(F.when(F.col("source") == "commit", files_text).otherwise(pull_text)).alias("content"),
    )


@query
def decisions_all(spark, sf):
    return _run(spark, sf, "all").all_decisions()


@query
def stage_funnel(spark, sf):
    return report.stage_funnel(_run(spark, sf, "all").all_decisions())


@query
def reason_counts(spark, sf):
    return report.reason_counts(_run(spark, sf, "all").all_decisions())


@query
def task_distribution(spark, sf):
    return report.task_distribution(_run(spark, sf, "all").all_decisions())


@query
def run_stats(spark, sf):
    outcome = _run(spark, sf, "all")
    return report.run_stats(outcome.all_decisions(), outcome.all_collected())


@query
def repos_processed(spark, sf):
    return report.repos_processed(_run(spark, sf, "all").all_collected())


@query
def run_report(spark, sf):
    """The report row without its id and times; maps as sorted text."""
    row = jobs.run(_exports(spark, sf), WHOLE, output="", dry_run=True)

    def listed(name: str) -> F.Column:
        entries = F.array_sort(F.map_entries(name))
        texts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return _joined(texts)

    return row.select(
        "stats.*", "left_out.*", "n_repos", "format", "task",
        listed("top_exclusion_reasons").alias("reasons"),
        listed("task_distribution").alias("tasks"),
    )


@query
def collection_limits(spark, sf):
    """What small limits leave out, per limit and repo."""
    exports = _exports(spark, sf)
    p = PROFILE.limited_to(50)
    limits = [*dataset.commit_keys(exports, p)[1], *dataset.pull_keys(exports, p)[1]]
    return limits[0].union(limits[1]).union(limits[2])


@query
def profile_funnel(spark, sf):
    """All four stages under each preset with its own selection, from one pass."""
    profiles = {name: pm.profile(name) for name in pm.profile_names()}
    return funnel.profile_funnel(_exports(spark, sf), profiles)


# ---- repository health --------------------------------------------------------------------


def _closed(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_closed")


@query
def health_sample(spark, sf):
    return health.health_sample(_closed(spark, sf)).select("repo", "number", "rank")


@query
def health_signals(spark, sf):
    hits = health.review_signals(health.health_sample(_closed(spark, sf)))
    return hits.select("repo", "number", "system", "doc_url", "signal", "by_bot")


@query
def health_examples(spark, sf):
    hits = health.review_signals(health.health_sample(_closed(spark, sf)))
    shown = health.example_signals(hits)
    return shown.select("repo", F.array_join("example_signals", "; ").alias("example_signals"))


@query
def repo_health(spark, sf):
    return health.repo_health(_closed(spark, sf)).select(
        "repo", "merge_rate", "total_sampled", "merged_count", "external_system", "system_doc_url",
        _joined("bot_usernames").alias("bot_usernames"), "is_native", "confidence",
    )


@query
def healthy_repos(spark, sf):
    closed = _closed(spark, sf)
    selected = closed.select(F.col("repo").alias("full_name")).distinct()
    return health.drop_flagged(selected, health.repo_health(closed, selected))


# ---- splits -------------------------------------------------------------------------------


def _sides(train: DataFrame, held_out: DataFrame, *columns: str) -> DataFrame:
    return train.select(*columns, F.lit("train").alias("side")).union(
        held_out.select(*columns, F.lit("eval").alias("side"))
    )


@query
def train_eval_split(spark, sf):
    sides = _sides(*split.split_lines(view(spark, sf, "fx_lines"), "line_no"), "value")
    return sides.groupBy("value", "side").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def train_eval_split_ordered(spark, sf):
    rows = split.non_blank(view(spark, sf, "fx_lines"))
    return _sides(*split.split_in_order(rows, "line_no"), "line_no", "value")
