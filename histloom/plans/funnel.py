"""Several sets of parameters compared over one pass: what each would keep, and why not the rest.

Every record carries one bit per profile that takes it. Facts, scores, signatures and issue contexts
are computed once for all records that any profile needs; only rules differ. Stage 4 decides all
profiles together: a record takes part once per profile, under keys of that profile's own, so the
rounds of one never touch another and all are done in the rounds of the slowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions.minhash import band_keys, minhash_signature
from histloom.operators import dedup, formats
from histloom.operators.exclusions import exclusion_rules
from histloom.operators.quality import quality_rules, with_scores
from histloom.operators.rules import first_failing
from histloom.operators.staging import stage
from histloom.operators.structure import (
    commit_structure_rules,
    pull_structure_rules,
    with_full_message,
)
from histloom.params import FilterParams, RunParams
from histloom.plans import dataset
from histloom.sources import commits as commit_source
from histloom.sources import files as file_source
from histloom.sources import pulls as pull_source
from histloom.sources.exports import Exports


def _bit(bits: str, i: int) -> Column:
    return F.col(bits).bitwiseAND(F.lit(1 << i)) != 0


def _decided(df: DataFrame, stages: list, i: int) -> DataFrame:
    """``failed{i}`` and ``reason{i}``: the first failing rule of profile ``i``."""
    return dataset.decide(df, stages).withColumnsRenamed(
        {"stage_failed": f"failed{i}", "reason": f"reason{i}"}
    )


def _open(n: int) -> Column:
    """Bits of the profiles that take a record and have no reason against it."""
    flags = [F.when(_bit("taken", i) & F.col(f"reason{i}").isNull(), 1 << i).otherwise(0) for i in range(n)]
    return sum(flags[1:], flags[0])


def _commits(exports: Exports, filters: list[FilterParams], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(screened, scored): stages 1 and 2 of all taken commits; stage 3 of those still open."""
    files = file_source.normalise_files(exports.file_changes)
    rows = file_source.with_file_facts(dataset.commits_of(exports, keys), files)
    rows = with_full_message(rows)
    for i, p in enumerate(filters):
        stages = [("stage1", exclusion_rules(p)), ("stage2", commit_structure_rules(p))]
        rows = _decided(rows, stages, i)
    screened = rows.drop("full_message").withColumn("open", _open(len(filters)))
    screened = stage(screened, "funnel-screened")
    passed = screened.filter("open > 0")
    scored = with_scores(file_source.assemble_files(file_source.files_of(files, passed), passed))
    for i, p in enumerate(filters):
        late = F.when(_bit("open", i), first_failing(quality_rules(p)))
        scored = scored.withColumns(
            {
                f"failed{i}": F.when(late.isNotNull(), F.lit("stage3")).otherwise(F.col(f"failed{i}")),
                f"reason{i}": F.coalesce(late, f"reason{i}"),
            }
        )
    scored = scored.withColumns({"scored": F.col("open"), "open": _open(len(filters))})
    return screened, stage(scored, "funnel-scored")


def _pulls(exports: Exports, filters: list[FilterParams], keys: DataFrame) -> DataFrame:
    rows = dataset.pulls_of(exports, keys)
    for i, p in enumerate(filters):
        rows = _decided(rows, [("stage2", pull_structure_rules(p))], i)
    return stage(rows.withColumn("open", _open(len(filters))), "funnel-pulls")


def _contents(scored: DataFrame, pulls: DataFrame) -> DataFrame:
    diff = formats.commit_diff_terminated(F.col("files"))
    commits = scored.filter("open > 0").select(
        "repo", F.lit("commit").alias("source"), F.lit(0).alias("source_rank"),
        F.col("sha").alias("record_id"), "arrival", "open",
        dedup.content(F.col("message_subject"), diff).alias("content"),
    )
    requests = pulls.filter("open > 0").select(
        "repo", F.lit("pr").alias("source"), F.lit(1).alias("source_rank"),
        F.col("number").cast("string").alias("record_id"), "arrival", "open",
        dedup.content(F.col("title"), F.col("diff")).alias("content"),
    )
    return commits.unionByName(requests)


def _duplicates(records: DataFrame, filters: list[FilterParams], **skew) -> DataFrame:
    """(repo, source, record_id, copies): bits of the profiles in which a record is a duplicate."""
    n = len(filters)
    signed = records
    if any(p.dedup_method == "minhash" for p in filters):
        signed = records.withColumn("_signature", minhash_signature("content"))
    digest = F.sha2("content", 256)
    runs = []
    for i, p in enumerate(filters):
        bands = F.lit(None).cast("array<string>")
        if p.dedup_method == "minhash":
            bands = band_keys(F.col("_signature"), p.dedup_threshold)
        group = F.coalesce(F.md5(F.array_join(bands, "")), digest)
        runs.append(F.struct(F.lit(i).alias("i"), group.alias("group"), bands.alias("bands")))
    keyed = stage(
        signed.select("repo", "source", "source_rank", "record_id", "arrival", "open",
                      F.array(*runs).alias("runs")),
        "funnel-keyed",
    )
    order = [F.col("repo"), F.col("source_rank"), F.col("arrival")]
    keyed = dedup.number_in_order(keyed, order)
    each = keyed.select("ord", "open", F.inline("runs")).filter(
        F.col("open").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("i"))) != 0
    )
    own = F.concat(F.col("i").cast("string"), F.lit("-"))
    each = each.select(
        (F.col("ord") * n + F.col("i")).alias("ord"),
        F.concat(own, "group").alias("_group"),
        F.transform("bands", lambda b: F.concat(own, b)).alias("bands"),
    )
    judged = dedup.judge(stage(each, "funnel-runs"), **skew).filter("is_duplicate")
    copies = judged.select(
        F.floor(F.col("ord") / F.lit(n)).cast("long").alias("ord"),
        F.call_function("shiftleft", F.lit(1), (F.col("ord") % n).cast("int")).alias("bit"),
    )
    bits = copies.groupBy("ord").agg(F.sum("bit").cast("int").alias("copies"))
    return stage(keyed.join(bits, "ord").select("repo", "source", "record_id", "copies"), "funnel-copies")


def _with_copies(df: DataFrame, copies: DataFrame, key: str, source: str) -> DataFrame:
    mine = copies.filter(F.col("source") == source).select(
        "repo", F.col("record_id").cast(df.schema[key].dataType).alias(key), "copies"
    )
    return df.join(mine, ["repo", key], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def _row(name: str, task: Column, failed: Column, reason: Column) -> Column:
    kinds = dict(zip(("profile", "task", "stage_failed", "reason"), (F.lit(name), task, failed, reason)))
    return F.struct(*[c.cast("string").alias(k) for k, c in kinds.items()])


def _listed(df: DataFrame, source: str, key: str, rows: list[Column]) -> DataFrame:
    """One row per decision; ``rows`` are structs, null where a profile decides nothing."""
    held = F.filter(F.array(*rows), lambda r: r.isNotNull())
    listed = df.select("repo", F.lit(source).alias("source"), F.col(key).cast("string").alias("record_id"),
                       F.inline(held))
    return listed.select("profile", "repo", "source", "record_id", "task", "stage_failed", "reason")


def profile_decisions(exports: Exports, profiles: dict[str, RunParams], **skew) -> DataFrame:
    """Decisions of a run of all tasks under each profile, from one pass: (profile, repo, source,
    record_id, task, stage_failed, reason), as the runs themselves would list them."""
    names, filters = list(profiles), [p.filter for p in profiles.values()]
    choices = [p.collect for p in profiles.values()]
    none = F.lit(None).cast("string")

    commit_keys = stage(commit_source.newest_by_choice(exports.listing(), choices), "funnel-commit-keys")
    pull_keys = stage(pull_source.scan_by_choice(exports.closed_pulls(), choices), "funnel-pull-keys")
    screened, scored = _commits(exports, filters, commit_keys.select("repo", "sha", "arrival", "taken"))
    pulls = _pulls(exports, filters, pull_keys.select(*pull_source.KEY, "arrival", "taken"))
    copies = _duplicates(_contents(scored, pulls), filters, **skew)
    judged = _with_copies(scored, copies, "sha", "commit")
    gated = stage(_with_copies(pulls, copies, "number", "pr"), "funnel-gated")

    early, late, requests, patches = [], [], [], []
    accepted = F.col("open").bitwiseAND(F.bitwise_not("copies"))
    contextual = gated.withColumn("accepted", accepted).filter("accepted > 0")
    contextual = dataset.with_context(contextual, exports, **skew)
    for i, p in enumerate(filters):
        taken = _bit("taken", i)
        failed, reason, copy = F.col(f"failed{i}"), F.col(f"reason{i}"), _bit("copies", i)
        early.append(F.when(taken & reason.isNotNull(), _row(names[i], none, failed, reason)))
        near = F.when(copy, F.lit("dedup:near_duplicate"))
        row = _row(names[i], F.lit("commit_message"), F.coalesce(failed, F.when(copy, F.lit("stage4"))),
                   F.coalesce(reason, near))
        late.append(F.when(_bit("scored", i), row))
        near = F.when(copy, F.lit("dedup:near_duplicate_pr"))
        why = F.coalesce(reason, near)
        dropped = _row(names[i], none, F.coalesce(failed, F.when(copy, F.lit("stage4"))), why)
        review = _row(names[i], F.lit("pr_review"), none, none)
        requests.append(F.when(taken, F.when(why.isNotNull(), dropped).otherwise(review)))
        contextual = contextual.drop(f"failed{i}", f"reason{i}")
        contextual = _decided(contextual, dataset.patch_gates(p), i)
        row = _row(names[i], F.lit("issue_to_patch"), F.col(f"failed{i}"), F.col(f"reason{i}"))
        patches.append(F.when(_bit("accepted", i), row))
    return (
        _listed(screened, "commit", "sha", early)
        .unionByName(_listed(judged, "commit", "sha", late))
        .unionByName(_listed(gated, "pr", "number", requests))
        .unionByName(_listed(contextual, "pr", "number", patches))
    )


def profile_funnel(exports: Exports, profiles: dict[str, RunParams], **skew) -> DataFrame:
    """How many decisions of each kind every profile makes: (profile, source, task, stage_failed,
    reason, n). Outputs are the rows without a reason."""
    kinds = ["profile", "source", "task", "stage_failed", "reason"]
    decisions = profile_decisions(exports, profiles, **skew)
    return decisions.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
