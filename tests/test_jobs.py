import json
import os
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from histloom import params as pm
from histloom.functions import fixed_values as fv
from histloom.operators.staging import stage
from histloom.plans import dataset, jobs
from histloom.plans.dataset import plan_run
from histloom.sources.exports import SCHEMAS, Exports, read_exports

WHEN = datetime(2024, 1, 1, 12, 0, 0, 250000)
DIFF = "@@ -8,2 +8,3 @@\n-items.pop()\n+items.popleft()\n+# queue parser"


def tables():
    body = "<!-- template -->This change checks the expiry date of every token before it is decoded, " * 2
    commits = [
        ("o/r", "c1", "Fix order bug in queue parser\nbody text", "Ann", "a@x", WHEN, False, ["p"]),
        ("o/r", "c2", "Fix order bug in queue parser\nother", "Ann", "a@x", datetime(2023, 1, 1), False, ["p"]),
        ("o/r", "c3", "WIP decode", "Ann", None, WHEN, False, ["p"]),
        ("o/r", "c4", "The parser of queue order changes", "Ann", None, WHEN, False, ["p"]),
        ("o/r", "c5", "Merge x", "Ann", None, WHEN, True, ["p", "q"]),
    ]
    files = [("o/r", c, 0, None, "lib/queue.py", "MODIFY", DIFF, 2, 1) for c in ("c1", "c2", "c4")]
    files += [("o/r", "c5", i, None, f"f{i}.py", "ADD", "x", 1, 0) for i in range(25)]
    pulls = [
        ("o/r", 1, "Check expiry", body + "Fixes #5, #6 and #99999999", DIFF + "\n+more", "u", ["bug"], WHEN, WHEN),
        ("o/r", 2, "Short", "few words", DIFF, "u", [], WHEN, WHEN),
        ("o/r", 3, "Open", body, DIFF, "u", [], WHEN, None),
        ("o/r", 4, "Check expiry", body, DIFF + "\n+more", "u", [], datetime(2023, 5, 1), WHEN),
    ]
    comments = [("o/r", 1, 1, "b.py", "@@ 2", "second", None), ("o/r", 1, 0, "a.py", "@@ 1", "first", "bob")]
    issues = [("o/r", 5, "Tokens <!-- x -->never expire"), ("o/r", 6, "<!-- only -->")]
    repos = [(0, "o/r", False, None, 3, 10, WHEN)]
    return {
        "commits": commits, "file_changes": files, "pull_requests": pulls,
        "review_comments": comments, "issues": issues, "repos": repos,
    }


@pytest.fixture
def exports(spark):
    from decimal import Decimal

    data = tables()
    data["issues"] = [(r, Decimal(n), b) for r, n, b in data["issues"]]
    return Exports(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def read(path):
    rows = []
    for name in sorted(os.listdir(path)):
        if name.endswith((".json", ".txt")):
            with open(os.path.join(path, name), encoding="utf-8") as f:
                rows += [json.loads(line) for line in f]
    return rows


def test_alpaca_run(exports, tmp_path):
    out = str(tmp_path)
    jobs.run(exports, pm.profile("default"), out)
    records = {(r["_meta"]["task"], r["_meta"].get("sha") or r["_meta"]["pr_number"]): r
               for r in read(f"{out}/{jobs.DATASET_WITH_META}")}
    assert set(records) == {("commit_message", "c1"), ("pr_review", 1), ("issue_to_patch", 1)}
    commit = records["commit_message", "c1"]
    assert commit["instruction"] == fv.COMMIT_INSTRUCTION
    assert commit["input"] == f"diff --git a/lib/queue.py b/lib/queue.py\n{DIFF}"
    assert commit["output"] == "Fix order bug in queue parser"
    assert commit["_meta"] == {
        "repo": "o/r", "sha": "c1", "task": "commit_message", "score": commit["_meta"]["score"],
        "timestamp": "2024-01-01T12:00:00.250000+00:00",
    }
    assert records["pr_review", 1]["output"] == "[a.py] first\n[b.py] second"
    assert "score" not in records["pr_review", 1]["_meta"]
    patch = records["issue_to_patch", 1]
    assert patch["input"].startswith("Issue #5:\nTokens never expire\n\nIssue #6:\n\nPR Description:\nThis")
    assert patch["output"] == DIFF + "\n+more"
    clean = read(f"{out}/{jobs.DATASET}")
    assert sorted(map(str, clean)) == sorted(
        str({k: v for k, v in r.items() if k != "_meta"}) for r in records.values()
    )
    log = {(r["reason"], r["record"].get("sha") or r["record"]["number"]): r
           for r in read(f"{out}/{jobs.EXCLUDED_LOG}")}
    assert {(k, v["stage_failed"]) for k, v in log.items()} == {
        (("dedup:near_duplicate", "c2"), "stage4"),
        (("hard_exclusion:no_files", "c3"), "stage1"),
        (("content_quality:no_verb_start", "c4"), "stage3"),
        (("hard_exclusion:is_merge", "c5"), "stage1"),
        (("structural:pr_body_too_short", 2), "stage2"),
        (("dedup:near_duplicate_pr", 4), "stage4"),
    }
    assert log["dedup:near_duplicate", "c2"]["record"]["files_changed"][0]["filename"] == "lib/queue.py"
    # Records are whole, whatever their size.
    whole = log["hard_exclusion:is_merge", "c5"]["record"]["files_changed"]
    assert len(whole) == 25 and set(whole[0]) >= {"filename", "change_type", "additions"}
    assert "pos" not in whole[0]
    assert log["dedup:near_duplicate_pr", 4]["record"]["linked_issue_bodies"] == []
    (report,) = read(f"{out}/{jobs.REPORT}")
    assert report["stats"] == {
        "raw_commits_collected": 5, "raw_prs_collected": 3, "stage1_hard_exclusion_dropped": 2,
        "stage2_structural_dropped": 1, "stage3_content_score_dropped": 1, "stage4_dedup_dropped": 2,
        "final_records": 3, "filter_rate_pct": 62.5,
    }
    assert report["task_distribution"] == {"commit_message": 1, "pr_review": 1, "issue_to_patch": 1}
    assert report["top_exclusion_reasons"]["dedup:near_duplicate"] == 1
    assert report["format"] == "alpaca" and report["task"] == "all" and report["n_repos"] == 1


def test_sharegpt_review(exports, tmp_path):
    p = pm.RunParams(pm.FilterParams(), pm.CollectParams(), "sharegpt", "pr_review")
    jobs.run(exports, p, str(tmp_path))
    (record,) = read(f"{tmp_path}/{jobs.DATASET}")
    turns = record["conversations"]
    assert [t["from"] for t in turns] == ["system", "human", "gpt"]
    assert turns[0]["value"] == fv.REVIEW_CHAT_SYSTEM
    assert turns[1]["value"].startswith("PR #1: Check expiry\n\n**Description:** <!-- template -->This")
    assert turns[2]["value"] == (
        "### Review Comment on `a.py`:\n**Context:**\n```diff\n@@ 1\n```\n**Feedback:** first\n\n"
        "### Review Comment on `b.py`:\n**Context:**\n```diff\n@@ 2\n```\n**Feedback:** second"
    )


def test_strict_needs_linked_issue(exports, spark):
    p = pm.RunParams(pm.FilterParams(require_linked_issue=True), task="issue_to_patch")
    others = exports.pull_requests.filter("number = 4")
    only = Exports(pull_requests=others, issues=exports.issues, repos=exports.repos)
    (row,) = plan_run(only, p).all_decisions().collect()
    assert (row["stage_failed"], row["reason"]) == ("stage1", "pr_exclusion:no_linked_issue")


def test_dry_run_writes_nothing(exports, tmp_path):
    row = jobs.run(exports, pm.profile("default"), str(tmp_path), dry_run=True).first()
    assert row["stats"]["final_records"] == 3 and os.listdir(tmp_path) == []


def test_selected_repos_count_without_records(exports, spark, tmp_path):
    selected = spark.createDataFrame([("o/r",), ("o/empty",)], "full_name string")
    row = jobs.run(exports, pm.profile("default"), str(tmp_path), selected=selected).first()
    assert row["n_repos"] == 2
    assert {r["repo"] for r in read(f"{tmp_path}/{jobs.REPOS}")} == {"o/r", "o/empty"}
    folder = spark.conf.get("spark.checkpoint.dir")
    assert not [f for f in os.listdir(folder) if f.startswith("run-")]


def test_repeated_source_rows_and_no_limits(exports, spark):
    twice = Exports(commits=exports.commits.union(exports.commits), file_changes=exports.file_changes)
    p = pm.RunParams(collect=pm.CollectParams(None, None), task="commit_message")
    once = plan_run(Exports(commits=exports.commits, file_changes=exports.file_changes), p)
    assert sorted(map(str, plan_run(twice, p).all_decisions().collect())) == sorted(
        map(str, once.all_decisions().collect())
    )
    limited = pm.RunParams(task="commit_message")
    assert plan_run(twice, limited).all_decisions().count() == 5
    free = pm.RunParams(collect=pm.CollectParams(None, None), task="pr_review")
    pulls = plan_run(exports, free).all_decisions()
    bounded = plan_run(exports, pm.RunParams(task="pr_review")).all_decisions()
    assert sorted(map(str, pulls.collect())) == sorted(map(str, bounded.collect()))


def test_healthy_repos_only(exports, spark):
    kept = jobs.only_healthy(exports, exports.repos.select("full_name"))
    assert kept.selected.count() == 1
    other = spark.createDataFrame([("o/other",)], "full_name string")
    for repos, n in ((kept.selected, 8), (other, 0)):
        plan = plan_run(jobs.only_repos(exports, repos), pm.profile("default"))
        assert plan.all_collected().count() == n


def test_read_exports(exports, spark, tmp_path):
    for name in ("commits", "issues"):
        getattr(exports, name).write.json(str(tmp_path / name))
    back = read_exports(spark, str(tmp_path), "json", ("commits", "issues"))
    assert back.commits.exceptAll(exports.commits).isEmpty() and back.issues.count() == 2


def test_profiles():
    got = {n: pm.profile(n).filter.min_alignment_score for n in pm.profile_names()}
    assert got == {"default": 0.15, "strict": 0.25, "permissive": 0.0}
    assert pm.profile("strict").collect.since == date(2022, 1, 1)
    limited = pm.profile("default").limited_to(42).collect
    assert (limited.max_commits_per_repo, limited.max_prs_per_repo) == (42, 42)
    with pytest.raises(ValueError):
        pm.profile("none")
    with pytest.raises(ValueError):
        pm.RunParams(task="x")


def test_parameter_files(tmp_path):
    pytest.importorskip("yaml")
    path = str(tmp_path / "p.yaml")
    for name in pm.profile_names():
        pm.dump_yaml(pm.profile(name), path)
        assert pm.load_yaml(path) == pm.profile(name)
    part = pm.from_mapping({"task": "pr_review", "filter": {"max_commit_message_chars": 500}})
    assert part.filter.max_commit_message_chars == 500 and part.filter.min_diff_lines == 3
    with pytest.raises(FileNotFoundError):
        pm.load_yaml(str(tmp_path / "missing.yaml"))


def test_rows_of_their_own_key_are_not_exchanged_and_others_as_before(exports, spark):
    collect = pm.CollectParams(None, None)
    p = pm.RunParams(collect=collect)
    pulls, left = dataset.limited_pulls(exports, p)
    assert left == [] and "Exchange" not in pulls._jdf.queryExecution().executedPlan().toString()
    commits, left = dataset.limited_commits(exports, p)
    assert left == [] and "Exchange" not in commits._jdf.queryExecution().executedPlan().toString()
    unnamed = spark.createDataFrame([(None, 7, "t", "b", DIFF, "u", [], WHEN, WHEN)], SCHEMAS["pull_requests"])
    lost = spark.createDataFrame([("o/r", None, "x", "a", None, WHEN, False, ["p"])], SCHEMAS["commits"])
    some = replace(
        exports,
        pull_requests=exports.pull_requests.union(exports.pull_requests.filter("number < 3")).union(unnamed),
        commits=exports.commits.union(exports.commits.filter("sha > 'c3'")).union(lost),
    )
    for got, old in (
        (dataset.limited_pulls(some, p)[0], dataset.pulls_of(some, dataset.pull_keys(some, p)[0])),
        (dataset.limited_commits(some, p)[0], dataset.commits_of(some, dataset.commit_keys(some, p)[0])),
    ):
        columns = sorted(old.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, old.select(columns).collect()))


def test_texts_of_pull_requests_are_staged_once(exports, monkeypatch):
    staged = []
    monkeypatch.setattr(dataset, "stage", lambda df, name: staged.append((name, df.columns)) or stage(df, name))
    outcome = plan_run(exports, pm.profile("default"))
    assert [name for name, columns in staged if "diff" in columns] == ["pulls"]
    assert {r["task"] for r in outcome.all_decisions().collect()} >= {"pr_review", "issue_to_patch"}


def test_staged_texts_are_packed_small(spark):
    rows = spark.range(2000).select(F.repeat(F.md5(F.col("id").cast("string")), 40).alias("diff")).coalesce(1)
    files = stage(rows, "packed").inputFiles()
    assert all(".zstd." in f for f in files)


def unlimited(p):
    return replace(p, collect=replace(p.collect, max_commits_per_repo=None, max_prs_per_repo=None))


def test_messages_are_neither_staged_nor_exchanged_for_the_screen(exports, monkeypatch):
    staged = {}
    monkeypatch.setattr(dataset, "stage", lambda df, name: staged.setdefault(name, df) and stage(df, name))
    plan_run(exports, unlimited(pm.profile("default")))
    assert not {"message_body", "author", "full_message"} & set(staged["screened"].columns)
    plan = staged["screened"]._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "message_body" not in plan[plan.index(join) :].split("Project")[1]


def test_counted_gates_equal_those_of_whole_contexts(exports, spark):
    accepted = exports.pull_requests.transform(dataset.pull_source.normalise_pulls)
    titles = spark.createDataFrame([("o/r", 7, "one two three", "<!-- x -->", DIFF, "u", [], WHEN, WHEN),
                                    ("o/r", 8, None, None, DIFF, "u", [], WHEN, WHEN)], SCHEMAS["pull_requests"])
    accepted = accepted.unionByName(titles.transform(dataset.pull_source.normalise_pulls))
    resolved = dataset.resolved_issues(accepted, exports)
    seen = set()
    for least in (0, 1, 3, 4, 5, 10, 33, 34, 35, 36, 37, 38, 39, 40, 1000):
        p = replace(pm.FilterParams(), min_issue_to_patch_words=least)
        columns = ["repo", "number", "stage_failed", "reason"]
        whole = dataset.patch_candidates(accepted, exports, p).select(columns)
        got = dataset.patch_verdicts(accepted, resolved, p).select(columns)
        rows = sorted(map(str, whole.collect()))
        assert sorted(map(str, got.collect())) == rows
        seen.add(tuple(rows))
    assert len(seen) >= 4


def test_texts_of_pull_requests_move_once_for_both_tasks(exports):
    for output_format, text in (("alpaca", "input"), ("sharegpt", "conversations")):
        p = unlimited(replace(pm.profile("default"), output_format=output_format))
        both = plan_run(exports, p)
        plan = both.all_records()._jdf.queryExecution().executedPlan().toString()
        assert len([x for x in plan.splitlines() if "FileScan" in x and "diff#" in x]) == 1
        single = [plan_run(exports, replace(p, task=t)).all_records() for t in ("pr_review", "issue_to_patch")]
        wanted = sorted(map(str, single[0].union(single[1]).select("task", text, "_meta").collect()))
        got = both.all_records().filter("task != 'commit_message'").select("task", text, "_meta")
        assert wanted and sorted(map(str, got.collect())) == wanted


def test_log_is_gathered_only_for_a_log(exports, monkeypatch):
    staged = []
    monkeypatch.setattr(dataset, "stage", lambda df, name: staged.append(name) or stage(df, name))
    outcome = plan_run(exports, unlimited(pm.profile("default")))
    outcome.all_decisions().count()
    assert not [name for name in staged if name.startswith("excluded")]
    records = [json.loads(r.record) for r in outcome.excluded_log().collect()]
    merge = next(r for r in records if r.get("sha") == "c5")
    assert len(merge["files_changed"]) == 25 and merge["author"] == "Ann" and merge["parent_shas"] == ["p", "q"]
    assert [name for name in staged if name.startswith("excluded")] == [
        "excluded-commits", "excluded-patches", "excluded-pulls",
    ]


def test_log_of_repeated_keys_has_each_comment_once(exports):
    p = unlimited(pm.profile("default"))
    p = replace(p, filter=replace(p.filter, min_pr_body_words=1000))
    twice = replace(exports, pull_requests=exports.pull_requests.union(exports.pull_requests))
    logged = [r for r in plan_run(twice, p).excluded_log().collect() if r.source == "pr"]
    assert len(logged) == plan_run(twice, p).all_decisions().filter("source = 'pr'").count() == 6
    texts = [[c["body"] for c in json.loads(r.record)["review_comments"]] for r in logged]
    assert sorted(texts) == [[]] * 4 + [["first", "second"]] * 2
