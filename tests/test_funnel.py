import random
from collections import Counter
from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from histloom import params as pm
from histloom.operators.skew import first_n_by_choice
from histloom.plans import dataset, funnel, jobs
from histloom.sources.exports import SCHEMAS, Exports

START = datetime(2024, 1, 1)


def history(seed, n=60):
    rng = random.Random(seed)
    words = "parser queue order tokens expiry cache retry index worker lock stream batch".split()
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    families = [say(40) for _ in range(6)]
    starts = ["Fix", "Add", "Add", "WIP", "Merge", "The", "Update", "fix(core): add"]
    commits, files, pulls, issues = [], [], [], []
    for i in range(n):
        repo, when = f"o/{rng.choice('aaab')}", START + timedelta(days=i % 23, minutes=i)
        text = rng.choice(families)
        subject = " ".join(text.split()[: rng.choice((1, 6, 9))])
        commits.append((repo, f"c{i:03}", f"{rng.choice(starts)} {subject}\nbody", "Ann",
                        None, when, i % 13 == 0, ["p"]))
        for pos in range(rng.choice((0, 1, 1, 1, 2, 14))):
            diff = f"@@ -1 +1 @@\n-{text}\n+{text}\n+a\n+b\n+c"
            files.append((repo, f"c{i:03}", pos, None, f"lib/{rng.choice(words)}.py", "MODIFY", diff, 1, 1))
        body = say(rng.choice((2, 60, 60, 60))) + rng.choice(["", f" Fixes #{i % 4}"])
        merged = None if i % 5 == 4 else when
        pulls.append((repo, i, rng.choice(families[:3]), body, f"+{text}\n+{rng.choice(words)}\n-x\n-y\n-z\n z", "u", [], when, merged))
    issues = [(f"o/{r}", Decimal(i), say(30)) for r in "ab" for i in range(4)]
    repos = [(i, f"o/{r}", False, None, 3, 10, START) for i, r in enumerate("ab")]
    return {"commits": commits, "file_changes": files, "pull_requests": pulls, "review_comments": [],
            "issues": issues, "repos": repos}


def exports_of(spark, seed):
    return Exports(**{k: spark.createDataFrame(rows, SCHEMAS[k]) for k, rows in history(seed).items()})


def own_profiles():
    """The presets with small limits, first days of their own and one of them unlimited."""
    limits = {"default": (16, 9, None), "strict": (19, 8, date(2024, 1, 9)), "permissive": (None, None, date(2024, 1, 4))}
    out = {}
    for name, (commits, prs, day) in limits.items():
        p = pm.profile(name)
        chosen = pm.CollectParams(max_commits_per_repo=commits, max_prs_per_repo=prs, since=day)
        out[name] = replace(p, collect=chosen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_equals_runs_one_by_one(spark, seed):
    exports, profiles = exports_of(spark, seed), own_profiles()
    got = Counter(tuple(r) for r in funnel.profile_decisions(exports, profiles).collect())
    want = Counter()
    for name, p in profiles.items():
        for r in dataset.plan_run(exports, p).all_decisions().collect():
            want[(name, r.repo, r.source, r.record_id, r.task, r.stage_failed, r.reason)] += 1
    assert got == want
    stages = {(k[0], k[5]) for k in want}
    assert stages >= {("default", "stage4"), ("permissive", "stage4"), ("strict", None), ("permissive", None)}
    counts = {tuple(r) for r in funnel.profile_funnel(exports, profiles).collect()}
    grouped = Counter()
    for k, n in want.items():
        grouped[(k[0], k[2], *k[4:])] += n
    assert counts == {(*k, n) for k, n in grouped.items()}


def test_profiles_of_different_branches(spark):
    profiles = own_profiles()
    other = replace(profiles["strict"], collect=pm.CollectParams(branches=("main",)))
    with pytest.raises(ValueError):
        funnel.profile_funnel(exports_of(spark, 1), profiles | {"strict": other})


def test_first_n_by_choice(spark):
    rows = spark.range(300).select((F.col("id") % 2).alias("g"), "id")
    choices = [(F.lit(True), 7), (F.col("id") % 3 == 0, 5), (F.col("id") > 280, None)]
    chosen = first_n_by_choice(rows, ["g"], [F.asc("id")], choices, ["id"], "bits", salts=4)
    got = {r["id"]: r["bits"] for r in chosen.collect()}
    want = Counter()
    for g in range(2):
        mine = [i for i in range(300) if i % 2 == g]
        for bit, some in enumerate((mine[:7], [i for i in mine if i % 3 == 0][:5], [i for i in mine if i > 280])):
            want.update({i: 1 << bit for i in some})
    assert got == dict(want)


def test_limits_are_accounted_for(spark, tmp_path):
    exports, out = exports_of(spark, 3), str(tmp_path)
    p = replace(pm.profile("default"), collect=pm.CollectParams(max_commits_per_repo=9, max_prs_per_repo=4))
    row = jobs.run(exports, p, out).first()
    data = history(3)
    commits = Counter(r[0] for r in data["commits"])
    closed = {repo: sorted((r for r in data["pull_requests"] if r[0] == repo), key=lambda r: (r[7], r[1]))[::-1]
              for repo in commits}
    merged = {repo: sum(r[8] is not None for r in rows[:20]) for repo, rows in closed.items()}
    assert row["left_out"].asDict() == {
        "commits_beyond_limit": sum(max(n - 9, 0) for n in commits.values()),
        "closed_prs_not_scanned": sum(max(len(rows) - 20, 0) for rows in closed.values()),
        "prs_beyond_limit": sum(max(n - 4, 0) for n in merged.values()),
    }
    listed = spark.read.json(f"{out}/{jobs.LEFT_OUT}").filter("limit = 'max_commits_per_repo'")
    assert {(r["repo"], r["n_seen"], r["n_taken"]) for r in listed.collect()} == {
        (repo, n, 9) for repo, n in commits.items() if n > 9
    }
    whole = replace(p, collect=pm.CollectParams(max_commits_per_repo=None, max_prs_per_repo=None))
    assert set(jobs.run(exports, whole, "", dry_run=True).first()["left_out"]) == {0}


def test_limits_of_a_repo_without_any_merged_one(spark):
    rows = [("o/x", i, "t", "b", "d", "u", [], START + timedelta(hours=i), None) for i in range(30)]
    exports = Exports(pull_requests=spark.createDataFrame(rows, SCHEMAS["pull_requests"]))
    p = replace(pm.profile("default"), collect=pm.CollectParams(max_prs_per_repo=2))
    keys, left = dataset.pull_keys(exports, p)
    assert keys.isEmpty()
    assert [tuple(r) for df in left for r in df.collect()] == [("scanned_prs_per_repo", "o/x", 30, 10)]
