from datetime import date, datetime

from pyspark.sql import functions as F

from histloom.operators import health
from histloom.sources import catalog, commits, pulls
from histloom.params import CollectParams


def test_linked_numbers(spark):
    rows = [
        (7, "Fixes #12, see #7 and issues/3, pulls/12, pull/99, #0012 #0"),
        (8, None),
        (9, f"#{10**45} and #5"),
    ]
    df = spark.createDataFrame(rows, "n bigint, b string")
    got = df.select(pulls.linked_issue_numbers(F.col("b"), F.col("n"))).collect()
    assert [r[0] for r in got] == [["0", "3", "12"], [], ["5", str(10**45)]]


def test_ceiling(spark):
    df = spark.createDataFrame([(0,), (2000,), (None,)], "n bigint")
    assert [r[0] for r in df.select(pulls.issue_ceiling(F.col("n"))).collect()] == [5000, 6000, 100000]
    pairs = spark.createDataFrame([("999", 5000), ("5000", 5000), ("5001", 5000), ("1" * 40, 5000)], "d string, c bigint")
    assert [r[0] for r in pairs.select(pulls.within_ceiling(F.col("d"), F.col("c"))).collect()] == [
        True, True, False, False,
    ]


def test_scan_looks_at_five_times_the_limit(spark):
    day = datetime(2024, 1, 1)
    # Only every sixth pull request is merged: one of the first five, so one is found for limit 1.
    rows = [("r", i, datetime(2024, 3, 30 - i), day if i % 6 == 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "repo string, number bigint, updated_at timestamp, merged_at timestamp")
    assert [r["number"] for r in pulls.scan_pulls(df, 1).collect()] == [4]
    assert pulls.scan_pulls(df, 1, date(2024, 1, 2)).count() == 0
    assert sorted(r["number"] for r in pulls.scan_pulls(df, 2).collect()) == [4]
    assert sorted(r["number"] for r in pulls.scan_pulls(df, 3).collect()) == [4, 10]


def test_commit_selection(spark):
    rows = [
        ("r", "main", True, "a", datetime(2024, 1, 1)),
        ("r", "main", True, "b", datetime(2024, 1, 2)),
        ("r", "dev", False, "b", datetime(2024, 1, 2)),
        ("r", "dev", False, "c", datetime(2024, 1, 3)),
    ]
    df = spark.createDataFrame(
        rows, "repo string, branch string, is_default boolean, sha string, author_ts timestamp"
    )

    def taken(**k):
        got = commits.select_commits(df, CollectParams(**k)).orderBy("arrival").collect()
        return [r["sha"] for r in got]

    assert taken() == ["b", "a"]
    assert taken(branches=("dev", "main")) == ["c", "b", "a"]
    assert taken(branches=("main", "dev")) == ["b", "a", "c"]
    assert taken(branches=("main", "dev"), max_commits_per_repo=2) == ["b", "a"]
    assert taken(since=date(2024, 1, 2)) == ["b"]
    one = commits.branch_commit_counts(df, CollectParams()).collect()
    assert [(r["branch"], r["n_commits"]) for r in one] == [("main", 2)]
    both = commits.branch_commit_counts(df, CollectParams(branches=("main", "dev"))).collect()
    assert {(r["branch"], r["n_commits"]) for r in both} == {("main", 2), ("dev", 2), (None, 4)}


def test_since_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(datetime(2024, 1, 1),)], "author_ts timestamp").write.parquet(path)
    kept = commits.since(spark.read.parquet(path), "author_ts", date(2023, 1, 1))
    plan = kept._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(author_ts" in plan


def test_semver(spark):
    tags = ["v1.2.3", "1.2.3-rc.1+b.2", "01.2.3", "1.2", "v1.2.3-01", "1.0.0-alpha", None]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    got = [r[0] for r in df.select(catalog.is_semver(F.col("t"))).collect()]
    assert got == [True, True, False, False, False, True, False]


def test_health(spark):
    merged = datetime(2024, 1, 1)
    rows = []
    for repo, kind in (("native", "merged"), ("gerrit", "text"), ("bots", "bot"), ("idle", "none")):
        for i in range(40):
            body = "Change-Id: Iabc" if kind == "text" else None
            login = "Phab-Bot" if kind == "bot" else "u"
            when = merged if kind == "merged" and i % 2 else None
            rows.append((repo, i, "t", body, login, datetime(2024, 2, 1, 0, i), when))
    df = spark.createDataFrame(
        rows,
        "repo string, number bigint, title string, body string, author_login string, "
        "updated_at timestamp, merged_at timestamp",
    )
    names = spark.createDataFrame([(r,) for r in ("native", "gerrit", "bots", "idle", "empty")], "full_name string")
    result = health.repo_health(df, names)
    got = {r["repo"]: r for r in result.collect()}
    assert (got["native"]["merge_rate"], got["native"]["total_sampled"]) == (0.5, 30)
    assert got["native"]["is_native"] and got["native"]["confidence"] == "low"
    assert got["gerrit"]["external_system"] == "Gerrit" and got["gerrit"]["confidence"] == "high"
    assert got["gerrit"]["example_signals"] == [f'"Change-Id: I" in PR #{n}' for n in (39, 38, 37)]
    assert got["bots"]["external_system"] == "Phabricator"
    assert got["bots"]["bot_usernames"] == ["Phab-Bot"] and got["bots"]["example_signals"] == []
    assert (got["idle"]["external_system"], got["idle"]["confidence"]) == (None, "medium")
    assert (got["empty"]["total_sampled"], got["empty"]["merge_rate"]) == (0, 0.0)
    left = [r[0] for r in health.drop_flagged(names, result).collect()]
    assert left == ["native"]


def test_issue_joins_do_not_depend_on_salting(spark):
    pulls_df = spark.createDataFrame(
        [("r", n, ["1", "2", str(n)]) for n in range(3, 60)] + [("q", 1, ["1", "6000"])],
        "repo string, number bigint, linked_issue_numbers array<string>",
    )
    repos = spark.createDataFrame([("r", 10)], "full_name string, open_issues bigint")
    issues = spark.createDataFrame(
        [("r", 1, "one"), ("r", 2, ""), ("r", 7, "seven"), ("q", 1, "q one"), ("q", 6000, "far")],
        "repo string, number bigint, body string",
    )

    def blocks(**skew):
        links = pulls.links_with_ceiling(pulls.issue_links(pulls_df), repos, **skew)
        resolved = pulls.resolve_issues(links, issues, **skew)
        rows = pulls.attach_issue_blocks(pulls_df, resolved).collect()
        return {(r["repo"], r["number"]): r["linked_issue_bodies"] for r in rows}

    plain, salted = blocks(), blocks(min_rows=2)
    assert plain == salted and len(plain) == 58
    assert plain["r", 7] == ["Issue #1:\none", "Issue #7:\nseven"]
    assert plain["r", 8] == ["Issue #1:\none"]
    assert plain["q", 1] == ["Issue #1:\nq one", "Issue #6000:\nfar"]


def test_resolving_reads_the_pull_requests_once_for_the_rows(spark, tmp_path):
    """Links are staged: the plan of the result scans their source once more, for the rows themselves."""
    rows = [("o/r", i, "t", "Fixes #1", "d", "u", [], None, None) for i in range(20)]
    schema = ("repo string, number bigint, title string, body string, diff string, author string, "
              "labels array<string>, updated_at timestamp, merged_at timestamp")  # fmt: skip
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pulls"))
    requests = pulls.normalise_pulls(spark.read.parquet(str(tmp_path / "pulls")))
    repos = spark.createDataFrame([("o/r", 10)], "full_name string, open_issues bigint")
    issues = spark.createDataFrame([("o/r", 1, "why")], "repo string, number bigint, body string")
    links = pulls.links_with_ceiling(pulls.issue_links(requests), repos)
    found = pulls.attach_issue_blocks(requests, pulls.resolve_issues(links, issues))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/pulls") == 1
    assert {len(r["linked_issue_bodies"]) for r in found.collect()} == {0, 1}  # number 1 names itself
