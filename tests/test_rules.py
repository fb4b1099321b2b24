import dataclasses

import pytest
from pyspark.sql import functions as F

from histloom.operators import quality
from histloom.operators.exclusions import exclusion_rules
from histloom.operators.rules import first_failing
from histloom.operators.structure import (
    commit_structure_rules,
    pull_structure_rules,
    with_full_message,
)
from histloom.params import FilterParams
from histloom.sources.files import assemble_files

P = FilterParams()


def excluded(frame, p=P):
    return frame.select(first_failing(exclusion_rules(p))).first()[0]


@pytest.mark.parametrize(
    "fields, reason",
    [
        ({}, None),
        ({"is_merge": True}, "is_merge"),
        ({"parent_shas": ["a", "b"]}, "is_merge"),
        ({"message_subject": "Merge pull request #1"}, "is_merge"),
        ({"message_subject": ' Revert "x"'}, "is_revert"),
        ({"message_subject": "Revert"}, None),
        ({"author": "dependabot[bot]"}, "is_bot"),
        ({"author": "x", "author_email": "build-bot"}, "is_bot"),
        # Without an e-mail the text ends in a blank, so an author ending in "bot" is not seen.
        ({"author": "mybot", "author_email": None}, None),
        ({"files": ()}, "no_files"),
        ({"files": (("assets/logo.png", ""),)}, "binary_only"),
        ({"files": (("Makefile", "x"), ("a.tsx", "y"))}, "binary_only"),
        ({"files": (("poetry.lock", "x"),)}, "lockfile_only"),
        ({"files": (("mydist/x.js", "x"),)}, "lockfile_only"),
        ({"message_subject": " Fix "}, "empty_or_trivial_message"),
        ({"message_subject": "　"}, "empty_or_trivial_message"),
        ({"message_subject": "WIP: fix auth bug"}, "wip_message"),
        ({"message_subject": "Template engine added"}, "wip_message"),
        ({"message_subject": "Bump to v1.2", "files": (("a/package.json", "x"),)}, "version_bump_only"),
        ({"message_subject": "Bump to v1.2"}, None),
        ({"message_subject": "https://x.org/a"}, "url_only_message"),
        ({"message_subject": "abc-12"}, "ticket_only_message"),
    ],
)
def test_hard_exclusions(make_commit, fields, reason):
    frame, _ = make_commit(**fields)
    assert excluded(frame) == (reason and f"hard_exclusion:{reason}")


def test_exclusion_toggles(make_commit):
    off = dataclasses.replace(P, exclude_merge_commits=False, exclude_binary_only=False)
    assert excluded(make_commit(is_merge=True)[0], off) is None
    assert excluded(make_commit(files=())[0], off) is None


@pytest.mark.parametrize(
    "fields, reason",
    [
        ({}, None),
        ({"message_subject": "fix auth bug", "message_body": "Signed-off-by: a b c d e"}, "message_too_short"),
        ({"message_body": "x" * 2001}, "message_too_long"),
        ({"files": ()}, "too_few_files"),
        ({"files": tuple((f"f{i}.py", "a\nb") for i in range(21))}, "too_many_files"),
        ({"files": (("a.py", "x\r\ny"),)}, "diff_too_small"),
        ({"files": (("a.py", "x\n" * 300), ("b.py", "x\n" * 201))}, "diff_too_large"),
    ],
)
def test_commit_structure(make_commit, fields, reason):
    frame, _ = make_commit(**fields)
    frame = with_full_message(frame)
    got = frame.select(first_failing(commit_structure_rules(P))).first()[0]
    assert got == (reason and f"structural:{reason}")


def test_pull_structure(spark):
    body = "w " * 20
    rows = [("w " * 19, "a\nb\nc"), (body, "a"), (body, "a\n" * 501), (body, ""), (body, "a\nb\nc")]
    df = spark.createDataFrame(rows, "body string, diff string")
    got = [r[0] for r in df.select(first_failing(pull_structure_rules(P))).collect()]
    assert got == [
        "structural:pr_body_too_short", "structural:pr_diff_too_small", "structural:pr_diff_too_large",
        "structural:pr_diff_missing", None,
    ]


@pytest.mark.parametrize(
    "subject, score",
    [
        ("Fix crash", 1.0), ("fix(core): add x", 1.0), ("net/http: update y", 1.0), ("Fixes it", 1.0),
        ("[fix] it", 1.0), ("The fix", 0.0), ("", 0.0), ("pass: miss", 0.0), ("uses x", 1.0),
        ("Ändert x", 0.0), ("fix: ", 1.0),
    ],
)
def test_verb_start(spark, subject, score):
    df = spark.createDataFrame([(subject,)], "s string")
    assert df.select(quality.verb_start_score(F.col("s"))).first()[0] == score


def scores(frame, changes):
    return quality.with_scores(assemble_files(changes, frame)).first()


def test_scores(make_commit):
    row = scores(*make_commit(message_subject="Fix the popleft bug; handle --- zzzzz"))
    # popleft, bug;(4 long), handle, zzzzz are searched; "popleft" is in the diff.
    assert row["align_score"] == 1 / 4
    assert (row["verb_score"], row["info_score"], row["lang_score"]) == (1.0, 1.0, 1.0)
    assert row["score"] == 0.3 * 1.0 + 0.3 * 1.0 + 0.2 * 0.25 + 0.2 * 1.0


@pytest.mark.parametrize(
    "subject, info",
    [("one two", 0.2), ("Please fix bug now", 0.3), ("a b c", 0.1), ("A fine day", 1.0)],
)
def test_informativeness(make_commit, subject, info):
    frame, changes = make_commit(message_subject=subject, files=(("x/a b c", "d"),))
    assert scores(frame, changes)["info_score"] == info


def test_quality_gates(make_commit):
    p = dataclasses.replace(P, min_alignment_score=0.15)
    subject = "refactor: optimize database connection pooling logic"
    frame, changes = make_commit(message_subject=subject)
    scored = quality.with_scores(assemble_files(changes, frame))
    got = scored.select(first_failing(quality.quality_rules(p))).first()[0]
    assert got == "content_quality:alignment_below_threshold"


def test_any_number_of_files_is_assembled(make_commit):
    frame, changes = make_commit(files=tuple((f"src/f{i}.py", f"+{i}") for i in range(5000)))
    (row,) = assemble_files(changes, frame).collect()
    assert [f["filename"] for f in row["files"]] == [f"src/f{i}.py" for i in range(5000)]
