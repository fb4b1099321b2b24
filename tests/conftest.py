import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staged")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_commit(spark):
    """Screened-commit frame of one commit with overridable fields."""

    def build(files=(("lib/queue.py", "@@ -7,2 +7,3 @@\n-    items.pop()\n+    items.popleft()\n+    # oldest"),),
              **fields):
        from histloom.sources import files as fs

        row = {
            "repo": "o/r", "sha": "a1", "message_subject": "Fix order of jobs in the queue parser",
            "message_body": "Jobs left the queue newest first; now the oldest goes first.",
            "author": "Mira Osei", "author_email": "mira@osei.example", "is_merge": False,
            "parent_shas": ["p"],
        }
        row.update(fields)
        commits = spark.createDataFrame(
            [tuple(row.values())],
            "repo string, sha string, message_subject string, message_body string, author string, "
            "author_email string, is_merge boolean, parent_shas array<string>",
        )
        changes = spark.createDataFrame(
            [("o/r", "a1", i, None, p, "MODIFY", d, 1, 1) for i, (p, d) in enumerate(files)],
            "repo string, sha string, pos int, old_path string, new_path string, "
            "change_type string, diff string, additions bigint, deletions bigint",
        )
        changes = fs.normalise_files(changes)
        return fs.with_file_facts(commits, changes), changes

    return build
