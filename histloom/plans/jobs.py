"""Jobs: plan a run, write its outputs; split a data set."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from histloom.operators import health as health_ops
from histloom.operators import report, split
from histloom.operators.outputs import Outputs, recover
from histloom.operators.staging import run_identity, stage, staged_run
from histloom.params import RunParams
from histloom.plans.dataset import plan_run
from histloom.sources.exports import Exports

DATASET = "dataset.jsonl"
DATASET_WITH_META = "dataset_with_meta.jsonl"
EXCLUDED_LOG = "excluded_log.jsonl"
REPORT = "run_report.json"
REPOS = "repos_processed.jsonl"
LEFT_OUT = "left_out.jsonl"
OUTPUTS = (DATASET, DATASET_WITH_META, EXCLUDED_LOG, REPORT, REPOS, LEFT_OUT)


def only_repos(exports: Exports, repos: DataFrame) -> Exports:
    """Exports whose runs take the given repos (full_name) only."""
    return replace(exports, selected=repos.select("full_name"))


def only_healthy(exports: Exports, selected: DataFrame) -> Exports:
    """Continue with the selected repos whose pull requests are reviewed where they live."""
    health = health_ops.repo_health(exports.pull_requests, selected)
    return only_repos(exports, stage(health_ops.drop_flagged(selected, health), "healthy"))


def clean(records: DataFrame) -> DataFrame:
    """Output records as trained on: no bookkeeping columns."""
    return records.drop("_meta", "task")


def run(
    exports: Exports, params: RunParams, output: str, dry_run: bool = False,
    selected: DataFrame | None = None, name: str | None = None,
) -> DataFrame:
    """Build the data set below ``output``; returns the report row.

    Previous outputs are replaced by all new ones at once, or not at all. ``selected`` (full_name)
    are the repos of the run: processed even if nothing came of them. A dry run writes nothing but
    counts everything. A run with a ``name`` that failed or lost its driver goes on after its last
    finished step when run again by that name, with the same inputs and parameters.
    """
    spark = next(t for t in (exports.commits, exports.pull_requests) if t is not None).sparkSession
    selected = exports.selected if selected is None else selected
    if not dry_run:
        recover(spark, output)
    with staged_run(spark, name):
        inputs = hashlib.sha256(f"{params!r} {output}".encode()).hexdigest()
        fresh = {"run_id": str(uuid.uuid4()), "began": time.time(), "inputs": inputs}
        identity = run_identity(spark, fresh)
        outputs = None if dry_run else Outputs(spark, output, identity["run_id"])
        try:
            row, schema = _run(exports, params, outputs, identity, selected)
            if outputs:
                outputs.publish(OUTPUTS)
        except BaseException:
            if outputs and name is None:
                outputs.discard()
            raise
    return spark.createDataFrame([row], schema)


def _run(
    exports: Exports, params: RunParams, outputs: Outputs | None, identity: dict,
    selected: DataFrame | None,
) -> tuple[Row, StructType]:
    began = identity["began"]
    outcome = plan_run(exports, params)
    decisions = stage(outcome.all_decisions(), "decisions")
    logged_at = F.lit(time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime(began)))
    if outputs:
        records = stage(outcome.all_records(), "records")
        outputs.write(DATASET_WITH_META, lambda: records.drop("task"))
        outputs.write(DATASET, lambda: clean(records))
        # Made in any case: a run that goes on must count the steps that this stages.
        log = outcome.excluded_lines(logged_at)
        outputs.write(EXCLUDED_LOG, lambda: log, text=True)
    repos = report.repos_processed(outcome.all_collected(), selected)
    ended = time.time()
    finished_at = F.lit(time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime(ended)))
    row = stage(
        report.run_report(
            decisions,
            outcome.all_collected(),
            repos,
            identity["run_id"],
            params.output_format,
            params.task,
            logged_at,
            finished_at,
            round(ended - began, 2),
            limits=outcome.left_out(),
        ),
        "report",
    )
    if outputs:
        outputs.write(REPORT, lambda: row)
        outputs.write(REPOS, lambda: repos)
        if outcome.limits:
            outputs.write(LEFT_OUT, lambda: outcome.left_out().filter("n_seen > n_taken"))
    return row.first(), row.schema


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (``value``) with their position ``ord`` by file name and place in the file.

    A reader's numbers grow by one within a block of a file, so a line's position is its block's
    offset, a running sum over the blocks' sizes, plus its place there. Texts are not sorted.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("within"),
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of the input files.
    blocks = (
        lines.groupBy("file", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.min("within").alias("first"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
        .select("file", "block", "offset")
    )
    placed = lines.join(blocks, ["file", "block"])
    return placed.select((F.col("offset") + F.col("within")).alias("ord"), "value")


def split_dataset(
    lines: DataFrame,
    output: str,
    eval_ratio: float = 0.1,
    seed: int = 42,
    order: str | None = None,
    train_name: str = "train.jsonl",
    eval_name: str = "eval.jsonl",
    position: str = "ord",
) -> tuple[int, int]:
    """Write train and eval sets of the non-blank text lines (``value``); returns their sizes.

    ``lines`` has a unique column ``position`` (see lines_in_order). The split is in seeded random
    order, or, with ``order``, in that column's order with its tail as eval.
    """
    if order is None:
        key, rows = "key", split.seeded(lines, position, seed)
        cut = split.find_digest_cut(rows, key, eval_ratio)
    else:
        key, rows = order, split.non_blank(lines)
        cut = split.find_integer_cut(rows, key, eval_ratio)
    for part, name in zip(split.sides(rows, key, cut), (train_name, eval_name), strict=True):
        part.orderBy(key).select("value").write.mode("overwrite").text(f"{output}/{name}")
    return cut.n_train, cut.n_eval


def split_file(spark: SparkSession, path: str, output: str, **options) -> tuple[int, int]:  # noqa: ANN003
    """Split a text file or folder by path; a missing one raises FileNotFoundError."""
    try:
        lines = lines_in_order(spark, path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no such data set: {path}") from error
    return split_dataset(lines, output, **options)
