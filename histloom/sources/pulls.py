"""Pull requests: bounded scan, linked numbers, comments, issue bodies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx
from histloom.operators.skew import first_n_by_choice, first_n_per_group, salted_join
from histloom.operators.staging import stage
from histloom.params import CollectParams
from histloom.sources.commits import start_of

KEY = ["repo", "number"]
SCAN_FACTOR = 5


def latest() -> list[Column]:
    """Pull requests of a repo in the order in which a scan meets them."""
    return [F.desc("updated_at"), F.desc("number")]


def scanned_pulls(closed: DataFrame, max_prs: int) -> DataFrame:
    """Keys of the closed pull requests that are looked at, with the number closed in their repo."""
    keys = closed.select(*KEY, "updated_at", "merged_at")
    scanned = first_n_per_group(
        keys, ["repo"], latest(), SCAN_FACTOR * max_prs, spread_by=["number"], size="n_closed"
    )
    return scanned.drop("rank")


def _merged_since(closed: DataFrame, day: date | None) -> Column:
    merged = F.col("merged_at").isNotNull()
    return merged if day is None else merged & (F.col("merged_at") >= start_of(day, closed, "merged_at"))


def take_pulls(scanned: DataFrame, max_prs: int, day: date | None = None) -> DataFrame:
    """The first merged ones of each repo with their ``arrival`` and the number to choose from."""
    merged = scanned.filter(_merged_since(scanned, day))
    return first_n_per_group(
        merged, ["repo"], latest(), max_prs, spread_by=["number"], rank="arrival", size="n_seen"
    )


def scan_pulls(closed: DataFrame, max_prs: int | None, day: date | None = None) -> DataFrame:
    """Keys of the merged pull requests a run takes, with their ``arrival`` position.

    Per repo the first SCAN_FACTOR x max_prs closed ones by update time are looked at, unmerged
    and too old ones are passed over, and the first max_prs of the rest are taken. Works on the
    key columns alone; texts are joined afterwards. Without a limit every merged one is taken and
    none ranked: ``arrival`` is then a text that sorts in the same order.
    """
    if max_prs is not None:
        return take_pulls(scanned_pulls(closed, max_prs), max_prs, day)
    return all_merged(closed.select(*KEY, "updated_at", "merged_at"), day)


def all_merged(closed: DataFrame, day: date | None = None) -> DataFrame:
    """The merged rows, with their ``arrival`` as a text that sorts as latest() does."""
    return closed.filter(_merged_since(closed, day)).withColumn("arrival", arrival_text())


def arrival_text() -> Column:
    """Sorts as latest() does."""
    late = F.lit(2**62) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    falling = [late, F.lit(2**62) - F.col("number")]
    return F.concat_ws("-", *[F.lpad(x.cast("string"), 20, "0") for x in falling])


def scan_by_choice(closed: DataFrame, choices: list[CollectParams]) -> DataFrame:
    """The pull requests that any of the choices takes, with a bit for each in ``taken``."""
    keys = closed.select(*KEY, "updated_at", "merged_at")
    limits = [c.max_prs_per_repo for c in choices]
    looked_at = [(F.lit(True), None if n is None else SCAN_FACTOR * n) for n in limits]
    scanned = first_n_by_choice(keys, ["repo"], latest(), looked_at, ["number"], "scanned")
    wanted = [
        (F.col("scanned").bitwiseAND(F.lit(1 << i)).cast("boolean") & _merged_since(closed, c.since), n)
        for i, (c, n) in enumerate(zip(choices, limits, strict=True))
    ]
    chosen = first_n_by_choice(scanned, ["repo"], latest(), wanted, ["number"], "taken")
    return chosen.withColumn("arrival", arrival_text())


def linked_issue_numbers(body: Column, number: Column) -> Column:
    """Distinct mentioned numbers other than the own one, ascending, as canonical digit strings.

    Digit strings keep numbers of any length exact; sorting by (length, digits) is numeric order.
    """
    text = F.coalesce(body, F.lit(""))
    found = F.concat(
        F.regexp_extract_all(text, F.lit("#([0-9]+)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit("(?:issues|pulls)/([0-9]+)"), F.lit(1)),
    )
    canonical = F.transform(found, lambda d: F.regexp_replace(d, "^0+(?=[0-9])", ""))
    others = F.filter(F.array_distinct(canonical), lambda d: d != number.cast("string"))
    keyed = F.array_sort(F.transform(others, lambda d: F.struct(F.length(d).alias("n"), d.alias("d"))))
    return F.transform(keyed, lambda k: k["d"])


def normalise_pulls(raw: DataFrame, *more: str) -> DataFrame:
    """Null defaults and linked numbers; ``more`` columns are kept as they are."""
    body = F.coalesce("body", F.lit(""))
    return raw.select(
        *KEY,
        "title",
        body.alias("body"),
        F.coalesce("diff", F.lit("")).alias("diff"),
        "labels",
        "merged_at",
        linked_issue_numbers(body, F.col("number")).alias("linked_issue_numbers"),
        *more,
    )


def ordered_per_pull(children: DataFrame, value: Column, name: str) -> DataFrame:
    """One row per pull request with its child values in ``pos`` order."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value.alias("v"))))
    return children.groupBy(*KEY).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def attach_ordered(pulls: DataFrame, children: DataFrame, value: Column, name: str) -> DataFrame:
    """``pulls`` plus the ordered array ``name``; only children of these pull requests are moved."""
    wanted = children.join(pulls.select(*KEY), KEY, "left_semi")
    return attach_gathered(pulls, wanted, value, name)


def attach_gathered(pulls: DataFrame, wanted: DataFrame, value: Column, name: str) -> DataFrame:
    """The same with children of these pull requests only."""
    return _with_arrays(pulls, ordered_per_pull(wanted, value, name))


def _with_arrays(pulls: DataFrame, arrays: DataFrame) -> DataFrame:
    """``pulls`` plus the last column of ``arrays``, empty where there is none."""
    name = arrays.columns[-1]
    empty = F.array().cast(arrays.schema[name].dataType)
    return pulls.join(arrays, KEY, "left").withColumn(name, F.coalesce(name, empty))


def comment_author(author: Column) -> Column:
    return F.coalesce(author, F.lit("unknown"))


def issue_ceiling(open_issues: Column) -> Column:
    """Largest number taken for an issue of this repo; the fallback when the repo is unknown."""
    known = F.greatest(open_issues * fv.ISSUE_CEILING_FACTOR, F.lit(fv.ISSUE_CEILING_MIN))
    ceiling = F.when(open_issues.isNull(), F.lit(fv.ISSUE_CEILING_UNKNOWN)).otherwise(known)
    return ceiling.cast("bigint")


def within_ceiling(digits: Column, ceiling: Column) -> Column:
    """Numeric ``digits <= ceiling`` on canonical digit strings of any length."""
    top = ceiling.cast("string")
    shorter = F.length(digits) < F.length(top)
    return shorter | ((F.length(digits) == F.length(top)) & (digits <= top))


def issue_links(pulls: DataFrame) -> DataFrame:
    """One row per (pull request, linked number)."""
    return pulls.select(*KEY, F.explode("linked_issue_numbers").alias("issue"))


def links_with_ceiling(links: DataFrame, repos: DataFrame, **skew) -> DataFrame:
    """Links with the ceiling of their repo; repos with very many links are salted.

    The links are narrow and read several times by the joins, so they are staged, as is the result.
    """
    links = stage(links, "issue-links")
    sizes = repos.select(F.col("full_name").alias("repo"), "open_issues")
    joined = salted_join(links, sizes, ["repo"], spread_by=["number", "issue"], **skew)
    found = joined.withColumn("ceiling", issue_ceiling(F.col("open_issues"))).drop("open_issues")
    return stage(found, "issue-ceilings")


def resolve_issues(links: DataFrame, issues: DataFrame, **skew) -> DataFrame:
    """Links whose issue exists below the ceiling and has a body: (repo, number, issue, body).

    An issue that very many pull requests mention is salted.
    """
    reachable = links.filter(within_ceiling(F.col("issue"), F.col("ceiling"))).drop("ceiling")
    bodies = issues.filter(F.coalesce("body", F.lit("")) != "").select(
        "repo", F.col("number").cast("string").alias("issue"), F.col("body").alias("issue_body")
    )
    return salted_join(
        reachable, bodies, ["repo", "issue"], spread_by=["number"], how="inner", **skew
    )


def issue_block() -> Column:
    return F.concat(F.lit("Issue #"), "issue", F.lit(":\n"), "issue_body")


def attach_issue_blocks(pulls: DataFrame, resolved: DataFrame) -> DataFrame:
    """``linked_issue_bodies``: headed bodies in ascending issue order; empty array without any.

    ``resolved`` holds links of these pull requests only, so nothing is looked up among them first.
    """
    blocks = resolved.select(
        *KEY, F.struct(F.length("issue").alias("n"), F.col("issue")).alias("pos"), issue_block().alias("block")
    )
    return _with_arrays(pulls, ordered_per_pull(blocks, F.col("block"), "linked_issue_bodies"))
