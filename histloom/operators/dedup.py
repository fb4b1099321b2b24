"""Stage 4: keep-first deduplication, exact and near.

A record is dropped when its content was seen before, or when one of its LSH bands equals a band of
an *earlier kept* record. Dropped records block nobody. Equal to inserting the records one by one
in order, but decided over band keys: no pair of records is ever formed. A few rounds decide almost
everything; what is left hangs together in chains and is split into connected components, the small
ones of which are walked in order, each inside one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions.minhash import band_keys, minhash_signature
from histloom.operators.components import components
from histloom.operators.skew import salted_join
from histloom.operators.staging import stage
from histloom.params import FilterParams

# Tasks get this module's functions with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rounds before chains are looked for, and the most memberships (record, key) of a component that
# one task walks: some 20 MB of keys.
EARLY_ROUNDS = 3
WALKED = 100_000


def content(message: Column, diff: Column) -> Column:
    return F.concat(message, F.lit("\n"), diff)


def first_per(records: DataFrame, group: str) -> DataFrame:
    """The first record (lowest ``ord``) of each group.

    Partial ``min`` collapses a hot group of copies before the shuffle, and the way back joins on
    the unique ``ord`` instead of the group.
    """
    firsts = records.groupBy(group).agg(F.min("ord").alias("ord")).select("ord")
    return records.join(firsts, "ord", "left_semi")


def with_band_keys(records: DataFrame, text: Column, threshold: float) -> DataFrame:
    """Adds ``bands``, null for texts without tokens."""
    signed = records.withColumn("_signature", minhash_signature(text))
    return signed.withColumn("bands", band_keys(F.col("_signature"), threshold)).drop("_signature")


def _shared(memberships: DataFrame, **skew) -> DataFrame:
    """Memberships (key, ord) of keys with more than one record, with the key's ``first`` ord."""
    keys = (
        memberships.groupBy("key")
        .agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return salted_join(
        memberships,
        keys.drop("n"),
        ["key"],
        spread_by=["ord"],
        how="inner",
        counts=keys.select("key", "n"),
        **skew,
    )


def _round(live: DataFrame, **skew) -> DataFrame:
    """(ord, is_kept) of the records that one round decides."""
    is_first = F.col("first") == F.col("ord")
    kept = live.groupBy("ord").agg(F.every(is_first).alias("k")).filter("k").select("ord")
    later = live.filter(~is_first).select("ord", "first").distinct()
    hit = salted_join(
        later,
        kept.withColumnRenamed("ord", "first"),
        ["first"],
        spread_by=["ord"],
        how="inner",
        **skew,
    )
    return kept.withColumn("is_kept", F.lit(True)).union(
        hit.select("ord").distinct().withColumn("is_kept", F.lit(False))
    )


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(ord, is_kept) of rows (root, ord, key) sorted by them: each component one by one."""
    root, used = None, set()
    record, keys = None, []

    def verdict() -> bool:
        kept = used.isdisjoint(keys)
        if kept:
            used.update(keys)
        return kept

    for batch in batches:
        decided = []
        for r, o, k in zip(batch["root"], batch["ord"], batch["key"], strict=True):
            if record is not None and o != record:
                decided.append((record, verdict()))
                keys = []
            if r != root:
                root = r
                used.clear()
            record = o
            keys.append(k)
        yield pd.DataFrame(decided, columns=["ord", "is_kept"])
    if record is not None:
        yield pd.DataFrame([(record, verdict())], columns=["ord", "is_kept"])


def _walk(live: DataFrame, walked: int) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the records in components of at most ``walked`` memberships; the others' ``live``.

    Records without a verdict share no key with those that have one, so both go on apart.
    """
    roots = components(live.select(F.col("ord").alias("a"), F.col("first").alias("b")))
    placed = live.join(roots.withColumnRenamed("node", "ord"), "ord")
    small = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= walked)
    mine = stage(
        placed.join(small.select("root", F.lit(True).alias("small")), "root", "left"), "placed"
    )
    rows = mine.filter("small").select("root", "ord", "key").repartition("root")
    rows = rows.sortWithinPartitions("root", "ord", "key")
    verdicts = rows.mapInPandas(_walked, "ord bigint, is_kept boolean")
    return stage(verdicts, "walked"), mine.filter("small IS NULL").select("key", "ord", "first")


def near_duplicates(
    banded: DataFrame, early_rounds: int = EARLY_ROUNDS, walked: int = WALKED, **skew
) -> DataFrame:
    """``ord`` of the records to drop, from (ord, bands).

    Round: a record that is first in all of its keys is kept, and whoever shares a key with it is
    blocked. Keys left with one undecided record are forgotten, and a record without keys is kept.
    The lowest undecided record is decided in every round, so the rounds end. After
    ``early_rounds`` the components of what is left with at most ``walked`` memberships are decided
    at once by walking them; only larger ones go on in rounds.
    """
    memberships = banded.select(F.explode("bands").alias("key"), "ord")
    live = stage(_shared(stage(memberships, "bands"), **skew), "live")
    blocked, rounds = [], 0
    while not live.isEmpty():
        if rounds == early_rounds:
            decided, live = _walk(live, walked)
            blocked.append(decided.filter(~F.col("is_kept")).select("ord"))
        else:
            decided = stage(_round(live, **skew), "decided")
            blocked.append(decided.filter(~F.col("is_kept")).select("ord"))
            undecided = live.select("key", "ord").join(decided, "ord", "left_anti")
            live = stage(_shared(undecided, **skew), "live")
        rounds += 1
    return reduce(DataFrame.union, blocked, banded.select("ord").limit(0))


def fingerprint(records: DataFrame, text: str, params: FilterParams) -> DataFrame:
    """Replaces ``text`` by ``_group`` (equal for records one of which must go) and ``bands``.

    Records with equal band lists share all their blockers, so only the first can stay; that covers
    equal contents too. Records without tokens, and all records in exact mode, compare by digest.
    """
    group = F.sha2(F.col(text), 256)
    if params.dedup_method == "minhash":
        records = with_band_keys(records, F.col(text), params.dedup_threshold)
        group = F.coalesce(F.md5(F.array_join("bands", "")), group)
        records = records.withColumn("_group", F.unhex(group))
        # As bytes digests take half the room, in every exchange from here on.
        return records.withColumn("bands", F.transform("bands", F.unhex)).drop(text)
    return records.withColumn("_group", F.unhex(group)).drop(text)


def keep_first(
    records: DataFrame,
    text: str,
    params: FilterParams,
    order: list[Column] | None = None,
    **skew,
) -> DataFrame:
    """``records`` without ``text``, plus ``is_duplicate`` and ``ord``.

    ``order`` is a total order of the records; without it they bring a unique bigint ``ord``. The
    texts are read once; everything after works on fingerprints.
    """
    keyed = stage(fingerprint(records, text, params), "keyed")
    if order is not None:
        keyed = number_in_order(keyed, order)
    return judge(keyed, **skew)


def judge(keyed: DataFrame, **skew) -> DataFrame:
    """``is_duplicate`` for rows with ``ord``, ``_group`` and, unless compared exactly, ``bands``."""
    firsts = first_per(keyed, "_group")
    if "bands" in keyed.columns:
        banded = firsts.filter(F.col("bands").isNotNull()).select("ord", "bands")
        firsts = firsts.join(near_duplicates(banded, **skew), "ord", "left_anti")
    verdict = firsts.select("ord", F.lit(False).alias("is_duplicate"))
    return (
        keyed.drop("_group", "bands")
        .join(verdict, "ord", "left")
        .withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(True)))
    )


def number_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``ord``: a bigint increasing in ``order`` (which must be total).

    A range sort of narrow rows, materialised at once: the numbers follow the sort's partitions, so
    they must not be computed twice.
    """
    return stage(df.orderBy(*order).withColumn("ord", F.monotonically_increasing_id()), "ordered")
