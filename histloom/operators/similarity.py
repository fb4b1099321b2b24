"""Evidence for near-duplicates: exact similarity with the earliest record that was kept.

A set-similarity join with prefix filtering. The tokens of every distinct token set are ordered by
ascending frequency over all sets. Two sets of Jaccard similarity t or more have sizes within a
factor t of each other and share s tokens among their first n - ceil(t n) + s (all their common ones
if those are fewer), so only sets that meet in s such rare tokens, at places that leave room for
enough others and with sketches that do not rule it out (``functions/prefixes.py``), are compared in
full; sets that share a rare token by chance are not. Equal sets are joined once, whatever the
number of their copies, and one of a pair must have been kept.

Token lists are neither staged nor shuffled to be counted or ordered: texts are read again instead.
Postings of prefixes move once, lists only for the pairs that are compared.

Tokens are compared by 64-bit hashes. Records without tokens are similar to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import prefixes as px
from histloom.operators.keyfilter import marked, maybe_in
from histloom.operators.skew import SALTS, salted_join
from histloom.operators.staging import stage

# Sets for each of which a token's postings are dealt out once more: a task compares each of them
# with at most all others of the token.
HOT_SETS = 1 << 14


def token_sets(records: DataFrame, text: Column) -> DataFrame:
    """``records`` without other columns than ord and is_kept, plus ``tokens`` (sorted hashes) and
    ``digest``, equal for equal sets; records without tokens are left out."""
    kind = records.schema["ord"].dataType.simpleString()
    texts = records.select("ord", "is_kept", text.alias("text"))
    sets = texts.mapInArrow(px.tokenised, f"ord {kind}, is_kept boolean, tokens array<bigint>")
    digest = F.struct(F.xxhash64("tokens").alias("one"), F.xxhash64(F.lit(1), "tokens").alias("two"))
    return sets.withColumn("digest", digest)


def set_keys(members: DataFrame) -> DataFrame:
    """One narrow row per set: ``id`` (its first record), ``kept`` (its first kept one), ``last``
    (its last record), digest, size."""
    firsts = members.groupBy("digest").agg(
        F.min("ord").alias("id"),
        F.min(F.when(F.col("is_kept"), F.col("ord"))).alias("kept"),
        F.max("ord").alias("last"),
    )
    # The way back goes over the unique id, not over a digest that very many records may share.
    sizes = members.select(F.col("ord").alias("id"), "size")
    return firsts.join(sizes, "id").select("id", "kept", "last", "digest", "size")


def distinct_sets(members: DataFrame) -> DataFrame:
    """One row per set: ``id`` (its first record), ``kept`` (its first kept one), tokens and size."""
    sized = members.withColumn("size", F.size("tokens"))
    texts = members.select(F.col("ord").alias("id"), "tokens")
    return set_keys(sized).join(texts, "id").select("id", "kept", "digest", "tokens", "size")


def prefixes(
    sets: DataFrame,
    threshold: float,
    texts: DataFrame | None = None,
    min_rows: int = HOT_SETS,
    salts: int = SALTS,
) -> DataFrame:
    """Postings (token, id, about, sketch) of the rarest tokens of each set, some of which similar
    sets share; see ``functions/prefixes.py``. Every task makes those of the sets it reads.

    ``texts`` (id, is_kept, tokens) may hold the tokens instead of ``sets``, those of other records
    included; it is read twice, now to count the tokens.
    """
    if texts is None:
        texts = sets.select("id", F.col("kept").isNotNull().alias("is_kept"), "tokens")
    texts = texts.select(F.col("id").cast("bigint"), "is_kept", "tokens")
    bits = px.group_bits(sets.agg(F.sum("size")).first()[0] or 0)
    counts = texts.select("tokens").mapInArrow(px.counted(bits), px.COUNTED)
    levels = counts.repartition("piece").mapInArrow(px.levels, px.LEVELS).collect()
    table = texts.sparkSession.sparkContext.broadcast(px.level_table(levels, bits))
    return texts.mapInArrow(px.postings(table, threshold, min_rows, salts), px.POSTINGS)


def candidates(index: DataFrame, threshold: float) -> DataFrame:
    """Distinct (id, other), the smaller id first: sets that may be similar, one of them kept."""
    dealt = index.repartition("token").sortWithinPartitions("token", "about")
    met = dealt.mapInArrow(px.meetings(threshold), px.PAIRS)
    shared = met.groupBy("id", "other", "needed").agg(F.sum("n").alias("n"))
    return shared.filter("n >= needed").select("id", "other").distinct()


def useful(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with digest and first kept record of both sets, and whether either set has a record
    that the other's kept one could be the witness of; pairs of which neither has are left out."""
    sets = sets.select("id", "digest", "kept", "last").distinct()
    one = sets.select("id", F.col("digest").alias("d1"), F.col("kept").alias("k1"), F.col("last").alias("l1"))
    two = sets.select(
        F.col("id").alias("other"), F.col("digest").alias("d2"), F.col("kept").alias("k2"), F.col("last").alias("l2")
    )
    both = pairs.join(one, "id").join(two, "other")
    # Least skips nulls: a set without a kept record is bound by its last one only.
    flags = {
        "for1": F.coalesce(F.col("k2") < F.least("k1", "l1"), F.lit(False)),
        "for2": F.coalesce(F.col("k1") < F.least("k2", "l2"), F.lit(False)),
    }
    return both.withColumns(flags).drop("l1", "l2").filter("for1 OR for2")


def similar_kept(sets: DataFrame, texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(digest, witness, jaccard): the earliest kept record at or over the threshold, per set.

    ``texts`` (ord, text) are read for both sides of the pairs of ``useful``, which must be staged:
    only tokens of sets that are in pairs are moved.
    """

    def side(n: int, on: str) -> DataFrame:
        ids = pairs.select(F.col(on).alias("ord"))
        tokens = _tokens(maybe_in(texts, ids, ["ord"]))
        # Records with a repeated id may differ: their sets are told apart by the digest.
        return tokens.select(F.col("ord").alias(on), F.col("digest").alias(f"d{n}"), F.col("tokens").alias(f"t{n}"))

    both = pairs.join(side(1, "id"), ["id", "d1"]).join(side(2, "other"), ["other", "d2"])
    either = F.size("t1") + F.size("t2") - F.col("shared")
    compared = both.withColumn("shared", px.n_shared("t1", "t2")).select(
        "d1", "k1", "for1", "d2", "k2", "for2", (F.col("shared").cast("double") / either).alias("jaccard")
    )
    ways = F.array(
        F.struct(F.col("for1").alias("use"), F.col("d1").alias("digest"), F.col("k2").alias("kept")),
        F.struct(F.col("for2").alias("use"), F.col("d2").alias("digest"), F.col("k1").alias("kept")),
    )
    found = compared.filter(F.col("jaccard") >= F.lit(threshold)).select(F.explode(ways).alias("w"), "jaccard")
    found = found.filter("w.use").select("w.digest", "w.kept", "jaccard")
    same = sets.filter(F.col("kept").isNotNull()).select("digest", "kept", F.lit(1.0).alias("jaccard"))
    first = F.min_by(F.struct("kept", "jaccard"), "kept")
    return found.unionByName(same).groupBy("digest").agg(first.alias("f")).select(
        "digest", F.col("f.kept").alias("witness"), F.col("f.jaccard").alias("jaccard")
    )


def _tokens(texts: DataFrame) -> DataFrame:
    """(ord, tokens, digest) of rows (ord, text)."""
    return token_sets(texts.withColumn("is_kept", F.lit(None).cast("boolean")), F.col("text")).drop("is_kept")


def witnesses(
    records: DataFrame, text: Column, threshold: float, verdicts: DataFrame | None = None, **skew
) -> DataFrame:
    """``witness`` and ``jaccard`` for records (ord, is_kept, text): the earliest kept record before
    each whose token set has at least this similarity; null where there is none.

    The earliest of all similar kept records is looked for, once per distinct set: if it does not
    come before a record, none does. ``verdicts`` (ord, is_kept) may stand apart from the records;
    texts are then never joined. The records are read several times: they should be a table.
    """
    texts = records.select("ord", text.alias("text"))
    size = F.size("tokens").alias("size")
    if verdicts is None:
        judged = records.select("ord", "is_kept")
        keyed = stage(token_sets(records, text).select("ord", "is_kept", "digest", size), "set-keys")
    else:
        verdicts = stage(verdicts.select("ord", "is_kept"), "verdicts")
        keyed = stage(_tokens(texts).select("ord", "digest", size), "set-keys").join(verdicts, "ord")
        judged = records.select("ord").join(verdicts, "ord")
    sets = stage(set_keys(keyed), "distinct-sets")
    # Texts stay where they are: bitmaps of the sets' ids pick the rows and tell which were kept.
    firsts = maybe_in(texts.filter(F.col("ord").isNotNull()), sets.select(F.col("id").alias("ord")), ["ord"])
    kept = sets.filter(F.col("kept").isNotNull()).select(F.col("id").alias("ord"))
    firsts = marked(_tokens(firsts).drop("digest"), kept, ["ord"], "is_kept")
    index = prefixes(sets, threshold, firsts.withColumnRenamed("ord", "id"), **skew)
    pairs = stage(useful(sets, stage(candidates(index, threshold), "candidates")), "pairs")
    best = stage(similar_kept(sets, texts, pairs, threshold), "best")
    by_digest = best.join(sets.select("digest"), "digest")
    found = salted_join(
        keyed.select("ord", "digest"), by_digest, ["digest"], spread_by=["ord"], how="inner", **skew
    )
    earlier = found.filter(F.col("witness") < F.col("ord")).select("ord", "witness", "jaccard")
    return judged.join(earlier, "ord", "left")


def recall(evidence: DataFrame) -> DataFrame:
    """One row: how many records have an earlier kept one at or over the threshold, how many of
    them were dropped (recall), and how many dropped ones have none (dropped by chance)."""
    similar = F.col("witness").isNotNull()
    counts = evidence.agg(
        F.count_if(similar).alias("n_similar"),
        F.count_if(similar & ~F.col("is_kept")).alias("n_similar_dropped"),
        F.count_if(~F.col("is_kept")).alias("n_dropped"),
        F.count_if(~similar & ~F.col("is_kept")).alias("n_dropped_below"),
    )
    share = F.col("n_similar_dropped").cast("double") / F.col("n_similar")
    return counts.withColumn("recall", F.when(F.col("n_similar") > 0, share))
