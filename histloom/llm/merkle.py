"""A Merkle tree over the rows of a data set, with a proof of membership for every row.

Rows are leaves, grouped into trees (here by language) and ordered within; the roots of the trees
are the leaves of one tree above them. Going up, every level is an equijoin of its nodes with
themselves on the computed index of their siblings: ``index XOR 1`` for runs of two, the other slots
of the run otherwise. The node in slot zero then emits the parent. Going down, nodes join their
parents' paths, so that each leaf ends with the siblings of all levels up to the root. Join keys
are (tree, index), unique whatever the sizes of the trees; no task holds a tree or a run of equal rows.

A digest is lower-case hex SHA-256 of the joined inputs, digests as hex text. A step of a path is
binary: the node's slot in its run, then the digests of the others in order (none: hashed alone).

Defined results: null fields are hashed as ``-``; a null tree name is a tree of its own and comes
first; null ids come first in it. Rows equal in tree, id and leaf follow each other in any order,
which changes no digest. A tree of one leaf is that leaf; no rows, no result. Other columns take no
part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histloom.llm.common import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of paths in one plan. The written ones are small beside the leaves'.
CUT = 3
# monotonically_increasing_id: the partition's number stands above these bits.
_WITHIN = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    texts = [v.cast("string") for v in values]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return digest(*[F.coalesce(s, F.lit("-")) for s in sized])


def _tree_name(column: Column) -> Column:
    """Never null; orders as null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def _indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx`` (from 0 by ``order`` within ``tree``) and ``size`` (leaves of the tree).

    One range sort; a row's place is the offset of its (tree, partition), a running sum over one
    row per partition and tree, plus its place there. Rows equal in all of ``order`` are told apart
    by a number of their own, so they may lie in several partitions.
    """
    own = stage(leaves.withColumn("_own", F.monotonically_increasing_id()), "merkle-leaves")
    ranked = own.orderBy("tree", *order, "_own").drop("_own")
    ranked = stage(ranked.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    ranked = ranked.withColumn("_part", F.shiftright("_at", _WITHIN))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy("tree", "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            "tree",
            "_part",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
            F.sum("_n").over(whole).alias("size"),
        )
    )
    placed = ranked.join(offsets, ["tree", "_part"])
    return placed.withColumn("idx", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds ``step``: the node's slot and its siblings' digests; by one equijoin for each sibling."""
    slot = F.col("idx") % fanout
    found = []
    for k in range(1, fanout):
        # The sibling k slots further on, around the run's end.
        other = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else (
            F.col("idx") - slot + (slot + k) % fanout
        )
        keyed = nodes.select("tree", F.col("idx").alias("_other"), F.col("digest").alias(f"_d{k}"))
        nodes = nodes.withColumn("_other", other).join(keyed, ["tree", "_other"], "left").drop("_other")
        found.append(F.struct(((slot + k) % fanout).alias("slot"), F.col(f"_d{k}").alias("d")))
    others = F.filter(F.array_sort(F.array(*found)), lambda s: s["d"].isNotNull())
    texts = F.array_join(F.transform(others, lambda s: s["d"]), "")
    step = F.concat(F.unhex(F.lpad(F.hex(slot), 2, "0")), F.unhex(texts))
    return nodes.withColumn("step", step).drop(*[f"_d{k}" for k in range(1, fanout)])


def folded(acc: Column, step: Column) -> Column:
    """The digest above ``acc``, given the step beside it."""
    slot = F.conv(F.hex(F.substring(step, 1, 1)), 16, 10).cast("int")
    others = F.lower(F.hex(step))
    before = F.substring(others, F.lit(3), slot * 64)
    after = F.substring(others, slot * 64 + 3, F.length(others))
    return digest(before, acc, after)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, folded)


def proof_text(path: Column) -> Column:
    """All siblings' digests of a path, from the leaf's up, left to right, joined."""
    return F.array_join(F.transform(path, lambda s: F.substring(F.lower(F.hex(s)), 3, 1 << 20)), "")


def _grown(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Levels of nodes (tree, idx, size, digest, step), the leaves' first; tops have size 1."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        nodes = stage(_with_siblings(nodes, fanout), f"{name}-{len(levels)}")
        levels.append(nodes)
        if most <= 1:
            return levels
        most = -(-most // fanout)
        first = nodes.filter((F.col("size") > 1) & (F.col("idx") % fanout == 0))
        nodes = first.select(
            "tree",
            F.floor(F.col("idx") / fanout).cast("long").alias("idx"),
            F.ceil(F.col("size") / fanout).cast("long").alias("size"),
            folded(F.col("digest"), F.col("step")).alias("digest"),
        )


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, height, digest): the root of every tree."""
    each = [
        nodes.filter("size = 1").select("tree", F.lit(h).alias("height"), "digest")
        for h, nodes in enumerate(levels)
    ]
    return reduce(DataFrame.union, each)


def _paths(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The leaves with ``path`` and what ``above`` (tree, height, path, ...) says of their trees."""
    kept = [c for c in above.columns if c not in ("tree", "height", "path")]
    known = None
    for height in range(len(levels) - 1, -1, -1):
        # A tree of this height has one node here; what is above it is known.
        parents = above.filter(F.col("height") == height).select(
            "tree", F.lit(0).cast("long").alias("_parent"), F.col("path").alias("_path"), *kept
        )
        if known is not None:
            up = [F.col("idx").alias("_parent"), F.col("path").alias("_path")]
            parents = parents.unionByName(known.select("tree", *up, *kept))
        nodes = levels[height].withColumn("_parent", F.floor(F.col("idx") / fanout).cast("long"))
        own = F.when(F.col("size") > 1, F.array("step")).otherwise(F.array().cast("array<binary>"))
        joined = nodes.join(parents, ["tree", "_parent"])
        known = joined.withColumn("path", F.concat(own, F.col("_path"))).drop("_path", "_parent")
        if height and height % CUT == 0:
            known = stage(known.select("tree", "idx", "path", *kept), "merkle-paths")
    return known


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id",
    fanout: int = 2, carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root and ``path`` (array<binary>).

    ``carried`` adds columns computed from the row, e.g. a digest to compare with.
    """
    columns = {f"c_{n}": c for n, c in (carried or {}).items()}
    leaves = docs.select(
        _tree_name(F.col(f"`{tree}`")).alias("tree"),
        F.col(f"`{key}`").alias("key"),
        leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("digest"),
        *[c.alias(n) for n, c in columns.items()],
    )
    levels = _grown(_indexed(leaves, ["key", "digest"]), fanout, "merkle")
    roots = stage(_tops(levels), "merkle-subroots")
    # The roots, by the order of their trees, are the leaves of the tree above.
    over = roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("below"), F.col("height").alias("grown"), "digest"
    )
    upper = _grown(_indexed(over, ["below"]), fanout, "merkle-over")
    ends = _tops(upper).select(
        "tree", "height", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("root")
    )
    above = _paths(upper, ends, fanout).select(
        F.col("below").alias("tree"), F.col("grown").alias("height"), "path",
        F.col("digest").alias("subroot"), "root",
    )
    found = _paths(levels, stage(above, "merkle-over-paths"), fanout)
    return found.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path",
        *[F.col(f"c_{n}").alias(n) for n in (carried or {})],
    )
