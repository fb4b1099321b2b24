import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from histloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, TREE string, idx int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fanout):
    """Root, and per leaf the runs it meets: (own slot, others)."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(spots):
            run = level[at // fanout * fanout :][:fanout]
            paths[i].append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        spots = [at // fanout for at in spots]
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0], leaf(*row[:5])))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    below = {}
    for name in names:
        members = sorted(trees[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        below[name] = members, *tree([d for _, d in members], fanout)
    root, above = tree([below[n][1] for n in names], fanout)
    out = []
    for i, name in enumerate(names):
        members, subroot, paths = below[name]
        for (key, digest), path in zip(members, paths, strict=True):
            text = "".join(d for _, others in path + above[i] for d in others)
            out.append((key, digest, subroot, root, h(text)))
    return sorted(out, key=str)


def rows_of(n, seed=5):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice([None, *range(n)]), rnd.choice("ab"), rnd.choice([None, "", "en", "en", "en", "dé", "n"]),
         rnd.choice([None, i]), rnd.choice([None, "", "text", "é" * 9]), "x", 1)
        for i in range(n)
    ]
    return rows + rows[: n // 3] + [(7, "s", "alone", 1, "t", None, None)]


@pytest.mark.parametrize(("n", "fanout"), [(0, 2), (1, 2), (40, 2), (120, 2), (60, 3), (50, 4)])
def test_manifest_equals_hashing_by_hand(spark, n, fanout):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = merkle.manifest(docs, fanout=fanout, carried={"shown": F.lit(leaf("no such row"))})
    proof = F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256)
    held = merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")
    got = found.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("p"), held.alias("held"),
        (merkle.fold(F.col("shown"), F.col("path")) == F.col("root")).alias("forged"),
    ).collect()
    assert all(r.held and not r.forged for r in got)
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows, fanout)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_is_the_root(spark):
    row = merkle.manifest(spark.createDataFrame([(None, None, None, None, None, "", 0)], SCHEMA)).first()
    assert row.leaf == row.subroot == row.root == h("-----") and row.path == []


def test_copies_of_one_row(spark):
    rows = [(1, "s", "en", 3, "abc", "", 0)] * 300
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    want = tree([leaf(*rows[0][:5])] * 300, 2)[0]
    assert {r.root for r in found.collect()} == {want} and found.count() == 300
