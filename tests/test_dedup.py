import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histloom.functions import minhash as mh
from histloom.operators import dedup
from histloom.operators.components import components
from histloom.operators.skew import first_n_per_group, salted_join
from histloom.params import FilterParams


def walk(texts, threshold):
    """Kept positions when inserting one after the other."""
    bands, rows = mh.band_shape(threshold)
    seen, used, kept = set(), set(), set()
    for i, (text, sig) in enumerate(zip(texts, mh.signatures(iter(texts)))):
        if text in seen:
            continue
        seen.add(text)
        keys = set()
        if sig is not None:
            keys = {(b, tuple(sig[b * rows : (b + 1) * rows].tolist())) for b in range(bands)}
        if not keys & used:
            used |= keys
            kept.add(i)
    return kept


def test_band_shapes():
    shapes = [mh.band_shape(t) for t in (0.60, 0.80, 0.85, 0.95)]
    assert shapes == [(18, 7), (9, 13), (8, 16), (3, 42)]


def test_signatures_do_not_depend_on_grouping():
    rng = random.Random(3)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(n)) for n in (0, 1, 30, 20000, 5, 9000)]
    together = list(mh.signatures(iter(texts)))
    for text, sig in zip(texts, together):
        alone = next(mh.signatures(iter([text])))
        assert (sig is None and alone is None) or np.array_equal(sig, alone)
    a, b = mh.COEFFICIENTS
    tokens = texts[2].split()
    want = [
        min(((int(x) * mh._hash(t) + int(y)) % 2**64 % mh.PRIME) & mh.MAX_HASH for t in tokens)
        for x, y in zip(a, b)
    ]
    assert together[2].tolist() == want


def test_near_and_exact_duplicates(spark):
    text = "Rivers carry sand and {} from the hills to the sea, where waves sort them by their weight."
    diff = "\n@@ -3,2 +3,4 @@\n-sand\n+sand and silt\n+gravel stays behind\n+clay travels far"
    rows = [(0, text.format("gravel") + diff), (1, text.format("gravel") + diff),
            (2, text.format("pebbles") + diff), (3, "something else entirely"), (4, ""), (5, "")]
    df = spark.createDataFrame(rows, "ord bigint, t string")

    def dropped(p):
        judged = dedup.keep_first(df, "t", p).filter("is_duplicate").collect()
        return {r["ord"] for r in judged}

    assert dropped(FilterParams(dedup_threshold=0.60)) == {1, 2, 5}
    assert dropped(FilterParams(dedup_method="exact")) == {1, 5}


@pytest.mark.parametrize("min_rows", [2, 100_000])
def test_rounds_equal_insertion_one_by_one(spark, min_rows):
    """Chains of slowly changing texts, a hot family, copies; with and without salted hot keys."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        words = rng.sample(vocabulary, 40)
        for _ in range(15):
            texts.append(" ".join(words))
            words[rng.randrange(40)] = rng.choice(vocabulary)
            words[rng.randrange(40)] = rng.choice(vocabulary)
    family = " ".join(rng.sample(vocabulary, 60))
    texts += [f"{family} x{i}" for i in range(80)] + [family] * 20
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "ord bigint, t string").repartition(4)
    p = FilterParams(dedup_threshold=0.60)
    judged = dedup.keep_first(df, "t", p, min_rows=min_rows)
    kept = {r["ord"] for r in judged.filter("not is_duplicate").collect()}
    assert kept == walk(texts, 0.60)
    assert judged.count() == len(texts)


def test_random_bands_equal_insertion(spark):
    rng = random.Random(11)
    for _ in range(4):
        rows = [(i, [f"{b}-{rng.randint(0, 25)}" for b in range(4)]) for i in range(60)]
        df = spark.createDataFrame(rows, "ord bigint, bands array<string>")
        used, want = set(), set()
        for i, keys in rows:
            if used & set(keys):
                want.add(i)
            else:
                used |= set(keys)
        got = {r["ord"] for r in dedup.near_duplicates(df, min_rows=3).collect()}
        assert got == want


def test_salted_join_equals_join(spark):
    left = spark.range(2000).select((F.col("id") % 7 % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k bigint, v string")
    for how in ("inner", "left"):
        got = salted_join(left, right, ["k"], spread_by=["id"], how=how, min_rows=10)
        want = left.join(right, "k", how)
        assert got.select("k", "id", "v").exceptAll(want.select("k", "id", "v")).isEmpty()
        assert got.count() == want.count()


def test_first_n_per_group(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    rows = first_n_per_group(df, ["g"], [F.col("id").desc()], 10, spread_by=["id"]).collect()
    for g in range(3):
        got = sorted((r["rank"], r["id"]) for r in rows if r["g"] == g)
        want = [i for i in range(499, -1, -1) if i % 3 == g][:10]
        assert got == list(enumerate(want, 1))


def test_order_decides_who_stays(spark):
    rows = [("b", 1, "same text"), ("a", 2, "same text"), ("a", 1, "other words here")]
    df = spark.createDataFrame(rows, "repo string, place int, t string")
    judged = dedup.keep_first(df, "t", FilterParams(), [F.col("repo"), F.col("place")])
    assert [(r["repo"], r["place"]) for r in judged.filter("is_duplicate").collect()] == [("b", 1)]


def insertion(rows):
    """Dropped positions when inserting (ord, bands) one after the other."""
    used, dropped = set(), set()
    for i, keys in sorted(rows):
        if used & set(keys):
            dropped.add(i)
        else:
            used |= set(keys)
    return dropped


def steps(monkeypatch):
    """Names of the frames staged from now on."""
    names, own = [], dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name: (names.append(name), own(df, name))[1])
    return names


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    names = steps(monkeypatch)
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(1000)]
    rows += [(2000 + i, [f"alone{i}", f"none{i}"]) for i in range(50)]
    banded = spark.createDataFrame(rows, "ord bigint, bands array<string>").repartition(4)
    got = {r["ord"] for r in dedup.near_duplicates(banded).collect()}
    assert got == insertion(rows) == set(range(1, 1000, 2))
    assert names.count("decided") == dedup.EARLY_ROUNDS and names.count("walked") == 1


@pytest.mark.parametrize(("early", "walked"), [(0, 100_000), (0, 12), (1, 40), (9, 0)])
def test_walks_and_rounds_decide_alike(spark, early, walked):
    """Chains of several lengths and random tangles; with small limits the larger ones go in rounds."""
    rng = random.Random(early + walked)
    rows = []
    for c, length in enumerate((1, 2, 3, 5, 8, 13, 21)):
        rows += [(1000 * c + i, [f"{c}-{i}", f"{c}-{i + 1}"]) for i in range(length)]
    rows += [(9000 + i, [f"r{b}-{rng.randint(0, 30)}" for b in range(3)]) for i in range(40)]
    banded = spark.createDataFrame(rows, "ord bigint, bands array<string>").repartition(3)
    got = dedup.near_duplicates(banded, early_rounds=early, walked=walked, min_rows=3)
    assert {r["ord"] for r in got.collect()} == insertion(rows)


@pytest.mark.parametrize("n", [0, 1, 60])
def test_components(spark, n):
    rng = random.Random(n)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(n)]
    pairs += [(200 + i, 201 + i) for i in range(n)]  # a path
    pairs += [(400, 401 + i) for i in range(n)]  # a hub
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_a_word_is_permuted_once_and_memory_is_bounded(monkeypatch):
    texts = [" ".join(f"w{(i * 7 + k) % 40}" for k in range(12)) for i in range(50)]
    want = [list(s) for s in mh.signatures(iter(texts))]
    permuted, seen = mh._permuted, []
    monkeypatch.setattr(mh, "_permuted", lambda h: seen.append(len(h)) or permuted(h))
    assert [list(s) for s in mh.signatures(iter(texts))] == want
    assert sum(seen) == 40
    monkeypatch.setattr(mh, "_REMEMBERED", 16)
    monkeypatch.setattr(mh, "_GROUP", 8)
    few = mh._Permuted()
    assert [list(s) for s in mh.signatures(iter(texts), few)] == want
    assert len(few._places) <= 16


def test_digests_travel_as_bytes(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, "")], "ord bigint, t string")
    for method, size in (("minhash", {0: 16, 1: 32}), ("exact", {0: 32, 1: 32})):
        p = FilterParams(dedup_method=method)
        rows = dedup.fingerprint(df, "t", p).collect()
        assert {r.ord: len(r._group) for r in rows} == size
        assert method == "exact" or {len(b) for b in rows[0].bands} == {16} and rows[1].bands is None
