import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from histloom.functions import prefixes
from histloom.operators import dedup, similarity
from histloom.params import FilterParams


def brute(rows, threshold):
    """(ord) -> (witness, jaccard): the earliest kept record at or over the threshold."""
    sets = [(o, kept, set((t or "").split())) for o, kept, t in rows]
    out = {}
    for o, _, mine in sets:
        found = sorted(
            (p, len(mine & theirs) / len(mine | theirs))
            for p, kept, theirs in sets
            if kept and p < o and mine and theirs and len(mine & theirs) / len(mine | theirs) >= threshold
        )
        out[o] = found[0] if found else (None, None)
    return out


def family(rng, vocabulary, size, n, changes):
    words = rng.sample(vocabulary, size)
    for _ in range(n):
        yield " ".join(rng.sample(words, len(words)))
        for _ in range(changes):
            words[rng.randrange(size)] = rng.choice(vocabulary)


@pytest.mark.parametrize(("threshold", "min_rows"), [(0.5, 100_000), (0.8, 3), (0.85, 100_000), (1.0, 100_000)])
def test_witnesses_equal_comparing_all(spark, threshold, min_rows):
    rng = random.Random(threshold)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [t for size in (3, 12, 40, 41, 90) for t in family(rng, sorted(set(vocabulary)), size, 14, 2)]
    texts += [None, "", " ", "one", "one", "one two", *["copy of one text"] * 30, "copy of one  text copy"]
    rng.shuffle(texts)
    rows = [(i, rng.random() < 0.6, t) for i, t in enumerate(texts)]
    records = spark.createDataFrame(rows, "ord bigint, is_kept boolean, t string").repartition(3)
    found = similarity.witnesses(records, F.col("t"), threshold, min_rows=min_rows).collect()
    assert {r["ord"]: (r["witness"], r["jaccard"]) for r in found} == brute(rows, threshold)
    assert len(found) == len(rows)


def test_prefixes_pass_over_frequent_words(spark):
    """Texts that share only words of all texts never meet."""
    rows = [(i, True, f"the of and to {i} a{i} b{i} c{i} d{i} e{i}") for i in range(60)]
    records = spark.createDataFrame(rows, "ord bigint, is_kept boolean, t string")
    sets = similarity.distinct_sets(similarity.token_sets(records, F.col("t")))
    assert similarity.candidates(similarity.prefixes(sets, 0.8), 0.8).isEmpty()


def test_recall_counts_what_banding_missed(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [t for _ in range(15) for t in family(rng, vocabulary, 50, 6, 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord bigint, t string")
    judged = dedup.keep_first(rows, "t", FilterParams(dedup_threshold=0.8))
    records = rows.join(judged.select("ord", (~F.col("is_duplicate")).alias("is_kept")), "ord")
    row = similarity.recall(similarity.witnesses(records, F.col("t"), 0.8)).first()
    want = brute([(r["ord"], r["is_kept"], r["t"]) for r in records.collect()], 0.8)
    kept = {r["ord"] for r in records.filter("is_kept").collect()}
    similar = {o for o, (w, _) in want.items() if w is not None}
    assert row["n_similar"] == len(similar) and row["n_similar_dropped"] == len(similar - kept)
    assert row["n_dropped"] == len(texts) - len(kept)
    assert row["n_dropped_below"] == len({*range(len(texts))} - kept - similar)
    assert row["recall"] == len(similar - kept) / len(similar)


def test_no_records(spark):
    none = spark.createDataFrame([], "ord bigint, is_kept boolean, t string")
    found = similarity.witnesses(none, F.col("t"), 0.8)
    assert found.isEmpty() and similarity.recall(found).first()["recall"] is None


def test_one_rare_word_in_common_is_no_candidate(spark):
    """Texts that share a word of no other text, and little else, are not compared in full."""
    rows = [(i, True, f"pair{i // 2} " + " ".join(f"w{i}x{k}" for k in range(19))) for i in range(40)]
    records = spark.createDataFrame(rows, "ord bigint, is_kept boolean, t string")
    sets = similarity.distinct_sets(similarity.token_sets(records, F.col("t")))
    assert similarity.candidates(similarity.prefixes(sets, 0.8), 0.8).isEmpty()


def test_verdicts_may_stand_apart_from_the_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)]
    texts = [t for size in (2, 9, 30) for t in family(rng, sorted(set(vocabulary)), size, 12, 1)]
    rows = [(i, rng.random() < 0.5, t) for i, t in enumerate([*texts, None, "", *["a b c"] * 5])]
    together = spark.createDataFrame(rows, "ord bigint, is_kept boolean, t string")
    texts, verdicts = together.select("ord", "t"), together.select("ord", "is_kept")
    found = similarity.witnesses(texts, F.col("t"), 0.8, verdicts).collect()
    assert {r["ord"]: (r["witness"], r["jaccard"]) for r in found} == brute(rows, 0.8)


def test_long_texts_must_share_more_rare_words(spark):
    """Four words of no other text in common, of 200, are no reason to compare two texts."""
    rows = [
        (i, True, " ".join([f"pair{i // 2}x{k}" for k in range(4)] + [f"w{i}x{k}" for k in range(196)]))
        for i in range(12)
    ]
    records = spark.createDataFrame(rows, "ord bigint, is_kept boolean, t string")
    sets = similarity.distinct_sets(similarity.token_sets(records, F.col("t")))
    assert similarity.candidates(similarity.prefixes(sets, 0.8), 0.8).isEmpty()


def test_no_list_of_tokens_is_written(spark, monkeypatch):
    """Staged tables of a run grow with records, sets and pairs, not with their tokens."""
    staged, stage = [], similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, name: staged.append(df.schema) or stage(df, name))
    texts = [f"a b c d e f g {i % 3}" for i in range(9)]
    rows = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "ord bigint, is_kept boolean, t string")
    similarity.witnesses(rows.select("ord", "t"), F.col("t"), 0.7, rows.select("ord", "is_kept")).collect()
    assert staged and not [f for s in staged for f in s if f.dataType.typeName() == "array"]


def test_prefixes_are_made_where_the_tokens_are(spark):
    rows = [(i, i, [1, 2, 3, i + 10], 4) for i in range(8)]
    sets = spark.createDataFrame(rows, "id bigint, kept bigint, tokens array<bigint>, size int")
    plan = similarity.prefixes(sets, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_families_below_the_threshold_are_not_compared_in_pairs(spark):
    """Texts that have three quarters of their words in common, and those are their rarest."""
    rng = random.Random(9)
    pool, family = [f"p{i}" for i in range(300)], [f"f{i}" for i in range(75)]
    texts = [" ".join([*family, *rng.sample(pool, 25)]) for _ in range(30)]
    texts += [" ".join([*pool, f"x{i}"]) for i in range(60)]
    records = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "ord bigint, is_kept boolean, t string")
    sets = similarity.distinct_sets(similarity.token_sets(records, F.col("t")))
    pairs = similarity.candidates(similarity.prefixes(sets, 0.85), 0.85)
    assert pairs.filter("id < 30 AND other < 30").count() < 30 * 29 / 2 / 10


@pytest.mark.parametrize(("threshold", "min_rows"), [(0.6, 5), (0.85, 100_000), (0.85, 2)])
def test_long_sets_of_unequal_sizes(spark, threshold, min_rows):
    """Sizes on both sides of those where sketches become longer, or are left out."""
    rng = random.Random(min_rows)
    vocabulary, texts = [f"w{i}" for i in range(3000)], []
    for size in (140, 150, 160, 290, 310, 600, 1190, 1230):
        words = rng.sample(vocabulary, size)
        for _ in range(6):
            texts.append(" ".join(words))
            words = [w for w in words if rng.random() > 0.04] + rng.sample(vocabulary, size // 30)
    rng.shuffle(texts)
    rows = [(i, rng.random() < 0.7, t) for i, t in enumerate(texts)]
    records = spark.createDataFrame(rows, "ord bigint, is_kept boolean, t string")
    found = similarity.witnesses(records, F.col("t"), threshold, min_rows=min_rows).collect()
    assert {r["ord"]: (r["witness"], r["jaccard"]) for r in found} == brute(rows, threshold)


def test_words_are_those_of_split():
    words = ["a", "é" * 40, "x" * 64, "x" * 65, "abcdefgh", "abcdefghi", "abcdefg\x00", "abcdefg"]
    texts = [None, "", " \u3000", *words, " ".join(words), "\x1cb\x85a a\xa0", "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["ord", "text"])
    whole = {r["ord"]: r["tokens"] for r in next(prefixes.tokenised(iter([batch]))).to_pylist()}
    assert [len(whole.get(i, [])) for i in range(len(texts))] == [len(set((t or "").split())) for t in texts]
    assert whole[len(texts) - 2] == whole[len(texts) - 1] and len({whole[i + 3][0] for i in range(len(words))}) == len(words)
    for i in range(len(texts)):
        alone = next(prefixes.tokenised(iter([batch.slice(i, 1)]))).to_pylist()
        assert [r["tokens"] for r in alone] == [whole[i] for _ in range(i in whole)]


def test_sketches_and_table_of_levels_count_no_similar_pair_out():
    """Parity sketches of different lengths differ in no more bits than their sets in tokens."""
    rng = np.random.default_rng(3)
    for size, less in ((301, 5), (1201, 60), (150, 0), (601, 30)):
        tokens = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        sketches = [prefixes._sketch(tokens), prefixes._sketch(tokens[less:])]
        about = np.array([len(tokens) << 32, (len(tokens) - less) << 32]) | 3
        rows = prefixes._Postings(np.zeros(2, np.int64), np.arange(2), about, pa.array(sketches, pa.binary()))
        words, folded = rows.folded()
        common = int(words.min())
        if common:
            assert np.bitwise_count(folded[common][0] ^ folded[common][1]).sum() <= less
    levels = list(prefixes.levels(prefixes.counted(15)(iter([pa.RecordBatch.from_arrays(
        [pa.array([[5, 7], [5], [7 + (1 << 15)], [9, -1]], pa.list_(pa.int64()))], ["tokens"])]))))
    table = prefixes.level_table([(r["piece"], r["levels"]) for b in levels for r in b.to_pylist()], 15)
    assert [table[i] for i in (5, 7, 9, 11, (1 << 15) - 1)] == [6, 6, 1, 0, 1]


def test_pairs_without_an_earlier_witness_are_left_out(spark):
    rows = [(1, 10, 1, 1), (2, 20, None, 2), (3, 30, 3, 9), (4, 40, None, 4)]
    sets = spark.createDataFrame(rows, "id bigint, digest bigint, kept bigint, last bigint")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)], "id bigint, other bigint")
    found = {(r["id"], r["other"]): (r["for1"], r["for2"]) for r in similarity.useful(sets, pairs).collect()}
    assert found == {(1, 2): (False, True), (1, 3): (False, True), (3, 4): (False, True)}
