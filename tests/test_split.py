import random

import pytest

from histloom.operators import split
from histloom.plans.jobs import lines_in_order, split_dataset, split_file


@pytest.mark.parametrize("total, ratio, sizes", [
    (10, 0.2, (8, 2)), (1, 0.5, (1, 0)), (2, 0.1, (1, 1)), (5, 0.5, (3, 2)), (25, 0.1, (23, 2)),
    (3, 1.0, (0, 3)), (2, 0.9, (1, 1)), (4, 0.0, (4, 0)),
])
def test_sizes(total, ratio, sizes):
    assert split.split_sizes(total, ratio) == sizes


@pytest.mark.parametrize("n, ratio", [(1, 0.5), (2, 0.1), (25, 0.1), (60, 0.2), (300, 0.5)])
def test_split_lines(spark, n, ratio):
    rng = random.Random(n)
    lines = [f'{{"l":{rng.randint(0, n // 4)}}}' for _ in range(n)]
    numbered = list(enumerate([*lines, "  ", "", "\t"]))
    df = spark.createDataFrame(numbered, "ord bigint, value string")
    train, held_out = split.split_lines(df, "ord", ratio)
    a = sorted(r["value"] for r in train.collect())
    b = sorted(r["value"] for r in held_out.collect())
    assert sorted(a + b) == sorted(lines)
    assert (len(a), len(b)) == split.split_sizes(n, ratio)
    again = split.split_lines(df.repartition(7), "ord", ratio)
    assert sorted(r["value"] for r in again[1].collect()) == b


def test_hot_line_is_in_both_sides_in_proportion(spark):
    df = spark.range(20_000).selectExpr(
        "id AS ord", "CASE WHEN id % 5 < 3 THEN 'same' ELSE concat('l', id) END AS value"
    )
    train, held_out = split.split_lines(df, "ord", 0.1)
    assert (train.count(), held_out.count()) == (18_000, 2_000)
    assert abs(held_out.filter("value = 'same'").count() - 1200) < 100


@pytest.mark.parametrize("n", [1, 2, 40, 500])
def test_split_in_order(spark, n):
    rng = random.Random(n)
    values = [rng.randint(-(2**63), 2**63 - 2) for _ in range(n - 1)] + [2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "o bigint")
    train, held_out = split.split_in_order(df, "o", 0.25)
    ordered = sorted(values)
    n_train, _ = split.split_sizes(n, 0.25)
    assert sorted(r["o"] for r in train.collect()) == ordered[:n_train]
    assert sorted(r["o"] for r in held_out.collect()) == ordered[n_train:]


def test_order_must_be_unique(spark):
    df = spark.createDataFrame([(1,)] * 10, "o bigint")
    with pytest.raises(ValueError):
        split.split_in_order(df, "o", 0.5)


def test_empty_input(spark):
    empty = spark.createDataFrame([(0, "  ")], "ord bigint, value string")
    with pytest.raises(ValueError):
        split.split_lines(empty, "ord")


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f'{{"line": {i}}}') for i in range(100)], "ord bigint, value string")
    assert split_dataset(df, str(tmp_path), 0.2) == (80, 20)
    assert spark.read.text(str(tmp_path / "train.jsonl")).count() == 80
    assert spark.read.text(str(tmp_path / "eval.jsonl")).count() == 20


def test_unshuffled_files_keep_their_order(spark, tmp_path):
    lines = [f'{{"line": {i}}}' for i in range(3000)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)  # several blocks per file
    try:
        numbered = lines_in_order(spark, str(tmp_path / "in.jsonl"))
        got = [r["value"] for r in numbered.orderBy("ord").collect() if r["value"]]
        assert got == lines
        assert split_dataset(numbered, str(tmp_path), 0.2, order="ord") == (2400, 600)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tail = {r["value"] for r in spark.read.text(str(tmp_path / "eval.jsonl")).collect()}
    assert tail == set(lines[2400:])


def test_split_by_path(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(f"line {i % 3}\n" for i in range(50)))
    assert split_file(spark, str(tmp_path / "in.jsonl"), str(tmp_path), eval_ratio=0.2) == (40, 10)
    with pytest.raises(FileNotFoundError):
        split_file(spark, str(tmp_path / "none.jsonl"), str(tmp_path))
