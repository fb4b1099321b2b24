import random
import re

import duckdb
import pytest

from histloom.llm import decontaminate as d
from histloom.llm import oracle, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(doc, items, window):
    w, hit, found = words(doc), set(), set()
    for key, text in items:
        v = words(text)
        n = min(window, len(v))
        for i in range(len(v) - n + 1) if v else []:
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


def drawn(rng, n):
    return " ".join(rng.choices(["a", "B", "c", "É", "d1", "e,"], k=n))


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(3)
    items = [(i, drawn(rng, rng.choice([2, 3, 5, 7]))) for i in range(12)]
    items += [(50, ""), (51, None), (None, "é b c d1 e"), (3, "repeated ID a a a a")]
    docs = [(i, drawn(rng, rng.choice([0, 1, 4, 30, 200])), "x") for i in range(40)]
    docs += [(None, items[0][1] + " tail", "n"), (7, None, "n"), (7, None, "n"), (8, "--", None),
             (9, items[4][1], "t"), (9, items[4][1], "t"), (10, "long " * 30_000, "l")]
    return (
        docs, items,
        spark.createDataFrame(docs, "doc_id bigint, text string, ITEMS string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


@pytest.mark.parametrize("limit", [100_000, 0])
def test_equals_brute_force(cases, limit):
    docs, items, df, bench = cases
    items = [("null" if k is None else k, t) for k, t in items]
    got = d.contamination(df, bench, window=5, set_limit=limit).collect()
    shown = sorted(
        str((r.doc_id, r.n_words, r.n_hit, [x for x in r["items"] if x != "null"])) for r in got
    )
    want = []
    for key, text, _ in docs:
        n, hit, found = brute(text, items, 5)
        want.append(str((key, n, hit, [x for x in found if x != "null"])))
    assert shown == sorted(want)


def test_items_without_id_count_as_sql_says(spark, tmp_path):
    docs = [(1, "a b c d"), (2, "x y"), (3, "a b c and x y"), (None, "none")]
    items = [(None, "a b c"), (None, "b c d"), (7, "x y"), (8, "a b c")]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id bigint, text string"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
    }
    duck = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.QUERIES["op9_decontaminate"](spark, str(tmp_path))
    relation = duck.sql(oracle.ORACLE["op9_decontaminate"])
    want = relation.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r.doc_id: r.n_items for r in got.collect()} == {1: 2, 2: 1, 3: 3, None: 0}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_passages_are_cut_out(spark, limit):
    item = "One two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Before it, ONE two three four five six seven eight nine ten. And after it! "
             "more words that stay here as they are", 0),
         (2, item, 0), (3, "Clean, text.\nStays  as is", 0), (4, None, 1), (5, "", 1)],
        "doc_id bigint, text string, _hits int",
    )
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in d.decontaminate(docs, bench, set_limit=limit).collect()}
    assert got == {
        1: "Before it. And after it! more words that stay here as they are",
        3: "Clean, text.\nStays  as is", 4: None, 5: "",
    }
    assert d.decontaminate(docs, bench).columns == docs.columns


def test_empty_tables(cases):
    _, _, df, bench = cases
    assert d.contamination(df.filter("false"), bench).count() == 0
    none = d.contamination(df, bench.filter("false"))
    assert none.filter("n_hit > 0 OR size(items) > 0").count() == 0 and none.count() == 47
    assert d.decontaminate(df, bench.filter("false")).count() == 47
