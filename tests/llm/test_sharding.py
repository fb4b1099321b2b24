import zlib
from collections import Counter

from pyspark.sql import functions as F

from histloom.llm import common, sharding
from histloom.llm.common import stage


def rows_of(n):
    out = [(i, f"text {i % 37}", "hot" if i % 3 == 0 else f"s{i % 11}", i) for i in range(n)]
    return [*out, (None, None, None, 0), (None, None, None, 0), (5, "", None, 1)]


def test_every_shard_matches_the_mixture(spark):
    rows = rows_of(2400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, SHARD int")
    got = sharding.shard_rows(docs).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for source, n in Counter(r[2] for r in rows).items():
        per = Counter(r.shard for r in got if r.source == source)
        assert all(abs(per[s] - n / 24) <= 2 for s in range(24))
    want = Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_same_order_by_brute_force(spark):
    docs = spark.createDataFrame(rows_of(300), "doc_id bigint, text string, source string, n int")
    placed = sharding.interleaved(docs, "source").collect()
    order = sorted(placed, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(order)))
    seen, sizes = Counter(), Counter(r.source for r in order)
    fractions = []
    for r in order:
        fractions.append((seen[r.source] + 0.5) / sizes[r.source])
        seen[r.source] += 1
    assert fractions == sorted(fractions)


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame(rows_of(2), "doc_id bigint, text string, source string, n int")
    got = sharding.shard_rows(docs).collect()
    assert len(got) == 5 and all(r.slot == 0 for r in got) and len({r.shard for r in got}) == 5
    assert sharding.shard_rows(docs.filter("false")).count() == 0


def test_shard_files_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(100), "doc_id bigint, text string, source string, n int")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "source", "n").collect())) == sorted(
        map(str, docs.collect())
    )


def test_sources_of_one_row_share_no_task(spark, monkeypatch):
    rows = [(i, f"text {i}", f"host {i}", i) for i in range(4000)] + rows_of(400)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _tie int")
    staged = {}

    def kept(df, name, *more):
        staged[name] = stage(df, name, *more)
        return staged[name]

    monkeypatch.setattr(common, "stage", kept)
    conf = "spark.sql.adaptive.enabled"
    before = spark.conf.get(conf)
    # With so few rows it would put all partitions together.
    spark.conf.set(conf, "false")
    try:
        got = sharding.interleaved(docs, "source")
        assert got.columns == [*docs.columns, "position"]
        assert sorted(r.position for r in got.collect()) == list(range(len(rows)))
    finally:
        spark.conf.set(conf, before)
    # All hosts have the same fractional rank; the parts of the sort by it are near even all the same.
    for name in ("ranked", "interleaved"):
        part = F.shiftright("_at", 33)
        parts = [r["count"] for r in staged[name].groupBy(part).count().collect()]
        assert len(parts) == 4 and max(parts) < 0.4 * len(rows)
