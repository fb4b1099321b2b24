import os
import re

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from histloom.llm import oracle, privacy
from histloom.llm.common import stage
from histloom.llm.queries import QUERIES
from histloom.llm.simhash import fingerprint_of
from tests.llm.test_decontaminate import words
from tests.llm.test_privacy import slow_spans
from tests.llm.test_quality import plain_scores

FOLDER = "/root/testdata/sf0.001"
CASED_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(FOLDER):
        duck.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    relation = duck.sql(oracle.ORACLE[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(relation.columns)
    want = relation.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def windows(items, n=10):
    """(length, words) of all windows of the benchmark items."""
    out = set()
    for _, text in items:
        w = words(text)
        size = min(n, len(w))
        out |= {(size, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if w}
    return out


def without_benchmark(text, known):
    """The text without benchmark words; None if more than half of its words are."""
    w, hit = words(text), set()
    for size in {n for n, _ in known}:
        for i in range(len(w) - size + 1):
            if (size, tuple(w[i : i + size])) in known:
                hit |= set(range(i, i + size))
    if not hit or 2 * len(hit) > len(w):
        return None if hit else text
    out, end = [], 0
    for n, found in enumerate(CASED_WORD.finditer(text)):
        if n not in hit:
            out.append(text[end : found.end()])
        end = found.end()
    return "".join([*out, text[end:]]).strip(" ")


def plainly_masked(text):
    out, end = "", 0
    for start, kind, stop in slow_spans(text):
        if start >= end:
            out += text[end:start] + ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][kind]
        end = max(end, stop)
    return out + text[end:]


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, apply in corpus_pipeline.STAGES:
        frames.append(stage(apply(spark, frames[-1], FOLDER), "pipeline-test"))
        if name != "packing":
            assert frames[-1].columns == columns
    raw, good, single, clean, masked, packed = [f.collect() for f in frames]
    assert len(raw) > len(good) > len(single) >= len(clean) == len(masked)
    # The quality classifier keeps what plain numpy scores at 0.3 or more.
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").collect()
    scores = plain_scores([(r.doc_id, r.text) for r in raw], [tuple(m) for m in marks])
    assert sorted(good) == sorted(r for r, score in zip(raw, scores, strict=True) if score >= 0.3)
    # Benchmark words are cut out, texts that are mostly benchmark go, others stay as they are.
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    want = [(r.doc_id, without_benchmark(r.text, windows(bench))) for r in single]
    assert sorted((r.doc_id, r.text) for r in clean) == sorted(w for w in want if w[1] is not None)
    # Personal data is masked; no term of the given documents discloses any.
    assert privacy.disclosing_terms(frames[3]).count() == 0
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: plainly_masked(r.text) for r in clean}
    # One of each group of near-duplicates, and every group of the good documents has one.
    prints = {r.doc_id: fingerprint_of(r.text) for r in good}
    kept = {r.doc_id for r in single}
    group = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                low = min(group[a], group[b])
                old = {group[a], group[b]}
                group = {k: low if g in old else g for k, g in group.items()}
    assert kept == {min(k for k, g in group.items() if g == root) for root in group.values()}
    # All ids of all documents are packed once.
    per_doc = {}
    for r in packed:
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    n_ids = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in masked}
    assert {i: pieces[0][2] for i, pieces in per_doc.items()} == n_ids
    for pieces in per_doc.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]


def test_run_of_awkward_documents(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "same " * 30, "en", "s", 1),
            (2, "same " * 30, "en", "s", 1), (3, "x" * 300_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, kind)
    for frame in (docs, docs.filter("false")):
        for _, apply in corpus_pipeline.STAGES:
            out = apply(spark, frame, FOLDER)
            assert out.count() <= len(rows) * 200
