import os
import zlib

import numpy as np
import pytest

from histloom.llm import quality

FOLDER = "/root/testdata/sf0.01"


def plain_scores(docs, labels):
    """Scores by position for (doc_id, text) rows: covariances and densities by plain numpy."""
    x = np.array([quality.statistics(t) for _, t in docs])
    known = dict(labels)
    fold = [zlib.crc32(str("" if i is None else i).encode()) % 5 for i, _ in docs]
    train = {k: [n for n, (i, _) in enumerate(docs) if fold[n] and known.get(i) == k] for k in (0, 1)}
    centre = x[train[0] + train[1]].mean(axis=0)
    words = np.array([len((t or "").split()) for _, t in docs])[:, None]
    x = np.delete(centre + (x - centre) * words / (words + 5), 0, axis=1)
    covs = {k: np.cov(x[train[k]].T, bias=True) for k in (0, 1)}
    n = {k: len(train[k]) for k in (0, 1)}
    pooled = np.diag(np.diag((n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])))
    density = {}
    for k in (0, 1):
        cov = 0.95 * covs[k] + 0.05 * pooled + 1e-3 * np.eye(x.shape[1])
        away = x - x[train[k]].mean(axis=0)
        far = np.einsum("ij,ij->i", away, np.linalg.solve(cov, away.T).T)
        density[k] = -(far + np.linalg.slogdet(cov)[1]) / 2
    logit = (density[1] - density[0] + np.log(n[1] / n[0])) / 4
    return 1 / (1 + np.exp(-logit))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_scores_equal_plain_numpy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality").collect()]
    want = {i: s for (i, _), s in zip(rows, plain_scores(rows, marks), strict=True)}
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert max(abs(got[i] - want[i]) for i in got) < 1e-9
    assert len({round(s, 6) for s in got.values()}) > 100


def test_statistics_by_hand():
    got = dict(zip(quality.STATISTICS, quality.statistics("The cat sat. The cat\nsat 42!"), strict=True))
    want = {
        "log_words": np.log(8), "word_length": np.log1p(22 / 7), "letters": np.sqrt(18 / 22),
        "symbols": np.sqrt(2 / 22), "capitals": np.sqrt(2 / 22), "digits": np.sqrt(2 / 22),
        "distinct": np.log(6) / np.log(8), "top_word": np.sqrt(2 / 7), "echo": 0,
        "short_words": np.sqrt(6 / 7), "odd_words": 0, "title_words": np.sqrt(2 / 7),
        "ends": np.sqrt(2 / 7), "lines": np.log1p(7 / 2), "repeated_lines": 0,
    }
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-12)
    assert quality.statistics(None) == quality.statistics("")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    mine = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in mine]) > 0.95
    assert np.mean([r.predicted for r in mine if r.quality == 1]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p}


def test_awkward_rows(spark):
    good = "The river ran past the old mill and on to the sea, as it had for many years."
    bad = "XX!! YY!! ZZ!! XX!! XX!! $$ %% XX!!"
    rows = [(i, f"{good} {i % 7} times." if i % 2 else f"{bad} {i}", "s") for i in range(120)]
    rows += [(None, good, None), (500, None, "n"), (501, "", "n"), (502, "a " * 600_000, "long"),
             (1, rows[1][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, SCORE string")
    marks = [(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (3, 0, 0), (5, None, 0), (9, 7, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 120:
            assert r.predicted == r.doc_id % 2
    one_class = labels.filter("quality = 1")
    assert {r.score for r in quality.quality_scores(docs, one_class).collect()} == {0.5}
    assert quality.quality_scores(docs.filter("false"), labels).count() == 0
    assert quality.keep_good(docs, labels.filter("false")).count() == len(rows)
