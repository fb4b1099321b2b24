"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of transformed statistics, shrunk towards the pooled
diagonal; statistics of very short texts are drawn towards the training mean first. A score is the
logistic of the difference of Gaussian log densities (Mahalanobis distances through cached Cholesky
factors) plus the log odds of the classes. The model is fitted on every labelled training document:
only sums and products of statistics leave the tasks.

Defined results: null and empty texts have the statistics of no words; documents without label are
scored only; labels that are null, not 0 or 1, or contradict each other for one id are left out;
if a class has fewer than two training documents, every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import by_value, fresh, stage

by_value(__name__)

# Share of the pooled diagonal in each class's covariance, and what is added to its diagonal.
SHRINKAGE = 0.05
RIDGE = 1e-3
# Log odds are divided by this before the logistic, so that scores keep their order in doubles.
SOFTNESS = 4.0
THRESHOLD = 0.3
# Statistics of a document with this many words count half, the training mean the other half.
STEADY_WORDS = 5.0
FOLDS = 5
_SLICE = 1_000_000
_SPACE = re.compile(r"\s")

STATISTICS = (
    "log_words", "word_length", "letters", "symbols", "capitals", "digits", "distinct", "top_word",
    "echo", "short_words", "odd_words", "title_words", "ends", "lines", "repeated_lines", "entropy",
)

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_BLANK = np.isin(_CODES, [9, 10, 11, 12, 13, 32])


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that end at white space, so a very long one is never split up at once."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + _SLICE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; shares by square root, counts by logarithm."""
    text = text or ""
    histogram = np.zeros(256, dtype=np.int64)
    words, lines = Counter(), Counter()
    count = length = echo = short = title = odd = 0
    for part in _slices(text):
        raw = np.frombuffer(part.encode("utf-8", "replace"), dtype=np.uint8)
        histogram += np.bincount(raw, minlength=256)
        found = part.split()
        words.update(found)
        lines.update(part.split("\n"))
        count += len(found)
        echo += sum(map(str.__eq__, found, found[1:]))
    for word, n in words.items():
        length += len(word) * n
        short += n * (len(word) <= 3)
        title += n * word[0].isupper()
        odd += n * (not word[:-1].isalnum() and len(word) > 1)
    total = max(1, int(histogram.sum()))
    dense = max(1, int(total - histogram[_BLANK].sum()))
    share = histogram[histogram > 0] / total
    n = max(1, count)
    n_lines = max(1, sum(lines.values()))
    letters, digits = histogram[_LETTER].sum(), histogram[_DIGIT].sum()
    ends = histogram[[33, 46, 63]].sum()
    shares = {
        "letters": letters / dense,
        "symbols": (dense - letters - digits) / dense,
        "capitals": histogram[_UPPER].sum() / dense,
        "digits": digits / dense,
        "top_word": max(words.values(), default=0) / n,
        "echo": echo / n,
        "short_words": short / n,
        "odd_words": odd / n,
        "title_words": title / n,
        "ends": min(1.0, ends / n),
        "repeated_lines": 1 - len(lines) / n_lines if lines else 0.0,
    }
    values = {k: float(np.sqrt(max(0.0, v))) for k, v in shares.items()}
    values |= {
        "log_words": float(np.log1p(count)),
        "word_length": float(np.log1p(length / n)),
        "distinct": float(np.log1p(len(words)) / np.log1p(n)),
        "lines": float(np.log1p(n / n_lines)),
        "entropy": float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
    }
    return [values[k] for k in STATISTICS]


def _measured(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return udf(text)


def steadied(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Statistics of few words drawn towards the training mean; the word count itself goes."""
    words = np.expm1(x[:, :1])
    return (centre + (x - centre) * (words / (words + STEADY_WORDS)))[:, 1:]


@dataclass(frozen=True)
class Model:
    """Training mean; per class (0, 1) mean, inverse Cholesky factor, half log determinant."""

    centre: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    half_logdet: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        x, density = steadied(x, self.centre), []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            density.append(-0.5 * (z * z).sum(axis=1) - self.half_logdet[k])
        logit = (density[1] - density[0] + self.log_odds) / SOFTNESS
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def model_from(centre: np.ndarray, moments: dict[int, np.ndarray]) -> Model:
    """Class models from [n, sums, products] of steadied statistics per class."""
    d = len(STATISTICS) - 1
    counts = np.array([moments[k][0] for k in (0, 1)])
    means = np.array([moments[k][1 : d + 1] / moments[k][0] for k in (0, 1)])
    covs = [moments[k][d + 1 :].reshape(d, d) / counts[k] - np.outer(means[k], means[k])
            for k in (0, 1)]
    pooled = np.diag(np.diag(counts[0] * covs[0] + counts[1] * covs[1]) / counts.sum())
    whiten, half = [], []
    for k in (0, 1):
        cov = (1 - SHRINKAGE) * covs[k] + SHRINKAGE * pooled + RIDGE * np.eye(d)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        whiten.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    odds = float(np.log(counts[1] / counts[0]))
    return Model(centre, means, np.array(whiten), np.array(half), odds)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Never used for fitting: checksum of the id's text divides by ``folds``; null counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _moments(
    batches: Iterator[pa.RecordBatch], centre: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Per class of this task: count, sums, products, as (label, place, value) rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
        x = x if centre is None else steadied(x, centre)
        for k in (0, 1):
            mine = x[label == k]
            if len(mine):
                part = np.concatenate(([len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()))
                sums[k] = sums.get(k, 0) + part
    names = ["label", "place", "value"]
    for k, s in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(s), k, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)),
             pa.array(s)], names=names,
        )


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Model from (doc_id, x) rows and labels; sums are reduced on the cluster."""
    votes = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )
    train = measured.filter(~held_out(F.col("doc_id"))).join(votes, "doc_id")
    train = train.select(F.col("label").cast("int"), "x")

    def total(centre: np.ndarray | None) -> dict[int, np.ndarray]:
        parts = train.mapInArrow(lambda b: _moments(b, centre), "label int, place int, value double")
        moments: dict[int, np.ndarray] = {}
        d = len(STATISTICS) - (centre is not None)
        # Two classes of fixed size.
        for r in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
            moments.setdefault(r.label, np.zeros(1 + d + d * d))[r.place] = r.value
        return moments

    raw = total(None)
    if any(k not in raw or raw[k][0] < 2 for k in (0, 1)):
        return None
    sums = raw[0] + raw[1]
    centre = sums[1 : len(STATISTICS) + 1] / sums[0]
    return model_from(centre, total(centre))


def _scored(model: Model | None, column: Column) -> Column:
    @F.pandas_udf("double")
    def udf(values: pd.Series) -> pd.Series:
        if not len(values) or model is None:
            return pd.Series(np.full(len(values), 0.5))
        return pd.Series(model.scores(np.array(values.tolist())))

    return udf(column)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x), written once: the statistics are small beside the texts."""
    x = _measured(F.col(f"`{text}`"))
    return stage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), x.alias("x")), "statistics")


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    measured = measure(docs, doc_id, text)
    model = fit(measured, labels, label)
    return measured.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        _scored(model, F.col("x")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
              label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored at least ``threshold``; all columns stay. Texts are not shuffled.

    Documents are written once with their statistics; fitting then reads ids and statistics only.
    """
    x, score = fresh(docs, "_x"), fresh(docs, "_score")
    measured = stage(docs.withColumn(x, _measured(F.col(f"`{text}`"))), "measured", "zstd")
    narrow = measured.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(x).alias("x"))
    scored = measured.withColumn(score, _scored(fit(narrow, labels, label), F.col(x)))
    kept = scored.filter(F.col(score) >= threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
