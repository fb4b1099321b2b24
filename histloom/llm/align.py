"""Alignment of two tokenizers' tokens over the bytes of every document.

A text is encoded by both. In each batch the documents' bytes follow one another on one axis and the
tokens of both sides stand in one frame by first byte; ``pandas.merge_asof`` finds for each token's
start the other side's token that covers it, and the union of both directions is every pair of
overlapping tokens. Bytes where tokens of both sides end cut the tokens into groups.

How many documents hold a pair of ids linked is a partially aggregated count over the documents'
distinct pairs; it comes back to the documents by joins. The at most 4096 pairs that hold more than
1/4096 of all entries each are few by arithmetic and are broadcast; every other pair then has too
few entries to burden a task, and those are joined by exchange.

Defined results: null and empty texts, and texts whose tokens' bytes on either side are not a space
and the text, have no tokens: counts of zero, no groups, no pairs. Rows are counted as documents of
their own, also with equal ids, null ids or equal texts. Other columns take no part.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histloom.llm.common import by_value, stage
from histloom.llm.pieces import LETTERS, SIGNS, SPACE, WHITE, Pieces, Remembered, parts, per_worker, pieces

by_value(__name__)

SHAPE = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups string, pairs array<bigint>, times array<int>"
)
# Pairs treated apart: those with more than this share of all entries.
HOT_SHARE = 4096
# Characters of texts aligned in one frame; a longer text stands alone.
_FRAME = 1 << 19
# Words of a lot a worker remembers, and the longest of them.
_REMEMBERED = 250_000
_LONGEST = 64
_WORD = f"[{WHITE}]*[{LETTERS}]++(?=[{WHITE}0-9{re.escape(SIGNS)}]|$)"
# A word of letters with at most the one space before it that belongs to it.
_PLAIN = re.compile(f" ?[{LETTERS}]+")
_CHUNKS = re.compile(f"{_WORD}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def _byte_letters() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level tokenizer file; special tokens' strings are ordinary text.

    Words of a text are cut at white space after a word and between a letter and a sign or digit,
    where the tokenizer always cuts; their ids are looked up, and the tokenizer encodes those not
    seen before.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        names = self._tokenizer.get_vocab(with_added_tokens=False)
        self._bytes = [b""] * (self._tokenizer.get_vocab_size() + 1)
        for name, i in names.items():
            self._bytes[i] = bytes(letters[c] for c in name)
        self._seen = Remembered(_REMEMBERED)
        # The tokenizer cuts nothing out of a word of letters: only the model's merges are left to do.
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        own = self._tokenizer.normalizer is None and not any(re.fullmatch(f"[ {LETTERS}]+", t) for t in added)
        self._plain = _PLAIN if own else None
        self._stands = {b: c for c, b in letters.items()}

    def token_bytes(self) -> list[bytes]:
        return self._bytes

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        if self._plain is None:
            found = self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
            return [e.ids for e in found]
        merge, stands, plain = self._tokenizer.model.tokenize, self._stands, self._plain.fullmatch
        others = [c for c in chunks if not plain(c)]
        found = self._tokenizer.encode_batch_fast(others, add_special_tokens=False)
        known = {c: e.ids for c, e in zip(others, found, strict=True)}
        return [
            known[c] if c in known
            else [t.id for t in merge(c.encode().decode("latin-1").translate(stands))]
            for c in chunks
        ]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new chunks, as bytes; those of usual length are remembered."""
        long_: dict[str, bytes] = {}
        get, seen = self._bytes.__getitem__, self._seen.young
        for chunk, ids in zip(new, self._encoded(new), strict=True):
            if b"".join(map(get, ids)) != chunk.encode():
                raise ValueError(f"not a lossless byte-level tokenizer: {chunk!r}")
            (seen if len(chunk) <= _LONGEST else long_)[chunk] = pack(f"<{len(ids)}i", *ids)
        return long_

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        found = []
        for text in texts:
            ids = []
            for part in parts(text):
                chunks = _CHUNKS.findall(part)
                new = self._seen.unknown(set(chunks))
                long_ = self._learn(list(new)) if new else {}
                seen = self._seen.young
                get = (lambda c: long_.get(c) or seen[c]) if long_ else seen.__getitem__  # noqa: B023
                ids.append(b"".join(map(get, chunks)))
            found.append(np.frombuffer(b"".join(ids), dtype="<i4"))
        return found


class _Side:
    """One tokenizer with its tokens' bytes, their lengths and their ids in decimal."""

    def __init__(self, tokens: ByteTokens | Pieces, end: str):
        self.tokens, self.bytes = tokens, tokens.token_bytes()
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.size = len(self.bytes)
        # Within a group, then at its end.
        ids = range(self.size)
        self.words = np.array([f"{i}," for i in ids] + [f"{i}{end}" for i in ids], dtype=object)

    def spans(self, ids: np.ndarray) -> int:
        return int(self.lengths[ids].sum())


def _byte_side(path: str) -> _Side:
    return per_worker(("align-a", path), lambda: _Side(ByteTokens(path), "|"))


def _piece_side(path: str) -> _Side:
    return per_worker(("align-b", path), lambda: _Side(pieces(path), ";"))


def _frame(ids: list[np.ndarray], lengths: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Tokens of several documents (doc, start, number, id) and their ends.

    Starts and ends count the bytes of all documents before, so frames are sorted as they are.
    """
    flat = np.concatenate(ids) if ids else np.empty(0, dtype="<i4")
    ends = np.cumsum(lengths[flat])
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    frame = pd.DataFrame(
        {"doc": doc, "start": ends - lengths[flat], "number": np.arange(len(flat)), "id": flat}
    )
    return frame, ends


def _covering(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Number of the right token that covers each left token's start.

    On the axis of all bytes each document begins at the same place on both sides, so the last
    token that starts no later is one of the same document; no key has to be looked up.
    """
    found = pd.merge_asof(left[["start"]], right[["start", "number"]], on="start")
    return found["number"].to_numpy(dtype=np.int64)


def _aligned(a: _Side, b: _Side, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> dict[str, list]:
    """Columns of the result for documents that both sides spell; one row each."""
    n = len(ids_a)
    left, ends_a = _frame(ids_a, a.lengths)
    right, ends_b = _frame(ids_b, b.lengths)
    to_right, to_left = _covering(left, right), _covering(right, left)
    # Every A token's start, and those B starts that are no A start.
    fresh = left["start"].to_numpy()[to_left] != right["start"].to_numpy()
    link_a = np.concatenate([np.arange(len(left)), to_left[fresh]])
    link_b = np.concatenate([to_right, np.flatnonzero(fresh)])
    doc_a, doc_b = left["doc"].to_numpy(), right["doc"].to_numpy()
    id_a, id_b = left["id"].to_numpy().astype(np.int64), right["id"].to_numpy().astype(np.int64)

    # Distinct pairs per document.
    code = (id_a[link_a] << 32) | id_b[link_b]
    of = doc_a[link_a]
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    new = np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1]))[: len(code)]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(code))).astype(np.int32)
    cuts = np.searchsorted(of[first], np.arange(n + 1))

    # Groups: a token ends one if the other side has a token that ends there too.
    last_a, last_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    per_a = np.bincount(group_a, minlength=1)
    per_b = np.bincount(group_b, minlength=1)
    words = np.empty(len(left) + len(right), dtype=object)
    before_b, after_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
    words[np.arange(len(left)) + before_b[group_a]] = a.words[id_a + a.size * last_a]
    words[np.arange(len(right)) + after_a[group_b]] = b.words[id_b + b.size * last_b]
    n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
    bounds = np.append(0, np.cumsum(n_a + n_b)).tolist()
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(doc_a[last_a], minlength=n),
        "n_links": np.bincount(of, minlength=n),
        "groups": ["".join(words[x:y].tolist())[:-1] for x, y in zip(bounds, bounds[1:], strict=False)],
        "pairs": np.split(code[first], cuts[1:-1]) if n else [],
        "times": np.split(times, cuts[1:-1]) if n else [],
    }


def _results(rows: list[tuple[int, int | None, str | None]], a: _Side, b: _Side) -> pa.RecordBatch:
    texts = [text or "" for _, _, text in rows]
    spelled = [n for n, text in enumerate(texts) if text]
    ids_a = dict(zip(spelled, a.tokens.encode([" " + texts[n] for n in spelled]), strict=True))
    ids_b = dict(zip(spelled, b.tokens.encode([texts[n] for n in spelled]), strict=True))
    # Side A checked every word it learnt byte by byte; side B writes a space for its own sign.
    held = [
        n for n in spelled
        if SPACE not in texts[n]
        and a.spans(ids_a[n]) == b.spans(ids_b[n]) == 1 + len(texts[n].encode())
    ]
    found = _aligned(a, b, [ids_a[n] for n in held], [ids_b[n] for n in held])
    place = {n: i for i, n in enumerate(held)}

    def column(name: str, empty: object, kind: pa.DataType) -> pa.Array:
        values = found[name]
        return pa.array([values[place[n]] if n in place else empty for n in range(len(rows))], kind)

    none = np.empty(0, dtype=np.int64)
    counts = [column(c, 0, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _, _ in rows], pa.int64()),
            pa.array([d for _, d, _ in rows], pa.int64()),
            *counts,
            column("groups", "", pa.string()),
            column("pairs", none, pa.list_(pa.int64())),
            column("times", none.astype(np.int32), pa.list_(pa.int32())),
        ],
        names=[c.split()[0] for c in SHAPE.split(", ")],
    )


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts, ``groups`` as text (``a1,a2|b1;a3|b2,b3``), distinct ``pairs`` of ids
    (``a << 32 | b``) and how many ``times`` each is linked. ``row`` tells rows apart once staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _byte_side(path_a), _piece_side(path_b)
        waiting, size = [], 0
        for batch in batches:
            columns = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for row in columns:
                waiting.append(row)
                size += len(row[2] or "")
                if size >= _FRAME:
                    yield _results(waiting, a, b)
                    waiting, size = [], 0
        if waiting:
            yield _results(waiting, a, b)

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
    )
    return narrow.mapInArrow(run, SHAPE)


def pair_counts(staged: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold the pair linked; is it its A id's most frequent?"""
    counts = (
        staged.select(F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    counts = stage(counts, "pair-counts")
    id_a = F.shiftright("pair", 32)
    most = counts.groupBy(id_a.alias("a")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("a", id_a).join(most, "a")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(staged: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of the rows that have links; ``staged`` rows of ``aligned``."""
    counted = stage(pair_counts(staged), "pairs")
    entries = staged.select("row", F.inline(F.arrays_zip("pairs", "times"))).select(
        "row", F.col("pairs").alias("pair"), "times"
    )
    total = counted.agg(F.sum("count")).first()[0] or 0
    # A pair's entries are its count: above this there are fewer than HOT_SHARE pairs.
    is_hot = F.col("count") * HOT_SHARE > total
    hot, rest = counted.filter(is_hot), counted.filter(~is_hot)
    near = entries.join(F.broadcast(hot), "pair", "left")
    known = F.col("count").isNotNull()
    here = near.filter(known).groupBy("row").agg(*_sums())
    cold = near.filter(~known).select("row", "pair", "times")
    there = cold.join(rest.hint("shuffle_merge"), "pair").groupBy("row").agg(*_sums())
    both = here.unionByName(there).groupBy("row")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _sums() -> list[Column]:
    times = F.col("times").cast("long")
    return [
        F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("n_best"),
        F.sum(times * F.col("count")).alias("count_sum"),
    ]


def with_link_sums(staged: DataFrame) -> DataFrame:
    """``staged`` without its pairs, with ``n_best`` and ``count_sum``."""
    sums = link_sums(staged)
    kept = staged.drop("pairs", "times").join(sums, "row", "left")
    return kept.na.fill(0, ["n_best", "count_sum"]).drop("row")
