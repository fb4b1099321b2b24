"""SimHash near-duplicates: fingerprints, a binary-trie self-join, connected components.

Fingerprints within ``BUDGET`` differing bits are linked. A link has no differing bit in at least
one of five blocks, and, going round the blocks from the right one, never more than its share of
the budget (pigeonring). So each fingerprint enters five tries, one per rotation that puts a block
first. A node pair of a trie is descended together, differing bits are added up, and a pair over
its budget is pruned. Nodes are rows of a table until they are small, then a task finishes them;
a task links the members of a node with a spanning forest, never with all pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like
any other; null doc_ids take part and are never a component's smallest id unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import by_value, fresh, row_hash, stage
from histloom.llm.components import components

by_value(__name__)

SHINGLE = 4
SEED = 42
BUDGET = 4
BLOCKS = (13, 13, 13, 13, 12)
# Members up to which a trie node is finished inside one task.
NODE_ROWS = 2048
# Rows taken by a task at a time, and node pairs it holds at a time.
BATCH_ROWS = 50_000
PAIRS = 1_000_000
_CHUNK = 65_536


def fingerprint_of(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; bytes.lower and bytes.split are exactly the ASCII rules."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    first, last = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), _CHUNK):
        spans = zip(first[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(first), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """Signed 64-bit column of fingerprints."""

    @F.pandas_udf("bigint")
    def udf(texts: pd.Series) -> pd.Series:
        found = np.fromiter(map(fingerprint_of, texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    return udf(text)


def _allowed(block: int) -> int:
    """Differing bits a pair may have once blocks 0 to ``block`` of its rotation are read."""
    return (block + 1) * BUDGET // len(BLOCKS)


def _rotations() -> list[tuple[int, list[int]]]:
    """(shift, block widths in reading order) of each rotation."""
    found, shift = [], 0
    for i in range(len(BLOCKS)):
        found.append((shift, [*BLOCKS[i:], *BLOCKS[:i]]))
        shift += BLOCKS[i]
    return found


def _roots(prints: DataFrame) -> DataFrame:
    """Node pairs (node, node) of every rotation's first block."""
    parts = []
    for turn, (shift, widths) in enumerate(_rotations()):
        key = f"shiftleft(fp, {shift}) | shiftrightunsigned(fp, {64 - shift})" if shift else "fp"
        parts.append(f"struct({turn} AS turn, {key} AS key, {widths[0]} AS bits)")
    rows = prints.select(F.explode(F.expr(f"array({', '.join(parts)})")).alias("r")).select("r.*")
    node = F.expr("shiftrightunsigned(key, 64 - bits)")
    return rows.select("turn", "key", "bits", node.alias("one"), node.alias("two"),
                       F.lit(0).alias("errors"))


def _descend(rows: DataFrame, block: int) -> DataFrame:
    """Both nodes of each pair go down by the next block; pairs over budget are never made."""
    limit = _allowed(block)
    widths = F.expr(
        "CASE turn " + " ".join(
            f"WHEN {turn} THEN {w[block]}" for turn, (_, w) in enumerate(_rotations())
        ) + " END"
    )

    def flips(width: int, most: int) -> str:
        masks = [sum(1 << b for b in c) for n in range(most + 1)
                 for c in combinations(range(width), n)]
        return f"array({', '.join(f'{m}L' for m in masks)})"

    choices = " ".join(
        f"WHEN width = {w} AND {limit} - errors = {left} THEN {flips(w, left)}"
        for w in sorted(set(BLOCKS)) for left in range(limit + 1)
    )
    return (
        rows.withColumn("width", widths)
        # The node on the other side of this row's own.
        .withColumn(
            "other", F.expr("CASE WHEN shiftrightunsigned(key, 64 - bits) = one THEN two ELSE one END")
        )
        .withColumn("bits", F.expr("bits + width"))
        .withColumn("mine", F.expr("shiftrightunsigned(key, 64 - bits)"))
        .withColumn("flip", F.explode(F.expr(f"CASE {choices} END")))
        .withColumn(
            "other",
            F.expr("shiftleft(other, width) | ((mine & (shiftleft(1L, width) - 1)) ^ flip)"),
        )
        .select(
            "turn", "key", "bits",
            F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
            (F.col("errors") + F.bit_count("flip")).alias("errors"),
        )
    )


def _limits() -> np.ndarray:
    """Allowed errors after each bit, most significant first, for every rotation at once.

    All blocks count as narrow, so a block's allowance may begin a few bits early, never late.
    """
    block = np.minimum(np.arange(64) // min(BLOCKS), len(BLOCKS) - 1)
    return np.array([_allowed(i) for i in range(len(BLOCKS))])[block]


def trie_links(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group within the budget, found by joint trie descent.

    ``group`` and ``key`` (uint64) are sorted by (group, key). A trie node is a range of rows.
    """
    limits = _limits()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stops = np.r_[starts[1:], len(group)]
    left, right = [], []
    work = [(0, np.stack([starts, stops, starts, stops, np.zeros_like(starts)]))]
    while work:
        depth, pairs = work.pop()
        if pairs.shape[1] > PAIRS:
            middle = pairs.shape[1] // 2
            work += [(depth, pairs[:, :middle]), (depth, pairs[:, middle:])]
            continue
        one, one_end, two, two_end, errors = pairs
        same = one == two
        single = (one_end - one == 1) & (two_end - two == 1)
        leaf = single & ~same
        if leaf.any():
            a, b = one[leaf], two[leaf]
            near = np.bitwise_count(key[a] ^ key[b]) <= BUDGET
            left.append(a[near])
            right.append(b[near])
        going = ~single
        if depth == 64 or not going.any():
            continue
        one, one_end, two, two_end, errors, same = (
            x[going] for x in (one, one_end, two, two_end, errors, same)
        )
        ones = np.r_[0, np.cumsum((key >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        one_cut = one_end - (ones[one_end] - ones[one])
        two_cut = two_end - (ones[two_end] - ones[two])
        down = [
            np.stack([one, one_cut, two, two_cut, errors]),
            np.stack([one_cut, one_end, two_cut, two_end, errors]),
            np.stack([one, one_cut, two_cut, two_end, errors + 1]),
            np.stack([one_cut, one_end, two, two_cut, errors + 1])[:, ~same],
        ]
        pairs = np.concatenate(down, axis=1)
        alive = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= limits[depth])
        # A single row has no partner in itself.
        alive &= ~((pairs[0] == pairs[2]) & (pairs[1] - pairs[0] == 1))
        work.append((depth + 1, pairs[:, alive]))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    low = np.arange(n)
    while len(left):
        a, b = low[left], low[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (jumped := low[low]).tolist() != low.tolist():
            low = jumped
    return low


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (fingerprint, smallest of its part of the node) from rows sorted by node pair."""
    shifts = np.array([shift for shift, _ in _rotations()], dtype=np.uint64)

    def solve(node: np.ndarray, turn: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((key, node))
        node, turn, key = node[order], turn[order], key[order]
        low = _forest(len(node), *trie_links(node, key))
        by = shifts[turn]
        back = np.where(by > 0, (key >> by) | (key << (np.uint64(64) - by) % np.uint64(64)), key)
        signed = back.view(np.int64)
        moved = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays(
            [pa.array(signed[moved]), pa.array(signed[low[moved]])], names=["a", "b"]
        )

    held: list[np.ndarray] = []
    count = 0
    names = ("turn", "one", "two", "key")
    for batch in batches:
        held.append(np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names]))
        count += batch.num_rows
        if count < BATCH_ROWS:
            continue
        rows = np.concatenate(held, axis=1)
        changes = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if cut:
            yield _solved(rows[:, :cut], solve)
        held, count = [rows[:, cut:]], rows.shape[1] - cut
    if count:
        yield _solved(np.concatenate(held, axis=1), solve)


def _solved(rows: np.ndarray, solve) -> pa.RecordBatch:  # noqa: ANN001
    changed = np.r_[False, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)] if rows.shape[1] else []
    return solve(np.cumsum(changed), rows[0], rows[3].view(np.uint64))


def linked(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``fp`` within the budget."""
    node = ["turn", "one", "two"]
    rows, found = _roots(prints), []
    for block in range(1, len(BLOCKS) + 1):
        large = rows.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NODE_ROWS)
        large = stage(large.select(*node), "large-nodes")
        some = block < len(BLOCKS) and not large.isEmpty()
        small = rows.join(large, node, "left_anti") if some else rows
        small = small.select("turn", "one", "two", "key").repartition(*node)
        found.append(
            small.sortWithinPartitions(*node).mapInArrow(_finish, "a bigint, b bigint")
        )
        if not some:
            break
        rows = stage(_descend(rows.join(large, node, "left_semi"), block), "node-pairs")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def with_components(docs: DataFrame, fp: str) -> DataFrame:
    """(fp, root) for every distinct fingerprint of the staged frame ``docs``."""
    prints = docs.select(F.col(fp).alias("fp")).distinct()
    prints = stage(prints, "fingerprints")
    roots = components(linked(prints))
    return (
        prints.join(roots.withColumnRenamed("a", "fp"), "fp", "left")
        .select("fp", F.coalesce("b", "fp").alias("root"))
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed) and component_id, the smallest id reachable."""
    prints = docs.select(
        F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")
    )
    prints = stage(prints, "document-prints")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = with_components(prints, "fp")
    lows = roots.join(per_print, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(roots.join(lows, "root").select("fp", "component_id"), "named-prints")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the smallest id (then row hash); columns stay.

    Rows equal in id and in all hashable columns are one document and stay once.
    """
    columns = docs.columns
    keys = [fresh(docs, "_row"), fresh(docs, "_row2")]
    # Two chains of hashes: 128 bits tell rows apart at any number of documents.
    marked = docs.withColumns({keys[0]: row_hash(docs), keys[1]: row_hash(docs, F.lit(SEED))})
    narrow = stage(
        marked.select(
            F.col(f"`{doc_id}`").alias("doc_id"), *keys,
            fingerprint(F.col(f"`{text}`")).alias("fp"),
        ),
        "document-prints",
    )
    roots = with_components(narrow, "fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)).alias("k")
    first = narrow.groupBy("fp").agg(best)
    kept = first.join(roots, "fp").groupBy("root").agg(F.min("k").alias("k"))
    kept = stage(kept.select(*[f"k.{k}" for k in keys]), "kept")
    return (
        marked.join(kept, keys, "left_semi")
        .dropDuplicates(keys)
        .select(*[F.col(f"`{c}`") for c in columns])
    )
