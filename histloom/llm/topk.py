"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are quantised to integers. In every block of candidates each dimension is a list sorted by
component; for a positive query weight it is read from its high end, for a negative one from its low
end. Lists are read in step, a fraction further per round. What has been read of a candidate gives
its partial score; every unread list bounds the rest by its last value read from above and by its
far end from below. A candidate whose upper bound falls below the k-th lower bound is out, reading
stops when no outsider can qualify, and the exact scores of those left are resolved.

Queries and candidates meet block by block: both sides are packed into bounded blocks, a query block
travels to every candidate block, and only k rows per query and block come back. Query blocks first
meet one candidate block; the k-th scores found there are the bars with which they start in every
other one, so blocks whose list ends lie below all bars are not read at all.

How much this prunes is up to the vectors. Where most pairs of a block stay open, as with independent
random components, their scores are resolved by one product of the matrices. Products that could
exceed 2^53 are resolved in 64-bit integers without bounds, beyond 2^63 in Python's integers.

Defined results: vectors that are null or hold a null or non-finite component take no part; a query
is never its own candidate (same id); equal scores rank by smaller id; with fewer candidates than k
all are returned; vectors of another length than the query's are not compared with it; a row without id
takes no part; an id asked with several vectors is answered for the smallest of them, a candidate row
given twice counts twice; scores beyond 64 bits are ranked exactly and returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import arrow_rows, by_value, stage
from histloom.operators.skew import first_n_per_group

by_value(__name__)

SCALE = 256
K = 5
# Rows of a block; a pair of blocks needs a few arrays of their product.
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
# Pairs of blocks that Python is handed at a time.
PAIR_ROWS = 4
# Share of each sorted list that has been read after each round.
READ = (1 / 16, 1 / 4, 1 / 2)
# Products up to here are exact in 32-bit and 64-bit floats, and in 64-bit integers.
_EXACT32 = 2**24
_EXACT64 = 2**53
_LONG = 2**63
# Open pairs, as a share of all, from which on whole products are cheaper than single scores.
_DENSE = 1 / 16


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for vectors that take no part."""
    # NaN compares greater than any number, so one test finds it and the infinities.
    usable = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.when(usable, whole.cast("array<bigint>"))


def _packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(block, width, n, ids, data): blocks of at most about ``rows`` vectors of one width."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def out(width: int) -> pa.RecordBatch:
            some = held.pop(width)
            ids = np.array([r[0] for r in some], dtype=np.int64).tobytes()
            data = np.array([r[1] for r in some], dtype=np.int64).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([len(some)], pa.int32()),
                 pa.array([ids], pa.binary()), pa.array([data], pa.binary())],
                names=["width", "n", "ids", "data"],
            )

        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((key, v))
                if len(mine) == rows:
                    yield out(len(v))
        for width in list(held):
            yield out(width)

    blocks = vectors.mapInArrow(pack, "width int, n int, ids binary, data binary")
    return stage(blocks.withColumn("block", F.monotonically_increasing_id()), name)


def _bound(q: np.ndarray, c: np.ndarray) -> int:
    """No sum of products is larger."""
    largest = [max(1, abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (q, c)]
    return largest[0] * largest[1] * max(1, q.shape[1])


def _open_pairs(
    q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray, kind: type
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (rows of ``c``) still alive, and which pairs with them are open."""
    n = len(c)
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    values = c.astype(kind)
    lists = np.sort(values, axis=0)  # ascending; read from the far end for positive weights
    # Every list unread: bounds from the ends alone.
    far_low = up @ lists[0] + down @ lists[-1]
    far_high = up @ lists[-1] + down @ lists[0]
    alive, open_ = np.arange(n), ~own
    if (far_high < bars).all():
        return alive[:0], open_[:, :0]
    for share in READ:
        depth = max(1, int(n * share))
        high_at, low_at = lists[n - depth], lists[depth - 1]
        here = values[alive]
        seen_high, seen_low = here >= high_at, here <= low_at
        # Sum over lists read: partial scores; over lists unread: the bounds on the rest.
        partial = up @ (here * seen_high).T + down @ (here * seen_low).T
        lower = partial + (far_low[:, None] - up @ (seen_high * lists[0]).T
                           - down @ (seen_low * lists[-1]).T)
        upper = partial + up @ (~seen_high * high_at).T + down @ (~seen_low * low_at).T
        mine = own[:, alive]
        lower[mine] = -np.inf
        bar = bars
        if len(alive) > k:
            bar = np.maximum(bar, np.partition(lower, len(alive) - k, axis=1)[:, len(alive) - k])
        # An upper bound equal to the bar may still win by its id.
        open_ = (upper >= bar[:, None]) & ~mine
        keep = open_.any(axis=0)
        alive, open_ = alive[keep], open_[:, keep]
        if open_.sum() <= 4 * k * len(q) or not keep.any():
            break
    return alive, open_


def _resolved(
    q: np.ndarray, c: np.ndarray, alive: np.ndarray, open_: np.ndarray, k: int, bound: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, exact score) of the open pairs that may be among the best."""
    if bound < _EXACT64 and open_.sum() > _DENSE * open_.size:
        kind = np.float32 if bound < _EXACT32 else np.float64
        scores = q.astype(kind) @ c[alive].astype(kind).T
        scores[~open_] = -np.inf
        if len(alive) > k:
            least = np.partition(scores, len(alive) - k, axis=1)[:, len(alive) - k]
            open_ = open_ & (scores >= least[:, None])
        rows, columns = np.nonzero(open_)
        return rows, alive[columns], scores[rows, columns].astype(np.int64)
    rows, columns = np.nonzero(open_)
    columns = alive[columns]
    if bound >= _LONG:
        q, c = q.astype(object), c.astype(object)
    scores = np.empty(len(rows), dtype=q.dtype)
    for at in range(0, len(rows), 1 << 18):
        part = slice(at, at + (1 << 18))
        scores[part] = (q[rows[part]] * c[columns[part]]).sum(axis=1)
    return rows, columns, scores


def best_of_block(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
    bars: np.ndarray | None = None, resolved: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's best ``k`` in one candidate block.

    ``bars`` are scores that k others reach; ``resolved`` gets the number of pairs left open.
    """
    bound = _bound(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    alive, open_ = np.arange(len(c)), ~own
    if 4 * bound < _EXACT64:
        kind = np.float32 if 4 * bound < _EXACT32 else np.float64
        start = np.full(len(q), -np.inf) if bars is None else bars
        alive, open_ = _open_pairs(q, c, own, k, start.astype(kind), kind)
    if resolved is not None:
        resolved.append(int(open_.sum()))
    rows, columns, scores = _resolved(q, c, alive, open_, k, bound)
    if scores.dtype == object:
        by_score = sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], c_ids[columns[i]]))
        order = np.array(by_score, dtype=np.int64)
    else:
        order = np.lexsort((c_ids[columns], -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], columns[best], scores[best]


def _search(k: int):  # noqa: ANN202
    """Rows (width, q_ids, q_data, ids, data, bars): the best of every pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                q_ids, c_ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
                q, c = (
                    np.frombuffer(row[x], np.int64).reshape(-1, width) for x in ("q_data", "data")
                )
                bars = {x["query_id"]: x["bar"] for x in row["bars"] or []}
                start = np.array([bars.get(i, -np.inf) for i in q_ids.tolist()], dtype=np.float64)
                rows, columns, scores = best_of_block(q_ids, q, c_ids, c, k, start)
                longs = [max(-_LONG, min(_LONG - 1, int(x))) for x in scores]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), row["q_block"])), pa.array(q_ids[rows]),
                     pa.array(c_ids[columns]), pa.array(longs, pa.int64())],
                    names=["q_block", "query_id", "vec_id", "score"],
                )

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score from frames of (id bigint, v array<bigint>) without nulls."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // query_block))
    asked = _packed(queries.repartition(blocks), query_block, "queries").select(
        "width", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"),
    )
    offered = _packed(candidates, candidate_block, "candidates")
    first = offered.groupBy("width").agg(F.min("block").alias("first"))
    pairs = asked.select("width", "q_block").join(offered.select("width", "block"), "width").join(first, "width")
    shape = "q_block bigint, query_id bigint, vec_id bigint, score bigint"

    def meet(some: DataFrame, bars: DataFrame | None, name: str) -> DataFrame:
        """The stated queries meet all rows, block with block, dealt out evenly over tasks."""
        met = some.join(asked, ["width", "q_block"]).join(offered, ["width", "block"])
        if bars is None:
            met = met.withColumn("bars", F.lit(None).cast("array<struct<query_id:bigint,bar:bigint>>"))
        else:
            met = met.join(bars, "q_block", "left")
        columns = met.select("width", "q_block", "q_ids", "q_data", "ids", "data", "bars")
        with arrow_rows(queries.sparkSession, PAIR_ROWS):
            return stage(columns.mapInArrow(_search(k), shape), name)

    sighted = meet(pairs.filter("block = first"), None, "first-hits")
    # One row per query that has k hits, at most query_block of them per block of queries.
    full = sighted.groupBy("q_block", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")
    )
    entry = F.struct("query_id", "bar")
    bars = full.filter(F.col("n") == k).groupBy("q_block").agg(F.collect_list(entry).alias("bars"))
    found = sighted.union(meet(pairs.filter("block <> first"), stage(bars, "bars"), "block-hits"))
    # Only k rows per query and candidate block are left; they are ranked in two levels.
    order = [F.col("score").desc(), F.col("vec_id")]
    best = first_n_per_group(found.drop("q_block"), ["query_id"], order, k, ["vec_id"])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
