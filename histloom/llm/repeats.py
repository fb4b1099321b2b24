"""Removal of long repeated byte strings with a difference cover.

Wanted are all bytes covered by a ``LENGTH``-byte string that also starts elsewhere. Sorting every
suffix of the corpus moves many times its size, so suffixes are sampled by a perfect difference set:
positions whose offset modulo the period lies in the set. Any two positions are, after the same
shift below the period, both sampled. So equal strings of ``LENGTH`` bytes hold equal sampled
prefixes of ``LENGTH - period + 1`` bytes.

1. Sampled prefixes are named by 64-bit hashes, names are sorted, neighbours compared: which samples
   repeat. Samples of false alarms only cost time.
2. The remaining suffixes are merged in: every start that has a repeated sample within reach names
   its ``LENGTH``-byte prefix by 96 bits; names are sorted, neighbours compared again.
3. Starts with an equal neighbour cover their bytes.

Texts move once, into a table of batches bucketed by batch number; after that only names and bits
travel, and joins with the table need no exchange. A name reaches a sorting task once per batch at
most, so a passage in a third of all texts is no hot group. Equal texts are collapsed first.

Defined results: a null text is empty; matches never cross texts; equal texts of ``LENGTH`` bytes or
more go whole; offsets are bytes of the UTF-8 form; in the remaining text a character that was cut
in two leaves replacement characters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from histloom.llm.common import arrow_rows, by_value, fresh_folder, stage
from histloom.llm.pieces import per_worker

by_value(__name__)

LENGTH = 400
# Order of the difference set: period ORDER^2 + ORDER + 1, of which ORDER + 1 offsets are sampled.
ORDER = 13
BATCH_BYTES = 4_000_000
# Batches that Python is handed at a time.
BATCH_ROWS = 8
# Names sorted together by one task.
SORTED_NAMES = 1_000_000
_CHUNK = 1_000_000


def difference_set(order: int = ORDER) -> tuple[int, np.ndarray]:
    """Period and offsets of a perfect difference set, once per process."""
    return per_worker(("difference set", order), lambda: _difference_set(order))


def _difference_set(order: int) -> tuple[int, np.ndarray]:
    """From a plane over a prime field.

    Powers of a cubic's root that lie in a plane have exponents whose differences meet every
    residue. Cubics are tried until one works.
    """
    period = order * order + order + 1
    for c0, c1, c2 in product(range(1, order), range(order), range(order)):
        power, found = (1, 0, 0), []
        for i in range(period):
            if power[2] == 0:
                found.append(i)
            a, b, c = power
            power = (c * c0 % order, (a + c * c1) % order, (b + c * c2) % order)
        if len(found) == order + 1:
            if len({(i - j) % period for i in found for j in found}) == period:
                return period, np.array(found)
    raise ValueError("the order must be prime")


def _tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return per_worker(("powers", seed, size), lambda: _drawn(seed, size))


def _drawn(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of an odd base and of its inverse, modulo 2^64."""
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 2**64, 256, dtype=np.uint64)
    base = int(draw.integers(0, 2**62, dtype=np.uint64)) * 8 + 5

    def powers(b: int) -> np.ndarray:
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return values, powers(base), powers(pow(base, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def names(data: np.ndarray, starts: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """64-bit hash of the ``length`` bytes at each of the sorted ``starts``."""
    values, powers, inverse = _tables(seed, _CHUNK + length + 1)
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(data), _CHUNK):
        lo, hi = np.searchsorted(starts, (at, at + _CHUNK))
        if lo == hi:
            continue
        part = data[at : at + _CHUNK + length]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * powers[: len(part)], dtype=np.uint64, out=sums[1:])
        s = starts[lo:hi] - at
        out[lo:hi] = (sums[s + length] - sums[s]) * inverse[s]
    return _mixed(out)


class Batch:
    """Some texts laid end to end, and the steps that are the same each time it is read."""

    def __init__(self, row: dict, length: int):
        self.number = row["batch"]
        self.data = np.frombuffer(row["data"], dtype=np.uint8)
        self.ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.length = length
        self.period, self._offsets = difference_set()
        self._reach = length - self.period + 1  # bytes of a sampled prefix

    def _inside(self, starts: np.ndarray, length: int) -> np.ndarray:
        text = np.searchsorted(self.ends, starts, side="right")
        return starts[starts + length <= self.ends[text]]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        rounds = np.arange(0, len(self.data), self.period)
        starts = (rounds[:, None] + self._offsets).ravel()
        starts = self._inside(starts[starts < len(self.data)], self._reach)
        return starts, names(self.data, starts, self._reach)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts whose string holds a repeated sample: at most a period before it."""
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(change, np.maximum(repeated - self.period + 1, 0), 1)
        np.add.at(change, repeated + 1, -1)
        return self._inside(np.flatnonzero(np.cumsum(change[:-1]) > 0), self.length)

    def strings(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = self.candidates(repeated)
        check = (names(self.data, starts, self.length, 2) >> np.uint64(32)).astype("<u4")
        return starts, names(self.data, starts, self.length), check

    def covered(self, starts: np.ndarray) -> np.ndarray:
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        change[starts] += 1
        np.subtract.at(change, starts + self.length, 1)
        return np.cumsum(change[:-1]) > 0


def _distinct(key: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the first of each distinct name, whether it occurs again, each row's rank."""
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    if check is not None:
        check = check[order]
        new[1:] |= check[1:] != check[:-1]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    again = np.diff(np.r_[first, len(key)]) > 1
    return order[first], again, rank


def _dealt(batch: Batch, key: np.ndarray, check: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """Distinct names in order, one row per sorting task: (part, batch, key, check, again)."""
    first, again, _ = _distinct(key, check)
    key = key[first]
    part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    rows = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)][: len(cuts)], strict=True):
        extra = b"" if check is None else check[first[a:b]].tobytes()
        rows.append((int(part[a]), batch.number, key[a:b].tobytes(), extra,
                     np.packbits(again[a:b]).tobytes()))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "batch", "key", "check", "again"])


_DEALT = "part bigint, batch bigint, key binary, check binary, again binary"


def _compare(table: pa.Table) -> pa.Table:
    """Sort the names of one part; tell each batch which of its names have an equal neighbour."""
    rows = table.select(["part", "batch", "key", "check", "again"]).to_pylist()
    keys = [np.frombuffer(r["key"], "<u8") for r in rows]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    check = np.frombuffer(b"".join(r["check"] for r in rows), "<u4")
    _, again, rank = _distinct(key, check if len(check) else None)
    shared, at, out = again[rank], 0, []
    for r, n in zip(rows, sizes, strict=True):
        own = np.unpackbits(np.frombuffer(r["again"], np.uint8), count=n).astype(bool)
        out.append(np.packbits(shared[at : at + n] | own).tobytes())
        at += n
    return pa.table(
        {"batch": pa.array([r["batch"] for r in rows], pa.int64()),
         "part": pa.array([r["part"] for r in rows], pa.int64()),
         "n": pa.array(sizes, pa.int64()), "bits": pa.array(out, pa.binary())}
    )


def _shared(dealt: DataFrame, name: str) -> DataFrame:
    """(batch, bits per part in order), written once."""
    told = dealt.groupBy("part").applyInArrow(
        _compare, "batch bigint, part bigint, n bigint, bits binary"
    )
    return stage(told, name).groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("part", "n", "bits"))).alias(name)
    )


def _flags(told: list[dict] | None) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=t["n"]) for t in told or []]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _repeated_samples(batch: Batch, told: list[dict] | None) -> np.ndarray:
    starts, key = batch.samples()
    _, _, rank = _distinct(key, None)
    return starts[_flags(told)[rank]] if told else starts[:0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_PACKED = "batch bigint, size bigint, one binary, two binary, copies binary, ends binary, data binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to batches of about BATCH_BYTES; a longer text is a batch of its own."""
    part, sequence = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size, kind = 0, None

    def out() -> pa.RecordBatch:
        nonlocal sequence, held, size
        ends = np.cumsum([len(r[3]) for r in held], dtype=np.int64).tobytes()
        number, sequence = (part << 32) | sequence, sequence + 1
        columns = [np.array([r[i] for r in held], dtype=np.int64).tobytes() for i in range(3)]
        data, ids = b"".join(r[3] for r in held), [r[4] for r in held]
        held, size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(data)], pa.int64()),
             *[pa.array([c], pa.binary()) for c in (*columns, ends)],
             pa.array([data], pa.large_binary()).cast(pa.binary()), pa.array([ids], pa.list_(kind))],
            names=["batch", "size", "one", "two", "copies", "ends", "data", "ids"],
        )

    for batch in batches:
        kind = batch.column(4).type
        keys = zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True)
        for (one, two, copies, key), body in zip(keys, batch.column(3), strict=True):
            body = body.as_py()
            if held and size + len(body) > BATCH_BYTES:
                yield out()
            held.append((one, two, copies, body, key))
            size += len(body)
    if held:
        yield out()


_REMOVALS = "one bigint, two bigint, copies bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string"


def _removals(batch: Batch, row: dict, starts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """One row per distinct text; of several equal ones nothing stays."""
    removed = batch.covered(starts)
    one, two, copies = (np.frombuffer(row[c], np.int64) for c in ("one", "two", "copies"))
    n_removed, n_spans, kept, texts = [], [], [], []
    start = 0
    for end, n in zip(batch.ends.tolist(), copies.tolist(), strict=True):
        mask = removed[start:end] if n == 1 else np.ones(end - start, bool)
        n_removed.append(int(mask.sum()))
        n_spans.append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
        rest = batch.data[start:end]
        rest = (rest[~mask] if n_removed[-1] else rest).tobytes()
        kept.append(hashlib.sha256(rest).hexdigest())
        texts.append(rest.decode("utf-8", "replace"))
        start = end
    return pa.RecordBatch.from_arrays(
        [pa.array(one), pa.array(two), pa.array(copies), pa.array(np.diff(batch.ends, prepend=0)),
         pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string()),
         pa.array(texts, pa.string()), pa.array(row["ids"], kind)],
        names=[*(c.split()[0] for c in _REMOVALS.split(", ")), "doc_id"],
    )


def _bits_for(names_total: int) -> int:
    return max(0, (max(1, names_total // SORTED_NAMES) - 1).bit_length())


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining ``text``.

    A text that occurs once is answered where it lies; only of equal texts, of which nothing stays,
    the documents are looked up again, by narrow rows.
    """
    spark = docs.sparkSession
    period, offsets = difference_set()
    if length <= period:
        raise ValueError("strings must be longer than the period")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    docs = docs.withColumns(
        {"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(length), "text"),
         "n_bytes": F.octet_length("text").cast("long")}
    )
    long = docs.filter(F.col("n_bytes") >= length)
    distinct = long.groupBy("one", "two").agg(
        F.count(F.lit(1)).alias("copies"), F.first("text").cast("binary").alias("text"),
        F.first("doc_id").alias("doc_id"),
    )
    name, path = f"histloom_repeats_{uuid.uuid4().hex}", fresh_folder(spark, "repeats")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    packed = distinct.mapInArrow(_pack, f"{_PACKED}, ids array<{id_kind}>")
    (
        packed.write.bucketBy(buckets, "batch").option("path", path)
        .option("compression", "zstd").format("parquet").saveAsTable(name)
    )
    try:
        batches = spark.table(name)
        total = batches.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        bits = _bits_for(total * len(offsets) // period)
        arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)

        def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(rows):
                batch = Batch(row, length)
                yield _dealt(batch, batch.samples()[1], None, bits)

        def second(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(rows):
                batch = Batch(row, length)
                _, key, check = batch.strings(_repeated_samples(batch, row["samples"]))
                yield _dealt(batch, key, check, bits)

        def third(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(rows):
                batch = Batch(row, length)
                starts, key, check = batch.strings(_repeated_samples(batch, row["samples"]))
                hits = starts[:0]
                if len(starts):
                    _, _, rank = _distinct(key, check)
                    hits = starts[_flags(row["strings"])[rank]]
                yield _removals(batch, row, hits, arrow_id)

        with arrow_rows(spark, BATCH_ROWS):
            samples = _shared(batches.select("batch", "data", "ends").mapInArrow(first, _DEALT), "samples")
            sampled = batches.join(samples, "batch", "left")
            strings = _shared(
                sampled.select("batch", "data", "ends", "samples").mapInArrow(second, _DEALT), "strings"
            )
            done = sampled.join(strings, "batch", "left").mapInArrow(
                third, f"{_REMOVALS}, doc_id {id_kind}"
            )
            removals = stage(done, "removals", compression="zstd")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    none = F.lit(0).cast("long")
    short = docs.filter(F.col("n_bytes") < length).withColumns(
        {"n_removed": none, "n_spans": none, "kept_sha256": F.sha2(F.col("text").cast("binary"), 256)}
    )
    single = removals.filter("copies = 1")
    several = removals.filter("copies > 1").select("one", "two", "n_removed", "n_spans", "kept_sha256", "text")
    copies = long.drop("text").join(several, ["one", "two"])
    return short.select(*result).union(single.select(*result)).union(copies.select(*result))
