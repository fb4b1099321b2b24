"""What a task does with token sets for the similarity join: hashes, counts, prefixes, meetings.

Token sets are never shuffled. A table of how often tokens occur, one byte for each of at most
2 ** 24 groups of tokens, is small enough to be sent to all tasks, so each orders the tokens of its
own sets by it, and only the rarest ones, the prefix, leave the task as postings.

A posting brings an odd sketch of its set: bit i is the parity of the number of tokens that hash to
i. Bits in which two sketches differ come from as many different tokens at least, so a pair with
more of them than similar sets may have is passed over where two postings meet, and never written.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's functions with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]

# Products of a threshold and a size may miss a whole number by this much.
SLACK = 1e-9
# Words of more eights of bytes are hashed one by one; words that are hashed together.
_LONG, _CHUNK, _SEED = 8, 1 << 16, np.uint64(0x9E3779B97F4A7C15)
# Groups of tokens that are counted apart: so many tokens a group, within these bounds, and the
# groups of one row of the table.
_TOKENS_PER_GROUP, _LEAST_BITS, _MOST_BITS = 16, 15, 24
PIECE_BITS = 15
# Levels: 1 for a token of one set only, then four to a factor of two.
ALONE, _FIRST, _TOP = 1, 2, 254
# Tokens of up to about 16 sets make so few pairs that their postings go without a sketch.
_RARE = _FIRST + 16
# Tokens per word of 64 bits of a sketch, and the most words. Larger sets have none.
_PER_WORD, _MOST_WORDS = 150, 8
# Sets that are handled together, and pairs looked at together.
_SETS, _PAIRS = 1000, 1 << 20
# Rare tokens that two sets must share before they are compared: so many, and one more for every
# so many tokens of the smaller set, since long texts share some rare tokens by chance.
SHARED, SHARED_PER = 3, 64

COUNTED = "piece int, counts binary"
LEVELS = "piece int, levels binary"
POSTINGS = "token bigint, id bigint, about bigint, sketch binary"
PAIRS = "id bigint, other bigint, needed int, n int"


def _hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, all words of a length in eights together."""
    ends = np.frombuffer(words.buffers()[1], np.int32)
    ends = ends[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    starts, lengths = ends[:-1], np.diff(ends)
    found = _mixed(lengths.astype(np.uint64) ^ _SEED)
    eights = np.minimum((lengths + 7) >> 3, _LONG + 1)
    for n in range(1, _LONG + 1):
        rows = np.flatnonzero(eights == n)
        for at in (rows[i : i + _CHUNK] for i in range(0, len(rows), _CHUNK)):
            places = np.arange(8 * n)
            letters = data.take(starts[at][:, None] + places, mode="clip")
            letters[places >= lengths[at][:, None]] = 0
            value = found[at]
            for eight in letters.view("<u8").T:
                value = _mixed(value ^ eight)
            found[at] = value
    for i in np.flatnonzero(eights > _LONG):
        digest = blake2b(data[starts[i] : ends[i + 1]].tobytes(), digest_size=8).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another number for every number, all bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenised(batches: Batches) -> Batches:
    """Replaces ``text`` by ``tokens``, the sorted distinct hashes of its whitespace-separated words;
    rows without words are left out. A function of batches, which no filter is moved below."""
    for batch in batches:
        for start in range(0, batch.num_rows, _SETS):
            yield _tokenised(batch.slice(start, _SETS))


def _tokenised(batch: pa.RecordBatch) -> pa.RecordBatch:
    # White space is what str.split takes for it.
    lists = pc.utf8_split_whitespace(batch.column("text"))
    words, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
    flat, ends = _hashed(words)[some], np.cumsum(np.concatenate(([0], n)))
    rows = np.flatnonzero(n)
    parts = [np.unique(flat[ends[i] : ends[i + 1]]) for i in rows]
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else flat
    rest = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(rows))
    tokens = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))
    return pa.RecordBatch.from_arrays([*rest.columns, tokens], [*rest.schema.names, "tokens"])


@F.arrow_udf(T.IntegerType())
def n_shared(ones: pa.Array, others: pa.Array) -> pa.Array:
    """How many tokens two sorted lists of distinct ones share."""
    a, x = _lists(ones)
    b, y = _lists(others)
    found = [
        len(np.intersect1d(a[x[i] : x[i + 1]], b[y[i] : y[i + 1]], assume_unique=True))
        for i in range(len(ones))
    ]
    return pa.array(found, pa.int32())


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values as unsigned, ends) of lists without null."""
    ends = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends - ends[0]


def _least(total: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens that similar sets of so many tokens together have in common at least."""
    return np.ceil(total * (threshold / (1 + threshold)) - SLACK).astype(np.int64)


# ---- how often tokens occur ----------------------------------------------------------------


def group_bits(tokens: int) -> int:
    groups = max(tokens // _TOKENS_PER_GROUP, 1)
    return min(_MOST_BITS, max(_LEAST_BITS, (groups - 1).bit_length()))


def counted(bits: int) -> Callable[[Batches], Batches]:
    """Rows (tokens) to counts per group of tokens: places within a piece, then as many counts."""

    def run(batches: Batches) -> Batches:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            tokens, _ = _lists(batch.column("tokens"))
            np.add.at(counts, tokens & np.uint64((1 << bits) - 1), 1)
        for piece, part in enumerate(counts.reshape(-1, 1 << PIECE_BITS)):
            at = np.flatnonzero(part)
            if len(at):
                data = at.astype("<u2").tobytes() + part[at].astype("<u4").tobytes()
                columns = [pa.array([piece], pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "counts"])

    return run


def levels(batches: Batches) -> Batches:
    """All counts of a piece to one level per group of tokens; rows of a piece are in one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total = sums.setdefault(piece, np.zeros(1 << PIECE_BITS, dtype=np.uint64))
            n = len(data) // 6
            total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<u4", n, 2 * n)
    for piece, total in sums.items():
        level = _FIRST + np.floor(4 * np.log2(np.maximum(total, 1)))
        level = np.where(total <= ALONE, total, np.minimum(level, _TOP)).astype(np.uint8)
        columns = [pa.array([piece], pa.int32()), pa.array([level.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "levels"])


def level_table(rows: list[tuple[int, bytes]], bits: int) -> bytes:
    table = np.zeros((1 << (bits - PIECE_BITS), 1 << PIECE_BITS), dtype=np.uint8)
    for piece, level in rows:
        table[piece] = np.frombuffer(level, np.uint8)
    return table.tobytes()


# ---- postings ------------------------------------------------------------------------------


def _sketch(tokens: np.ndarray) -> bytes:
    words = 1
    while words * _PER_WORD < len(tokens):
        words *= 2
    if words > _MOST_WORDS:
        return b""
    bits = 64 * words
    places = ((tokens >> np.uint64(28)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits) & 1, bitorder="little").tobytes()


def postings(table, threshold: float, min_rows: int, salts: int) -> Callable[[Batches], Batches]:
    """Rows (id, is_kept, tokens) to POSTINGS, ``table`` being a broadcast level table.

    ``about`` is the set's size, the token's place in the set's order, whether the set has a kept
    record and whether the posting meets those before it, in 30, 30, 1 and 1 bits. Tokens of one
    set only keep their place but are left out. A token of ``min_rows`` sets or more becomes
    several, one for each that number of sets, up to ``salts``; a set's postings are in all of
    them and meet those before them in one.
    """

    def run(batches: Batches) -> Batches:
        level = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, _SETS):
                yield _posted(batch.slice(start, _SETS), level, threshold, min_rows, salts)

    return run


def _posted(batch, level, threshold, min_rows, salts) -> pa.RecordBatch:
    flat, ends = _lists(batch.column("tokens"))
    mask = np.uint64(len(level) - 1)
    numbers = (level[flat & mask].astype(np.uint64) << np.uint64(56)) | (flat >> np.uint64(8))
    ids, kept = batch.column("id").to_pylist(), batch.column("is_kept").to_pylist()
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i, (record, has_kept) in enumerate(zip(ids, kept, strict=True)):
        tokens = flat[ends[i] : ends[i + 1]]
        size = len(tokens)
        # Not even a set of one token more, or less, is similar.
        if size < threshold * (size + 1) - SLACK:
            continue
        prefix = np.sort(numbers[ends[i] : ends[i + 1]])
        prefix = prefix[: size - int(np.ceil(size * threshold - SLACK)) + size // SHARED_PER + SHARED]
        levels = prefix >> np.uint64(56)
        alone, rare = np.searchsorted(levels, [ALONE + 1, _RARE + 1])
        places = np.arange(alone, len(prefix), dtype=np.int64)
        if not len(places):
            continue
        about = (size << 32) | (places << 2) | (2 * bool(has_kept))
        sketches = [b""] * max(rare - alone, 0)
        if len(sketches) < len(places):
            sketches += [_sketch(tokens)] * (len(places) - len(sketches))
        prefix, levels = prefix[alone:], levels[alone:]
        often = np.exp2((levels.astype(np.float64) - _FIRST) / 4)
        copies = np.clip(np.ceil(often / min_rows), 1, salts).astype(np.int64)
        if copies.max() > 1:
            at = np.repeat(np.arange(len(copies)), copies)
            salt = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = _mixed(np.array([record]).view(np.uint64))[0] % copies[at].astype(np.uint64)
            # Zero stays zero, so the first salt changes nothing.
            prefix = prefix[at] ^ _mixed(salt.astype(np.uint64))
            about = about[at] | (own == salt.astype(np.uint64))
            sketches = [sketches[j] for j in at]
        else:
            about = about | 1
        out[0].append(prefix.view(np.int64))
        out[1].append(np.full(len(prefix), record, dtype=np.int64))
        out[2].append(about)
        out[3].extend(sketches)
    whole = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in out[:3]]
    columns = [*map(pa.array, whole), pa.array(out[3], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["token", "id", "about", "sketch"])


# ---- meetings ------------------------------------------------------------------------------


class _Postings:
    """Postings of one or more tokens, sorted by token and size."""

    def __init__(self, token, record, about, sketch: pa.Array) -> None:
        self.token, self.record, self.about, self.sketch = token, record, about, sketch
        self.size, self.place = about >> 32, (about >> 2) & ((1 << 30) - 1)
        self.kept, self.meets = (about & 2) > 0, (about & 1) > 0

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Postings:
        numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "id", "about")]
        return cls(*numbers, batch.column("sketch"))

    def after(self, start: int) -> _Postings:
        return _Postings(self.token[start:], self.record[start:], self.about[start:], self.sketch[start:])

    def with_more(self, more: _Postings) -> _Postings:
        numbers = [
            np.concatenate(c)
            for c in zip((self.token, self.record, self.about), (more.token, more.record, more.about), strict=True)
        ]
        return _Postings(*numbers, pa.concat_arrays([self.sketch, more.sketch]))

    def folded(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Words of each sketch, and by number of words the sketches of at least so many, folded."""
        ends = np.frombuffer(self.sketch.buffers()[1], np.int32)
        ends = ends[self.sketch.offset : self.sketch.offset + len(self.sketch) + 1]
        data = self.sketch.buffers()[2]
        data = np.frombuffer((data or b"")[ends[0] : ends[-1]], np.uint64)
        starts, words = (ends[:-1] - ends[0]) >> 3, np.diff(ends) >> 3
        found, n = {}, _MOST_WORDS
        while n:
            found[n] = np.zeros((len(words), n), dtype=np.uint64)
            if 2 * n in found:
                found[n] = found[2 * n][:, :n] ^ found[2 * n][:, n:]
            at = np.flatnonzero(words == n)
            if len(at):
                found[n][at] = data[starts[at][:, None] + np.arange(n)]
            n //= 2
        return words, found


def meetings(threshold: float) -> Callable[[Batches], Batches]:
    """Postings sorted by (token, about) to PAIRS, the smaller id first: sets that share ``n`` tokens
    of their prefixes here, one of them kept, and may be similar by sizes, places and sketches if
    they share ``needed`` in all."""

    def run(batches: Batches) -> Batches:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _Postings.of(batch)
            all_ = new if before is None else before.with_more(new)
            first = 0 if before is None else len(before.token)
            yield from _met(all_, first, threshold)
            # What later postings of the last token can meet: sizes only grow.
            last = len(all_.token) - 1
            least = np.ceil(all_.size[last] * threshold - SLACK)
            start = np.searchsorted(all_.token, all_.token[last])
            before = all_.after(start + int(np.searchsorted(all_.size[start:], least)))

    return run


def _met(rows: _Postings, first: int, threshold: float) -> Batches:
    """Pairs of a posting from ``first`` on and one before it."""
    token = np.cumsum(np.concatenate(([0], rows.token[1:] != rows.token[:-1]))).astype(np.int64)
    least = np.ceil(rows.size * threshold - SLACK).astype(np.int64)
    low = np.searchsorted((token << 31) | rows.size, (token << 31) | least)
    each = np.arange(len(low)) - low
    each[:first] = 0
    each[~rows.meets] = 0
    if not each.any():
        return
    words, folded = rows.folded()
    ends = np.cumsum(each)
    start = 0
    while start < len(each):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        n = each[start:stop]
        if n.any():
            later = np.repeat(np.arange(start, stop), n)
            earlier = np.arange(len(later)) - np.repeat(np.cumsum(n) - n, n) + low[later]
            yield from _near(rows, earlier, later, threshold, words, folded)
        start = stop


def _near(rows, a, b, threshold, words, folded) -> Batches:
    either = (rows.kept[a] | rows.kept[b]) & (rows.record[a] != rows.record[b])
    a, b = a[either], b[either]
    total = rows.size[a] + rows.size[b]
    least = _least(total, threshold)
    # Tokens shared up to here at most, and tokens left on either side.
    shared = np.minimum(rows.place[a], rows.place[b]) + 1
    left = np.minimum(rows.size[a] - rows.place[a], rows.size[b] - rows.place[b]) - 1
    near = shared + left >= least
    a, b, least, apart = a[near], b[near], least[near], (total - 2 * least)[near]
    common = np.minimum(words[a], words[b])
    near = np.ones(len(a), dtype=bool)
    for n, sketches in folded.items():
        at = np.flatnonzero(common == n)
        if len(at):
            differ = np.bitwise_count(sketches[a[at]] ^ sketches[b[at]]).sum(axis=1, dtype=np.int64)
            near[at] = differ <= apart[at]
    a, b, least = a[near], b[near], least[near]
    if not len(a):
        return
    needed = np.minimum(least, np.minimum(rows.size[a], rows.size[b]) // SHARED_PER + SHARED)
    one, two = rows.record[a], rows.record[b]
    pairs = np.stack([np.minimum(one, two), np.maximum(one, two), needed], axis=1)
    # A token that meets twice because records repeat counts twice, so never too little.
    pairs, n = np.unique(pairs, axis=0, return_counts=True)
    columns = [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
    columns += [pa.array(pairs[:, 2].astype(np.int32)), pa.array(n.astype(np.int32))]
    yield pa.RecordBatch.from_arrays(columns, ["id", "other", "needed", "n"])
