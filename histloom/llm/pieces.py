"""Encoding into and decoding from the pieces of a byte-pair SentencePiece model.

The library merges one pair at a time: the best scored one, the leftmost of equals. Here all words
of a batch are merged together in rounds over flat arrays of symbols:

1. the best rank of every word's pairs (a segmented minimum),
2. all its occurrences at once, the leftmost of overlapping ones,
3. symbols that went are squeezed out, as are words without a pair left.

Merging all occurrences at once equals merging one by one unless an early one makes a pair that is
not worse than its own; then the later ones of that word wait for another round. Words are split
where no piece of the model could span, and each word is encoded once and remembered. What is left
of a word of thousands of symbols after 256 rounds is finished with a heap of its pairs.

Defined results: a null or empty text has no ids; ids null decode to null, no ids to the empty text.
Rows are independent, so repeated rows and clashing other columns change nothing. Ids outside the
vocabulary raise ``ValueError``, as does a model that is no byte-pair model with byte fallback, a
dummy prefix and no normalisation.
"""

from __future__ import annotations

import codecs
import heapq
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import by_value

by_value(__name__)

# The model's sign for a space, kinds of its pieces and types of its file.
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2
_NO_RANK = np.int64(1 << 40)

# Words of a lot a worker remembers, the longest of them, symbols merged together and characters cut into
# words at a time. They bound memory and change no result.
_REMEMBERED = 200_000
_LONGEST = 64
_SYMBOLS = 1 << 19
_PART = 1 << 20
# Rows of a batch in hand at once.
_ROWS = 256
# Rounds after which what is left of a word is merged one pair at a time.
_ROUNDS = 256

# Letters of words that are cut off from the signs after them, and those signs.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# White space that ends a word for every tokenizer used here.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CUT = re.compile(f"[^{WHITE}{SPACE}](?= )")


def parts(text: str, size: int = _PART) -> Iterator[str]:
    """The text in pieces of about ``size``, cut before a space that follows a word."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def per_worker(key: object, build: Callable[[], object]) -> object:
    """What ``build`` made once in this worker process; one task's tables serve the next."""
    home = sys.modules.setdefault("histloom_worker", ModuleType("histloom_worker"))
    held = vars(home).setdefault("held", {})
    if key not in held:
        held[key] = build()
    return held[key]


class Remembered:
    """Values of the words met lately, in two lots of at most ``most``.

    A full lot becomes the old one, and its words move over when they are met again: frequent words
    stay, and words met once are dropped with the lot they came in.
    """

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = most

    def unknown(self, words: set[str]) -> set[str]:
        """The words to learn; all others are in ``young`` now."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > self._most:
            self.young, self._old = {}, self.young
            new = words
        old = self._old
        again = {w: old[w] for w in new if w in old}
        self.young.update(again)
        return new.difference(again)


class _Lookup:
    """Sorted 64-bit keys with a row of values each."""

    def __init__(self, entries: dict[int, tuple[int, ...]], width: int):
        keys = np.fromiter(entries, dtype=np.int64, count=len(entries))
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.array(list(entries.values()), dtype=np.int64).reshape(len(entries), width)
        self._values = np.vstack([values[order], np.full((1, width), _NO_RANK)])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values per key; rows of _NO_RANK where the key is not there."""
        at = np.searchsorted(self._keys, keys)
        return self._values[np.where(self._keys[at] == keys, at, len(self._keys) - 1)]


def _single(error: UnicodeError) -> tuple[str, int]:
    """One replacement character for every byte that does not belong to a character."""
    return "�", error.start + 1


class Pieces:
    """The tables of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (
            model.trainer_spec.model_type != _BPE
            or not model.trainer_spec.byte_fallback
            or model.trainer_spec.treat_whitespace_as_suffix
            or plain.precompiled_charsmap
            or not plain.add_dummy_prefix
            or plain.remove_extra_whitespaces
            or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        ):
            raise ValueError(f"not a plain byte-pair model with byte fallback: {path}")
        names = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", name) for name in normal):
            raise ValueError(f"pieces that go beyond a word: {path}")
        self.size = len(names)
        self._bytes = {
            int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE
        }
        self._symbols(normal)
        self._pairs_of(normal, model)
        self._words = self._word_pattern(normal)
        self._seen = Remembered(_REMEMBERED)
        # What an id stands for in a decoded text.
        self._surface = [
            b"" if p.type == _CONTROL
            else model.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN
            else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE
            else p.piece.replace(SPACE, " ").encode()
            for p in model.pieces
        ]
        self._silent = {i for i, p in enumerate(model.pieces) if p.type == _CONTROL}
        self._spaced = {i for name, i in normal.items() if name.startswith(SPACE)}
        codecs.register_error("histloom-single", _single)

    def _symbols(self, normal: dict[str, int]) -> None:
        """Numbers for single characters: their piece's id, or one beyond all ids."""
        letters = sorted({c for name in normal for c in name})
        self._letters = np.array([ord(c) for c in letters] + [0x7FFFFFFF], dtype=np.int64)
        own = [normal.get(c, self.size + n) for n, c in enumerate(letters)]
        self._letter_ids = np.array([*own, -1], dtype=np.int64)
        self._number = dict(zip(letters, own, strict=True)) | normal
        self._wide = np.int64(self.size + len(letters))

    def _pairs_of(self, normal: dict[str, int], model: object) -> None:
        """(left, right) -> (rank, merged); and the pairs of characters that pieces hold."""
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {score: n for n, score in enumerate(scores)}
        pairs: dict[int, tuple[int, ...]] = {}
        beside: dict[int, tuple[int, ...]] = {}
        number, wide = self._number, int(self._wide)
        for name, i in normal.items():
            for cut in range(1, len(name)):
                left, right = number.get(name[:cut]), number.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * wide + right] = (rank[model.pieces[i].score], i)
                beside[number[name[cut - 1]] * wide + number[name[cut]]] = (1,)
        self._pairs, self._beside = _Lookup(pairs, 2), _Lookup(beside, 1)

    def _word_pattern(self, normal: dict[str, int]) -> re.Pattern:
        """Cuts at spaces, at plain characters that no piece of several characters holds, and
        between a letter and a sign where no piece holds the two."""
        held = {c for name in normal if len(name) > 1 for c in name}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held)
        letter = re.compile(f"[{LETTERS}]")
        joined = {b for name in normal for a, b in zip(name, name[1:], strict=False) if letter.match(a)}
        signs = "".join(re.escape(c) for c in SIGNS if c not in joined)
        word = f"{SPACE}*[{LETTERS}]++(?=[{SPACE}{alone}{signs}]|$)"
        return re.compile(f"{word}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]")

    # ---- merging ------------------------------------------------------------------------

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of neighbours; a negative symbol merges with nothing."""
        found = self._pairs(np.where((left < 0) | (right < 0), -1, left * self._wide + right))
        return found[:, 0], found[:, 1]

    def _chosen(
        self, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, made: np.ndarray, best: np.ndarray
    ) -> np.ndarray:
        """Places of the pairs to merge in this round."""
        places = np.flatnonzero(rank == best)
        # Pairs in a row overlap: every other one, from the left.
        order = np.arange(len(places))
        fresh = np.append(True, np.diff(places) > 1)
        places = places[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
        word = seg[places]
        if not (word[1:] == word[:-1]).any():
            return places
        # Does a merge make a pair that goes before the next occurrence?
        end = len(sym)
        to_left = np.maximum(places - 1, 0)
        left = np.where((places > 0) & (seg[to_left] == word), sym[to_left], -1)
        touching = np.append(False, places[1:] == places[:-1] + 2) & (left >= 0)
        left[touching] = made[places[np.flatnonzero(touching) - 1]]
        to_right = np.minimum(places + 2, end - 1)
        right = np.where((places + 2 < end) & (seg[to_right] == word), sym[to_right], -1)
        result = made[places]
        new = np.minimum(self._merged(left, result)[0], self._merged(result, right)[0])
        early = (new <= rank[places]).astype(np.int64)
        before = np.cumsum(early) - early
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        base = np.repeat(before[first], np.diff(np.append(first, len(places))))
        return places[before == base]

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols by first place, and which places still hold one; ``seg`` numbers words."""
        final, holds = sym.copy(), np.zeros(len(sym), dtype=bool)
        place = np.arange(len(sym))
        rank, made = self._merged(sym, np.append(sym[1:], -1))
        rank = np.where(np.append(seg[1:] == seg[:-1], False), rank, _NO_RANK)
        for turn in range(_ROUNDS + 1):
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            if turn == _ROUNDS:
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sym)], strict=True):
                    kept, ends_ = self._one_by_one(sym[a:b].tolist())
                    final[place[a:b][kept]], holds[place[a:b][kept]] = ends_, True
                break
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            going = best < _NO_RANK
            done = place[~going]
            final[done], holds[done] = sym[~going], True
            sym, seg, rank, made, place, best = (
                x[going] for x in (sym, seg, rank, made, place, best)
            )
            if not len(sym):
                break
            at = self._chosen(sym, seg, rank, made, best)
            sym[at] = made[at]
            stays = np.ones(len(sym), dtype=bool)
            stays[at + 1] = False
            new = (np.cumsum(stays) - 1)[at]
            sym, seg, rank, made, place = (x[stays] for x in (sym, seg, rank, made, place))
            near = np.zeros(len(sym), dtype=bool)
            near[new] = near[new[new > 0] - 1] = True
            touched = np.flatnonzero(near)
            follow = np.minimum(touched + 1, len(sym) - 1)
            inside = (follow > touched) & (seg[follow] == seg[touched])
            fresh_rank, made[touched] = self._merged(sym[touched], sym[follow])
            rank[touched] = np.where(inside, fresh_rank, _NO_RANK)
        return final, holds

    def _one_by_one(self, sym: list[int]) -> tuple[list[int], list[int]]:
        """Places and symbols left of one word, its pairs merged best first, then leftmost."""
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        ranks, made = self._merged(np.array(sym[:-1]), np.array(sym[1:]))
        found = zip(ranks.tolist(), range(len(sym)), made.tolist(), sym, sym[1:], strict=False)
        heap = [x for x in found if x[0] < _NO_RANK]
        heapq.heapify(heap)
        learnt: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= len(sym):
                return
            pair = sym[i], sym[j]
            if pair not in learnt:
                rank, result = self._merged(np.array(pair[:1]), np.array(pair[1:]))
                learnt[pair] = int(rank[0]), int(result[0])
            rank, result = learnt[pair]
            if rank < _NO_RANK:
                heapq.heappush(heap, (rank, i, result, *pair))

        gone = -2
        while heap:
            _, i, result, left, right = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= len(sym) or sym[j] != right:
                continue  # of symbols that have been merged since
            sym[i], sym[j], after[i] = result, gone, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        kept = [i for i, x in enumerate(sym) if x != gone]
        return kept, [sym[i] for i in kept]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word (already with SPACE for spaces), as bytes."""
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        at = np.searchsorted(self._letters, points)
        sym = np.where(self._letters[at] == points, self._letter_ids[at], -1)
        ends = np.cumsum([len(w) for w in words])
        starts = np.zeros(len(sym), dtype=bool)
        starts[np.append(0, ends[:-1])] = True
        both = np.append(-1, np.where((sym[1:] < 0) | (sym[:-1] < 0), -1, sym[:-1] * self._wide + sym[1:]))
        starts |= self._beside(both)[:, 0] != 1
        final, holds = self._rounds(sym, np.cumsum(starts))
        where = np.flatnonzero(holds)
        found = final[where]
        bounds = np.searchsorted(where, np.append(0, ends))
        odd = (found < 0) | (found >= self.size)
        if odd.any():
            # Characters without a piece: the ids of their bytes.
            spelled = {
                n: [self._bytes[b] for b in chr(points[where[n]]).encode("utf-8", "surrogatepass")]
                for n in np.flatnonzero(odd).tolist()
            }
            width = np.ones(len(found), dtype=np.int64)
            width[list(spelled)] = [len(ids) for ids in spelled.values()]
            offsets = np.append(0, np.cumsum(width))
            wide = np.empty(offsets[-1], dtype=np.int64)
            wide[offsets[:-1][~odd]] = found[~odd]
            for n, ids in spelled.items():
                wide[offsets[n] : offsets[n + 1]] = ids
            found, bounds = wide, offsets[bounds]
        flat, bounds = found.astype("<i4").tobytes(), (4 * bounds).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words, as bytes; those of usual length are remembered."""
        new, long_, group, size = self._seen.unknown(words), {}, [], 0
        seen = self._seen.young

        def flush() -> None:
            for word, ids in zip(group, self._encoded(group), strict=True):
                (seen if len(word) <= _LONGEST else long_)[word] = ids
            group.clear()

        for word in new:
            if size + len(word) > _SYMBOLS and group:
                flush()
                size = 0
            group.append(word)
            size += len(word)
        if group:
            flush()
        return long_

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """32-bit ids of each text, whole; null is the empty text."""
        texts = list(texts)
        found: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if waiting:
                long_ = self._learn(set().union(*(words for _, words in waiting)))
                seen = self._seen.young
                get = (lambda w: long_.get(w) or seen[w]) if long_ else seen.__getitem__
                for n, words in waiting:
                    found[n].append(b"".join(map(get, words)))
            waiting.clear()
            size = 0

        for n, text in enumerate(texts):
            for k, part in enumerate(parts(text or "")):
                if part:
                    part = part.replace(" ", SPACE)
                    waiting.append((n, self._words.findall(part if k else SPACE + part)))
                    size += len(part)
                if size > _PART:
                    flush()
        flush()
        return [np.frombuffer(b"".join(x), dtype="<i4") for x in found]

    # ---- decoding -----------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the space before the first word goes, stray bytes are replaced.

        Bytes on both sides of a control id make no character together.
        """
        if ids and not (0 <= min(ids) and max(ids) < self.size):
            raise ValueError("id outside the vocabulary")
        if not self._silent.isdisjoint(ids):
            cuts = [n for n, i in enumerate(ids) if i in self._silent]
            runs = [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        else:
            runs = [ids]
        runs = [b"".join(map(self._surface.__getitem__, run)) for run in runs]
        first = next((i for i in ids if i not in self._silent), None)
        if first in self._spaced:
            at = next(n for n, run in enumerate(runs) if run)
            runs[at] = runs[at][1:]
        return "".join(run.decode("utf-8", "histloom-single") for run in runs)

    def token_bytes(self) -> list[bytes]:
        """The bytes each id stands for within a text."""
        return self._surface


def pieces(path: str) -> Pieces:
    return per_worker(("pieces", path), lambda: Pieces(path))


def round_trip(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", kind: str = "bigint"
) -> DataFrame:
    """(key, ids, decoded) of every row in one pass, a bounded share of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, _ROWS)
                ids = table.encode(part.column(1).to_pylist())
                texts = pa.array([table.decode(x.tolist()) for x in ids], pa.string())
                columns = [part.column(0), _lists(ids), texts]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"])
                at += _ROWS

    narrow = docs.select(F.col(f"`{key}`").cast(kind).alias("key"), F.col(f"`{text}`"))
    found = narrow.mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
    return found.withColumnRenamed("key", key)


def _lists(flat: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in flat])).astype(np.int64)
    values = np.concatenate(flat) if flat else np.empty(0, dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def ids_of(text: Column, model: str) -> Column:
    """array<int>: ids of the whole text."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pieces(model)
        for texts in batches:
            yield _lists(table.encode(texts.to_pylist()))

    return encoded(text)


def text_of(ids: Column, model: str) -> Column:
    """The text that the ids decode to."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pieces(model)
        for lists in batches:
            ends = lists.offsets.to_numpy().tolist()
            flat, gone = lists.values.to_numpy(zero_copy_only=False), lists.is_null().to_pylist()
            rows = zip(ends[:-1], ends[1:], gone, strict=True)
            texts = [None if null else table.decode(flat[a:b].tolist()) for a, b, null in rows]
            yield pa.array(texts, pa.string())

    return decoded(ids)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of their ids (replacing one of that name)."""
    return docs.withColumn(ids, ids_of(F.col(f"`{text}`"), model))


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the texts of their ids (replacing a column of that name)."""
    return docs.withColumn(text, text_of(F.col(f"`{ids}`"), model))
