"""MinHash signatures and LSH band keys.

A signature needs, for every distinct token of a text, 128 modular products and a running minimum.
Exploding tokens and aggregating 128 columns would shuffle every token of the corpus; instead each
task computes the signatures of its own rows with numpy, and only the small band keys are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's functions with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The hash family.
NUM_PERM = 128
SEED = 1
PRIME = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1

# Tokens permuted in one numpy block (kept small enough for the CPU caches), tokens of a text whose
# minima are taken at once, and tokens whose permuted values a task remembers (512 bytes each).
# They bound memory whatever a text's length and whatever the number of texts.
_BLOCK = 256
_GROUP = 1 << 13
_REMEMBERED = 1 << 16


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the permutations: drawn pairwise from the seeded legacy generator."""
    draw = np.random.RandomState(SEED).randint
    pairs = [
        (draw(1, PRIME, dtype=np.uint64), draw(0, PRIME, dtype=np.uint64)) for _ in range(NUM_PERM)
    ]
    table = np.array(pairs, dtype=np.uint64)
    return table[:, 0], table[:, 1]


COEFFICIENTS = _coefficients()


def _permuted(hashes: np.ndarray) -> np.ndarray:
    """One row of NUM_PERM permuted 32-bit values per 32-bit hash."""
    a, b = COEFFICIENTS
    prime, zero, shift = np.uint64(PRIME), np.uint64(0), np.uint64(61)
    out = np.empty((len(hashes), NUM_PERM), dtype=np.uint32)
    for start in range(0, len(hashes), _BLOCK):
        # 64-bit products wrap around; that is part of the family's definition.
        x = hashes[start : start + _BLOCK, None] * a
        x += b
        # Remainder by the Mersenne prime: fold the high bits once, then subtract at most once.
        high = x >> shift
        x &= prime
        x += high
        x -= np.where(x >= prime, prime, zero)
        out[start : start + _BLOCK] = x & np.uint64(MAX_HASH)
    return out


class _Permuted:
    """Permuted values of tokens: most tokens of a corpus are few words, each permuted once."""

    def __init__(self) -> None:
        self._places: dict[str, int] = {}
        self._rows = np.empty((max(_REMEMBERED, _GROUP), NUM_PERM), dtype=np.uint32)

    def lowest(self, tokens: list[str]) -> np.ndarray:
        """Minimum per permutation over at most _GROUP distinct tokens."""
        new = [t for t in tokens if t not in self._places]
        if len(self._places) + len(new) > len(self._rows):
            self._places.clear()
            new = tokens
        if new:
            first, after = len(self._places), len(self._places) + len(new)
            self._rows[first:after] = _permuted(_hashes(new))
            self._places.update(zip(new, range(first, after), strict=True))
        at = np.fromiter(map(self._places.__getitem__, tokens), dtype=np.intp, count=len(tokens))
        return self._rows.take(at, axis=0).min(axis=0)


def signatures(
    texts: Iterator[str | None], permuted: _Permuted | None = None
) -> Iterator[np.ndarray | None]:
    """Signature of each text's token set, None for a text without tokens.

    The minima of a long text are taken in groups of its tokens and folded.
    """
    permuted = permuted or _Permuted()
    for text in texts:
        tokens = list(set(text.split())) if text else []
        lowest = None
        for start in range(0, len(tokens), _GROUP):
            part = permuted.lowest(tokens[start : start + _GROUP])
            lowest = part if lowest is None else np.minimum(lowest, part)
        yield lowest


def _hash(token: str) -> int:
    """First four bytes of the SHA-1 digest, little-endian."""
    return int.from_bytes(sha1(token.encode("utf-8", "surrogatepass")).digest()[:4], "little")


def _hashes(tokens: list[str]) -> np.ndarray:
    """_hash of many tokens."""
    digests = b"".join([sha1(t.encode("utf-8", "surrogatepass")).digest() for t in tokens])
    return np.frombuffer(digests, dtype="<u4").reshape(len(tokens), -1)[:, 0].astype(np.uint64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def minhash_signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NUM_PERM minima over the text's token set; null without tokens."""
    permuted = _Permuted()
    for texts in batches:
        values = np.zeros((len(texts), NUM_PERM), dtype=np.uint32)
        empty = np.zeros(len(texts), dtype=bool)
        for i, found in enumerate(signatures((t.as_py() for t in texts), permuted)):
            if found is None:
                empty[i] = True
            else:
                values[i] = found
        ends = np.arange(0, values.size + 1, NUM_PERM, dtype=np.int32)
        flat = pa.array(values.reshape(-1).astype(np.int64))
        yield pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(empty))


@lru_cache(maxsize=None)
def band_shape(threshold: float, num_perm: int = NUM_PERM) -> tuple[int, int]:
    """(bands, rows) minimising the evenly weighted areas of false positives and negatives.

    A pair of Jaccard similarity s collides in some band with probability 1 - (1 - s^rows)^bands.
    """
    steps = np.arange(0.0, 1.0, 0.001) + 0.0005
    best, shape = np.inf, (1, 1)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            collide = 1.0 - (1.0 - steps**rows) ** bands
            below = steps < threshold
            error = 0.5 * collide[below].sum() + 0.5 * (1.0 - collide[~below]).sum()
            if error < best:
                best, shape = error, (bands, rows)
    return shape


def band_keys(signature: Column, threshold: float) -> Column:
    """One key per band: a digest of the band's position and its slice of the signature."""
    bands, rows = band_shape(threshold)
    keys = []
    for i in range(bands):
        values = F.slice(signature, i * rows + 1, rows).cast("array<string>")
        keys.append(F.md5(F.concat_ws(",", F.lit(str(i)), values)))
    return F.when(signature.isNotNull(), F.array(*keys))
