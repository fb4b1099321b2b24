import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from histloom.llm import simhash
from histloom.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42)
        for i in range(len(words) - n + 1)
    ]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    """prints: list of (doc_id, fingerprint) -> smallest reachable id per position."""
    low = [i for i, _ in prints]
    while True:
        new = [
            min((low[j] for j in range(len(prints))
                 if (prints[i][1] ^ prints[j][1]).bit_count() <= 4 and low[j] is not None),
                default=None)
            for i in range(len(prints))
        ]
        if new == low:
            return low
        low = new


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b\x1c .", max_size=60))
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint_of(text) == slow_fingerprint(text)


def near(rng, centre, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        centre ^= 1 << b
    return centre


def test_trie_finds_every_pair_of_one_node():
    rng = random.Random(5)
    # One shared first block, as in a root node of a rotation.
    keys = {(3 << 51) | near(rng, c, 4) & (2**51 - 1) for c in
            [rng.getrandbits(51) for _ in range(20)] for _ in range(15)}
    keys = np.array(sorted(keys), dtype=np.uint64)
    left, right = simhash.trie_links(np.zeros(len(keys), np.int64), keys)
    found = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist(), strict=True)}
    values = keys.tolist()
    # The trie of this rotation owes exactly the pairs whose running errors stay in allowance.
    limits = simhash._limits()
    for i in range(len(values)):
        for j in range(i):
            x = values[i] ^ values[j]
            run = [(x >> (63 - d)).bit_count() for d in range(64)]
            owed = all(run[d] <= limits[d] for d in range(64))
            assert ((j, i) in found) >= owed
            if (j, i) in found:
                assert x.bit_count() <= 4


@pytest.mark.parametrize("node_rows", [2048, 8])
def test_links_connect_like_brute_force(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = random.Random(11)
    values = {0}
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(12):
            c = near(rng, c, 4)  # chains, so components are wider than the budget
            values.add(c)
    prints = list(enumerate(sorted(values)))
    rows = [(int(np.uint64(v).astype(np.int64)),) for _, v in prints]
    links = simhash.linked(spark.createDataFrame(rows, "fp bigint"))
    for a, b in links.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() > 0
    found = dict(components(links).collect())
    groups = {}
    for (fp,), low in zip(rows, slow_components(prints), strict=True):
        groups.setdefault(low, set()).add(found.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_of_awkward_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base, "x"), (2, base.upper(), "y"), (3, base + " end", None), (4, None, "z"),
            (5, "", "z"), (6, "  \n", "z"), (None, base, "n"), (9, "some other text here", "q"),
            (9, "some other text here", "q"), (10, "long " * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, FP string")
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fp & (2**64 - 1), r.component_id))
    prints = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    lows = slow_components(prints)
    for (i, fp), low in zip(prints, lows, strict=True):
        assert (fp, low) in got[i]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(lows))
    empty = docs.filter("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
