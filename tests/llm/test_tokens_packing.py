import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from histloom.llm import materialise, packing
from histloom.llm.common import stage
from histloom.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, "Plain words, repeated words. " * 900, "a"), (2, None, "b"), (3, "", "b"), (3, "", "b"),
    (None, "No id here", "c"), (4, "I'll keep “quotes”, ΟΔΟΣ and ＦＵＬＬ width\x1c too", None),
    (5, "Éa ²½ 12a3 x_y--z «ok»…", "d"), (6, " \n\t ", "d"), (7, "hello <|endoftext|> world<|startoftext|>", "e"),
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(
    ["<|endoftext|>", "<|startoftext|>", "<|END", "oftext|>", "hello", " ", "Wörld's", "日", "\n", "<|", "1"]
)).map("".join)))
def test_ids_equal_the_tokenizers_own(text):
    tokenizer = test_ids_equal_the_tokenizers_own.__dict__.setdefault(
        "own", Tokenizer.from_file(PATH)
    )
    mine = test_ids_equal_the_tokenizers_own.__dict__.setdefault("mine", Encoder(PATH))
    want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert mine.ids(text).tolist() == want


@pytest.mark.parametrize("lengths", [[], [5], [7, 6, 5, 4, 3, 3, 2, 1, 1], [10] * 7])
def test_first_fit_by_hand(lengths):
    bins, offsets = packing.first_fit(lengths, 10)
    free, want = [], []
    for n in lengths:
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(10)
        want.append((at, 10 - free[at]))
        free[at] -= n
    assert list(zip(bins, offsets, strict=True)) == want


def test_packing_covers_every_id_once(spark, plain):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, OFFSET string")
    got = packing.pack(docs, PATH, capacity=64).collect()
    per_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        per_doc[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces]).tolist()
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 64
    for key, text, _ in ROWS:
        ids = plain(text)
        pieces = sorted(per_doc[key, len(ids)], key=lambda r: r.start)
        copies = sum(1 for k, t, _ in ROWS if (k, plain(t)) == (key, ids))
        want = [
            (s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()))
            for s in range(0, len(ids), 64)
        ]
        assert [(r.start, r.length, r.ids_crc32) for r in pieces] == sorted(want * copies)
    assert packing.pack(docs.filter("false"), PATH).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4096, 5000])
def test_permutation_is_a_bijection(total):
    slots = materialise.permuted(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        other = materialise.permuted(np.arange(total), total, key=7)
        assert (slots != np.arange(total)).mean() > 0.9 and (slots != other).mean() > 0.9


def test_shards_read_back_exactly(spark, plain, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, SLOT string")
    path = str(tmp_path / "shards")
    index = materialise.materialise(docs, path, PATH, stride=16, shard_records=40).collect()
    records = {
        r.slot: np.frombuffer(r.ids, "<u2").tolist()
        for r in materialise.read_shards(spark, path, 16).collect()
    }
    assert sorted(records) == list(range(len(index))) == sorted(r.slot for r in index)
    texts = defaultdict(list)
    for key, text, _ in ROWS:
        texts[key].append(plain(text))
    for r in index:
        assert (r.shard, r.record) == divmod(r.slot, 40)
        ids = records[r.slot]
        assert ids[r.length :] == [0] * (16 - r.length)
        assert any(ids[: r.length] == t[r.start : r.start + 16] for t in texts[r.doc_id])
    files = sorted((tmp_path / "shards").glob("shard=*/part-*"))
    assert len(files) == -(-len(index) // 40)
    # A record is found by its offset alone.
    stride = materialise.record_bytes(16)
    for f in files:
        shard = int(f.parent.name.split("=")[1])
        data = f.read_bytes()
        assert len(data) % stride == 0
        at = len(data) // stride - 1
        one = np.frombuffer(data[at * stride + 8 : at * stride + 40], "<u2").tolist()
        assert one == records[shard * 40 + at]
    empty = materialise.materialise(docs.filter("false"), str(tmp_path / "none"), PATH)
    assert empty.count() == 0
    assert materialise.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_staged_ids_hold_copies_further_apart_than_a_usual_page_once(spark, tmp_path):
    bodies = np.random.default_rng(1).integers(0, 256, (2_000, 1_024), dtype=np.uint8)
    rows = [(bytearray(b.tobytes()),) for b in bodies] * 2
    df = spark.createDataFrame(rows, "ids binary").coalesce(1)
    size = {}
    for name, options in (("plain", {}), ("tight", materialise.TIGHT)):
        staged = stage(df, name, "zstd", options)
        assert Counter(staged.collect()) == Counter(df.collect())
        size[name] = sum(os.path.getsize(f.removeprefix("file:")) for f in staged.inputFiles())
    assert size["tight"] < 0.75 * size["plain"]
