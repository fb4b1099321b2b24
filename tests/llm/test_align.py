from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histloom.llm import align, queries
from histloom.llm.pieces import Remembered

PATH_A, PATH_B = queries.BYTES, queries.PIECES
TOKENIZER = Tokenizer.from_file(PATH_A)
TOKENIZER.encode_special_tokens = True
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
LETTERS = align._byte_letters()


def tokens(text):
    """(ids of A, its tokens' bytes, ids of B, its tokens' bytes); empty ones for texts left out."""
    if not text:
        return [], [], [], []
    a = TOKENIZER.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(LETTERS[c] for c in TOKENIZER.id_to_token(i)) for i in a]
    b = PROCESSOR.encode(text)
    names = [PROCESSOR.id_to_piece(i) for i in b]
    bytes_b = [
        bytes([int(n[3:5], 16)]) if PROCESSOR.is_byte(i) else n.replace("▁", " ").encode()
        for i, n in zip(b, names, strict=True)
    ]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    return a, bytes_a, b, bytes_b


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    links, groups, counts = [], [], Counter()
    for text in texts:
        a, bytes_a, b, bytes_b = tokens(text)
        at, bt = spans(bytes_a), spans(bytes_b)
        found = [(a[i], b[j]) for i, (s, e) in enumerate(at) for j, (u, v) in enumerate(bt)
                 if s < v and u < e]
        links.append(found)
        counts.update(set(found))
        common = sorted({e for _, e in at} & {e for _, e in bt})
        cut = []
        for lo, hi in zip([0, *common], common, strict=False):
            one = ",".join(str(i) for i, (s, e) in zip(a, at, strict=True) if lo <= s and e <= hi)
            two = ",".join(str(i) for i, (s, e) in zip(b, bt, strict=True) if lo <= s and e <= hi)
            cut.append(f"{one}|{two}")
        groups.append((len(a), len(b), len(cut), ";".join(cut)))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [
        (n_a, n_b, n_groups, len(found), text, sum(counts[p] == most[p[0]] for p in found),
         sum(counts[p] for p in found))
        for (n_a, n_b, n_groups, text), found in zip(groups, links, strict=True)
    ]


TEXTS = [
    "Plain words, plain words.", None, "", "", "▁ is no space", "日本語 mixed 😀 text",
    "<|endoftext|> and <s> are text", "  two  spaces\n\n\tand tabs ", "a", " ", "don't I'll we've",
    "Zürich's 2023-08-01 (draft), naïve—ﬁne.", "x" * 300, "the end of the words " * 40, "é" * 50 + "\x00\x1c",
    "Plain words, plain words.",
]


@pytest.mark.parametrize("share", [1, 4096])
def test_alignment_equals_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(align, "HOT_SHARE", share)
    rows = [(i % 12, t, "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string").repartition(3)
    staged = align.stage(align.aligned(docs, PATH_A, PATH_B), "aligned")
    got = align.with_link_sums(staged).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(brute(TEXTS))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abz éßøı日😀 \n\t\x1c\x85\xa0 .,'!?-0129'st<|▁", max_size=40))
def test_words_are_cut_where_the_tokenizer_cuts(text):
    own = test_words_are_cut_where_the_tokenizer_cuts.__dict__.setdefault(
        "own", align.ByteTokens(PATH_A)
    )
    assert own.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_cut_where_the_tokenizer_cuts(text):
    own = align.per_worker("test-own", lambda: align.ByteTokens(PATH_A))
    assert own.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.with_link_sums(align.stage(align.aligned(docs, PATH_A, PATH_B), "t")).count() == 0


def test_registered_columns(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_align(spark, str(tmp_path))
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    ]
    empty = got.filter(F.col("n_a") == 0).select("groups_sha256").distinct().collect()
    assert [r[0] for r in empty] == [""]
    assert public_tokenizers.path("byte_bpe_50k.json") == PATH_A


def test_words_met_again_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(align, "_REMEMBERED", 4)
    own, learnt = align.ByteTokens(PATH_A), Counter()
    encoded = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda words: learnt.update(words) or encoded(words))
    texts = [f" often rare{n} of{n} them" for n in "abcdefgh"]
    texts += [" naïve Ǆ x'll it's <|endoftext|> 日本  two\n of them"]
    found = own.encode(texts)
    assert [x.tolist() for x in found] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt[" often"] == 1


def test_remembered_words_move_from_the_old_lot():
    held = Remembered(3)
    for n in range(6):
        for word in held.unknown({"often", f"rare{n}"}):
            assert word == f"rare{n}" or n == 0
            held.young[word] = word.encode()
        assert held.young["often"] == b"often" and len(held.young) <= 3
    assert held.unknown({"rare0"}) == {"rare0"}
