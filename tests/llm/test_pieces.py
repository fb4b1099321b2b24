import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from histloom.llm import pieces
from histloom.llm.pieces import Pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN = Pieces(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ALPHABET = "abcdefghij the and ing  ▁▁\n\t0123.,;:!?\"'()-=_aaabbbéßµøı日本語中文абв\x00​😀é<s></s>�"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=ALPHABET, max_size=200)))
def test_ids_and_text_equal_the_librarys(text):
    ids = OWN.encode([text])[0].tolist()
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize(
    "text",
    ["a" * 30_000, " " * 20_000, "ab" * 9_000 + "=" * 3_000, "▁" * 700 + "x" * 700, "word " * 300_000,
     "nowhitespace" * 4_000, "=-" * 5_000 + " \n" * 3_000],
    ids=["letter", "spaces", "pairs", "signs", "long", "one word", "lines"],
)
def test_long_words_and_texts(text):
    assert OWN.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_ties_go_leftmost_and_rounds_end_in_the_heap(monkeypatch):
    monkeypatch.setattr(pieces, "_ROUNDS", 2)
    own = Pieces(PATH)
    for text in ("   x     y       z", "intermediate representations of words", "aaaaaaa" * 9):
        assert own.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_remembering_little_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 3)
    monkeypatch.setattr(pieces, "_PART", 16)
    texts = ["one two three four five six seven", "", "one two", "seven  eight\nnine"] * 3
    assert [x.tolist() for x in Pieces(PATH).encode(texts)] == LIBRARY.encode(texts)


def test_ids_outside_the_vocabulary():
    with pytest.raises(ValueError):
        OWN.decode([32_000])


ROWS = [(1, "Plain words, plain words.", "x"), (2, None, "y"), (3, "", None), (3, "", None),
        (None, "日本 ▁ x", "z"), (4, "long " * 50_000, "z")]


def test_frames(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, IDS string")
    want = {(d, t): LIBRARY.encode(t or "") for d, t, _ in ROWS}
    encoded = pieces.encode(docs.drop("IDS"), PATH)
    got = pieces.decode(encoded, PATH).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.ids == want[r.doc_id, r.text] and r.decoded == LIBRARY.decode(r.ids)
    once = pieces.round_trip(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in once) == sorted(
        (str(r.doc_id), r.ids, r.decoded) for r in got
    )
    missing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(missing, PATH).collect()] == [None, ""]
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0
