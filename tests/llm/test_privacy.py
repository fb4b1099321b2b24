import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histloom.llm import privacy


def slow_spans(text):
    """The patterns as they are written, one kind after the other."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        odd = sum(digits[-1::-2])
        even = sum(sum(divmod(2 * n, 10)) for n in digits[-2::-2])
        if 12 <= len(digits) <= 19 and (odd + even) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.+-% (25)0é\n", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert privacy.base_spans(text) == slow_spans(text)


@pytest.mark.parametrize("text", [
    "mail a.b@c-d.example, 10.0.255.1 and 1.2.3.256, 4111 1111 1111 1111 or +49 (30) 1234-5678.",
    "1.2.3.4.5.6.7.8", "a@b@c.d", "x@y.z@q.r", "0000000000000000", "+1 (408) 555-0123" * 3,
    "9" * 5000 + "." + "9" * 5000, "@" * 3000, "a" * 20_000 + "@", "+1" * 2000,
])
def test_base_spans_by_example(text):
    assert privacy.base_spans(text) == slow_spans(text)


def corpus():
    rows = [
        (i, f"case {i}: the veltranic office of kim@corp.example wrote letter number {chr(97 + i) * 4}", "x")
        for i in range(12)
    ]
    rows += [(1000 + i, f"common words about the office and the letter, draft {i}", "x") for i in range(200)]
    rows += [(200, "veltranic people met", "y"), (201, "nothing here", "y"), (None, "kim@corp.example", None),
             (202, None, "y"), (203, "", "y"), (203, "", "y"), (204, "pad " * 40_000 + "1.2.3.4", "y")]
    return rows


@pytest.mark.parametrize("limit", [200_000, 0])
def test_disclosing_terms_are_found_everywhere(spark, limit):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, SPANS string")
    terms = {r.term: r.action for r in privacy.disclosing_terms(docs, limit=limit).collect()}
    assert terms == {"veltranic": "remove", "case": "remove", "wrote": "remove", "number": "remove"}
    got = {r.doc_id: r for r in privacy.personal_data(docs, limit=limit).collect()}
    assert len(got) == 218 and got[200].spans == "term:0:9" and got[201].spans == ""
    assert got[None].n_email == 1 and got[204].n_ip == 1 and got[202].spans == ""
    assert "email" in got[3].spans and got[3].spans.startswith("term:0:4,")
    clean = privacy.sanitise(docs, limit=limit)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[200] == " people met" and texts[201] == "nothing here" and texts[202] is None
    assert "[EMAIL]" in texts[3] and "kim@" not in texts[3] and texts[204].endswith("[IP]")


def test_copies_prove_nothing_and_empty_tables(spark):
    rows = [(i, "the zorblat wrote to kim@corp.example", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    assert privacy.disclosing_terms(docs).count() == 0
    assert privacy.personal_data(docs.filter("false")).count() == 0
    assert privacy.sanitise(docs.filter("false")).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_copies_hide_nothing(spark, limit):
    kind = "doc_id bigint, text string, n string"
    once = privacy.disclosing_terms(spark.createDataFrame(corpus(), kind), limit=limit).collect()
    docs = spark.createDataFrame(corpus() * 5, kind).repartition(3)
    assert len(once) == 4 and set(privacy.disclosing_terms(docs, limit=limit).collect()) == set(once)
    # One text copied often, the others not.
    docs = spark.createDataFrame(corpus() + corpus()[:1] * 300, kind)
    assert set(privacy.disclosing_terms(docs, limit=limit).collect()) == set(once)


def test_one_text_alone_proves_nothing(spark):
    rows = [(0, " ".join(f"veltranic {chr(97 + i) * 4} kim@corp.example {chr(97 + i) * 5} " + "pad " * 20
                         for i in range(5)), "x")]
    rows += [(1 + i, f"common words, draft {i}", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    assert privacy.disclosing_terms(docs).count() == 0


@pytest.mark.parametrize("text, words", [
    ("Veltranic " + "0 | " * 400 + "kim@corp.example" + " " * 5000 + "Zorblat", {"veltranic", "zorblat"}),
    ("q" * 400 + " kim@corp.example " + "z" * 400, {"q" * 400, "z" * 400}),
    ("far one two three four five six seven eight, kim@corp.example",
     {"one", "two", "three", "four", "five", "six", "seven", "eight"}),
])
def test_nearest_words_are_whole_at_any_distance(text, words):
    found = privacy._near(text, privacy.base_spans(text))
    assert {t for _, t in found} == words | {None}


def test_overlapping_spans_are_masked_once():
    text = "call +1 408 555 0123 4567 now"
    spans = [(5, 3, 20), (6, 2, 25)]
    assert privacy.masked(text, spans, lambda a, b: None) == "call [PHONE] now"


def overlapping(found, taken):
    return [(a, b) for a, b in found if any(b > s and a < e for s, _, e in taken)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 3), st.integers(1, 20)), max_size=12),
       st.lists(st.integers(1, 6), max_size=15))
def test_terms_outside_of_spans(spans, steps):
    taken = sorted((a, k, a + n) for a, k, n in spans)
    found, at = [], 0
    for n in steps:
        found.append((at, at + n))
        at += n + 1
    free = privacy._outside(found, taken)
    assert sorted(free + overlapping(found, taken)) == found


def test_many_terms_and_spans_in_one_text():
    text = "kim@corp.example wrote " * 20_000
    base = privacy.base_spans(text)
    found = privacy.term_spans(text, {"wrote": "", "kim": ""}, base)
    assert len(base) == len(found) == 20_000


@pytest.mark.parametrize("limit", [200_000, 0])
def test_terms_are_generalised_to_the_kind_they_tell_about(spark, limit):
    # Each term stands beside its entity in 6 of the 10 texts that hold it.
    rows = [f"the {t} of {e} is {chr(97 + i) * 4}" for t, e in (("bureau", "kim@corp.example"), ("gateway", "10.1.2.3"))
            for i in range(6)]
    rows += [f"a {t} is like any other, draft {chr(97 + i) * 5}" for t in ("bureau", "gateway") for i in range(4)]
    rows += [f"the words of common texts, draft {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}" for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    terms = {r.term: (r.action, r.mask) for r in privacy.disclosing_terms(docs, limit=limit).collect()}
    assert terms == {"bureau": ("generalise", "[EMAIL CONTEXT]"), "gateway": ("generalise", "[IP CONTEXT]")}
    texts = {r.doc_id: r.text for r in privacy.sanitise(docs, limit=limit).collect()}
    assert texts[0] == "the [EMAIL CONTEXT] of [EMAIL] is aaaa"
    assert texts[6] == "the [IP CONTEXT] of [IP] is aaaa"
    assert texts[12] == "a [EMAIL CONTEXT] is like any other, draft aaaaa"
