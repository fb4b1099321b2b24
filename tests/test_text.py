import os.path
import random
import re

from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx


def test_character_classes_cover_unicode():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert {c for c in points if c.isspace()} == set(fv.WHITESPACE_CHARS)
    assert {c for c in points if len(f"a{c}b".splitlines()) == 2} == set(fv.LINE_BREAK_CHARS)


def test_text_expressions_equal_python(spark):
    rng = random.Random(1)
    pieces = [
        "a", "b c", " ", "\n", "\r", "\r\n", "\x0b", "\x1c", "\x85", " ", "　", "  ",
        "Signed-off-by: x", "Fixes: #1", "(cherry picked from y)", "\n\n", "<!--", "-->", "é", ".",
    ]
    rows = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(2000)]
    rows += ["Fixes: a\n" + "\n" * 200000 + "x", "<!--" + "x\n" * 200000 + "-->y"]
    t = F.col("t")
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(
        "t", tx.count_words(t), F.size(tx.words(t)), tx.line_count(t),
        tx.strip_html_comments(t), tx.strip(t),
    )
    for r in got.collect():
        s = r[0]
        n = len(s.split())
        uncommented = re.sub(r"<!--.*?-->", "", s, flags=re.S).strip()
        assert r[1:] == (n, n, len(s.splitlines()), uncommented, s.strip())


def test_trailers_are_removed(spark):
    cases = [
        ("text\n\nSigned-off-by: x", "text"),
        ("text\nFixes: #1\n\n\nmore", "text\nmore"),
        ("Signed-off-by: x", ""),
        ("a\n\nb", "a\n\nb"),
        ("a\n(cherry picked from y)\nb", "a\nb"),
        ("a\n  Signed-off-by: x\n \nb\n", "a\nb"),
        ("  a  ", "a"),
        ("", ""),
    ]
    rng = random.Random(8)
    pieces = ["a", "", " ", "Signed-off-by: x", "Fixes: 2", "  Fixes: 3", "b c"]
    drawn = ["\n".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(300)]
    texts = [text for text, _ in cases] + drawn
    once = tx.strip_trailers(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", once.alias("s"))
    rows = df.select("t", "s", tx.strip_trailers(F.col("s")).alias("again")).collect()
    assert [r.s for r in rows[: len(cases)]] == [want for _, want in cases]
    for r in rows:
        lines = [line.strip() for line in r.s.splitlines()]
        assert not any(line.startswith(fv.TRAILER_PREFIXES) for line in lines)
        assert r.again == r.s
        kept = [x.strip() for x in r.t.splitlines() if not x.strip().startswith(fv.TRAILER_PREFIXES)]
        assert [x for x in lines if x] == [x for x in kept if x]


def test_null_texts(spark):
    t = F.col("t")
    row = spark.createDataFrame([(None,)], "t string").select(
        tx.count_words(t), tx.line_count(t), tx.strip_trailers(t), tx.strip_html_comments(t)
    )
    assert tuple(row.first()) == (0, 0, "", "")


def test_paths_equal_python(spark):
    paths = [
        "a.py", ".gitignore", "..a.b", "d.x/f", "d.x/.f", "a.", "a/b.c.d", "", "/", "x/.a.b",
        "....", ".a.", "a/..b", "é.PY", "a b.c",
    ]
    p = F.col("p")
    got = spark.createDataFrame([(x,) for x in paths], "p string").select("p", tx.file_ext(p), tx.basename(p))
    for path, ext, base in got.collect():
        assert (ext, base) == (os.path.splitext(path)[1], os.path.basename(path))


def test_message_split_and_language(spark):
    df = spark.createDataFrame([("s\nb\nc",), ("only",), ("",)], "m string")
    m = F.col("m")
    assert [tuple(r) for r in df.select(tx.subject(m), tx.body(m)).collect()] == [
        ("s", "b\nc"), ("only", ""), ("", ""),
    ]
    names = spark.createDataFrame([("a.PY",), ("b.tsx",), ("c.yml",)], "p string")
    assert [r[0] for r in names.select(tx.language(F.col("p"))).collect()] == ["python", None, "yaml"]


def test_few_words_are_told_from_the_beginning(spark):
    rng = random.Random(4)
    words = ["a", "bc", "x" * 300, " ", "\n", "\u3000", "\x85 ", "  ", "é"]
    rows = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(500)] + ["", " ", " " * 5000 + "a b"]
    t = F.col("t")
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "t string")
    for n in (0, 1, 2, 20):
        for r in df.select("t", tx.fewer_words_than(t, n), tx.words_up_to(t, n)).collect():
            count = len((r[0] or "").split())
            assert r[1] == (count < n) and (r[2] == count or (r[2] >= n and count >= n))
