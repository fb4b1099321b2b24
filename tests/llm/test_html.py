import pytest

from histloom.llm import html_text as h

PARA = "This is what was said of it by all that were there, and it was not the first of its kind."
CASES = [
    ("", ""), (None, ""), ("<p></p>", ""), ("short text", "short text"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{PARA}<p><b>x</b>y</article>",
     f"T & U\n{PARA}\nxy"),
    (f"<div class='ad'>{PARA}</div><main><p>zz zz</p><aside>{PARA}</aside></main>", "zz zz"),
    (f"<article><div class='comments'><p>{PARA}</p></div><p>kept</p></article>", "kept"),
    (f"<article><header><h2>Head</h2><span>by me</span></header><p>{PARA}</article>",
     f"Head\n{PARA}"),
    (f"<header>{PARA}</header><div id=content><p>{PARA}</p><p>Tiny.</p><p>{PARA}</div>"
     f"<div class='cookie-notice'>{PARA}</div><form>{PARA}</form><footer>{PARA}</footer>",
     f"{PARA}\nTiny.\n{PARA}"),
    ("<article><script>var a = '</p>';</script><style>p{}</style><!-- <p>no</p> -->a\n\n  b</article>",
     "a b"),
    ("<article>one<br>two<br><br>three&nbsp;four</article>", "one two\nthree four"),
    ("<article><p title='a > b' data-x=it's>in</p><p hidden>out</p>"
     "<p style='display: none'>out</p><p role=navigation>out</p></article>", "in"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article>unclosed <p>text <i>here", "unclosed\ntext here"),
    ("<article><p>1 < 2 &lt; 3</p></article>", "1 < 2 < 3"),
    (f"<div><a href=a>{PARA}</a></div><p>{PARA}</p>", PARA),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages_by_hand(page, text):
    assert h.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<div id=content><p>{PARA}</p><p>Tiny.</p><p>{PARA}</p></div><footer>f</footer>"
     "<article><p>Read this next</p></article>", f"{PARA}\nTiny.\n{PARA}"),
    (f"<article><p>One says so.</p></article><nav>n</nav><div><p>{PARA}</p></div>", PARA),
    (f"<nav>n</nav><h1>T</h1><article><p>{PARA}</p><nav>n</nav><p>zz</p></article><p>yy</p><nav>n</nav>",
     f"T\n{PARA}\nzz"),
    (f"<div><p>{PARA}</p></div><nav>n</nav><article><p>{'zz ' * 30}</p><p>zz</p></article>",
     f"{PARA}\n{('zz ' * 30).strip()}\nzz"),
])
def test_text_outside_of_articles_is_judged_too(page, text):
    assert h.main_text(page) == text


@pytest.mark.parametrize("tag", [
    "article class=comment", "article class='teaser related'", "article hidden", "main aria-hidden=true",
    "article role=complementary", "article id='promo-2'", "main style='display: none'",
])
def test_attributes_of_articles_count(tag):
    name = tag.split()[0]
    assert h.main_text(f"<div><p>{PARA} Text.</p></div><{tag}><p>{PARA}</p></{name}>") == f"{PARA} Text."


@pytest.mark.parametrize("tag", [
    "article class='post tag-promo category-related'", "main role=main class='has-comments'", "article id=header",
    "article class='sidebar-left'",
])
def test_topics_of_articles_do_not_count(tag):
    assert h.main_text(f"<{tag}><p>{PARA}</p></{tag.split()[0]}>") == PARA


@pytest.mark.parametrize("page, text", [
    (f"<a name=top><h1>T</h1><p>{PARA}</p><p>{PARA}</p>", f"T\n{PARA}\n{PARA}"),
    (f"<article><a name='top' title='href=x'>{PARA}</a></article>", PARA),
    (f"<p><a href=x>Back<p>{PARA}</p><p>{PARA}</p>", f"{PARA}\n{PARA}"),
    (f"<a href=x>Back<div><p>{PARA}</p></div><a href=y>Next</a>", PARA),
    (f"<ul><li><a HREF = 'x'>a</ul><p>{PARA}</p><p><a>b</a></p>", f"{PARA}\nb"),
    # A closed link may hold blocks.
    (f"<a href=x><div><p>{PARA}</p></div><div>{PARA}</div></a><p>{PARA} Text.</p>", f"{PARA} Text."),
])
def test_links_end(page, text):
    assert h.main_text(page) == text


def test_open_blocks_inherit():
    assert h._inherited([True, None, None, False], [False] * 4) == [True, True, False, False]
    assert h._inherited([False, None, True], [False, True, False]) == [False, True, True]
    assert h._inherited([False, None, True], [False] * 3) == [False, False, True]
    assert h._inherited([None, None], [False] * 2) == [False, False]


def test_pages_table(spark):
    rows = [(i, f"u{i}", p, "q") for i, (p, _) in enumerate(CASES)] + [(None, None, CASES[4][0], None)]
    rows += [(99, "big", "<article>" + f"<p>{PARA}</p>" * 20_000, "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, N_CHARS string")
    got = h.extract(df).collect()
    want = {i: t for i, (_, t) in enumerate(CASES)} | {None: CASES[4][1]}
    want[99] = "\n".join([PARA] * 20_000)
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert h.extract(df.filter("false")).count() == 0
