"""Main text of hand-made and given pages."""

import html
import re

from corpusloom.llm.main_text import extract_main_text, main_blocks

PARA = "This is a paragraph of the article, long enough to count, with commas, and with words."


def text(page):
    return "\n".join(main_blocks(page))


def test_cuts_what_is_no_article():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>if (a<b) "</p>"</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li>menu</li></ul></nav><div class="sidebar widget"><p>{PARA} side</p></div>
    <div class="cookie-notice">We use cookies, and more, and more.</div>
    <main><article><h1>Title &amp; more</h1><p>{PARA}</p><p>One <b>two</b>\n three<br>four&nbsp;five.</p><ul><li>first item</li><li>second
    item</li></ul><div class="ad banner">Buy, buy, buy now, and save money today, friends.</div><blockquote>Quoted &lt;words&gt;.</blockquote>
    <form><label>Mail</label><input></form><section id="comments"><p>Reader comment, {PARA}</p></section></article></main>
    <aside><p>{PARA}</p></aside><footer>&copy; somebody</footer></body></html>"""
    assert text(page).split("\n") == ["Title & more", PARA, "One two three four five.", "first item", "second item", "Quoted <words>."]


def test_container_without_article_element():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three, and more, and more words here</a></div><div id=c><p>{PARA}</p><p>{PARA}</p></div><div class=comments><p>{PARA}</p></div></body>"
    assert text(page) == f"{PARA}\n{PARA}"


def test_unclosed_and_crossed_elements():
    page = f"<article><p><b>{PARA}<br><p>{PARA}<p>last <i>words</b> here</i></article><footer>x"
    assert text(page).split("\n") == [PARA, PARA, "last words here"]


def test_edges():
    assert [text(p) for p in (None, "", "  ", "<script>x</script>", "<!-- only -->", "<p></p>")] == [""] * 6
    assert text("just words") == "just words"
    assert text("a < b & c &#x41;&eacute;") == "a < b & c Aé"
    assert text("<div " + "<div>" * 3000 + "deep words" + "</div>" * 3000) == "deep words"
    assert text("<p>" + "long words, " * 60000) != ""
    assert text('<p title="a>b">quoted, attribute</p>') == "quoted, attribute"


def test_whole_article_with_uneven_sections():
    many = "".join(f"<p>{PARA}</p>" for _ in range(10))
    page = f"<body><nav>menu</nav><article>Bare lead.<section>{many}</section><section><h2>Short</h2><p>{PARA}</p></section><ul><li>tea</li></ul><p>End.</p></article></body>"
    assert text(page).split("\n") == ["Bare lead.", *[PARA] * 10, "Short", PARA, "tea", "End."]


def test_article_header_beside_its_body():
    many = "".join(f"<p>{PARA}</p>" for _ in range(10))
    for outer in ("article", "main"):
        page = f"<body><header>site</header><{outer}><header><h1>Title</h1></header><div class=body>{many}</div></{outer}><footer>x</footer></body>"
        assert text(page).split("\n") == ["Title", *[PARA] * 10]
    page = f"<main><article><div><p>One.</p></div></article><article><div>{many}</div></article></main>"
    assert text(page).split("\n") == ["One.", *[PARA] * 10]


def test_siblings_without_article_element():
    many = "".join(f"<p>{PARA}</p>" for _ in range(10))
    menu = "<div><a href=1>one</a> <a href=2>two, and more words here</a></div><a href=3>three</a>"
    page = f"<body>{menu}<h1>Title</h1>Bare <b>bold</b> text, <a href=4>see</a> below.<div>{many}</div><ul><li>tea</li><li>milk</li></ul><p>Short end.</p>left{menu}<x-tail>tail</x-tail></body>"
    assert text(page).split("\n") == ["Title", "Bare bold text, see below.", *[PARA] * 10, "tea", "milk", "Short end.", "left", "tail"]
    assert text(page.replace("tail<", "<p>tail<")).split("\n")[-2:] == ["left", "tail"]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract_main_text(pages, keep=("page_id", "url"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert found[r.page_id].text == "\n".join(filter(None, blocks))
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5)], "page_id long, html string, text int")
    assert [(r.page_id, r.text, r.n_chars) for r in extract_main_text(df).collect()] == [(1, "", 0)] * 2
    assert extract_main_text(df.limit(0)).count() == 0


def test_quotes_and_cut_off_tags():
    assert text(f"<article><p data-x=it's>{PARA}</p><p>isn't it</p></article>") == f"{PARA}\nisn't it"
    assert text(f"<article><p>{PARA}</p><p>text<p class=\"a") == f"{PARA}\ntext"
    assert text(f"<p a='>'>{PARA}</p>") == PARA


def test_hidden_is_an_attribute_not_a_class():
    page = f'<main><div class="md:flex hidden lg:block"><p>{PARA}</p></div><p hidden>gone</p><p aria-hidden="true">gone</p><p style="display:none">gone</p><p title="hidden x">stays here</p></main>'
    assert text(page) == f"{PARA}\nstays here"


def test_forms():
    assert text(f"<body><form id=aspnet><input name=q><nav>menu</nav><div><p>{PARA}</p><p>{PARA}</p></div><button>Go</button></form></body>") == f"{PARA}\n{PARA}"
    assert text(f"<body><main><p>{PARA}</p><p>{PARA}</p><form><p>Your name please</p></form></main></body>") == f"{PARA}\n{PARA}"


def test_names_of_other_parts():
    kept = f'<p class="social-history">{PARA}</p><header class="entry-header"><h2>Title</h2></header><section class="menu-planning"><p>{PARA}</p></section>'
    cut = "".join(f'<div class="{c}"><p>{PARA} cut</p></div>' for c in ("social-links", "related-posts", "cookie-consent", "comment-list", "ad-slot-wrapper", "siteSidebar", "newsletter signup"))
    page = f'<body class="has-sidebar"><article>{kept}{cut}<p>The end.</p></article></body>'
    assert text(page).split("\n") == [PARA, "Title", PARA, "The end."]
    assert text(f'<div class="layout-sidebar"><h1>Head</h1><p>{PARA}</p></div>').split("\n") == ["Head", PARA]


def test_formula():
    assert text(f"<article><p>{PARA} Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold.</p></article>") == f"{PARA} Let x=2 hold."


def test_crossed_inline_end_tags():
    assert text(f"<article><b><div><p>{PARA}</p></b><p>inside</p></div></article>") == f"{PARA}\ninside"


def test_time_grows_with_the_length():
    import time

    for piece in ("<div>", "</b>", '<p a="', "<b", "<p><table><td><div>", "<ul><li>", "<a>", "<!--", "<form><p>word "):
        times = []
        for n in (4000, 16000):
            start = time.perf_counter()
            main_blocks("<p>some words</p>" + piece * n)
            times.append(time.perf_counter() - start)
        assert times[1] < 8 * times[0] + 0.3, piece


FAMILY_A = """<html><body class="page"><div id="top-nav"><ul><li><a href=#>Home</a></li></ul></div><div class="columns"><div class="col-main"><h1>{t}</h1><div class="byline">By someone</div>{body}</div>
<div class="col-side sidebar"><p>Read more, much more, and even more of this.</p></div></div><div class="site-footer">foot</div></body></html>"""
FAMILY_B = """<div class=wrap><header><h2>Site</h2></header><section><h1>{t}</h1>{body}<div class=share-buttons><a>x</a></div></section><section class="user-comments"><p>Nice, very nice, I think.</p></section></div>"""


def test_two_families_without_article():
    body = "".join(f"<p>{i} {PARA}</p>" for i in range(4))
    blocks = [f"{i} {PARA}" for i in range(4)]
    assert text(FAMILY_A.format(t="A title", body=body)).split("\n") == ["A title", "By someone", *blocks]
    assert text(FAMILY_B.format(t="A title", body=body)).split("\n") == ["A title", *blocks]
