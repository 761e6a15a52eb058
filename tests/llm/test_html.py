import re
from html import unescape

import pytest

from buslens.llm.html_text import extract, learn_weights, main_text
from tests.llm.helpers import ordered, with_clashes

PAGES = "page_id long, url string, html string"
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav>menu a b c</nav></header>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header><p>One&nbsp;two <b>three</b><br>four.</p>
<div class="ad-box">Buy now buy now buy now</div><form><input><label>Mail</label>Send</form><p>Five <a href=x>six</a> &lt;seven&gt;.
<script>var a="</p>"</script><!-- <p>no</p> --><ul><li>eight<li>nine</ul><section id="comments"><p>Nice post said he</p></section></article></main>
<aside class="sidebar"><p>Related words words words</p></aside><footer>foot</footer></body></html>"""
TEXT = "Head & line\nOne two three four.\nFive six <seven>.\neight\nnine"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def truth(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_all_kinds_of_furniture():
    assert main_text(PAGE, {}) == TEXT


def test_whole_table(spark, pages):
    found = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == truth(r.html)
        assert found[r.page_id].n_chars == len(truth(r.html)) and found[r.page_id].url == r.url


def test_learned_weights_find_unmarked_articles(pages):
    weights = learn_weights(pages)
    assert weights["p"] > 0 > weights["li"] and all(w < 0 for n, w in weights.items() if n.startswith("<"))
    for r in pages.collect():
        assert main_text(re.sub("</?article>", "", r.html), weights) == truth(r.html)


@pytest.mark.parametrize("html, text", [
    ("", ""), (None, ""), ("<p>x<", "x<"), ("plain words", "plain words"), ("<script>a", ""), ("<!-- a", ""), ("<nav>a b c</nav>", ""),
    ("<p>a  b\n\tc</p><p> </p><p>d", "a b c\nd"), ("<article><p>1 &lt; 2 &#233;</p></article>", "1 < 2 é"), ("<b>" * 5000 + "deep", "deep"),
    ("<div>" * 300 + "deep", "deep"), ("<div hidden>no</div><p>yes", "yes"), ('<div role="navigation">no</div><p>yes', "yes"),
])
def test_odd_pages(html, text):
    assert main_text(html, {}) == text


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p>a b</p>"), (2, None, "<p>a b</p>"), (3, "u", PAGE), (4, "u", "<p>" + "long text " * 50_000)]
    found = extract(with_clashes(spark.createDataFrame(rows, PAGES))).collect()
    want = [(None, None, "", 0), (1, "u", "", 0), (2, None, "a b", 3), (2, None, "a b", 3), (3, "u", TEXT, len(TEXT)), (4, "u", ("long text " * 50_000).strip(), 499_999)]
    assert ordered(found) == ordered(want)
    assert extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("card", ['<aside><article><p>a card</p></article></aside>', '<div class="related"><article><p>a card</p></article></div>'])
def test_articles_in_furniture_mark_nothing(pages, card):
    weights = learn_weights(pages)
    assert main_text(f"<body><div><p>The real text of the page.</p><p>It goes on.</p></div>{card}</body>", weights) == "The real text of the page.\nIt goes on."
    assert main_text(f"<body><div><p>The real text of the page.</p><p>It goes on.</p></div>{card}</body>", {}) == "The real text of the page.\nIt goes on."


def test_marked_pages_are_scored_by_learned_weights():
    html = '<body><article><p>Good words here.</p><div class="stamp"><p>Printed by machine.</p></div><p>More good words.</p></article></body>'
    assert main_text(html, {"p": 1.0, "article": 3.0, ".stamp": -9.0}) == "Good words here.\nMore good words."


@pytest.mark.parametrize("before, after", [
    ('<body class="no-sidebar"><article>', "</article>"), ("<body><article class='post comments-open'>", "</article>"),
    ('<body class="sidebar"><main class="with-sidebar">', "</main>"), ('<article><section id="social-history">', "</section></article>"),
    ('<div class="sidebar"><main>', "</main></div>"), ('<div id="social"><div><article>', "</article></div></div>"),
])
@pytest.mark.parametrize("weights", [{}, {".sidebar": -4.0, ".social": -4.0, ".comments": -4.0, "article": 4.0, "p": 1.0}])
def test_article_keeps_its_text_whatever_its_wrappers_are_called(before, after, weights):
    assert main_text(f'{before}<p>One two three.</p><div class="related-posts">no</div><p>Four.</p>{after}<div class="sidebar"><article>x</article></div>', weights) == "One two three.\nFour."


def test_other_compound_names_are_learned():
    assert main_text('<p>One two three.</p><div class="social-x"><p>Four.</p></div>', {".social-x": -4.0}) == "One two three."


@pytest.mark.parametrize("html, text", [
    ("<head><title>T</title><meta charset=x><style>p{}</style><body><article><p>One two.</p></article>", "One two."),
    ("<html><head><title>T</title><p>One two.", "One two."), ("<head><title>T<body><p>One two.", "One two."),
    ("<head><noscript><link rel=x></head><body><p>One two.", "One two."),
    *[(f"<div><p>One.</p><div><{t}><b>no</div><p>Two.</p></div>", "One.\nTwo.") for t in ("select", "object", "svg", "iframe", "noscript", "audio")],
    ("<p>One <svg><g><path d=x></g><p>Two.", "One\nTwo."), ("<p>One <svg><svg><text>a</text></svg><title>b</title></svg> two.", "One two."),
    ("<p>One <select><option>a<option>b</select> two.", "One two."), ("<div>One<script>a='</div>'", "One"),
    ("<div>One <object><object>a</object><div>b</div></object> two</div>", "One two"),
    ("<div>One <noscript><script>a=\"</div>\"</script>no</noscript> two</div>", "One two"),
])
def test_hidden_elements_end_with_what_is_around_them(html, text):
    assert main_text(html, {}) == text


@pytest.mark.parametrize("inline", [
    '<span class="ad">buy <span>now</span> or never</span>', '<a class="share" href=x>share <b>it</b></a>', "<span hidden>no</span>", '<a role="button">press</a>',
    '<b id="popup">x<br>y</b>', '<span class="ad"><div>buy</div> now</span>',
])
def test_inline_furniture_goes(inline):
    assert main_text(f"<article><div>One two {inline} <a href=x>three</a> <i>four</i>.</div><p>Five.</p></article>", {}).split() == "One two three four. Five.".split()


@pytest.mark.parametrize("html", [
    "<article><p>One <span class=ad>buy</p><p>Two.</p></article>", "<article><p>One <span class=ad>buy<p>Two.</article>",
    "<article><ul><li>One <a class=share>it<li>Two.</ul></article>", "<article><div>One <span class=ad>buy</div><p>Two.</article>",
])
def test_unclosed_inline_furniture_ends_with_its_block(html):
    assert main_text(html, {}) == "One\nTwo."


REAL = "<h2>Search algorithms</h2><p>A binary search halves the range.</p><p>It takes few steps.</p>"
REAL_TEXT = "Search algorithms\nA binary search halves the range.\nIt takes few steps."


@pytest.mark.parametrize("html, text", [
    (f'<article><section id="search">{REAL}</section></article>', REAL_TEXT),
    (f'<article><div class="social">{REAL}</div><p>end</p></article>', REAL_TEXT + "\nend"),
    (f'<article><div class="social"><div id="related">{REAL}</div></div><p>end</p></article>', REAL_TEXT + "\nend"),
    (f'<article><section id="search">{REAL}<div class="related">See too</div></section></article>', REAL_TEXT),
    (f'<article>{REAL}<div class="related"><p>Three other words.</p></div></article>', REAL_TEXT),
    ('<article><p>Short.</p><div class="related"><a href=x>One long title</a> <a href=y>another title</a></div></article>', "Short."),
    (f'<article><p>Short.</p><section id="comments">{REAL}</section></article>', "Short."),
    (f'<article>{REAL}<div id="user-comments"><p>Nice post.</p></div></article>', REAL_TEXT),
    (f'<article><p>Short.</p><div class="reader_feedback">{REAL}</div></article>', "Short."),
    (f'<article>{REAL}<div class="CommunityDiscussion"><p>No.</p></div></article>', REAL_TEXT),
])
@pytest.mark.parametrize("learned", [False, True])
def test_names_of_furniture_are_no_veto_on_content(pages, html, text, learned):
    assert main_text(f"<body>{html}<footer>foot</footer></body>", learn_weights(pages) if learned else {}) == text


ITEMS = [f"The item number {k} says a little." for k in range(6)]
MENU = "<ul>" + "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(6)) + "</ul>"


@pytest.mark.parametrize("body, text", [
    ("<div><h1>Head of it</h1><p>Some words come first here.</p><ul>" + "".join(f"<li>{i}" for i in ITEMS) + "</ul></div>", ["Head of it", "Some words come first here.", *ITEMS]),
    ("<div><p>Some words come first here.</p><ol>" + "".join(f"<li>{i} <a href=x>See it</a></li>" for i in ITEMS) + "</ol><p>And last.</p></div>",
     ["Some words come first here.", *[i + " See it" for i in ITEMS], "And last."]),
    ("<div><p>Words before.</p><table><tr><td>One cell</td><td>Two cells</td></tr></table><p>Words behind it.</p></div>", ["Words before.", "One cell", "Two cells", "Words behind it."]),
    ("<div><p>Words before.</p><blockquote>Quoted by them.</blockquote><pre>x = 1</pre><p>Words behind it.</p></div>", ["Words before.", "Quoted by them.", "x = 1", "Words behind it."]),
    ("<section><div>" + " ".join(ITEMS) + "</div><div>" + " ".join(ITEMS) + "</div></section>", [" ".join(ITEMS)] * 2),
])
def test_unmarked_pages_of_other_templates(pages, body, text):
    weights = learn_weights(pages)
    for before, behind in (("", ""), (MENU, MENU), ("<nav>" + MENU + "</nav>", "<footer>foot</footer>")):
        assert main_text(f"<body>{before}{body}{behind}</body>", weights).split("\n") == text
    assert main_text(f"<body><article>{body}</article>{MENU}</body>", weights).split("\n") == text
