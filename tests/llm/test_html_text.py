import re
import time

import pytest

from readalike.llm import html_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page has-sidebar">
<header><a href=/>Site</a> Our site, the best.</header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and we like them very much, so please accept all of them now.</p></div>
%s
<aside><p>Sidebar text, which is quite long and has punctuation, too. Really long text it is.</p></aside>
<section id="comments"><div class="comment"><p>I think, this is great. I read it twice, and liked it, very much so.</p></div></section>
<footer>&copy; 2024</footer></body></html>"""

CONTENT = """<h1>Head &amp; line</h1><p>First   paragraph, with <b>bold</b> and
<a href=x>a link</a>. It is long enough to be content, surely.<!-- no --><p>Second one.<script>var t = "</p>";</script>
<ul><li>item one<li>item&nbsp;two</ul><blockquote>A quote, here.</blockquote><table><tr><td>a<td>b</table>"""

EXPECTED = ("Head & line\nFirst paragraph, with bold and a link. It is long enough to be content, surely.\n"
            "Second one.\nitem one\nitem two\nA quote, here.\na\nb")


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>',
                                   '<article><div class="ad">Buy this, now, it is cheap.</div>%s<form>Mail: <input></form></article>'])
def test_content_is_whole_and_nothing_else(frame):
    assert html_text.main_text(PAGE % (frame % CONTENT)) == EXPECTED


@pytest.mark.parametrize("source,text", [
    ("", ""), ("just text < 5 & more", "just text < 5 & more"), ("<p>a<p>b", "a\nb"), ("<div>" * 5000 + "x", "x"),
    ("<nav>only a menu</nav>", ""), ("<p hidden>no</p><p>yes, this.</p>", "yes, this."), ("<script>never closed", ""),
    ("<p>&lt;b&gt; &#233; &amp;lt;</p>", "<b> é &lt;"), ("<!-- open <p>x</p>", "")])
def test_defined_cases(source, text):
    assert html_text.main_text(source) == text


@pytest.mark.parametrize("source,text", [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>a, b.</p>", "a, b."),
    ("<head><style>x</style><p>a, b.</p>", "a, b."), ("<head><title>T</title>a, b.", "a, b."),
    ("<head><script>x</script><noscript><img src=x></noscript></head><p>a", "a"),
    ("<p>a <svg viewBox='0 0'/> b</p><p>c", "a b\nc"), ("<p>a <math/>b<p>c", "a b\nc"),
    ("<p>a <svg><title>T</title><text>no</text></svg>b<p>c", "a b\nc"), ("<p>a <svg><style/><path d=1/></svg>b", "a b"),
    ("<p>a<svg><g><p>b", "a\nb"), ("<p>a <svg><foreignObject><p>no</p></foreignObject></svg>b", "a b"),
    ("<video-player>a, b.</video-player><p>c", "a, b.\nc"), ("<p>x<select-box>a</select-box><object-card>b</object-card>", "x\na\nb"),
    *((f"<div><p>a</p><{t}>no</div><p>b</p><p>c", "a\nb\nc") for t in ("object", "canvas", "video", "audio", "select")),
    *((f"<p>a <{t}><b>no</b></{t}>b", "a b") for t in ("object", "canvas", "video", "audio", "select", "template", "noscript")),
    ("<p>a<video src=x><p>b", "a\nb"), ("<p>a<script data-x='<b>'>no</script >b", "ab"), ("<p>a<iframe>no", "a")])
def test_embedded_elements_end(source, text):
    assert html_text.main_text(source) == text


def test_given_pages_yield_their_article(spark):
    import html
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in html_text.page_texts(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert found[page["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert found[page["page_id"]]["n_chars"] == len(found[page["page_id"]]["text"])


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a", "x"), (None, "u", "<p>a", "x"), (2, "u", "<p>" + "long, text. " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = [(r["page_id"], r["n_chars"]) for r in html_text.page_texts(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, 0), (None, 1), (None, 1), (2, 1_199_999)], key=str)
    assert html_text.page_texts(pages.limit(0)).count() == 0


PROSE = "The quick brown fox, which had slept, jumps over the lazy dog; then it rests. " * 3
LONG = f"<p>{PROSE}</p>"


def test_page_without_a_telling_name():
    source = ("<body><div><a href=1>Home</a> <a href=2>News and more</a></div><div><p>Side note, short.</p></div>"
              f"<div><div>{LONG * 6}</div></div><div><p>Other side, here.</p></div><div>Imprint. All rights reserved.</div></body>")
    assert html_text.main_text(source) == "\n".join([PROSE.strip()] * 6)


def test_sections_of_an_article_are_kept_whole_whatever_their_name():
    kept = [f'<section id="related-work">{LONG}</section>', f'<div class="search-algorithms">{LONG}</div>', f'<div id="discussion">{LONG}</div>',
            f'<div class="legal"><h2>Law</h2>{LONG}</div>']
    gone = ['<div class="related"><a href=1>One, two.</a><a href=2>Three.</a></div>', f'<div class="comment-list">{LONG}</div>',
            f'<div class="newsletter">{LONG}</div>', '<div class="share">Share this</div>', f'<aside>{LONG}</aside>']
    for order in (kept + gone, gone + kept, [x for pair in zip(kept, gone, strict=False) for x in pair] + gone[4:]):
        found = html_text.main_text(f"<body><article><h1>Title</h1>{LONG}{''.join(order)}</article></body>").split("\n")
        assert found == ["Title", *[PROSE.strip()] * 4, "Law", PROSE.strip()]


@pytest.mark.parametrize("depth", [100, 198, 199, 400, 5000])
def test_depth_changes_nothing(depth):
    assert "x, y" in html_text.main_text("<div><p>start, one." + "<b hidden>" * depth + "zz<div>x, y")


@pytest.mark.parametrize("source", [
    "<div></section>" * 50_000, "<head>" + "<noscript>" * 50_000, "<b hidden>" * 50_000 + "</i>" * 50_000, "<div><p>" * 50_000,
    "<i hidden><div>" + "<b hidden>" * 30_000 + "</i>" * 30_000, "<article>" + "<div class=related>" * 50_000, "<svg>" + "<g>" * 50_000 + "</a>" * 50_000])
def test_time_is_linear(source):
    started = time.perf_counter()
    html_text.main_text(f"<p>a, b.</p>{source}x, y.")
    assert time.perf_counter() - started < 4
