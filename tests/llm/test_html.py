"""Main text of pages against what their writers put there."""

import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from depthforge.llm import html
from depthforge.llm.common import table
from depthforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, text string, key int"
LONG = "There are many things that we would like to know about the history of this town, and some of them can be found in the archive that is kept in the old house by the river, where they have been for a long time."


def frame(spark, pages):
    return spark.createDataFrame([(i, f"u{i}", p, "t", 1) for i, p in enumerate(pages)], SCHEMA)


def between_tags(page):
    """The article of the given tables, cut at its block tags."""
    article = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = between_tags(p.html)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


ARTICLE = "<article><header><h1>A title</h1></header><p>Short.<p>" + LONG + "<ul><li>One<li>Two</ul><p>zzz qqq"
WANT = "A title\nShort.\n" + LONG + "\nOne\nTwo\nzzz qqq"


@pytest.mark.parametrize(
    "before, after",
    [
        ("<header><a href=/>Site</a> <p>Our slogan that is for you and the others in this town</header>", "<footer><p>" + LONG + "</footer>"),
        ("<div class='cookie-notice'><p>" + LONG + "</div>", "<aside><p>" + LONG + "</aside>"),
        ("<form><p>" + LONG + "<input><button>Go</button></form>", "<section id=comments><article class=comment><p>" + LONG + "</article></section>"),
        ("<div id='sidebar'><div>" + LONG + "</div></div>", "<div class=\"ad\">" + LONG + "</div>"),
        ("<script>var t='<article><p>no</article>';</script><style>p{}</style><!-- <p>no -->", "<noscript><p>no</noscript><template><p>no</template>"),
        ("<nav><ul><li><a href=a>The one</a><li>and the other</ul></nav>", "<div role='navigation'>no</div><p style='display: none'>no</p>"),
        ("<p>Somebody said something here.", "<p>And something there."),
        ("<form action='/all'><div class='page with-sidebar'>", "</div></form>"),
        ("<main><h2 hidden>no</h2>", "<div class=related><a href=x>More</a></div></main>"),
    ],
)
def test_around_an_article(before, after):
    assert html.main_text(f"<!DOCTYPE html><html><head><title>no</title></head><body>{before}{ARTICLE}</article>{after}</body></html>") == WANT


@pytest.mark.parametrize("inner", ["<div class=ad>Buy the best</div>", "<aside>" + LONG + "</aside>", "<div class='comments'><p>" + LONG + "</div>", "<ul><li><a href=a>Read this too</a><li><a href=b>And that</a></ul>", "<footer>By the author</footer>", "<div class='share-bar'>Share this</div>"])
def test_inside_an_article(inner):
    assert html.main_text(f"<body><article><h1>A title</h1><p>{LONG}</p>{inner}<p>The end.</p></article></body>") == f"A title\n{LONG}\nThe end."


def test_without_an_article():
    """The figures decide: lists of links and the copyright go, short text between long text stays."""
    page = f"""<body><div><a href=/>Home</a> | <a href=/b>News</a> | <a href=/c>About</a></div><div>Welcome</div>
    <div><h1>A title</h1><div>{LONG}</div><div>Short one.</div><div>{LONG}</div><div>Qxz vbn mkl wrt plk jhg fds qwe zxc vbn mkl wrt plk jhg fds qwe zxc vbn</div></div>
    <div><a href=1>One story that is told</a><a href=2>Another story that is told</a></div><div>Imprint</div><div>© 2020 by the town and all of its people who have been here for a long time, and some others</div></body>"""
    assert html.main_text(page) == f"A title\n{LONG}\nShort one.\n{LONG}"


def test_labels_come_from_neighbours():
    block = lambda text, linked=0, heading=0: html.Block(linked=linked, heading=heading, text=text)
    short, link = block("Short one."), block("A link", 6)
    run = lambda *bs: [b.label for b in html.label([block(b.text, b.linked, b.heading) for b in bs])]
    good = block(LONG)
    assert run(good, short, good) == ["good"] * 3
    assert run(link, short, link) == ["bad"] * 3
    assert run(short) == ["bad"] and run() == []
    assert run(link, short, short, short, good, short) == ["bad", "bad", "good", "good", "good", "good"]
    assert run(link, short, short, short, short, good) == ["bad", "bad", "bad", "good", "good", "good"]
    near = block("The words that are in it and some more of them than before, Qxz vbn mkl wrt plk jhg fds.")
    assert run(link, near, short, good) == ["bad", "good", "good", "good"] and run(good, link, near, link) == ["good", "bad", "bad", "bad"]
    assert run(link, block("Title", heading=1), short, short, good)[1] == "good"


def test_a_page_of_undecided_blocks():
    """The text is where most words are: blocks near text if there are any, else the longest run of short ones, if it has a few words."""
    nav = "<div><a href=a>One</a> <a href=b>Two</a></div>"
    one = "<div>The words that are in it and some more of them than before, Qxz vbn mkl wrt plk jhg fds.</div>"
    assert html.main_text(f"<div>Slogan of the day</div>{nav}<h1>Title</h1>{one}<div>Short.</div>{nav}<div>Imprint</div>") == "Title\nThe words that are in it and some more of them than before, Qxz vbn mkl wrt plk jhg fds.\nShort."
    assert html.main_text(f"{nav}<p>Only a few words here.</p><p>And more.</p>{nav}<p>Imprint</p>") == "Only a few words here.\nAnd more."
    assert html.main_text(f"{nav}<p>Imprint</p>{nav}") == ""


def test_comments_under_a_heading():
    """What follows a heading of comments, up to the next heading of its level, isn't the article's."""
    page = f"<article><h1>A title</h1><p>{LONG}</p><h2>Comments (2)</h2><p>{LONG}</p><h3>Somebody</h3><p>Not so.</p><h2>How it ends</h2><p>Well.</p></article>"
    assert html.main_text(page) == f"A title\n{LONG}\nHow it ends\nWell."
    assert html.main_text(f"<div><h1>Comments</h1><p>{LONG}</p><h2>Leserkommentare</h2><p>{LONG}</p></div>") == f"Comments\n{LONG}"


@pytest.mark.parametrize("mark", ["adSlot", "ad-box", "leftSidebar", "topnav", "commentList", "cookieBanner", "site-notification", "userComments", "shareBar", "footerLinks"])
def test_marks_written_together(mark):
    assert html.main_text(f"<div><h1>A title</h1><p>{LONG}</p><div class='x {mark}'><p>{LONG} And so on.</p></div></div>") == f"A title\n{LONG}"


def test_frames_and_headers():
    """A marked element around the text is the page's frame; a header in an article is its own."""
    assert html.main_text(f"<form><div class='page social-theme'><div class=header>Our site</div><h1>A title</h1><p>{LONG}</p></div></form><div class=footer>no</div>") == f"A title\n{LONG}"
    assert html.main_text(f"<div class=header><h1>Our site</h1></div><article><div class=header><h1>A title</h1></div><p>{LONG}</p></article>") == f"A title\n{LONG}"
    assert html.main_text(f"<div class=post-header><h1>A title</h1></div><p>{LONG}</p><p class=commentary>{LONG}</p>") == f"A title\n{LONG}\n{LONG}"


def test_references_and_space():
    page = "<article><p>a&nbsp;b\n\t c &amp; d &lt;e&gt; &eacute;&#233;&#xe9; &am; &amp &unknown; 5 < 6 &copy;<br>f<b>g</b>h<br/><br>second <i>line</i></p></article>"
    assert html.main_text(page) == "a b c & d <e> ééé &am; & &unknown; 5 < 6 © f gh".replace("f gh", "fgh") + "\nsecond line"


def test_broken_markup():
    """Cut off or unclosed: what is known stays."""
    assert html.main_text(f"<article><p>{LONG}<p>Then <b>bold") == f"{LONG}\nThen bold"
    assert html.main_text(f"<article><p>{LONG}<!-- cut") == LONG and html.main_text(f"<article><p>{LONG}<script>if (a") == LONG and html.main_text(f"<article><p>{LONG}<a hre") == LONG
    assert html.main_text(f"<body><div class=ad>Buy<article><p>{LONG}</article>") == LONG
    assert html.main_text(f"<nav><ul><li><a href=a>The link</a><article><p>{LONG}</b></div></article></nav>") == ""
    assert html.main_text(f"<p>{LONG}<P CLASS=AD>Buy<p>{LONG}") == f"{LONG}\n{LONG}"
    assert html.main_text(f"<article data-class='ad'><p title='a > b'>{LONG}</article>") == LONG
    assert html.main_text(LONG) == LONG and html.main_text("<") == html.main_text("<<<>") == ""


def test_edges(spark):
    pages = [None, "", " ", "<p>", "<article></article>", "<article>Only this</article>", "<article>Only this</article>"]
    got = html.extract(frame(spark, pages)).select("key", "text").orderBy("key").collect()
    assert [r.text for r in got] == ["", "", "", "", "", "Only this", "Only this"]
    assert html.extract(frame(spark, [])).count() == 0
    null = spark.createDataFrame([(None, None, "<article>Only this</article>", None, None)], SCHEMA)
    assert html.extract(null).head() == (None, None, "Only this")
    rows = html.extract(frame(spark, [f"<nav>no</nav><p><a href=a>Link</a><p>{LONG}"]), all_blocks=True).select(F.explode("blocks").alias("b")).select("b.*").collect()
    assert [(r.text, r.label, r.linked) for r in rows] == [("Link", "bad", 4), (LONG, "good", 0)]


@pytest.mark.parametrize("unit", ["<div class=ad>", "<article>", "<p>word ", "</div>", "<a href=\"", "<a href='x>", "<!--", "<b", "<br>", "<a>x", "<script>", "<td><li>", "&amp", "<article><div class=ad></div></article>", "<title>", "<header>"])
def test_time_is_linear(unit):
    """A page of a megabyte of any broken markup takes seconds."""
    began = time.perf_counter()
    html.main_text(f"<article><p>{LONG}</p></article>" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20
