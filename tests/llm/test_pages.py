"""Main texts of pages with known articles."""

import html
import os
import re

import pytest

from methmix.llm import pages
from methmix.llm.pages import extract

FOLDER = "/root/testdata/sf0.01"
ARTICLE = "<h1>Title</h1><p>A first paragraph, with some length. It has marks, too.</p><p>The second &amp; last one, longer than a menu.</p>"
TEXT = "Title A first paragraph, with some length. It has marks, too. The second & last one, longer than a menu."


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_every_page_gives_its_article(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = pages.op7_html_extract(spark, FOLDER).collect()
    assert len(found) == len(source)
    for r in found:
        inner = re.search(r"(?s)<article>(.*?)</article>", source[r["page_id"]]).group(1)
        inner = re.sub(r"</?b>", "", inner).replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == " ".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page", [
    "<body><nav><a>Home</a></nav><article>{}</article><footer>Foot, note.</footer></body>",
    "<body><header><h1>Site</h1></header><main>{}</main><aside>Side, bar. And more, of it.</aside></body>",
    "<body><div class='nav-bar'>Menu, one. Two.</div><div id='content'>{}</div><div class='comments'><p>Nice, one. Really, nice.</p></div>",
    "<div class='sidebarLeft'><p>x</p></div><div class=post>{}<form>Name, please. <input></form><script>a('</p>')</script></div>",
    "<div><div class='cookie-notice'>We use cookies, as all do. Accept, please.</div>{}<style>p{{}}</style></div>",
    "<article><header>{}</header><section class='related'><p>Other, things. To, read.</p></section></article><div class=ad>Buy, now. Or, never.",
])
def test_boilerplate_is_left_out(page):
    assert extract(page.format(ARTICLE)) == TEXT


def test_markup_of_many_kinds():
    assert extract("<p>on<b>e</b>\n\t two<br>three") == "one two three"
    assert extract("<ul><li>a, b.<li>c, d.</ul>") == "a, b. c, d."
    assert extract("<table><tr><td>x, y.<td>z.<tr><td>w.</table>") == "x, y. z. w."
    assert extract("&lt;p&gt; &#233;&eacute;&nbsp;&amp;amp; &am") == "<p> éé &amp; &am"
    assert extract("<article><p>open <i>never <b>closed") == "open never closed"
    assert extract("</p></div>stray <!-- no --> ends") == "stray ends"
    assert extract("<div>" * 5000 + "deep, text." + "</div>" * 10) == "deep, text."


def test_null_empty_long_and_clash(spark):
    long = "<article>" + "<p>" + "word, " * 50_000 + "</p>" + "<p>tail.</p>" * 3000 + "</article>"
    kind = "page_id long, url string, html string, `Key` string"
    data = spark.createDataFrame([(1, None, None, "k"), (2, "u", "", "k"), (3, "u", long, "k"), (3, "u", long, "k"), (None, "u", "<script>x</script>", "k")], kind)
    found = sorted((str(r["page_id"]), r["n_chars"], len(r["content"]), r["Key"]) for r in pages.extract_content(data).collect())
    size = len(("word, " * 50_000).strip()) + 3000 * len(" tail.")
    assert found == [("1", 0, 0, "k"), ("2", 0, 0, "k"), ("3", size, size, "k"), ("3", size, size, "k"), ("None", 0, 0, "k")]
    assert pages.extract_content(data.limit(0)).collect() == []
    clash = pages.extract_content(data.withColumnRenamed("Key", "Content"))
    assert "Content" not in clash.columns and clash.count() == 5


@pytest.mark.parametrize("page", [
    "<div id='page' class='site has-sidebar'><main><article>{}</article></main></div>",
    "<div class='with-sidebar'><article>{}</article><div class='sidebar'><p>Side, bar. And more.</p></div></div>",
    "<body class=x><div class='no-ads'>{}</div><footer>Foot, note.</footer></body>",
    "<div class='nav-open'><div>{}</div><div class='comments'><p>Nice, one. Really, nice.</p></div></div>",
    "<div class='social-page'><section>{}</section></div>",
    "<body><form action=x><nav><a>Home</a></nav><div>{}</div><input></form></body>",
    "<article>{}</article><div class='related'><article><p>Other, things. To, read.</p></article></div>",
    "<div>{}</div><div class='comments'><article><p>Nice, one. Really, nice.</p></article></div>",
])
def test_marks_do_not_take_the_article(page):
    assert extract(page.format(ARTICLE)) == TEXT


def test_paths_over_the_threshold_outside_the_container_stay():
    lead = "A lead of some length, in a place of its own. It opens, and it tells, what comes next."
    body = "".join(f"<p>Paragraph {i} of the story, which goes on, and on. It has marks, too, and is long.</p>" for i in range(12))
    found = extract(f"<div class=page><div><h1>Title</h1><p>{lead}</p></div><div><div>{body}</div></div></div>")
    assert found.startswith(f"Title {lead} Paragraph 0") and "Paragraph 11" in found


PROSE = "A sentence of the article, long enough to count. " * 12


def test_deep_pages_hide_scripts_and_menus():
    """Below the tracked depth, what is unseen or boilerplate stays out, and end tags find their own elements."""
    script = "<script>alert('x')</script><style>.a{b:c}</style>"
    fonts = f"<html><body><article><p>{PROSE}" + "<font>" * 420 + f"the end{script}</p></article></body></html>"
    assert pages.extract(fonts) == f"{PROSE}the end"
    divs = "<html><body><div>" + "<div>" * 420 + "<script>var x=1;</script><nav>Menu nav</nav>" + f"<p>{PROSE}</p>" + "</div>" * 420 + "</div></body></html>"
    assert pages.extract(divs) == PROSE.strip()
    closed = "<html><body><article>" + "<div>" * 450 + "<p>one</p>" + "</div>" * 450 + f"<p>{PROSE}</p></article><footer>foot</footer></body></html>"
    assert pages.extract(closed) == f"one {PROSE}".strip()


def test_article_within_a_fieldset():
    assert pages.extract(f"<body><form><fieldset><p>{PROSE}</p></fieldset></form></body>") == PROSE.strip()
    assert pages.extract(f"<body><article><p>{PROSE}</p></article><fieldset>Your name <input></fieldset></body>") == PROSE.strip()
