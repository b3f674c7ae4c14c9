"""Main text of hand-made pages, of all given pages against a plain reading of their one layout, and of odd rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from lorespark.llm.html_extract import FEED, extract_text, main_blocks, smoothed
from lorespark.llm.queries import QUERIES

LONG = "This sentence of the article says a good deal about its subject, and goes on for a while. "


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "landmarks": (
        page(f"<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><article><h1>Title</h1><p>{LONG}</p><p>Short.</p><ul><li>one<li>two</ul></article><aside>Read more {LONG}</aside></main><footer>&copy; {LONG}</footer>"),
        ["Title", LONG.strip(), "Short.", "one", "two"],
    ),
    "short article, long rest": (page(f"<div class=ad>{LONG * 3}</div><article><p>Tiny.</p></article><section id=comments><p>{LONG * 9}</p></section><footer>{LONG * 4}</footer>"), ["Tiny."]),
    "no landmarks": (page(f'<div id="nav"><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div id="c"><h2>Head</h2><p>{LONG * 3}<p>Mid.<p>{LONG * 2}<p>End.</div><div class="cookie-notice">We use cookies. {LONG}</div><ul><li><a href=x>imprint and contact</a></ul>'), ["Head", (LONG * 3).strip(), "Mid.", (LONG * 2).strip(), "End."]),
    "comments inside, form, script, style, button": (
        page(f'<article><p>{LONG}<button>Share</button>tail</p><script>var a = "<p>no</p>";</script><style>p {{}}</style><form><label>Name</label><input><p>Subscribe to us</p></form><div class="comment-list"><div class="comment"><p>{LONG}</p></div></div><p>Last</p></article>'),
        [LONG + "tail", "Last"],
    ),
    "references, white space, breaks": (page("<article><p>a&amp;b &lt;c&gt; &#233;&nbsp;&eacute;\n\t x<br>y <b>b</b>old</p><p> \n </p><p>&amp;amp; &unknown; 1 < 2 & 3</p></article>"), ["a&b <c> é é x y bold", "&amp; &unknown; 1 < 2 & 3"]),
    "ends without beginnings, cut off": (f"<html><body><nav><ul><li><a href=/>x</a></nav><article></b></section><p><b>{LONG}<p>and the rest is miss", [LONG.strip(), "and the rest is miss"]),
    "a cue around the whole page": (page(f'<div class="has-sidebar menu-open"><div class="sidebar"><p>{LONG}</p></div><main><p>{LONG * 2}</p><p>b</p></main></div>'), [(LONG * 2).strip(), "b"]),
    "header of the article": (page(f"<article><header><h1>Title</h1><p>by someone</p></header><p>{LONG}</p><footer>Tags: a, b</footer></article>"), ["Title", LONG.strip()]),
    "two parts of an article": (page(f"<main><section><p>{LONG}</p></section><section><p>{LONG}</p></section></main>"), [LONG.strip(), LONG.strip()]),
    "teasers that are articles": (page(f"<article><p>{LONG * 5}</p></article><div class=teasers><article><p>{LONG}</p></article><article><p>{LONG}</p></article></div>"), [(LONG * 5).strip()]),
    "table and list": (page(f"<article><p>{LONG}</p><table><tr><th>k<th>v<tr><td>a</td><td>1</td></tr></table><dl><dt>t<dd>d</dl></article>"), [LONG.strip(), "k v", "a 1", "t", "d"]),
    "hidden, roles": (page(f'<div role="navigation">{LONG}</div><div role=main><p>{LONG}</p><p hidden>{LONG}</p><p style="display: none">x</p></div><div role="alert">{LONG}</div>'), [LONG.strip()]),
    "a form around everything": (page(f"<form><article><p>{LONG}</p></article><input></form>"), [LONG.strip()]),
    "paragraphs that are divs": (page(f"<div><a href=1>1</a> <a href=2>2</a></div><div><div>{LONG * 4}</div><div>{LONG}</div></div>"), [(LONG * 4).strip(), LONG.strip()]),
    "link within the article": (page(f"<article><p><a href=a>{LONG}</a></p><p>{LONG}</p></article>"), [LONG.strip()] * 2),
    "plain text": ("just a few words", ["just a few words"]),
    "nothing": ("", []),
    "only a menu": (page("<nav><a href=/>Home</a></nav>"), []),
    "comment and declaration": (f"<!-- {LONG} --><![CDATA[ x ]]><article><p>{LONG}<!-- ad --></p></article>", [LONG.strip()]),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    text, want = CASES[name]
    assert main_blocks(text) == want


def test_long_pages_are_read_whole():
    n = FEED // len(LONG) + 5
    text = page("<article>" + f"<p>{LONG}</p>" * n + f"<p>{'word ' * FEED}</p></article>")
    blocks = main_blocks(text)
    assert len(blocks) == n + 1 and blocks[0] == LONG.strip() and len(blocks[-1]) == 5 * FEED - 1


def test_smoothing_is_a_mean_of_neighbours():
    import numpy as np

    x = np.array([0, 0, 0, 6.0, 0, 0, 0, 0])
    y = smoothed(x)
    assert len(y) == len(x) and abs(y.sum() - 6) < 0.1 and y.argmax() == 3 and abs(y[2] - y[4]) < 1e-9 and y[2] > y[1]


def plain_reading(text):
    body = re.search(r"<article>(.*?)(</article>|$)", text, re.S)[1]
    parts = (html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(t for t in (" ".join(x.split()) for x in parts) if t)


def test_query_equals_a_plain_reading_of_the_given_layout(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op11_html_extract"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain_reading(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_odd_rows(spark):
    rows = [(1, None, None, "mine", 1.5), (2, "u", "", None, None), (2, "u", "", None, None), (None, "u", f"<article><p>{LONG}</p></article>", "x", 2.0), (3, "u", "<<<>>&&&#;</p></", "x", 2.0), (4, "u", "<article><p>𝒳é</p></article>", "x", 2.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, __html double")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "html", "__html", "text", "n_chars"]
    got = sorted(((r.page_id, r.text, r.n_chars, r["__html"]) for r in out.filter("page_id is null or page_id <> 3").collect()), key=str)
    assert got == sorted([(1, "", 0, 1.5), (2, "", 0, None), (2, "", 0, None), (None, LONG.strip(), len(LONG) - 1, 2.0), (4, "𝒳é", 2, 2.0)], key=str)
    assert out.filter("page_id = 3").count() == 1 and extract_text(df.limit(0)).count() == 0
    assert out.filter(F.col("n_chars") != F.length("text")).count() == 0
