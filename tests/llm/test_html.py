"""Main text of pages against plain cutting, and fixed cases."""

import html
import re

import numpy as np
import pytest

from spokeframe.llm import htmltext
from spokeframe.llm.htmltext import main_text

P1, P2 = "A first paragraph, long enough to be seen as content of the page.", "A second one, of many words as well, so that it counts too."
REST = (
    '<header><h1>Site</h1><p>A slogan that has quite a few words in it, for a header at least</p></header><div class="main-menu"><a href="/">Home</a> <a href="/x">X</a></div><div role="navigation">Go</div>'
    '<div class="cookieNotice">We use cookies, as everyone does, and say so in many words</div><form>Name <input></form><script>var a = "</p>";</script><style>p{}</style><aside>Side</aside><div class="ad-slot">Buy</div>'
)
COMMENTS = '<section id="comments"><article class="comment"><p>A reader says a lot of things here, in a comment that is longer than the article itself, by far, as they do.</p></article></section><footer>&copy;</footer>'


def test_given_pages(spark):
    """Pages of the test tables have one article, which a regular expression cuts out."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "\n", inner)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    assert len(got) == pages.count()


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>', '<div id="text">{}</div>', '<section class="story has-sidebar">{}</section>'])
def test_article_alone(around):
    inner = f'<h1>Ti<b>t</b>le</h1><p>{P1}<p>Ok.<p class="ad">Buy<p>{P2}<ul><li>one<li>two</ul><div class="share">Share</div>'
    for page in (REST + around.format(inner) + COMMENTS, f"<body>{REST}<div>{around.format(inner)}</div>{COMMENTS}</body>", f'<form id="page">{REST}{around.format(inner)}{COMMENTS}</form>'):
        assert main_text(page) == f"Title {P1} Ok. {P2} one two"


CASES = {
    None: "",
    "": "",
    " \n ": "",
    "plain &lt;text&gt; &am &amp": "plain <text> &am &",
    "<nav>Menu</nav><footer>x</footer>": "",
    "<article></article>": "",
    "<p>a<!-- b <p>c": "a",
    "<![if IE]> y <?php z ?> w < v": "y w < v",
    f"<article><p>{P1}</p><a href='{P2}": P1,
    f"<article><header><h2>Head</h2><p>By me</p></header><p>{P1}&nbsp;&#8364;<br>x</p><footer>f</footer></article>": f"Head {P1} € x",
    f'<article>{P1}<ins class="adsbygoogle">ad</ins> e<i>n</i>d<span class="ad">q</span>!</article>': f"{P1} end!",
    f"<h1>Head</h1><div><p>{P1}</p><p>{P2}</p></div>": f"Head {P1} {P2}",
    f"<div><a>L</a> <a>M</a></div><div><h2>H</h2><p>{P1}</p><div><p>{P2}</p><p>{P2}</p></div></div><div><a>N</a></div>": f"H {P1} {P2} {P2}",
    f"<table><tr><td>{P1}<td>b<tr><td>c</table>": f"{P1} b c",
    f"<article><script>{P2}": "",
}


def test_cases(spark):
    assert {page: main_text(page) for page in CASES} == CASES
    rows = [(i, "u", page, "t", 0) for i, page in enumerate(CASES)] + [(None, None, "<p>no id", "t", 0)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = htmltext.extract(pages).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted((t, len(t)) for t in [*CASES.values(), "no id", "no id"])
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_long_and_broken_pages_take_linear_time():
    word = "x" * 2_000_000
    assert main_text(f"<article><p>{word}</p><p>y</article>") == f"{word} y"
    assert len(main_text("<article>" + "<p>a" * 50_000)) == 2 * 50_000 - 1
    for page in ('<a href="' * 20_000, "</" * 100_000, "<!--" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<div>" * 20_000 + "</div>" * 20_000):
        assert main_text(page) == ""


def test_smoothing():
    ratios = np.array([1.0, 100, 3, 0, 0, 50, 2])
    weights = {d: np.exp(-0.5 * (d / htmltext.SIGMA) ** 2) for d in range(-htmltext.REACH, htmltext.REACH + 1)}
    for i, got in enumerate(htmltext.smooth(ratios)):
        near = {i + d: w for d, w in weights.items() if 0 <= i + d < len(ratios)}
        assert abs(got - sum(w * ratios[j] for j, w in near.items()) / sum(near.values())) < 1e-9
    assert list(htmltext.smooth(np.array([7.0]))) == [7.0]
