import random
import re
from html import unescape
from itertools import product
from math import exp

import pytest

from acctlens.llm import html_extract as h
from acctlens.llm.labelled_pages import labelled_pages
from acctlens.llm.queries import op7_html_extraction


@pytest.fixture(scope="module")
def model():
    return h.train(labelled_pages())


def article(html):
    """The article of a test page, by hand: block tags part, other tags go."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1|h2|br|div|ul|li)\b[^>]*>", found[1]) if found else []
    return " ".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_pages(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op7_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_layouts():
    """Trained on some of the labelled pages, right on the others."""
    pages = labelled_pages()
    rnd = random.Random(1)
    rnd.shuffle(pages)
    model = h.train(pages[: len(pages) // 2])
    right = total = 0
    for html in pages[len(pages) // 2 :]:
        page = h.parse(html)
        known = []
        for i, (node, odds) in enumerate(zip(page.nodes, h.marginals(page, model))):
            known.append(node.label if node.label is not None else known[node.parent] if i else 0)
            right, total = right + ((odds > 0) == (known[i] == 1)), total + 1
    assert right / total > 0.97


def test_messages_give_the_exact_marginals(model):
    html = "<body><div><p>one two</p><p><a href=/>x</a></p></div><article>t<p>some more</p></article><footer>f</footer></body>"
    page = h.parse(html)
    own = [max(-20.0, min(20.0, sum(model.features.get(f, 0.0) for f in h.evidence(n)))) for n in page.nodes]
    own[0] += model.prior
    mass = [[0.0, 0.0] for _ in page.nodes]
    for labels in product((0, 1), repeat=len(page.nodes)):
        weight = 1.0
        for i, (x, node) in enumerate(zip(labels, page.nodes)):
            weight *= exp(own[i]) if x else 1.0
            if i:
                t = model.child[node.cue][labels[node.parent]]
                weight *= t if x else 1 - t
        for i, x in enumerate(labels):
            mass[i][x] += weight
    for odds, (around, main) in zip(h.marginals(page, model), mass):
        assert exp(odds) == pytest.approx(main / around, rel=1e-6)


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>Title &amp; more</h1><p>First   <b>bo</b>ld&nbsp;text.<p>Second<br>line &#233; 3 &lt; 4</p><ul><li>One<li>Two</ul>
<script>var a = "<p>no</p>";</script><!-- no <p>no</p> --><div class="ad">Buy</div>
<section id="comments"><h3>Comments</h3><div class=comment><p>Reader says a lot of things here, really a lot of them.</p></div></section></article>
<aside><p>Side</p></aside><form><label>Mail</label><input><textarea>no</textarea></form><footer><p>Foot</p></footer></body></html>"""


def test_one_page(model):
    assert h.main_text(PAGE, model) == "Title & more First bold text. Second line é 3 < 4 One Two"


@pytest.mark.parametrize("html, wanted", [
    (None, ""), ("", ""), ("<", ""), ("<nav><a href=/>only a menu</a></nav>", ""),
    ("<main><p>a b</main>", "a b"), ("<article><p>x</b></i></p></div>y</article>", "x y"),
    ("<article><p>" + "long " * 5000 + "</article>", ("long " * 5000).strip()),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
])
def test_odd_pages(model, html, wanted):
    assert h.main_text(html, model) == wanted


def test_broken_markup_is_quick_and_whole(model):
    for html in ('<p "' * 30_000, '<a b="' + 'x"' * 40_000, "<script>" * 20_000, "<!--" * 20_000, "<div>" * 50_000 + "<p>" * 1000):
        h.main_text(html, model)


def test_odd_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<main><p>x</main>", "t", 9), (1, "u", "<main><p>x</main>", "t", 9), (None, None, None, None, None), (2, None, "", "", 0)]
    out = h.extract_main(spark.createDataFrame(rows, schema), labelled_pages())
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, None, "", 0)], key=repr)
    assert h.extract_main(spark.createDataFrame([], schema), labelled_pages()).count() == 0
