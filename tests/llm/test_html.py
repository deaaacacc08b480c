import html as entities
import itertools
import math
import os
import random
import re
import time

import pytest

from tonewright.llm import html

MODEL = html.Model(html.labelled_pages())


def text(page):
    return html.extract(page, MODEL)


def test_pages(spark, small):
    """The pages' own layout: everything inside <article>, block by block."""
    pages = spark.read.parquet(os.path.join(small, "pages.parquet"))
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " "))
        blocks = (re.sub(r"\s+", " ", entities.unescape(x)).strip() for x in re.split("<[^>]*>", inner))
        assert got[r.page_id].text == " ".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_marginals_are_exact():
    """Messages against the sum over all labellings of small trees."""
    rng = random.Random(1)
    for _ in range(20):
        nodes = [html.Node(-1, "html", "none")]
        for k in range(1, 8):
            n = html.Node(rng.randrange(k), rng.choice(["div", "p", "nav", "article", "li"]), rng.choice(["none", "ad", "body", "other"]))
            n.size, n.linked = rng.choice([0, 20, 100, 500]), 0
            nodes.append(n)
        weights = [0.0] * len(nodes)
        total = 0.0
        for states in itertools.product((0, 1), repeat=len(nodes)):
            w = sum(MODEL.potential(n)[s] for n, s in zip(nodes, states, strict=True))
            w += sum(MODEL.edge.get(html.edge_kind(n, nodes), MODEL.neutral)[states[n.parent]][s] for n, s in zip(nodes[1:], states[1:], strict=True))
            total += math.exp(w)
            for k, s in enumerate(states):
                weights[k] += s * math.exp(w)
        assert all(abs(a / total - b) < 1e-9 for a, b in zip(weights, MODEL.marginals(nodes), strict=True))


def test_held_out_layouts():
    right = wrong = 0
    for nodes, labels in html.labelled_pages(60, seed=99):
        for n, label, m in zip(nodes, labels, MODEL.marginals(nodes), strict=True):
            if n.size:
                right += (m > 0.5) == label
                wrong += (m > 0.5) != label
    assert right / (right + wrong) > 0.97


PROSE = "Plain prose that goes on for a while, so that nobody takes it for a label or a menu of any kind at all."


def test_clutter_goes():
    page = f"""<body><header>Site name <nav><a href=x>Home</a></nav></header><div class="cookie-banner"><p>We use cookies &amp; more, please accept.</p></div>
    <main><article><h1>Title &lt;1&gt;</h1><p>{PROSE}<b>bold</b>er<br>next</p><aside class="sidebar"><p>Read also this other story</p></aside><form><label>Mail</label></form>
    <p>{PROSE}</p><div class="ad">Buy now</div></article><section id="comments" class="comments"><div class="comment"><p>I disagree with all of this, really I do.</p></div></section></main>
    <footer>&copy; us</footer><script>var a = "</p><p>no</p>";</script></body>"""
    assert text(page) == f"Title <1> {PROSE}bolder next {PROSE}"


def test_broken_markup():
    assert text(None) == text("") == ""
    assert text(f"<article><p>{PROSE}<p>{PROSE} &am") == f"{PROSE} {PROSE} &am"
    assert text(f"<article><p>{PROSE}</b></i></p><p unclosed='x") == PROSE
    assert text(f"<article><p>{PROSE}<!-- open comment <p>x</p>") == PROSE
    assert text(f"<article><p>a\n\t {PROSE}&nbsp;&#233;&eacute;</p>") == f"a {PROSE} éé"
    text("<div>" * 5000 + PROSE + "</p>" * 50)


def test_formulas_pictures_and_frames():
    """Formulas and labels of pictures are read where they are content; frames of adverts and menus of choices are not."""
    page = f"""<article><p>{PROSE} The rule is <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math> for all.</p>
    <figure><svg><title>t</title><text>North of the river</text></svg><figcaption>A map of all the town</figcaption></figure><object><p>{PROSE}</p></object></article>
    <form><select><option>One</option><option>Two</option></select></form><div class="ad"><iframe src="x">Buy now</iframe></div>"""
    assert text(page) == f"{PROSE} The rule is x=y2 for all. North of the river A map of all the town {PROSE}"


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<ul><li><div>" + "<h1>" * 50_000 + "<li>" * 50_000, "<div>" * 50_000 + "</p></li>" * 50_000])
def test_reading_is_linear(page):
    began = time.process_time()
    html.parse(page)
    assert time.process_time() - began < 5  # a scan of the open elements for each tag would take many minutes


def test_a_long_page():
    page = "<article>" + f"<p>{PROSE}</p>" * 100_000 + "</article>"
    assert len(page) > 10_000_000 and text(page) == " ".join([PROSE] * 100_000)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (2, None, "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((str(r.page_id), str(r.url), r.n_chars == len(r.text)) for r in html.main_text(frame).collect()) == sorted((str(a), str(b), True) for a, b, _ in rows)
    assert html.main_text(frame.where("false")).collect() == []

LAYOUTS = {
    'div content': ('<body><div id="header">Site</div><div id="content"><h1>T</h1><p>PP</p><p>Short one.</p></div><div id="sidebar"><h3>More</h3><p>PP</p></div><div id="footer">c</div></body>', 'T PP Short one.'),
    'plain body': ('<body><h1>T</h1><p>PP</p><p>Short one.</p><footer>x</footer></body>', 'T PP Short one.'),
    'inner comments': ('<article><h1>T</h1><p>PP</p><section class="reader-comments"><h2>Comments</h2><p>PP</p><ul><li>PP</li></ul></section></article>', 'T PP'),
    'p notice': ('<article><p class="notice">PP</p><p>PP</p><div class="share-buttons"><a>tw</a><a>fb</a></div></article>', 'PP'),
    'aside in article': ('<main><article><p>PP</p><aside>PP</aside><p>PP</p></article></main>', 'PP PP'),
    'list/table': ('<article><p>PP</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><td>b</td></tr></table><blockquote>q PP</blockquote><h2>H</h2></article>', 'PP one two a b q PP H'),
    'form newsletter': ('<article><p>PP</p><form class="newsletter"><p>PP</p><input><button>Go</button></form><p>Short one.</p></article>', 'PP Short one.'),
    'comment articles': ('<article><p>PP</p><div class="advertisement"><p>PP</p></div><p>PP</p></article><div class="comments"><article class="comment"><p>PP</p></article></div>', 'PP PP'),
    'short article': ('<nav><a>x</a></nav><article><h1>T</h1><p>Short one.</p></article><footer>f</footer>', 'T Short one.'),
    'noscript': ('<article><noscript>PP</noscript><p>PP</p><template>PP</template></article>', 'PP'),
    'cookie': ('<div class="cookie-consent" role="dialog"><p>PP</p></div><div class="post"><p>PP</p></div><ol class="commentlist"><li class="comment"><p>PP</p></li></ol>', 'PP'),
    'deep div': ('<div class="page"><div class="wrap"><div><div><p>PP</p><p>PP</p></div></div><div class="right-rail"><p>PP</p></div></div></div>', 'PP PP'),
}  # PP stands for a paragraph


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert text(page.replace("PP", PROSE)).replace(PROSE, "PP") == want


RAWS = {
    "<article><p>PP</p><script src=/js/>var a = 1;</script><p>PP</p></article>": "PP PP",
    "<article><p>PP</p><script src='x.js'/>var a = 1;</script ><p>PP</p></article>": "PP PP",
    "<article><p>PP</p><style/>p {}</style/><p>PP</p></article>": "PP PP",
    "<article><script src='x.js'/><p>PP</p><script /><p>PP</p></article>": "PP PP",  # written as empty, and no end follows
    "<article><p>PP</p><script>if (a </scriptx> b) {}</script><p>PP</p></article>": "PP PP",
    "<article><p>PP</p><script>never ends": "PP",
}


@pytest.mark.parametrize("page", RAWS)
def test_raw_elements_end_at_their_end_tag(page):
    assert text(page.replace("PP", PROSE)).replace(PROSE, "PP") == RAWS[page]


def test_many_raw_elements_without_an_end_take_linear_time():
    import time

    began = time.perf_counter()
    html.parse("<script/>" * 200_000 + "x")
    assert time.perf_counter() - began < 10
