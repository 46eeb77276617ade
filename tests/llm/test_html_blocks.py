import random
import re
import time

import numpy as np
import pytest
from cuewright.llm import html_blocks as H


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_leaf_blocks():
    page = """<html><head><title>no</title><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><a href="a>b">Menu</a></nav>
    <article><p>One &amp; two<br>three<p><b>Four  <i>five</i></b><ul><li>six<li>seven</ul><style>p{}</style>tail</article> end"""
    got = H.leaf_blocks(page)
    assert [b[1] for b in got] == ["Menu", "One & two three", "Four five", "six", "seven", "tail", "end"]
    assert got[0][0].path() == ("html", "body", "nav") and got[0][2] == 1.0 and got[4][0].path() == ("html", "body", "article", "ul", "li")
    assert H.leaf_blocks(None) == H.leaf_blocks("") == H.leaf_blocks("<p> </p><") [:0]
    assert [b[1] for b in H.leaf_blocks("plain < text <3")] == ["plain < text <3"]


def test_gradient(model):
    m, r = H.BiLstm(3), np.random.default_rng(0)
    pages = [r.normal(size=(n, H.INPUT)).astype(np.float32) for n in (3, 5)]
    truth = [np.array([1, 0, 1.0]), np.array([0, 1, 1, 0, 0.0])]
    start = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss(p):
        m.p = p
        z, _ = m.logits(pages)
        return sum(np.logaddexp(0, np.where(t == 1, -z[: len(t), k], z[: len(t), k])).sum() for k, t in enumerate(truth)) / 8

    m.p = {k: v.copy() for k, v in start.items()}
    state: dict = {}
    m.learn(pages, truth, 0.0, state)
    for key in ("xf", "hf", "cb", "hb", "o", "z"):
        flat = int(np.argmax(np.abs(state[key][0])))
        up, down = ({k: v.copy() for k, v in start.items()} for _ in range(2))
        up[key].flat[flat] += 1e-2
        down[key].flat[flat] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - state[key][0].flat[flat] * 10) < 2e-3


def test_held_out_pages(model):
    r, wrong, total = random.Random(77), 0, 0
    for _ in range(150):
        blocks = H.leaf_blocks(H.sample_page(r)[0])
        truth = np.array([b[1][:1] in "qQ" for b in blocks], bool)
        got = model.label([H.vectors([(p, re.sub(r"\b[qQ](?=\w)", "", t), s) for p, t, s in blocks])])[0]
        wrong, total = wrong + int((got != truth).sum()), total + len(truth)
    assert wrong < 0.01 * total


def test_extract(spark, model):
    body = "<p>The long first paragraph, with words enough. It goes on and on, and on.</p>" * 3
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title</h1>{body}</article><div class="comments"><p>nice one</p></div><footer>© 2024</footer></body></html>'
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (3, "v", "", "y"), (4, "w", f"<body><article>{body * 4000}</article></body>", "z")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {x.page_id: x for x in got}
    line = "The long first paragraph, with words enough. It goes on and on, and on."
    assert len(got) == 5 and by[1].text == "\n".join(["Title"] + [line] * 3) and by[2].text == by[3].text == ""
    assert by[4].text == "\n".join([line] * 12000) and by[4].n_chars == len(by[4].text)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, blocks", [("<a " * 350_000, 1), ("<a<b" * 250_000 + '">', 1), ("<p>one</p>" + '<a "' * 300_000 + ">", None), ("</section>" * 100_000 + "x", 1), ("<script" * 150_000, 1), ("<!-- " * 200_000, 0), ("<textarea>x" * 100_000, 1), ("<svg>" * 200_000 + "<p>x", 1), ("<div><select>" * 50_000 + "</div>x" * 50_000, None)])
def test_long_broken_pages_take_linear_time(page, blocks):
    began = time.time()
    got = H.leaf_blocks(page)
    assert time.time() - began < 10 and (blocks is None or len(got) == blocks)


def test_deep_pages(model):
    began = time.time()
    page = "<div>x" * 100_000 + "</section>" * 50_000 + "</div>" * 100_000
    got = H.leaf_blocks(page)
    assert len(got) == 100_000 and got[-1][0].depth == 100_000
    assert len(H.main_text([page], model)) == 1 and time.time() - began < 60


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<html><head><title>t</title><meta charset=utf-8><p>one</p><p>two</p>", ["one", "two"]),
        ("<head><title>t</title><link rel=x>bare text<p>one", ["bare text", "one"]),
        ("<head><noscript><img src=x><style>p{}</style></noscript><meta name=a><script>1</script></head>x<p>one", ["x", "one"]),
        ("<head>\n<!-- c -->\n<base href=x></head>\n<body><p>one", ["one"]),
        ("<p>a <svg class='i'/> b</p><p>c</p>", ["a b", "c"]),
        ("<p>a <svg class='i'><path d='M'/><title>no</title><text>no</text></svg> b</p>", ["a b"]),
        ("<div><a href=x><svg><path></a> shown</div><p>c</p>", ["shown", "c"]),
        ("<div><svg><g><path></div><p>c</p>", ["c"]),
        ("<div><svg><text>no<p>c</p></div><p>d", ["c", "d"]),
        ("<div>Pick <select><option>no<option>no</select> one</div>", ["Pick one"]),
        ("<div><select><option>no</div><p>c", ["c"]),
        ("<select><option>no<p>c</p><p>d</p>", ["c", "d"]),
        ("<div><object data=x><param name=y>kept<p>c</p></div><p>d", ["kept", "c", "d"]),
        ("<section><template><p>no</p><div>no</div></section><p>c", ["c"]),
        ("<section><noscript><p>no</p></noscript><p>c</section>", ["c"]),
        ("<p>one</p><textarea>two<p>three", ["one", "two", "three"]),
        ("<p>one</p><iframe src=x><p>three", ["one", "three"]),
        ("<p>one</p><iframe src=x>no</iframe><textarea>no</textarea><p>three", ["one", "three"]),
        ("<p>one</p><script>no<p>no", ["one"]),
        ("<svg><svg></svg>no</svg>yes", ["yes"]),
        ("</select></svg></template>yes<select>", ["yes"]),
    ],
)
def test_nothing_but_hidden_content_is_dropped(page, blocks):
    assert [b[1] for b in H.leaf_blocks(page)] == blocks


def test_unfinished_tags_are_text():
    assert [b[1] for b in H.leaf_blocks("<p>a <b c='d>e</p>")] == ["a <b c='d>e"]
    assert [b[1] for b in H.leaf_blocks("<p title='a>b' lang=\"<\">one</p></p 'x>two")] == ["one", "two"]
    assert [b[1] for b in H.leaf_blocks("<SCRIPT>var a = '<p>no</p>'</script ><p>yes")] == ["yes"]


#: Pages of layouts that the generator doesn't make; blocks of main text are listed.
_FOREIGN = [
    (
        """<html><body><div id="page-wrap"><div class="top-links"><a href="/a">Start</a> <a href="/b">Archive</a> <a href="/c">Contact</a></div>
        <div class="blog-entry"><h2 class="entry-heading">A walk along the river</h2><div class="entry-text"><p>We set out early, when the mist still lay on the water, and followed the path downstream.</p>
        <p>By noon the sun was high. Herons stood in the shallows, and nobody spoke for an hour.</p><blockquote>The river remembers, said the ferryman, what we forget.</blockquote></div></div>
        <div class="sidebar-right"><h4>Tags</h4><ul><li><a href="/t/1">walks</a></li><li><a href="/t/2">rivers</a></li></ul></div>
        <div id="footer-area">All rights reserved. <a href="/imprint">Imprint</a></div></div></body></html>""",
        ["A walk along the river", "We set out early, when the mist still lay on the water, and followed the path downstream.", "By noon the sun was high. Herons stood in the shallows, and nobody spoke for an hour.", "The river remembers, said the ferryman, what we forget."],
    ),
    (
        """<html><body><table width="100%"><tr><td class="menu"><a href="1.html">Home</a><br><a href="2.html">News</a><br><a href="3.html">Links</a></td>
        <td><h1>Notes on old bridges</h1><p>Stone bridges outlast the roads that lead to them, since nobody carts away what still bears a load.</p>
        <p>The oldest in this valley was built by masons who left their marks on the inner arch.</p><ul><li>Three arches, the middle one wider</li><li>A parapet of later date</li></ul></td></tr></table>
        <form action="/search"><input name="q"><button>Search the site</button></form><div class="copyright">Copyright 2003 by the author</div></body></html>""",
        ["Notes on old bridges", "Stone bridges outlast the roads that lead to them, since nobody carts away what still bears a load.", "The oldest in this valley was built by masons who left their marks on the inner arch.", "Three arches, the middle one wider", "A parapet of later date"],
    ),
    (
        """<html><body><header class="site"><div class="logo">The Daily Example</div><nav><a href="/w">World</a><a href="/s">Sport</a></nav></header><div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
        <main><article><header><h1>Council votes to reopen the harbour</h1></header><p>The council voted last night, by a narrow margin, to reopen the old harbour to fishing boats.</p><div class="advertisement"><p>Buy now and save!</p></div>
        <p>Work on the quay begins in spring and is expected to take two years, the mayor said.</p></article><section class="related-stories"><h3>Read more</h3><ul><li><a href="/x">Harbour fees to rise</a></li></ul></section>
        <section id="comments"><h3>Comments</h3><p>About time they did this!</p></section></main><footer><p>Contact us. Terms of use.</p></footer></body></html>""",
        ["Council votes to reopen the harbour", "The council voted last night, by a narrow margin, to reopen the old harbour to fishing boats.", "Work on the quay begins in spring and is expected to take two years, the mayor said."],
    ),
    (
        """<!doctype html><head><meta charset=utf-8><title>Bread</title><ul class=nav><li><a href=/>Home</a><li><a href=/r>Recipes</a></ul><h1>Rye bread in two days</h1><p>Stir the starter into warm water the evening before, cover it and leave it by the stove.
        <p>In the morning add the flour and the salt, and knead until the dough comes away from the bowl.<ol><li>Shape a loaf and let it rise for an hour<li>Bake it hot, then less hot</ol><div class=newsletter><p>Sign up for our newsletter!</p></div><div class=foot>Imprint</div>""",
        ["Rye bread in two days", "Stir the starter into warm water the evening before, cover it and leave it by the stove.", "In the morning add the flour and the salt, and knead until the dough comes away from the bowl.", "Shape a loaf and let it rise for an hour", "Bake it hot, then less hot"],
    ),
    (
        """<body><div role="navigation"><a href="/1">One</a> | <a href="/2">Two</a></div><div role="main"><h2>Why owls fly silently</h2><p>The leading edge of an owl's wing carries a comb of stiff hairs that breaks the air into small streams.</p>
        <figure><img src="x.jpg"><figcaption>A barn owl over a field at dusk</figcaption></figure><p>The soft fringe behind it lets those streams join again without the rush that other birds make.</p></div>
        <div role="complementary"><h3>Popular</h3><ul><li><a href="/3">Ten facts about bats</a></li></ul></div><div role="contentinfo">Site map. Privacy.</div></body>""",
        ["Why owls fly silently", "The leading edge of an owl's wing carries a comb of stiff hairs that breaks the air into small streams.", "A barn owl over a field at dusk", "The soft fringe behind it lets those streams join again without the rush that other birds make."],
    ),
    (
        """<div class="wrapper"><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/h">History</a></div><div class="post"><h1 class="post-title">The lighthouse keepers</h1><div class="post-meta"><svg><path d="M0"/></svg></div><div class="post-content"><p>Four families lived on the rock, and each kept the lamp for six hours of the night.</p>
        <pre>oil: 3 casks
wicks: 40</pre><p>Supplies came twice a month when the sea allowed it, and in winter often not at all.</p></div></div><div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a></div><div class="comment-list"><div class="comment"><p>My grandfather was one of them.</p></div></div></div>""",
        ["The lighthouse keepers", "Four families lived on the rock, and each kept the lamp for six hours of the night.", "oil: 3 casks wicks: 40", "Supplies came twice a month when the sea allowed it, and in winter often not at all."],
    ),
]


def test_foreign_layouts(model):
    hit = found = wanted = 0
    for page, want in _FOREIGN:
        got = H.main_text([page], model)[0].split("\n")
        hit, found, wanted = hit + len(set(got) & set(want)), found + len(got), wanted + len(want)
    print("block F1 on foreign layouts", 2 * hit / (found + wanted))
    assert 2 * hit / (found + wanted) > 0.8


def slow_logits(model, x):
    """The two LSTMs one step and one page at a time, from their formulas."""
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    n, states = H.HIDDEN, {}
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h = c = np.zeros(n)
        for t in order:
            a = x[t].astype(float) @ model.p["x" + d] + model.p["c" + d] + h @ model.p["h" + d]
            c = sigmoid(a[n : 2 * n]) * c + sigmoid(a[:n]) * np.tanh(a[3 * n :])
            h = sigmoid(a[2 * n : 3 * n]) * np.tanh(c)
            states[d, t] = h
    return np.array([states["f", t] @ model.p["o"][:n] + states["b", t] @ model.p["o"][n:] + model.p["z"][0] for t in range(len(x))])


def test_labels_equal_brute_force(model, monkeypatch):
    monkeypatch.setattr(H, "_STEPS", 7)
    r = random.Random(5)
    pages = [H.vectors(H.leaf_blocks(H.sample_page(r)[0])) for _ in range(25)] + [H.vectors([])]
    for got, x in zip(model.label(pages), pages, strict=True):
        slow = slow_logits(model, x)
        assert (got == (slow > 0))[np.abs(slow) > 1e-3].all()
