import itertools
import math
import random
import time
from html.parser import HTMLParser

import pytest

from pairweave.llm import html_text as ht

LONG = "Many words stand here, one after the other. They form a sentence that is read. " * 3


def test_minimum_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        keep, drop = [rng.random() * 5 for _ in range(n)], [rng.random() * 5 for _ in range(n)]
        edges = [(a, b, rng.random() * 3) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            own = sum(d if x else k for x, k, d in zip(labels, keep, drop, strict=True))
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])

        found = ht.minimum_cut(keep, drop, edges)
        assert cost(found) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_article_between_all_kinds_of_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>Site &amp; title</title><style>p{{margin:0}}</style>
    <script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1><p>Welcome to the site, dear reader. Have a nice day.</p></header>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p><button>Accept</button></div>
    <main class="with-sidebar"><article><header><h1>The   title</h1></header><!-- a <p>comment</p> -->
    <div class="ad"><p>{LONG}</p></div>
    <p>First &lt;para&gt;&#33; with <b>bold</b> and<br>a break.<p>Short.</p>
    <ul><li>One item<li>Two <a href="x">items</a></ul><blockquote>Quoted</blockquote>
    <form><p>{LONG}</p><label>Mail</label><input value="x"></form><noscript>{LONG}</noscript>
    <p hidden>{LONG}</p><p style="display: none">{LONG}</p>
    <section id="comments"><h2>Comments</h2><p>{LONG}</p></section></article></main>
    <aside><p>{LONG}</p></aside><div class="related-posts"><p>{LONG}</p></div>
    <footer>&copy; someone. {LONG}</footer>"""
    assert ht.main_text(page).split("\n\n") == [
        "The title", "First <para>! with bold and a break.", "Short.", "One item", "Two items", "Quoted",
    ]


def test_page_without_semantic_elements():
    links = "".join(f'<a href="/{i}">Link {i}</a> ' for i in range(9))
    page = f"<div>{links}</div><div><div><p>{LONG}</p><p>And a short one.</p><p>{LONG}</p></div></div><div>{links}</div>"
    assert ht.main_text(page).split("\n\n") == [" ".join(LONG.split()), "And a short one.", " ".join(LONG.split())]


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("   \n", ""), ("<p>", ""), ("<article>a < b &amp;&amp; c", "a < b && c"),
        ("<article><p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\n\nfour"),
        ("<article><p>x</p></span></b></p>y", "x\n\ny"), ("<article>a<script>b", "a"), ("<article>a<!-- b", "a"),
        ("<article><P CLASS='AD'>x</P><p>y&nbsp;　z", "y z"), ("<article><p>cut <a href='", "cut"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<article>&#x1F600;&eacute;&bogus;", "😀é&bogus;"),
    ],
)
def test_small_pages(html, want):
    assert ht.main_text(html) == want


@pytest.mark.parametrize(
    "tag",
    [
        '<p title="the hidden valley">', '<p data-hidden="false">', "<p data-hidden>", '<p data-id="comment-5">', "<p xclass=ad>",
        "<p title='x hidden id=\"ad\"'>", "<p title = hidden>", '<p data-style="display:none">', '<p title="class=ad">', "<p =hidden>",
        '<p aria-hidden="false">', '<p data-aria-hidden="true">', '<p onclick="a.style=1; id = 2">', '<p class="x" class="ad">',
    ],
)
def test_words_in_values_and_longer_names_say_nothing(tag):
    assert ht.main_text(f"<article><p>a</p>{tag}b</p></article>") == "a\n\nb"
    assert ht.main_text(f"<html><body{tag[2:]}<article{tag[2:]}<p>a</p></article>") == "a"


def test_link_to_a_hidden_place_is_read():
    assert ht.main_text('<article><p>To the <a href="/travel/hidden-valley">valley</a> and on.</p></article>') == "To the valley and on."


@pytest.mark.parametrize(
    "tag",
    ["<p hidden>", "<p title='a'hidden>", '<p title="a > b" HIDDEN="">', "<p/hidden>", '<p class="x"id="ad">', "<p class = ad>", "<p CLASS='ad x'>",
     "<p style='color:red; display : none'>", "<p aria-hidden=true>", "<p a=b role=navigation c>"],
)
def test_attributes_of_all_forms_are_read(tag):
    assert ht.main_text(f"<article><p>a</p>{tag}b</p></article>") == "a"


def test_table_of_pages(spark):
    deep = "<div>" * 3000 + f"<article><p>{LONG}</p></article>"
    many = "<article>" + "".join(f"<p>word {i}, and more.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", "<article><p>a b</p></article>"), (1, "u", "<article><p>a b</p></article>"), (2, None, None), (None, "v", ""), (3, "d", deep), (4, "m", many)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): r for r in ht.extract(pages).collect()}
    assert (got[1, "u"].text, got[1, "u"].n_chars) == ("a b", 3)
    assert got[2, None].text == got[None, "v"].text == ""
    assert got[3, "d"].text == " ".join(LONG.split())
    assert got[4, "m"].text.count("\n\n") == 4999 and got[4, "m"].n_chars == len(got[4, "m"].text)
    assert ht.extract(pages).count() == 6
    assert ht.extract(pages.limit(0)).collect() == []


TITLED = f"<h1>The title</h1><p>{LONG}</p><p>A short end.</p>"
WHOLE_TEXT = ["The title", " ".join(LONG.split()), "A short end."]


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="site has-sidebar">{TITLED}</div>', f'<div class="layout no-sidebar">{TITLED}</div>',
        f'<div class="story tag-politics">{TITLED}</div>', f'<article class="post comments-open">{TITLED}</article>',
        f'<div><div class="article-header"><h1>The title</h1></div><p>{LONG}</p><p>A short end.</p></div>',
        f'<form id="aspnetForm"><div>{TITLED}</div></form>',
        f'<div class="content-sidebar-wrap"><div>{TITLED}</div><aside>{LONG}</aside></div>',
        f'<div class="post">{TITLED}</div><div id="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>',
        f'<div class="hentry"><div class="entry-content">{TITLED}</div><ul class="social-share"><li><a href="s">Share</a></ul>'
        f'<ol class="comment-list"><li>{LONG}<li>{LONG}</ol></div>',
        f'<body class="single has-widgets"><div id="siteHeader"><p>{LONG}</p></div><div class="post category-ads">{TITLED}</div>'
        f'<div class="tag-cloud"><a href="a">a</a></div><div class="footer-widgets">{LONG}</div>',
        f'<!--><script>if (a<b && "<!--") c="</script><article>{TITLED}</article>',
    ],
)
def test_names_of_layout_and_state_rule_nothing_out(page):
    assert ht.main_text(page).split("\n\n") == WHOLE_TEXT


@pytest.mark.parametrize("name,want", [
    ("ad", ht.WHOLE), ("site-footer", ht.WHOLE), ("cookieBanner", ht.WHOLE), ("ad-slot", ht.PART), ("footer2", ht.WHOLE), ("has-sidebar", 0),
    ("tag-ads", 0), ("tag-list", ht.PART), ("ads-off", 0), ("entry-header", 0), ("page-header", ht.WHOLE), ("shadow adept", 0), ("", 0), ("- _ 7", 0),
])
def test_names_are_compared_whole(name, want):
    assert ht.named(name, ht.BOILER_WORDS) == want


@pytest.mark.parametrize("page", [
    "<p" + " " * 1_000_000 + ">x", "<div>" * 100_000 + "x", "<b>x" * 50_000, "<a b='\" " * 50_000, "<div>" * 50_000 + "</p>x" * 50_000,
    "<p><object>" + "<div>" * 50_000, "<a " * 100_000, "<!--" * 100_000, "<script>" * 50_000, "<p" + "/ a" * 200_000,
])
def test_reading_is_linear(page):
    start = time.process_time()
    ht.main_text(page)
    assert time.process_time() - start < 5


class Plain(HTMLParser):
    """Texts of well-formed pages of p, h2 and li elements, with the path of (name, class) above each."""

    def __init__(self):
        super().__init__()
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.path.append((tag, dict(attrs).get("class", ""), object()))

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append((" ".join(data.split()), list(self.path)))


def plain_cost(text, path):
    """(cost as boilerplate, cost as content), from the path alone."""
    names = [t for t, _, _ in path]
    if {"nav", "aside", "footer"} & set(names):
        return 0.0, ht.SURE
    words = len(text.split())
    ends = sum(text.count(c + " ") + text.endswith(c) for c in ".!?")
    score = -0.6 + 0.3 * min(math.log2(words + 1), 6) + 0.5 * min(ends, 3)
    score += 5 * ("article" in names) + any(c == "story" for _, c, _ in path) - 15 * any(c == "ad" for _, c, _ in path)
    score += {"p": 1.0, "h2": 0.6, "li": -0.4}.get(names[-1], 0)
    return math.log(1 + math.exp(score)), math.log(1 + math.exp(-score))


def test_small_pages_equal_the_best_of_all_labellings():
    rng = random.Random(8)
    for _ in range(150):
        def element(depth):
            if depth == 0 or rng.random() < 0.4:
                tag = rng.choice(["p", "h2", "li"])
                return f"<{tag}>{' '.join(rng.choice(['word', 'end.', 'is it?']) for _ in range(rng.randrange(1, 30)))}</{tag}>"
            tag, name = rng.choice(["div", "section", "article", "nav", "aside"]), rng.choice(["", "", "story", "ad"])
            name = "" if tag == "article" else name
            return f'<{tag} class="{name}">' + "".join(element(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

        page = "<article><p>" + "A long first paragraph. " * 120 + "</p></article>" + "".join(element(2) for _ in range(3))
        plain = Plain()
        plain.feed(page)
        if len(plain.found) > 11:
            continue
        own = [plain_cost(*f) for f in plain.found]
        parents = [path[-2][2] if len(path) > 1 else None for _, path in plain.found]
        edges = [(i - 1, i, 0.6) for i in range(1, len(own))]
        for j in range(len(own)):
            before = [i for i in range(j) if parents[i] is parents[j]]
            edges += [(before[-1], j, 1.2)] if before else []

        def cost(labels):
            paid = sum(pair[label] for pair, label in zip(own, labels, strict=True))
            return paid + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(itertools.product([0, 1], repeat=len(own)), key=cost)
        assert ht.main_text(page).split("\n\n") == [t for (t, _), keep in zip(plain.found, best, strict=True) if keep]
