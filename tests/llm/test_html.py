import math
import random
import time

import pytest

from siftstone.llm import html

P = "The committee met on Tuesday to discuss the new harbour plan, which has been delayed for years by a lack of funding. "
PAGES = "page_id long, url string, html string, text string, n_chars string"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(("given", "want"), [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("x <b>y</b>z<br>w", "x yz w"), ("<script>unclosed " + P, ""), ("<!-- unclosed", ""),
    ("<div><a href='a>b'>x</a> 1 < 2 && 3 > 2</div>", "x 1 < 2 && 3 > 2"), ("<p>x&nbsp;&nbsp;y&#8212;z</p>", "x y—z"), ("<p title=\"unclosed>text</p>", "text"), ("</p></div>a", "a"),
    (page(f"<article><h1>Head</h1><p>{P}</p></article>"), f"Head {P}".strip()),
    (page(f"<nav><ul><li><a>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>Head</h1><p><b>{P}<br><p>{P}</p></article><footer>c</footer>"), f"Head {P}{P}".strip()),
    (page(f"<header>Site</header><div class='wrap has-sidebar'><div id=content><h2>Head</h2><p>{P}</p><p>{P}</p></div><div class=sidebar>{P[:40]}</div></div>"), f"Head {P}{P}".strip()),
    (page(f"<article><p>{P}</p><section class='comments'><p>{P * 4}</p></section><form>{P}<button>Go</button></form><aside>{P}</aside></article><div class='comment'>{P}</div>"), P.strip()),
    (page(f"<main><article><header><h1>Head</h1></header><p>{P}</p><p>{P}</p></article></main><div role=dialog>{P}</div><div hidden>{P}</div>"), f"Head {P}{P}".strip()),
    (page(f"<table><tr><td><ul class=menu><li><a>a</a><li><a>b</a></ul><td><p>{P}<p>{P}</table><div class='cookie-notice'>Cookies</div>"), f"{P}{P}".strip()),
    (page(f"<div class='topbar'>Site</div><div><h1>Hi</h1><div class='story'><p>{P}</p><blockquote>{P}</blockquote><ul><li>one</li><li>two</li></ul><p>{P}</p></div></div><div id='related-links'>{P}</div><section id='comments'><h3>Comments</h3><div><p>{P}</p></div></section>"), f"Hi {P}{P} one two {P}".strip()),
    (page(f"<div id=a><div id=b><p>{P * 2}</p><p>{P}</p><pre>x  =  1</pre><table><tr><td>k</td><td>v</td></tr></table></div><p>See <a href=x>more</a></p></div><div>Call us</div>"), f"{P * 3} x = 1 k v".strip()),
    (page(f"<div><ul>{'<li><a href=x>link text here</a></li>' * 30}</ul></div><div><p>{P * 3}</p><p>{P * 2}</p></div>"), (P * 5).strip()),
])
def test_pages(given, want):
    assert html.extract(given) == " ".join(want.split())


def test_depth_and_length_have_no_limit():
    began = time.time()
    assert html.extract("<div>" * 30_000 + P + "</div>" * 30_000) == P.strip()
    assert html.extract(page(f"<p>{P}</p>" * 5000)) == (P * 5000).strip()
    assert html.extract("<b>" * 20_000 + "x") == "x"
    assert html.extract("<" * 50_000) == "<" * 50_000
    assert time.time() - began < 20


def parsed(body):
    tree = html.parse(f"<html><body>{body}</body></html>")
    texts = tree.pieces
    return tree, texts, html.pruned(tree, texts), tree.tags.index("body")


def brute(tree, texts, keep, body):
    """Characters, link characters and densities by a walk down from each node, and the main text's nodes from their definition."""
    children = {i: [j for j, p in enumerate(tree.parents) if p == i] for i in range(len(tree.tags))}
    inline = [t in html.INLINE for t in tree.tags]

    def walk(i, link=False):
        """(characters, of links, tags, links) of the kept nodes in i."""
        link = link or tree.tags[i] == "a"
        size = sum(len("".join(t.split())) for j, t in texts if j == i) if keep[i] else 0
        c, lc = size, size if link else 0
        t = lt = 0
        for j in children[i]:
            if keep[j]:
                a, b, m, n = walk(j, link)
                c, lc, lt = c + a, lc + b, lt + n + (tree.tags[j] == "a")
                t += m + (tree.tags[j] == "a" or not inline[j] and tree.tags[j] != "br")
        return c, lc, t, lt

    whole = walk(body)
    d, cs, lcs = [], [], []
    for i in range(len(tree.tags)):
        linked, at = False, i
        while at >= 0:
            linked, at = linked or tree.tags[at] == "a", tree.parents[at]
        c, lc, t, lt = walk(i, linked)
        cs.append(c)
        lcs.append(lc)
        if not c or not keep[i] or inline[i] and i != body:
            d.append(0.0)
            continue
        x = c / max(1, lc) * max(1, t) / max(1, lt)
        base = math.log(math.e + c / max(1, c - lc) * max(1, lc) + whole[1] / max(1, whole[0]) * c)
        d.append(c / (t + 1) * math.log(max(1.0, x)) / math.log(base))
    sums = [sum(d[j] for j in children[i]) for i in range(len(d))]

    def inside(i):
        return [i, *(k for j in children[i] for k in inside(j))]

    def best(i):
        able = [j for j in inside(i) if keep[j] and (not inline[j] or j == body)]
        return max(able, key=lambda j: (sums[j], d[j], -j)) if able else i

    core = best(body)
    path = [core]
    while path[-1] != body:
        path.append(tree.parents[path[-1]])
    least = min(d[i] for i in path)
    picked = {core}
    for i in inside(body):
        if i != body and keep[i] and not inline[i] and d[i] >= least > 0:
            picked.add(best(i))
        elif tree.tags[i] in html.HEADINGS and keep[i] and core and tree.parents[i] == tree.parents[core]:
            picked.add(i)
    out = [False] * len(d)

    def mark(i, taken):
        out[i] = keep[i] and (taken or i in picked) and not (d[i] < least and 2 * lcs[i] > cs[i] and not inline[i] and i != core)
        for j in children[i]:
            mark(j, out[i])

    mark(0, False)
    return cs, lcs, d, out


def test_densities_by_hand():
    tree, texts, keep, body = parsed("<div><a href=x>12345</a></div><section><p>1234567890</p><p>1234 <b>567</b> 890</p></section>")
    assert tree.tags == ["html", "body", "div", "a", "section", "p", "p", "b"] and tree.parents == [-1, 0, 1, 2, 1, 4, 4, 6]
    c, lc, d = html.measures(tree, texts, keep, body)
    assert c == [25, 25, 5, 5, 20, 10, 10, 3] and lc == [5, 5, 5, 5, 0, 0, 0, 0]
    # a paragraph: 10 characters in a tag, none of links; a fifth of the body's characters are links'
    paragraph = 10 * math.log(10) / math.log(math.log(10 / 10 * 1 + 5 / 25 * 10 + math.e))
    assert d[5] == d[6] == pytest.approx(paragraph) and d[7] == d[3] == 0.0
    # the section: 20 characters in 3 tags, two of them below it
    assert d[4] == pytest.approx(20 / 3 * math.log(20 * 2) / math.log(math.log(1 + 4 + math.e)))
    # a block that is one link: as many characters and tags as its links
    assert d[2] == 0.0
    # the section's sum is 2 paragraphs, the body's is the section's density
    assert html.chosen(tree, c, lc, d, keep, body) == [False, False, False, False, True, True, True, True]


@pytest.mark.parametrize("seed", range(60))
def test_choice_against_brute_force(seed):
    rng = random.Random(seed)

    def node(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.choice([0, 1, 2, 5, 30])
        tag = rng.choice(["div", "section", "p", "ul", "li", "article", "nav", "h2", "a", "b", "span", "table", "aside", "footer"])
        return f"<{tag}>" + "".join(node(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    tree, texts, keep, body = parsed("".join(node(rng.randint(1, 5)) for _ in range(rng.randint(1, 5))))
    c, lc, d = html.measures(tree, texts, keep, body)
    want = brute(tree, texts, keep, body)
    assert c == want[0] and lc == want[1] and d == pytest.approx(want[2])
    if c[body]:
        assert html.chosen(tree, c, lc, d, keep, body) == want[3]


def test_density_chooses(monkeypatch):
    """Without densities, pages with menus give another text; the landmark elements have no say."""
    menu = "<ul>" + "".join(f"<li><a href=/{i}>section {i}</a></li>" for i in range(6)) + "</ul>"
    pages = [page(f"{a}{menu}{b}<{tag}><h1>Head</h1><p>{P}</p><p>{P}</p></{tag}>") for tag in ("article", "main", "div", "section") for a, b in (("<nav>", "</nav>"), ("<div class=menu>", "</div>"), ("", ""))]
    want = " ".join(f"Head {P}{P}".split())
    assert [html.extract(x) for x in pages] == [want] * len(pages)
    monkeypatch.setattr(html, "density", lambda *_: 0.0)
    assert all(html.extract(x) != want for x in pages)


def test_the_formula_chooses(monkeypatch):
    """Unnamed lists of short items and of links beside the article: without tags or links in the measure they come along."""
    links = lambda i: f"<a href=/{i}>A longer heading of some other story, number {i}</a>"
    kinds = [lambda i: f"{i} May", lambda i: f"{i} <a href=/{i}>May</a>", links]
    around = [("<ul>", "<li>", "</li>", "</ul>"), ("<div>", "<div>", "</div>", "</div>"), ("<table>", "<tr><td>", "</td></tr>", "</table>")]
    lists = [a + "".join(b + kind(i) + c for i in range(40)) + d for a, b, c, d in around for kind in kinds]
    pages = [page(f"{before}<div><h1>Head</h1><p>{P}</p><p>{P}</p></div>{after}") for x in lists for before, after in ((x, ""), ("", x), (x, x))]
    want = " ".join(f"Head {P}{P}".split())
    assert [html.extract(x) for x in pages] == [want] * 27
    right = []
    for measure in (lambda chars, *_: float(chars), lambda chars, tags, *_: chars / tags):
        monkeypatch.setattr(html, "density", measure)
        right.append(sum(html.extract(x) == want for x in pages))
    assert right[0] <= 18 and right[1] <= 18


def test_parsing_is_linear():
    n = 100_000
    for odd in ("<div>" * n + "</section>" * n, "<p><button>" + "<span>" * n + "<hr>" * n, "<b>" * n + "</i>" * n, "<table>" + "<tr><td><b>" * n, "<i><div></i>" * n, '<a "' * n):
        began = time.process_time()
        html.parse(odd)
        assert time.process_time() - began < 6


def test_threshold_adds_other_blocks():
    small, large = f"<section><p>{P}</p><p>{P}</p></section>", f"<section><p>{P}</p><p>{P}</p><p>{P}</p></section>"
    assert html.extract(page(f"<div>{small}{large}</div><div>Call us</div>")) == " ".join((P * 5).split())


def test_tables(spark):
    rows = [(1, "u", "<p>a", "x", "y"), (1, "u", "<p>a", "x", "y"), (None, None, None, None, None), (2, "v", "", "", "")]
    got = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(("given", "want"), [
    (f"<form action='./p.aspx'><input type=hidden value=x><div><h1>Head</h1><p>{P}</p><p>{P}</p></div><select><option>a</select><button>Go</button></form>", f"Head {P}{P}"),
    (f"<form><nav><a>Home</a></nav><article><p>{P}</p></article><div>{P * 3}</div></form>", P * 4),
    (f"<article class='post has-comments'><h1>Head</h1><p>{P}</p></article>", f"Head {P}"),
    (f"<main><article class='post has-comments'><p>{P * 2}</p><article class=comment><p>{P}</p></article></article></main>", P * 2),
    (f"<div class='post has-comments'><h1>Head</h1><p>{P}</p><p>{P}</p></div><div>Call us</div>", f"Head {P}{P}"),
    (f"<article><p>{P}</p><section class=comments><p>{P * 9}</p></section><form>{P}</form></article>", P),
])
def test_articles_are_not_cut_by_name(given, want):
    assert html.extract(page(given)) == " ".join(want.split())
