"""HTML extraction by composite text density.

A page becomes a tree of elements. For each node, C is its characters, T its tags (its own and those below it that
aren't text-level), LC and LT the characters and tags of links; its density is C/T, adjusted by how much of it is links
against the whole body. A node's sum is that of its children's densities. The node with the largest sum is the core of
the content; the least density on its path to the body is the threshold, and every other node at or above the threshold
adds its own largest-sum descendant, as do headings beside the core. In what is chosen, nodes below the threshold that
are mostly links go. Nothing else chooses: menus and lists of links are told from text by their densities alone, and an
``article`` or ``main`` element counts as any other.

Before, what density can't tell from the article, as it reads like text, is cut out: scripts, styles, what is hidden,
forms, headers, footers, sidebars, adverts, notices and reader comments, by their elements, roles and names. An element
that holds an ``article`` or ``main``, or most of the text of a page without one, isn't cut for a name.

Defined cases: a null, empty or tagless page works (its text is the content; none gives an empty string); unclosed
elements, comments and raw-text elements end where HTML ends them; equal sums go to the denser, then the earlier node; a
repeated page gives its row again; an empty table gives an empty result; other columns of the table aren't read,
whatever their names; an end tag without an open partner ends nothing; parsing is iterative and linear in the page, so
depth and length have no limit.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import with_fields

TOKEN = re.compile(r"""<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element of the key's kind ends when one of the named starts, if it is open in the same block.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
#: Search for an open element to close stops here.
SCOPE = frozenset("html body div article section main table ul ol dl td th blockquote aside nav header footer form figure".split())
CUT = frozenset("head script style noscript template title aside footer form button select textarea input iframe noembed noframes svg canvas object embed dialog audio video xmp".split())
CUT_ROLES = frozenset("banner contentinfo complementary search form dialog alert alertdialog toolbar note".split())
#: Words in class or id of what isn't the article, unless it holds a landmark, or most of the text of a page without one outside it ...
CUT_ALWAYS = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored comment comments commentlist disqus respond replies reply discussion".split())
#: ... and of what isn't, unless it holds most of the page's text.
CUT_SMALL = frozenset("promo promotion banner sidebar sidebars side footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar paywall copyright legal topbar".split())
LANDMARKS = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Tree:
    """Elements in page order, a parent before its children, and the text between tags with the element that holds it."""

    __slots__ = ("tags", "attrs", "parents", "pieces", "sizes")

    def __init__(self) -> None:
        self.tags, self.attrs, self.parents = ["html"], [""], [-1]
        self.pieces: list[tuple[int, str]] = []  # (element, text); the element -1: a break between blocks
        self.sizes: list[int] | None = None  # characters but white space of each text, once they were counted


def parse(page: str) -> Tree:
    tree = Tree()
    tags, attrs, parents, pieces = tree.tags, tree.attrs, tree.parents, tree.pieces
    stack = [0]
    # where in the stack the open elements of each tag stand, those that end a search, and those that aren't text-level
    open_at: defaultdict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []
    blocks: list[int] = []
    has_body = False

    def push(i: int) -> None:
        place, tag = len(stack), tags[i]
        stack.append(i)
        open_at[tag].append(place)
        if tag in SCOPE:
            scopes.append(place)
        if tag not in INLINE:
            blocks.append(place)

    def cut(place: int) -> None:
        while len(stack) > place:
            i = stack.pop()
            open_at[tags[i]].pop()
            for kind in (scopes, blocks):
                if kind and kind[-1] == len(stack):
                    kind.pop()

    def close(names: Iterable[str], scope: bool) -> None:
        place = max((open_at[t][-1] for t in names if open_at.get(t)), default=0)
        if place and not (scope and scopes and scopes[-1] > place):
            cut(place)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            pieces.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            pieces.append((stack[-1], page[at : m.start()]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            pieces.append((-1, ""))
        if m["close"] or m["close2"]:
            if tag == "br":
                continue
            # an inline end tag never closes a block, a block's end tag closes what is open in it
            close((tag,), tag in INLINE or tag == "p")
            continue
        rest = m["attrs"] if m["tag"] else m["attrs2"]
        if tag == "html" or tag == "body" and has_body:
            if rest and tag == "html":
                attrs[0] = rest
            continue
        if tag == "body":
            has_body = True
            close(("head",), False)
        elif tag in CLOSES_P:
            if blocks and tags[stack[blocks[-1]]] == "p":
                cut(blocks[-1])
        if tag in CLOSES_SELF:
            close(CLOSES_SELF[tag], True)
        tags.append(tag)
        attrs.append(rest or "")
        parents.append(stack[-1])
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            pieces.append((len(tags) - 1, page[at : end.start()]))
            at = end.end()
        elif tag not in VOID and not (rest or "").endswith("/"):
            push(len(tags) - 1)
    return tree


def _names(attrs: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words: set[str] = set()
    role, hidden = "", False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words.update(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return words, role, hidden


def _per_node(tree: Tree, texts: list[tuple[int, str]], counts: list[bool]) -> list[int]:
    """Characters but white space in each node and below it, of the nodes that count."""
    if tree.sizes is None:
        tree.sizes = [len("".join(t.split())) for _, t in texts]
    out = [0] * len(tree.tags)
    for (i, _), n in zip(texts, tree.sizes, strict=True):
        if i >= 0 and counts[i]:
            out[i] += n
    for i in range(len(out) - 1, 0, -1):
        out[tree.parents[i]] += out[i]
    return out


def pruned(tree: Tree, texts: list[tuple[int, str]]) -> list[bool]:
    """Which nodes stay: not scripts, forms, headers, footers, sidebars, adverts, notices and comments."""
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    all_chars = _per_node(tree, texts, [t not in RAW for t in tags])
    marked = [False] * n  # holds a landmark
    for i in range(n - 1, 0, -1):
        if marked[i] or tags[i] in LANDMARKS:
            marked[parents[i]] = True
    keep, inside = [True] * n, [False] * n  # inside: of a landmark
    outer = [0] * n  # the nearest landmark around, or the page
    landmarks = any(t in LANDMARKS for t in tags)
    for i in range(1, n):
        p, tag = parents[i], tags[i]
        inside[i] = inside[p] or tag in LANDMARKS
        outer[i] = p if tags[p] in LANDMARKS else outer[p]
        most = 2 * all_chars[i] > all_chars[0]
        body_like = marked[i] or most and not landmarks  # what its name or kind alone doesn't cut
        if not keep[p] or tag in CUT and not (tag == "form" and (body_like or most and not inside[p])) or tag == "header" and not inside[i]:
            keep[i] = False
        elif tree.attrs[i] and tag != "body":
            words, role, hidden = _names(tree.attrs[i])
            if hidden or role in CUT_ROLES and not marked[i] and not (role == "form" and body_like):
                keep[i] = False
            elif words and not marked[i]:
                if tag in LANDMARKS:  # one in another, as of a comment, unless it holds most of that
                    named = inside[p] and 2 * all_chars[i] <= all_chars[outer[i]]
                else:
                    named = not body_like
                if named and words & CUT_ALWAYS or not most and tag not in LANDMARKS and (words & CUT_SMALL or "header" in words and not inside[i]):
                    keep[i] = False
    return keep


def density(chars: int, tags: int, link_chars: int, links: int, body_chars: int, body_link_chars: int) -> float:
    """Composite density of a node: characters per tag, its own among them, raised by how few of the characters and of the tags below are links'.

    A node without links counts as if it had one of one character, which keeps the logarithm's base above one.
    """
    if not chars:
        return 0.0
    linked, n = max(1, link_chars), max(1, links)
    base = math.log(chars / max(1, chars - link_chars) * linked + body_link_chars / max(1, body_chars) * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / linked * max(1, tags - 1) / n)) / math.log(base)


def measures(tree: Tree, texts: list[tuple[int, str]], keep: list[bool], body: int) -> tuple[list[int], list[int], list[float]]:
    """Characters, link characters and density of each node; text-level elements have no density of their own, but links count as tags."""
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    link = [False] * n
    for i in range(1, n):
        link[i] = link[parents[i]] or tags[i] == "a"
    c = _per_node(tree, texts, keep)
    lc = _per_node(tree, texts, [k and x for k, x in zip(keep, link, strict=True)])
    t, lt = [1] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not keep[i]:
            continue
        t[parents[i]] += t[i] - (tags[i] in INLINE and tags[i] != "a" or tags[i] == "br")
        lt[parents[i]] += lt[i] + (tags[i] == "a")
    return c, lc, [density(c[i], t[i], lc[i], lt[i], c[body], lc[body]) if keep[i] and (tags[i] not in INLINE or i == body) else 0.0 for i in range(n)]


def chosen(tree: Tree, c: list[int], lc: list[int], d: list[float], keep: list[bool], body: int) -> list[bool]:
    """Which nodes belong to the main text."""
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    sums = [0.0] * n
    for i in range(1, n):
        sums[parents[i]] += d[i]
    below = [False] * n
    for i in range(n):
        below[i] = i == body or i > 0 and below[parents[i]]
    able = [below[i] and keep[i] and (tags[i] not in INLINE or i == body) for i in range(n)]
    best = list(range(n))  # of each subtree, the node of the largest sum
    rank = lambda i: (sums[i], d[i], -i)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if able[best[i]] and (not able[best[p]] or rank(best[i]) > rank(best[p])):
            best[p] = best[i]
    core = best[body]
    threshold, i = d[core], core
    while i != body:
        i = parents[i]
        threshold = min(threshold, d[i])
    picked = [False] * n
    for i in range(n):
        if able[i] and i != body and d[i] >= threshold > 0:
            picked[best[i]] = True
        elif tags[i] in HEADINGS and keep[i] and core and parents[i] == parents[core]:
            picked[i] = True  # a heading beside the core is its own, however short
    picked[core] = True
    taken = [False] * n
    for i in range(n):
        links_only = d[i] < threshold and 2 * lc[i] > c[i] and tags[i] not in INLINE and i != core
        taken[i] = keep[i] and (picked[i] or i > 0 and taken[parents[i]]) and not links_only
    return taken


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    tree = parse(page)
    tags, n = tree.tags, len(tree.tags)
    texts = [(i, entities.unescape(t) if "&" in t and (i < 0 or tags[i] not in ("script", "style")) else t) for i, t in tree.pieces]
    keep = pruned(tree, texts)
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    c, lc, d = measures(tree, texts, keep, body)
    if body and not c[body]:
        body = 0
        c, lc, d = measures(tree, texts, keep, body)
    if not c[body]:
        return ""
    taken = chosen(tree, c, lc, d, keep, body)
    return " ".join("".join(" " if i < 0 else t if taken[i] else "" for i, t in texts).split())


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) for each page, in one pass without a shuffle."""

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["key", "url", "text", "n_chars"])

    return pages.select(F.col(key).alias("key"), "url", F.col(html).alias("html")).mapInArrow(batches, with_fields({"key": pages.schema[key].dataType, "url": pages.schema["url"].dataType}, "text string, n_chars long"))
