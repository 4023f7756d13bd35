"""Main text of a page: minimum cut between content and boilerplate.

A page becomes a list of text blocks. A small linear classifier gives each block
the cost of either label; these are the capacities of its edges to the two
terminals. Neighbours in page order and blocks close in the tree are joined by
smoothness edges. The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.texts import lean

# Fixed values of HTML: elements whose content is raw text, that have no content, and that break lines of text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "button", "textarea", "label",
}
# Elements whose text is never shown as text, and those that hold no article text.
UNSEEN = {"head", "script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video",
          "noembed", "noframes", "datalist", "map"}
OUTSIDE = {"nav", "footer", "aside", "menu", "button", "select", "option", "textarea", "label", "fieldset", "legend",
           "dialog", "search", "header", "address"}
INSIDE = {"article", "main"}
# Words of class, id and role, each compared with a whole name or a whole part of a hyphenated one.
BOILER_WORDS = re.compile(
    r"ads?|adverts?|advertise\w*|advertising|sponsor\w*|promo\w*|banners?|nav|navs|navbar|navigation|menu\w*|breadcrumbs?|sidebars?|"
    r"side|footers?|header|masthead|topbar|toolbar|cookies?|consent|notices?|notifications?|alerts?|gdpr|privacy|newsletters?|"
    r"subscri\w*|signup|login|share|shares|sharing|social\w*|popular|trending|tags?|tagcloud|widgets?|popups?|modal|overlay|search|"
    r"searchbox|searchform|pagination|pager|copyright|legal|disclaimer|skip|complementary|contentinfo|dialog|form"
)
REMARK_WORDS = re.compile(r"comments?|commentlist|commenters?|repl(?:y|ies)|disqus|respond|related|recommend\w*|teasers?|cards?")
CONTENT_WORDS = re.compile(r"articles?|articlebody|post|entry|story|content|main|body|text|page")
# Names that tell how a page is laid out or filed, not what an element holds.
LAYOUT_FIRST = {"tag", "category", "cat", "format", "type", "status", "term", "layout", "template", "theme", "is", "js", "single", "archive"}
LAYOUT_ANY = {"has", "no", "not", "with", "without", "hide", "show"}
LAYOUT_LAST = {"open", "closed", "enabled", "disabled", "active", "visible", "hidden", "on", "off", "free"}
LISTS = {"list", "lists", "cloud", "links", "box"}  # after ``tag`` or ``category``: the list of them
PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

# A comment, a declaration, or a tag; quoted values may hold ``>``. Every run is consumed once, so reading is linear.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<![^>]*+>?|<\?[^>]*+>?|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
# One attribute after the other: a whole name and its value, which may contain anything.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?", re.A)
SENTENCE = re.compile(r"[.!?…。！？](?:\s|$)")

SURE = 12.0  # cost of a label that an element's own name rules out
WHOLE, PART = 15.0, 11.0  # what a word takes from the score: a whole name or the last part of one, another part of one
SMOOTH_ORDER, SMOOTH_TREE = 0.6, 1.2  # edges to the next block, and to the next one in the same element


def named(value: str, words: re.Pattern) -> float:
    """What the names of a class, id or role say for boilerplate: 0, ``PART`` or ``WHOLE``.

    The last part of a name says what the element is (``site-footer``), so it
    counts as a whole name does; ``article-header`` belongs to its article.
    Names of layout, state or filing (``has-sidebar``, ``tag-politics``,
    ``comments-open``) say nothing.
    """
    most = 0.0
    for name in value.split():
        parts = [x for x in (p.rstrip("0123456789").lower() for p in PARTS.split(name)) if x]
        if not parts:
            continue
        if len(parts) > 1:
            filed = parts[0] in LAYOUT_FIRST and parts[-1] not in LISTS
            if filed or parts[-1] in LAYOUT_LAST or not LAYOUT_ANY.isdisjoint(parts):
                continue
            if parts[-1] == "header" and CONTENT_WORDS.fullmatch(parts[0]) and parts[0] not in ("page", "main", "body"):
                continue
        if words.fullmatch(parts[-1]):
            return WHOLE
        if any(words.fullmatch(p) for p in parts):
            most = PART
    return most


class Node:
    """An open element: its name, what its attributes say, and (after ``judge``) what its ancestors say too."""

    __slots__ = ("name", "parent", "block", "unseen", "link", "layout", "remark", "content", "own", "rest", "hinted",
                 "outside", "inside", "hint", "boiler")

    def __init__(self, name: str, parent: Node | None, attributes: str):
        self.name, self.parent = name, parent
        self.block: Node = self if parent is None or name in BLOCKS else parent.block
        words, gone = [], False
        if attributes:
            read: set[str] = set()
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in read:
                    continue  # the first of a name counts
                read.add(key)
                if key in ("class", "id", "role"):
                    words.append(unescape(value))
                elif key == "style":
                    gone = gone or "display:none" in "".join(value.lower().split())
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    gone = True
        said = " ".join(words)
        free = not said or name in ("html", "body")
        self.layout = 0.0 if free or name in INSIDE else named(said, BOILER_WORDS)  # there they name its neighbours
        self.remark = 0.0 if free else named(said, REMARK_WORDS)
        if name == "form":
            self.layout = WHOLE
        self.content = not free and not self.layout and not self.remark and any(
            CONTENT_WORDS.fullmatch(p.lower()) for p in PARTS.split(said)
        )
        self.unseen = (parent is not None and parent.unseen) or name in UNSEEN or gone
        self.link = (parent is not None and parent.link) or name == "a"
        self.own = self.rest = self.hinted = 0  # characters below; those in article or main; those hinted at or in them


def judge(nodes: list[Node], found: list[Block]) -> None:
    """Hand down what elements say, in page order, once it is known how much text each of them holds.

    A layout word or a form around more than half of the text that elements do not
    rule out says nothing, unless an article or main element lies beside it. So
    does a part of a name like ``comment-area``, unless named content lies beside
    it; a whole name like ``comments`` keeps its say.
    """
    for n in nodes:
        up = n.parent or ROOT
        n.inside = up.inside or n.name in INSIDE
        n.hint = up.hint or n.content
        head = n.name == "header" and (n.inside or n.hint)  # an article's own header holds its title
        n.outside = up.outside or n.name in OUTSIDE and not head
    all_text = all_inside = all_hinted = 0
    for b in found:
        if not b.node.outside:
            size = len(b.text)
            b.node.own += size
            all_text += size
            if b.node.inside:
                b.node.rest += size
                all_inside += size
            if b.node.inside or b.node.hint:
                b.node.hinted += size
                all_hinted += size
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.own += n.own
            n.parent.rest += n.rest
            n.parent.hinted += n.hinted
    for n in nodes:
        up = n.parent or ROOT
        most = 2 * n.own > all_text and n.rest == all_inside
        n.boiler = max(up.boiler, 0.0 if most else n.layout, 0.0 if most and n.remark < WHOLE and n.hinted == all_hinted else n.remark)


class _Root:
    unseen = outside = inside = hint = link = False
    boiler, name, parent = 0.0, "", None


ROOT = _Root()


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: float):
        self.text, self.node, self.linked = text, node, linked


# an opening tag that ends open elements of the same kind, up to the given borders
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select", "datalist"})}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}


def blocks(html: str) -> list[Block]:
    """Visible text cut at block elements, white space reduced to one blank, in page order; linear in the page."""
    out: list[Block] = []
    nodes: list[Node] = []
    stack: list[Node] = []
    depths: dict[str, list[int]] = {}  # where elements of a name are open
    parts: list[str] = []
    linked, at, owner = 0, 0, None
    base = Node("", None, "")  # text outside of all elements
    nodes.append(base)

    def close() -> None:
        nonlocal linked, owner
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, owner, min(1.0, linked / len(text))))
            parts.clear()
        linked, owner = 0, None

    def write(text: str) -> None:
        nonlocal linked, owner
        top = stack[-1] if stack else base
        if text and not top.unseen:
            if owner is None and not text.isspace():
                owner = top.block
            if owner is not None:
                parts.append(text)
                if top.link:
                    linked += len(text.strip())

    def last(names: set[str]) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=-1)

    def drop(names: set[str], borders: set[str]) -> None:
        k = last(names)
        if k >= 0 and k > last(borders):
            for n in stack[k:]:
                depths[n.name].pop()
            del stack[k:]

    def push(node: Node) -> None:
        depths.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    while m := TOKEN.search(html, at):
        write(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            close()
        elif name == "br":
            write(" ")
        if m["end"]:
            drop({name}, set())
            continue
        if name in BLOCKS and name not in ("button", "label", "option", "select"):
            drop({"p"}, {"td", "th", "button", "table", "caption", "object"})
        if name in CLOSES:
            drop(*CLOSES[name])
        if name == "body":
            drop({"head"}, set())
        if name in VOID or m["rest"].endswith("/") and name not in BLOCKS and name not in RAW and name not in ("a", "b", "i", "span"):
            continue
        node = Node(name, stack[-1] if stack else base, m["rest"])
        nodes.append(node)
        if name in RAW:
            end = RAW_END[name].search(html, at)
            if name == "textarea":
                push(node)
                write(html[at : end.start() if end else len(html)])
                close()
                drop({name}, set())
            at = end.end() if end else len(html)
            continue
        push(node)
    write(html[at:])
    close()
    judge(nodes, out)
    return out


def costs(block: Block) -> tuple[float, float]:
    """Cost of calling a block boilerplate, and of calling it content.

    A linear score in what the tree says and how the text reads, as the two
    losses of a logistic classifier. Words of class, id and role are part of the
    score; only elements that never hold an article cost ``SURE``.
    """
    node, text = block.node, block.text
    if node.outside:
        return 0.0, SURE
    sentences = len(SENTENCE.findall(text))
    words = text.count(" ") + 1
    score = -0.6 + 0.9 * min(math.log2(words + 1), 6) / 3 + 0.5 * min(sentences, 3) - 4.0 * block.linked
    score += 5.0 * node.inside + 1.0 * node.hint - node.boiler
    score += {"p": 1.0, "h1": 1.5, "h2": 0.6, "h3": 0.6, "blockquote": 0.8, "pre": 0.8, "li": -0.4}.get(node.name, 0.0)
    if text[:1] == "©":
        score -= 3.0
    return math.log1p(math.exp(score)), math.log1p(math.exp(-score))


def minimum_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost, by shortest augmenting paths; True is content.

    ``keep[i]`` is lost if i is boilerplate, ``drop[i]`` if it is content, and an
    edge's weight if its ends differ.
    """
    n = len(keep)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):  # what both terminals would send through a block cancels out
        more = keep[i] - drop[i]
        if more > 0:
            add(source, i, more, 0.0)
        elif more < 0:
            add(i, sink, -more, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while place[a] < len(heads[a]):
                e = heads[a][place[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(heads[a]):
                path.append(heads[a][place[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1
            else:
                break


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between neighbours under one parent element."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH_ORDER))
        parent = id(block.node.parent or block.node)
        if parent in last:
            edges.append((last[parent], i, SMOOTH_TREE))
        last[parent] = i
    return edges


def main_text(html: str | None) -> str:
    """Content blocks joined by two line breaks; empty for null, empty or wordless pages."""
    found = blocks(html) if html else []
    if not found:
        return ""
    pairs = [costs(b) for b in found]
    content = minimum_cut([a for a, _ in pairs], [b for _, b in pairs], smoothness(found))
    return "\n\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every page, from its whole html.

    Each page is one row of one task and nothing is shuffled. Null and empty
    pages have an empty text. Null ids and urls and repeated rows are kept; extra
    columns are not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    found = rows.mapInArrow(lean(_extractor), "id long, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id, "url": url})
