"""Operator 2: main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As in browsers, a quote opens a value only after an equals sign; one that nothing closes is a character.
_VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
_MARKUP = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>=]|{_VALUE})*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup.
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article.
_FURNITURE = frozenset(
    "head script style noscript template svg math canvas iframe object embed audio video map nav menu aside footer form button select textarea input fieldset dialog title xmp noembed noframes datalist".split()
)
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of a class or id that tell furniture, in whatever name they stand ...
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside footer masthead cookie cookies consent gdpr popup modal newsletter signup pagination pager toolbar".split()
)
#: ... words that tell it only in a name of such words and neutral ones, as they may be what an article is about ...
_DOUBTFUL_WORDS = frozenset("promo promos promotion promotions notice notices overlay subscribe subscription share sharing social related recommended recommendations widget widgets login search header".split())
_NEUTRAL_WORDS = frozenset(
    "box bar block area wrap wrapper container content contents section list item items panel link links icon icons button buttons top bottom left right inner outer site page global main primary "
    "secondary post posts article articles story stories news more slot unit module zone space sticky fixed row col column grid card cards form field message text title us".split()
)
_TITLED = frozenset("post article entry story".split())
#: ... and reader comments, which may be articles themselves.
_COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
#: A start tag on the left ends open elements of the right, as far as the nearest of _SCOPES.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPES = frozenset("html body table ul ol dl menu select article section main div blockquote".split())
_STRUCTURE = _BLOCK - {"p"}
_HOLDERS = frozenset(["article", "main"])


class Node:
    """An element: its children are nodes and strings, in order."""

    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []


class _Open:
    """The open elements, with the places of each name and of blocks, structure and scopes, so nothing is searched."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.push(root)

    def push(self, node: Node) -> None:
        for kind in self._kinds(node.name):
            self.places.setdefault(kind, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, k: int) -> None:
        """End the elements from place k on."""
        while len(self.nodes) > k:
            for kind in self._kinds(self.nodes.pop().name):
                self.places[kind].pop()

    def last(self, kind: str) -> int:
        """Place of the innermost open element of a name or kind, -1 if there is none."""
        found = self.places.get(kind)
        return found[-1] if found else -1

    def outermost(self, names: set[str], above: int) -> int | None:
        """Place of the outermost open element of some names above a place."""
        found = [p[i] for n in names if (p := self.places.get(n)) and (i := bisect_right(p, above)) < len(p)]
        return min(found) if found else None

    @staticmethod
    def _kinds(name: str) -> list[str]:
        return [name] + [kind for kind, names in _KINDS if name in names]


_KINDS = (("#block", _BLOCK), ("#structure", _STRUCTURE), ("#scope", _SCOPES))


def parse(page: str) -> Node:
    """A forgiving tree of a page: unclosed and stray tags end as browsers end them, more or less. Time is linear in the page."""
    root = Node("html", {}, None)
    open_ = _Open(root)
    at, raw = 0, None

    def text(x: str, markup: bool = True) -> None:
        if x:
            open_.nodes[-1].children.append(html.unescape(x) if markup else x)

    while at < len(page):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            text(page[at : m.start()] if m else page[at:], markup=False)
            open_.close(len(open_.nodes) - 1)
            at, raw = (m.end() if m else len(page)), None
            continue
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"], markup=False)
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            k = open_.last(name)
            # a stray end tag does nothing, and one of an inline element doesn't close blocks
            if k > 0 and (name in _BLOCK or k > open_.last("#block")):
                open_.close(k)
            continue
        if name in ("html", "body") and open_.last(name) >= 0:
            continue
        if name in _BLOCK and open_.last("p") > open_.last("#structure"):
            open_.close(open_.last("p"))
        if name in _ENDS and (k := open_.outermost(_ENDS[name], open_.last("#scope"))):
            open_.close(k)
        attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m["attributes"])} if m["attributes"].strip(" /") else {}
        node = Node(name, attributes, open_.nodes[-1])
        open_.nodes[-1].children.append(node)
        if name in _VOID or (m["attributes"].endswith("/") and name not in _BLOCK and name not in _RAW):
            continue
        open_.push(node)
        if name in _RAW:
            raw = name
    return root


def _names(node: Node) -> list[list[str]]:
    """The class names and the id of an element, each as its words."""
    named = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split()
    return [[x.lower() for x in _TOKEN.findall(n)] for n in named]


class _Held:
    """What an element holds: names of elements, characters and blocks of text beside furniture by tag."""

    __slots__ = ("blocks", "chars", "names")

    def __init__(self):
        self.names, self.chars, self.blocks = set(), 0, 0


def _plainly_furniture(node: Node) -> bool:
    return node.name in _FURNITURE or "hidden" in node.attributes or "display:none" in node.attributes.get("style", "").replace(" ", "").lower()


def _furniture(node: Node, within: bool, held: _Held, page: int) -> bool:
    """Is this element, in an article or not, furniture? page: characters of the page beside furniture by tag.

    Names that tell furniture are only a hint: an element that holds most of the
    page's text stays, as a doubtful name or with several blocks of text.
    """
    if _plainly_furniture(node):
        return True
    if node.name in ("html", "body", "main"):
        return False
    names = _names(node)
    if any(_COMMENT_WORDS & set(n) for n in names) and "main" not in held.names and "h1" not in held.names:
        return True
    if node.name == "header" and not within:
        return not held.names & _HOLDERS
    if held.names & _HOLDERS or node.name == "article":
        return False
    most = 2 * held.chars > page
    if node.attributes.get("role", "").lower() in _FURNITURE_ROLES or any(_FURNITURE_WORDS & set(n) for n in names):
        return not (most and (held.blocks > 2 or "h1" in held.names))
    doubtful = [n for n in names if _DOUBTFUL_WORDS & set(n) and all(w in _DOUBTFUL_WORDS or w in _NEUTRAL_WORDS or w.isdigit() for w in n)]
    heads = [n for n in doubtful if "header" in n]
    if heads and len(heads) == len(doubtful):
        titled = any(_TITLED & set(n) for n in heads) and held.names & {"h1", "h2", "h3"}
        return not (within or most or titled or "h1" in held.names)
    return bool(doubtful) and not most


def prune(root: Node) -> None:
    """Take furniture out of a tree, from the root down."""
    held: dict[int, _Held] = {}
    for node in _bottom_up(root):
        own = held.setdefault(id(node), _Held())
        chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        own.chars += chars
        own.blocks += bool(chars) and node.name in _BLOCK
        if node.parent is not None:
            above = held.setdefault(id(node.parent), _Held())
            above.names |= own.names | {node.name}
            if not _plainly_furniture(node):
                above.chars += own.chars
                above.blocks += own.blocks
    page = held[id(root)].chars
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or node.name in _HOLDERS
        node.children = [x for x in node.children if isinstance(x, str) or not _furniture(x, within, held[id(x)], page)]
        todo += [(x, within) for x in node.children if not isinstance(x, str)]


def _bottom_up(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if not isinstance(x, str)]
    return order[::-1]


def main_subtree(root: Node) -> Node:
    """The subtree with the largest sum of its children's composite densities.

    A node has C characters, T tags, and of these LC and LT in links; body has
    Cb and LCb. Its density is C/T, weighed down by links: the logarithm of
    (C/LC)(T/LT) to the base ln(C/(C-LC) LC + LCb/Cb C + e). Ties go to the
    outer node. From the node of the largest sum the choice climbs: to the
    article or main element that holds it, else to parents as long as their
    density exceeds the threshold, the least density on the path to the body. A
    page's only main element, if it has text, stands for the body.
    """
    order = _bottom_up(root)
    figures: dict[int, list[int]] = {}
    for node in order:
        inside = [figures[id(x)] for x in node.children if not isinstance(x, str)]
        chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) + sum(f[0] for f in inside)
        tags = sum(f[1] + 1 for f in inside)
        if node.name == "a":
            figures[id(node)] = [chars, tags, chars, tags + 1]
        else:
            figures[id(node)] = [chars, tags, sum(f[2] for f in inside), sum(f[3] for f in inside)]
    mains = [x for x in order if x.name == "main" and figures[id(x)][0]]
    body = mains[0] if len(mains) == 1 else next((x for x in reversed(order) if x.name == "body"), root)
    cb, _, lcb, _ = figures[id(body)]

    def density(node: Node) -> float:
        c, t, lc, lt = figures[id(node)]
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + lcb / max(cb, 1) * c + math.e)
        weight = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))
        # a base near e to e has a logarithm near 0; the weight then isn't raised
        return c / t * weight / max(math.log(base), 1.0)

    densities = {id(x): density(x) for x in order}
    best, most = body, -1.0
    for node in reversed(_bottom_up(body)):
        own = sum(densities[id(x)] for x in node.children if not isinstance(x, str))
        # bare text of a block counts as a child without tags
        own += sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) if node.name in _BLOCK else 0
        if own > most:
            best, most = node, own
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    if holder := next((x for x in path if x.name == "article"), None) or next((x for x in path if x.name == "main"), None):
        return holder
    threshold = min(densities[id(x)] for x in path)
    for parent in path[1:]:
        if parent is body or densities[id(parent)] <= threshold:
            break
        best = parent
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space as one space each."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if joined := " ".join("".join(line).split()):
            out.append(joined)
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        else:
            if x.name in _BLOCK:
                end()
                todo.append(None)
            elif x.name == "br":
                line.append("\n")
            todo += reversed(x.children)
    end()
    return out


def main_text(page: str) -> str:
    """The article of a page as one line of text; empty if there is none."""
    root = parse(page)
    prune(root)
    return " ".join(blocks(main_subtree(root)))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text of every page.

    Null html: empty text; null ids and addresses are kept as they are. Each
    page is read alone, in time linear in its length, and nothing is shuffled,
    so repeated rows get a row each and an empty table gives an empty one.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py() or "") for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
