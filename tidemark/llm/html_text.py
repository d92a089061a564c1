"""Main-text extraction by tree scoring.

A page becomes a tree of elements. Each paragraph gives points (one, one more for each comma, up to three for its length)
to its parent and half of them to its grandparent and a third to the next; a candidate's points, plus what its tag and
class say, are discounted by the share of its text that stands in links. The best container is kept with those siblings
that score near it or read as prose; a comment thread, advert, menu, form or notice is left out wherever it stands.

Names are weighed against text. A word such as ad, comments or sidebar in a class or id gives its element a weight; the element
stays if its prose, paragraphs scored as above, is so many times that of the rest of the page, and in an article layout words
(tools, related-work) need only hold prose at all. A weight is a quarter where the word stands beside one that isn't of place or form
(``ads-free``, ``subscribe-wall``); words for a state of the page (``has-sidebar``, ``nav-open``, ``tag-x``) don't count, nor does any name
beside a good one. An element around the page's only <article> or <main> stays whatever its name. A header goes unless it is
an article's own; a figure counts as a block of where it stands.

The work is linear in the page: a tag ends where a browser ends it (quotes count after an equals sign only; of tags that the page's
end cuts off the first few are read up to their first >), sums run up the tree once, and elements nested deeper than
``DEEPEST`` are read as blocks of the element at that depth.

Blocks are in page order: character references are decoded, white space inside a block is one space, ends are trimmed,
empty blocks go, and blocks are joined by a line feed. Nothing in the kept containers is cut short.

Cases: null or empty html and a page without text give the empty string; unclosed, crossed and stray tags, comments,
CDATA and cut-off markup are read as a browser would, roughly; equal rows give equal results; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: Attributes up to the tag's end, to a quote that never closes, or to the page's end.
_INSIDE = re.compile(r"(?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+", re.S)
#: Depth of the tree, and how many tags with a quote that never closes are read up to their first >.
DEEPEST, UNCLOSED = 512, 16
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")

#: Element names by their role.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas select title".split())
DROP = frozenset("nav header footer aside form button menu dialog input label fieldset noscript head script style template textarea iframe object svg math canvas select title embed audio video option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot".split())
SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
TAG_POINTS = {"article": 30, "main": 25, "section": 3, "div": 5, "blockquote": 3, "td": 3, "pre": 3, "body": 0, "ul": -3, "ol": -3, "dl": -3, "form": -10}
#: What words of a class or id say against an element, as a weight: how many times as much prose as all the rest of the page it
#: must hold to stay. Readers' comments outdo their article easily, adverts and notices now and then, parts of the layout don't.
NAME_WEIGHTS = {
    16.0: "combx comment comments commentlist disqus replies respond shoutbox",
    8.0: "ad ads advert adverts advertisement advertising consent cookie cookies gdpr modal newsletter notice notification outbrain popup promo promos promotion skyscraper sponsor sponsored sponsors subscribe taboola",
    1.0: "banner breadcrumb breadcrumbs discussion foot footer footnav header masthead menu menubar meta nav navbar navigation pager pagination related remark rss share sharing side sidebar social tag tags toolbar tools topbar widget",
}
WEIGHT_OF = {word: weight for weight, words in NAME_WEIGHTS.items() for word in words.split()}
#: Words that say where or in what form something stands: beside them a weight holds in full, beside others it is quartered.
PLACES = frozenset("area bar block body bottom box button buttons card col column container count entry footer form group header holder icon icons inner item items left link links list panel row section slot space stack text thread title top outer right unit wrap wrapper".split())
_NAME_PART = re.compile(r"[^\s_-]+")
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)


#: Class words that tell a state of the page or a subject, not the role of the element.
STATE = re.compile(r"(?:has|with|no|without)[_-]\S+|\S+[_-](?:open|opened|close|closed|active|visible|collapsed|fixed|enabled|disabled|on|off|left|right)|tags?[_-](?!list$|links?$|cloud$)\S+", re.I)
#: Points of prose that a weighed element needs in any case, and that one needs in an article to stay there.
LEAST = 3.0
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt".split())
OWN_HEADER = re.compile(r"(?:^|[\s_-])(?:article|entry|hentry|post|story)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "attributes", "parent", "items", "points", "bad", "weight", "inside", "depth", "chars", "linked", "ends", "own", "prose")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.items, self.points = tag, attributes, parent, [], 0.0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.chars, self.linked, self.ends, self.own, self.prose = 0, 0, False, 0.0, 0.0
        self.bad = tag in DROP and not (tag == "header" and self._of_article())
        self.weight, self.inside = 0.0, False
        if attributes and not self.bad and tag not in ("body", "html", "article", "main"):
            self.bad = self._hidden()
            if not self.bad:
                self._weigh()

    def names(self) -> str:
        if "class" not in self.attributes and "id" not in self.attributes:
            return ""
        return " ".join(v.strip("\"'") for k, v in _ATTRIBUTE.findall(self.attributes) if k.lower() in ("class", "id"))

    def _of_article(self) -> bool:
        return any(up.tag in ("article", "main") or (up.attributes and up.tag not in ("body", "html") and OWN_HEADER.search(up.names())) for up in _up(self.parent))

    def _hidden(self) -> bool:
        low = self.attributes.lower()
        if "hidden" in low and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", low):
            return True
        if "display" in low and re.search(r"display\s*:\s*none", low):
            return True
        return "role" in low and re.search(r"role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu)", low) is not None

    def _weigh(self) -> None:
        """weight: the largest that a word of the names has, 0 without one or beside a good name."""
        words = [w for w in self.names().lower().split() if not STATE.fullmatch(w)]
        weights = []
        for w in words:
            parts = _NAME_PART.findall(w)
            own = [WEIGHT_OF[x] for x in parts if x in WEIGHT_OF]
            full = all(x in WEIGHT_OF or x in PLACES or x.isdigit() for x in parts)
            weights.append((max(own) if full else max(own) / 4) if own else 0.0)
        if not any(weights) or any(GOOD_NAME.search(w) for w, x in zip(words, weights, strict=True) if not x):
            return
        self.inside = max(weights) <= 1 and self._of_article()
        self.weight = 0.0 if self.inside and self.tag in PROSE else max(weights)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree, and its elements in page order; an element's items are elements and raw strings in page order."""
    root = Node("#root", "", None)
    nodes = [root]
    at, here, end = 0, root, len(page)
    absent: set[str] = set()  # raw elements that nothing closes from here on
    deeper: list[str] = []  # open elements below the deepest level
    deep: Counter[str] = Counter()
    unclosed = 0
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            here.items.append(page[at:])
            break
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at, tag = m.end(), m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.items.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        stop = _INSIDE.match(page, at).end()
        if stop < end and page[stop] == "=":  # a quote that never closes
            unclosed += 1
            stop = page.find(">", at) if unclosed <= UNCLOSED else end
        if not at <= stop < end:
            break  # a tag that the page's end cuts off
        attributes = page[at:stop]
        at, tag = stop + 1, tag.lower()
        if m[1]:
            if deep[tag]:
                while deeper:
                    last = deeper.pop()
                    deep[last] -= 1
                    if last == tag:
                        break
                if tag in BLOCK:
                    here.items.append(Node("br", "#block", here))
                continue
            up = here
            while up is not None and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = None  # an inline end tag doesn't close blocks
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
                deeper.clear()
                deep.clear()
            elif tag == "p" or tag == "br":
                here.items.append(Node("br", "", here))
            continue
        if tag in CLOSES_P:
            up = here
            while up is not None and up.tag not in ("p", "#root") and (up.tag not in BLOCK or up.tag == tag == "p"):
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                here = up.parent
        if tag in SAME:
            up = here
            while up is not None and up.tag not in SAME[tag] and up.tag != "#root":
                if up.tag == tag or (tag in ("dd", "dt") and up.tag in ("dd", "dt")) or (tag in ("td", "th") and up.tag in ("td", "th")):
                    here = up.parent
                    break
                up = up.parent
        node = Node(tag, attributes, here)
        here.items.append(node)
        nodes.append(node)
        if tag in RAW:
            close = None if tag in absent else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if close is None:
                absent.add(tag)
            at = close.end() if close else (end if tag in ("script", "style", "textarea", "title") else at)
        elif tag not in VOID and not attributes.endswith("/"):
            if node.depth < DEEPEST:
                here = node
            elif not node.bad:
                deeper.append(tag)
                deep[tag] += 1
    return root, nodes


def _sum_up(nodes: list[Node], found: list[tuple[str, Node, int]]) -> None:
    """Characters, linked characters and whether a sentence ends, for each element with all below it."""
    for n in nodes:
        n.chars, n.linked, n.ends = 0, 0, False
    for plain, owner, in_links in found:
        owner.chars += len(plain)
        owner.linked += in_links
        owner.ends = owner.ends or plain[-1] in ".!?"
    for n in reversed(nodes):  # an element comes after its parent
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.linked += n.linked
            up.ends = up.ends or n.ends


def _plain(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip()


def blocks(node: Node) -> list[tuple[str, Node, int]]:
    """The blocks below node outside dropped parts: text, the block element that holds it, characters in links."""
    out: list[tuple[str, Node, int]] = []
    text: list[str] = []
    linked = 0
    # an explicit stack: pages may nest thousands deep
    stack: list = [(node, iter(node.items), node, False)]

    def flush(owner: Node) -> None:
        nonlocal linked
        if text:
            plain = _plain(text)
            if plain:
                out.append((plain, owner, min(len(plain), linked)))
            text.clear()
        linked = 0

    while stack:
        here, items, owner, anchor = stack[-1]
        for item in items:
            if isinstance(item, str):
                text.append(item)
                if anchor:
                    linked += len(_SPACE.sub(" ", item).strip())
                continue
            if item.tag == "br":
                flush(owner) if item.attributes == "#block" else text.append(" ")
                continue
            if item.tag == "hr":
                flush(owner)
                continue
            if item.bad:
                if item.tag in BLOCK:
                    flush(owner)
                continue
            if item.tag in BLOCK:
                flush(owner)
                stack.append((item, iter(item.items), item, anchor))
            else:
                stack.append((item, iter(item.items), owner, anchor or item.tag == "a"))
            break
        else:
            stack.pop()
            if here.tag in BLOCK or not stack:
                flush(owner)
    return out


def _points(plain: str, in_links: int) -> float:
    """What a block is worth as prose: for itself, its commas and its length, less what stands in links."""
    if len(plain) < 25:
        return 0.0
    return (1 + plain.count(",") + plain.count("，") + min(3, len(plain) // 100)) * (1 - in_links / len(plain))


def _settle(root: Node, nodes: list[Node]) -> None:
    """Decides which named elements go. An element around the page's only <article> stays. Lighter weights come first: what stays
    counts as the page's prose when heavier ones are weighed against it, each against the page's rest and its like."""
    if not any(n.weight for n in nodes):
        return
    inside: dict[int, bool] = {id(root): False}  # of something that is dropped, or may be
    outside, first = False, None
    for n in nodes[1:]:
        inside[id(n)] = inside[id(n.parent)] or n.bad or n.weight > 0
        if n.tag in ("article", "main") and not n.bad:
            outside = outside or not inside[id(n)]
            first = first or n
    if first is not None and not outside:
        for up in _up(first.parent):
            up.weight = 0.0
    named = [n for n in nodes if n.weight]
    near: dict[int, Node] = {id(root): root}  # the weighed element that each one is in
    for n in nodes[1:]:
        near[id(n)] = n if n.weight else near[id(n.parent)]
    for plain, owner, linked in blocks(root):  # lines too short for points weigh a little: they may be all that a page has
        near[id(owner)].own += _points(plain, linked) or len(plain) / 25 * (1 - linked / len(plain))
    stays = {id(root)}

    def add_up() -> None:
        """prose: an element's own and what those inside that stay hold."""
        for n in [root, *named]:
            n.prose = n.own
        for n in reversed(named):  # an element comes after those around it
            if id(n) in stays:
                near[id(n.parent)].prose += n.prose

    for weight in sorted({n.weight for n in named}):
        add_up()
        like = [n for n in named if n.weight == weight]
        rest = root.prose + sum(n.prose for n in like)
        for n in reversed(like):
            if n.prose >= (LEAST if weight > 1 or n.inside else 0.1) and (n.inside or n.prose >= weight * (rest - n.prose)):
                stays.add(id(n))
                if n.parent is not None:
                    near[id(n.parent)].prose += n.prose
    add_up()
    if not root.prose and named:  # nothing is left: of the lightest, what holds the most prose stays
        best = max(named, key=lambda n: (-n.weight, n.prose))
        if best.prose >= LEAST:
            stays.update(id(up) for up in _up(best))
    for n in named:
        n.bad = n.bad or id(n) not in stays


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page)
    _settle(root, nodes)
    found = blocks(root)
    if not found:
        return ""
    _sum_up(nodes, found)
    scored: dict[int, Node] = {}
    for plain, owner, in_links in found:
        points = _points(plain, in_links)
        if not points:
            continue
        up = owner.parent if owner.tag in PROSE else owner
        for share in (1, 2, 3):
            while up is not None and up.tag not in BLOCK and up.tag != "#root":
                up = up.parent
            if up is None:
                break
            if id(up) not in scored:
                scored[id(up)] = up
                up.points = TAG_POINTS.get(up.tag, 0) + (10 if up.attributes and GOOD_NAME.search(up.names()) else 0)
            up.points += points / share
            up = up.parent
    density = lambda n: n.linked / max(1, n.chars)
    if not scored:
        named = next((n for n in nodes if n.tag in ("article", "main") and n.chars), None)
        return "\n".join(p for p, o, k in found if (named in _up(o) if named else k < 0.5 * len(p)))
    final = lambda n: n.points * (1 - density(n))
    best = max(scored.values(), key=final)
    # an <article> or <main> around the best container holds the whole of it
    for up in _up(best):
        if up.tag in ("article", "main") and up is not best:
            best = up
            break
    keep = [best]
    limit = max(10.0, 0.2 * final(best)) if id(best) in scored else 10.0
    for sibling in best.parent.items if best.parent is not None else []:
        if isinstance(sibling, Node) and sibling is not best and not sibling.bad and sibling.chars:
            prose = sibling.tag == "p" and (sibling.chars > 80 and density(sibling) < 0.25 or density(sibling) == 0 and sibling.ends)
            heading = sibling.tag in ("h1", "h2") and best.tag not in ("article", "main")
            if prose or heading or (id(sibling) in scored and final(sibling) >= limit):
                keep.append(sibling)
    kept = {id(n) for n in keep}
    return "\n".join(p for p, o, _ in found if any(id(n) in kept for n in _up(o)))


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield batch({"page_id": b.column(0).to_pylist(), "url": b.column(1).to_pylist(), "text": texts}, schema)

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
