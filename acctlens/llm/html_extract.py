"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is main text or not. A node's own evidence (tag, names,
length, share of links) and potentials between parent and child are learned from labelled pages by
counting. Sum-product messages go from the leaves to the root and back, so each node gets its exact
marginal given the whole page; text belongs to the page's main text if its node's marginal is above
one half. Scripts, styles, comments and other things that are not text leave with the markup.

White space inside a block becomes one space, blocks are joined by one space in the order of the page.
Null or empty html, and pages without main text, give the empty text. Pages are read whole, however
long or deeply nested, unclosed or misnested. Repeated rows get equal texts. Further columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from acctlens.llm.textbytes import batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)|[^<]++|<", re.S)
UNQUOTED = re.compile(r"""[^>"']*+""")
# After the last sign that could end a tag: comments and text only.
PLAIN = re.compile(r"<!--.*|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not text of the page.
HIDDEN = frozenset("script style template noscript svg math iframe object canvas audio video head title textarea select datalist option button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# An opening tag that ends an open element of these names, up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
P_BORDERS = {"table", "td", "th", "caption", "button", "object"}
TAGS = frozenset("nav header footer aside form article main section p ul ol li table tr td blockquote pre figure figcaption dl body div".split())
AROUND = frozenset((
    "nav navbar navigation menu header masthead topbar toolbar footer sidebar aside widget ad ads adv advert advertisement adverts promo promoted "
    "sponsor sponsored banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup form search login share "
    "sharing social related recommended recommend comment comments reply replies respond discussion breadcrumb breadcrumbs pagination pager "
    "copyright legal tags meta byline author skip logo complementary contentinfo dialog").split())
MAIN = frozenset("article post entry content main story body text".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    cue: str = "none"
    label: int | None = None
    inline: bool = False
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    """Nodes in the order of the page (parents first) and the pieces of text with their nodes;
    a piece of node -1 parts blocks."""

    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    return {n.lower(): a or b or c or "" for n, a, b, c in ATTRIBUTE.findall(source)}


def _tag_end(html: str, at: int, final: dict[str, int], dead: set[int]) -> int:
    """Where the ``>`` of a tag is whose attributes begin at ``at``: the first one outside quoted values,
    however long, or the first of all if a quote is not closed or no tag ends after the values.

    ``final`` has the last quotes of the page, which nothing closes. ``dead`` keeps the quotes from which no
    end was found, so that a broken page is passed once.
    """
    place, met = at, []
    while True:
        place = UNQUOTED.match(html, place).end()
        sign = html[place : place + 1]
        if sign == ">":
            return place
        if not sign or place in dead or place == final[sign]:
            dead.update(met, [place])
            return html.find(">", at)
        met.append(place)
        place = html.find(sign, place + 1) + 1


def _cue(attributes: dict[str, str]) -> str:
    names = " ".join(attributes.get(n, "") for n in ("class", "id", "role", "aria-label"))
    if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "around"
    words = {w.lower() for w in NAME.findall(names)}
    if words & AROUND:
        return "around"
    return "main" if words & MAIN else "none"


def parse(html: str) -> Page:
    """The block elements of the page as a tree, and its texts."""
    page = Page([Node("page", -1)])
    # Open elements: (tag, node of their texts, inside a link).
    stack: list[tuple[str, int, bool]] = [("page", 0, False)]
    nodes, texts, hidden = page.nodes, page.texts, 0
    # How many of each are open, so that a deep page is not searched for what is not there.
    opened: Counter[str] = Counter()

    def close(upto: int) -> None:
        nonlocal hidden
        while len(stack) > upto:
            tag = stack.pop()[0]
            opened[tag] -= 1
            hidden -= tag in HIDDEN
            if tag not in INLINE:
                texts.append((-1, ""))

    at, find, last = 0, TOKEN.match, html.rfind(">")
    final, dead = {sign: html.rfind(sign) for sign in "\"'"}, set()
    while at < len(html):
        found = find(html, at) if at <= last else PLAIN.match(html, at)
        at = found.end()
        text = found[0]
        tag = found[2] if found.re is TOKEN else None
        if tag is None:
            if (text[0] != "<" or text == "<") and not hidden and not text.isspace():
                _, node, link = stack[-1]
                text = unescape(text) if "&" in text else text
                texts.append((node, text))
                nodes[node].chars += len(text)
                nodes[node].linked += len(text) if link else 0
            elif text.isspace() and not hidden:
                texts.append((stack[-1][1], " "))
            continue
        end = _tag_end(html, at, final, dead)
        tag, source, at = tag.lower(), html[at:end], end + 1
        if found[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag not in INLINE and tag not in VOID:
            ends, borders = ENDS.get(tag, (set(), set()))
            for names, stop in ((ends, borders), ({"p"}, P_BORDERS)):
                if not any(opened[n] > 0 for n in names):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in names:
                        close(k)
                        break
        if tag in VOID:
            if tag in ("br", "hr"):
                texts.append((-1, ""))
            continue
        _, parent, link = stack[-1]
        attributes = _attributes(source) if source.strip(" /") else {}
        node = parent
        if tag not in INLINE or "class" in attributes or "id" in attributes or "data-main" in attributes:
            label = attributes.get("data-main")
            nodes.append(Node(tag, parent, _cue(attributes), int(label) if label in ("0", "1") else None, tag in INLINE))
            node = len(nodes) - 1
        if tag not in INLINE:
            texts.append((-1, ""))
        if source.endswith("/") and tag in ("svg", "math"):
            continue
        stack.append((tag, node, link or tag == "a"))
        opened[tag] += 1
        hidden += tag in HIDDEN
        if tag in RAW:
            # What follows is not markup until the element's own end.
            end = re.compile(f"</{tag}\\b", re.I).search(html, at)
            at = end.start() if end else len(html)
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].chars += nodes[k].chars
        nodes[nodes[k].parent].linked += nodes[k].linked
    return page


def evidence(node: Node) -> tuple[str, ...]:
    """What a node shows of itself, as discrete features."""
    tag = node.tag if node.tag in TAGS else "heading" if re.fullmatch("h[1-6]", node.tag) else "inline" if node.inline else "other"
    size = "size:" + ("0" if not node.chars else str(min(4, int(math.log(node.chars, 6)))))
    share = node.linked / node.chars if node.chars else 0.0
    links = "none" if not node.linked else "few" if share < 0.3 else "some" if share < 0.7 else "most"
    return (f"tag:{tag}/{node.cue}/{links}", size)


@dataclass(frozen=True)
class Model:
    """Log odds of main text of each feature and of the root, and the child's label given the parent's."""

    features: dict[str, float]
    prior: float
    # By the child's names: chance that it is main text if its parent is around, and if it is main.
    child: dict[str, tuple[float, float]]


def train(pages: Iterable[str]) -> Model:
    """Counts over labelled pages, smoothed."""
    seen, labels, edges = Counter(), Counter(), Counter()
    for html in pages:
        page = parse(html)
        known: list[int] = []
        for i, node in enumerate(page.nodes):
            known.append(node.label if node.label is not None else known[node.parent] if i else 0)
            labels[known[i]] += 1
            seen.update((f, known[i]) for f in evidence(node))
            if i:
                edges[node.cue, known[node.parent], known[i]] += 1
    odds = {
        f: math.log((seen[f, 1] + 1) / (labels[1] + 2)) - math.log((seen[f, 0] + 1) / (labels[0] + 2))
        for f in {f for f, _ in seen}}
    child = {
        cue: tuple((edges[cue, p, 1] + 1) / (edges[cue, p, 0] + edges[cue, p, 1] + 2) for p in (0, 1))
        for cue in ("none", "around", "main")}
    return Model(odds, math.log((labels[1] + 1) / (labels[0] + 1)), child)


def marginals(page: Page, model: Model) -> list[float]:
    """Log odds of main text of every node, by messages up and down the tree."""
    get = model.features.get
    # The edges carry the share of main text, so a node's own features come in without a prior.
    belief = [max(-20.0, min(20.0, sum(get(f, 0.0) for f in evidence(n)))) for n in page.nodes]
    belief[0] += model.prior
    up, ties = [0.0] * len(belief), [model.child[n.cue] for n in page.nodes]
    exp, log = math.exp, math.log
    for i in range(len(belief) - 1, 0, -1):
        e, (t0, t1) = exp(max(-60.0, min(60.0, belief[i]))), ties[i]
        up[i] = log((t1 * e + 1 - t1) / (t0 * e + 1 - t0))
        belief[page.nodes[i].parent] += up[i]
    for i in range(1, len(belief)):
        e, (t0, t1) = exp(max(-60.0, min(60.0, belief[page.nodes[i].parent] - up[i]))), ties[i]
        belief[i] += log((t1 * e + t0) / ((1 - t1) * e + 1 - t0))
    return belief


def main_text(html: str | None, model: Model) -> str:
    page = parse(html or "")
    odds = marginals(page, model)
    blocks, block = [], []
    for node, text in [*page.texts, (-1, "")]:
        if node < 0:
            if block:
                blocks.append(" ".join("".join(block).split()))
                block = []
        elif odds[node] > 0:
            block.append(text)
    return " ".join(b for b in blocks if b)


@lru_cache(maxsize=4)
def _trained(pages: tuple[str, ...]) -> Model:
    return train(pages)


def extract_main(pages: DataFrame, labelled: list[str]) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, by a model of the labelled pages."""
    model = _trained(tuple(labelled))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "html"):
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
