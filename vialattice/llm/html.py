"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Over a page, each path's text length and
punctuation per node are counted, smoothed over the sequence of nodes, and fused with the smoothed
values of the path's other nodes; paths whose score passes a share of the page's own mean, which
long text weighs most in, are chosen, and with them the region that holds the article. Paths that run
through navigation, headers, footers, asides, forms, notices, adverts or comments are never content.
What is furniture by its class, id or role only, is asked for its share of the page's scored text
first. Within the region a box is dropped only if both signs agree: its path isn't chosen and most of
its text is links.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, pick, tidied

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BREAK = re.compile(r"[>\"']")
#: One attribute after another, name and value, so that nothing within a value is taken for a name.
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option select button optgroup".split()
)
NEVER = frozenset("head nav aside footer form button select option menu dialog svg math canvas object video audio label input fieldset".split()) | RAW
CLOSES_P = BLOCK - frozenset("html head body option select button optgroup legend caption td th tr tbody thead tfoot".split())
#: What closes an open element of the same kind.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role names that tell page furniture and comments.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar aside rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs pager pagination masthead footer colophon copyright comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar tags toc complementary contentinfo search dialog hidden".split()
)
HEADER = frozenset("header topbar masthead siteheader".split())
#: Words that tell what an element has or how it stands, before and after the word they belong to.
BEFORE = frozenset("has have with without no not non".split())
AFTER = frozenset("open opened closed enabled disabled".split())
#: Shares of a page's scored text from which a name tells no furniture: if it has other words too, and if not.
SHARES = (0.5, 0.9)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that say nothing of what their text is, and the share of the page's mean path score and of its scored text from which a path is chosen.
BOXES, THIN, LIGHT = frozenset("div section center".split()), 0.3, 0.03
#: Blocks that hold a page's regions, not a paragraph, an item, a cell or a heading.
CONTAINERS = frozenset("html body article section main div center blockquote table tbody ul ol dl details figure".split())


def _attributes(given: str) -> Iterator[tuple[str, str]]:
    """Names in lower case, and values with their character references decoded."""
    for m in ATTRIBUTE.finditer(given):
        if m[1]:
            yield m[1].lower(), unescape(m[2] or m[3] or m[4] or "")


def _hidden(attributes: str) -> bool:
    return any(name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) for name, value in _attributes(attributes))


def _furniture(tag: str, attributes: str) -> float:
    """The share of the page that an element must hold to be content in spite of its names; 0: any."""
    share = 0.0
    for key, value in _attributes(attributes):
        for name in value.split() if key in ("class", "id", "role") else ():
            words = [w.lower() for w in NAME_PARTS.findall(name)]
            for k, w in enumerate(words):
                if not (w in FURNITURE or w in HEADER and tag != "h1"):
                    continue
                if k and words[k - 1] in BEFORE or k + 1 < len(words) and words[k + 1] in AFTER:
                    continue
                share = max(share, SHARES[all(x in FURNITURE or x in HEADER for x in words)])
    return share


class _Page:
    """Text nodes of a page in order: (block, innermost element, in furniture, text); names are judged later.

    Work is in proportion to the page: a quote that is never closed counts as an ordinary character,
    and elements know their parents instead of their paths.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[int, int, bool, str]] = []
        self.tags: list[str] = []  # of each element
        self.parent: list[int] = []  # -1: the page
        self.named: dict[int, float] = {}  # elements with names of furniture: share that overrules these
        self.stack: list[tuple[str, int, bool]] = []
        self.open: Counter[str] = Counter()
        self.block = 0
        self.unclosed: set[str] = set()  # quotes that don't occur any more
        at, n = 0, len(html)
        while at < n:
            m = MARKUP.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = self._markup(html, m)
        self._text(html[at:])

    def _markup(self, html: str, m: re.Match) -> int:
        """Read the comment or tag that begins here; where the text goes on."""
        n, kind = len(html), m[0]
        for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if kind == begin:
                found = html.find(end, m.end())
                return found + len(end) if found >= 0 else n
        if kind in ("<!", "<?"):
            return html.find(">", m.end()) + 1 or n
        name = NAME.match(html, m.end() - 1)
        tag, at = name[0].lower(), name.end()
        while True:
            k = BREAK.search(html, at)
            if k is None:
                end = at = n
                break
            if k[0] == ">":
                end, at = k.start(), k.end()
                break
            close = -1 if k[0] in self.unclosed else html.find(k[0], k.end())
            if close < 0:
                self.unclosed.add(k[0])
            at = close + 1 if close >= 0 else k.end()
        if kind[1] == "/":
            self._close(tag)
            return at
        self._open(tag, html[name.end() : end])
        if tag in RAW:
            self._pop(len(self.stack) - 1)
            close = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, at) if f"</{tag}" not in self.unclosed else None
            if close is None:
                self.unclosed.add(f"</{tag}")
            return close.end() if close else n
        return at

    def _text(self, text: str) -> None:
        if text and (text.strip() or self.nodes and self.nodes[-1][0] == self.block):
            self.nodes.append((self.block, self.stack[-1][1] if self.stack else -1, bool(self.stack) and self.stack[-1][2], text))

    def _pop(self, to: int) -> None:
        for tag, _, _ in self.stack[to:]:
            self.open[tag] -= 1
        del self.stack[to:]

    def _pop_to(self, tags: set[str] | frozenset[str], stop: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self._pop(k)
                return
            if self.stack[k][0] in stop:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._pop_to({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            self._pop_to(*SIBLINGS[tag])
        if tag in BLOCK:
            self.block += 1
        if tag in VOID:
            if tag in ("br", "wbr") and self.nodes and self.nodes[-1][0] == self.block and tag == "br":
                self._text(" ")
            return
        bad = bool(self.stack) and self.stack[-1][2]
        bad = bad or tag in NEVER or tag == "header" and not (self.open["article"] or self.open["main"]) or bool(attributes) and _hidden(attributes)
        # an article within another is a comment on it or a teaser
        named = attributes and not bad and tag not in ("html", "body", "main") and (tag != "article" or self.open["article"])
        if named and (share := _furniture(tag, attributes)):
            self.named[len(self.tags)] = share
        self.parent.append(self.stack[-1][1] if self.stack else -1)
        self.tags.append(tag)
        self.stack.append((tag, len(self.tags) - 1, bad))
        self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        if self.open[tag]:
            self._pop(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag))

    def below(self, marked: set[int]) -> list[bool]:
        """For each element, whether it is one of these or within one."""
        out: list[bool] = []
        for e, up in enumerate(self.parent):
            out.append(e in marked or up >= 0 and out[up])
        return out

    def summed(self, values: dict[int, float]) -> list[float]:
        """Values of innermost elements added up over all that hold them; the page's at the end."""
        out = [0.0] * (len(self.tags) + 1)
        for e, x in values.items():
            out[e] += x
        for e in range(len(self.parent) - 1, -1, -1):
            out[self.parent[e]] += out[e]
        return out


def _smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian means over neighbouring nodes."""
    weights = np.exp(-np.arange(-2, 3) ** 2 / 2)
    if len(values) < 2:
        return values
    padded = np.pad(values, 2, mode="edge")
    return np.convolve(padded, weights / weights.sum(), "valid")


def _runs(page: _Page, real: list) -> list[np.ndarray]:
    """Neighbouring nodes of one container, so that nothing is smoothed across a region's border."""
    own: list[int] = []
    for e, (tag, up) in enumerate(zip(page.tags, page.parent, strict=True)):
        own.append(e if tag in CONTAINERS or up < 0 else own[up])
    at = np.array([own[n[1]] if n[1] >= 0 else -1 for n in real])
    return np.split(np.arange(len(real)), np.flatnonzero(np.diff(at)) + 1)


def _path_scores(page: _Page, real: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's path, and its path's text length and punctuation for a node."""
    known: dict[tuple[int, str], int] = {}  # a path is the path above and a tag
    path: list[int] = []
    for tag, up in zip(page.tags, page.parent, strict=True):
        path.append(known.setdefault((path[up] if up >= 0 else -1, tag), len(known)))
    at = np.array([path[n[1]] if n[1] >= 0 else len(known) for n in real])
    count = np.bincount(at)
    length = np.bincount(at, [len(n[3].strip()) for n in real])
    marks = np.bincount(at, [len(PUNCTUATION.findall(unescape(n[3]))) for n in real])
    return at, length[at] / count[at], marks[at] / count[at]


def _weigh(page: _Page, real: list) -> tuple[np.ndarray, list[float]]:
    """Which nodes are chosen, and each element's mass (the page's at the end): its chosen nodes' scores by length."""
    at, length, marks = _path_scores(page, real)
    # fused: what a path has by itself, and what stands around its nodes
    near = np.concatenate([_smooth(length[r]) * (1 + _smooth(marks[r])) for r in _runs(page, real)])
    around = np.bincount(at, near)[at] / np.bincount(at)[at]
    score = np.sqrt(length * (1 + marks) * around)
    size = np.array([len(n[3]) for n in real])
    weight = np.bincount(at, score * size)[at]
    chosen = (score >= THIN * (score * size).sum() / size.sum()) & (weight >= LIGHT * (score * size).sum())
    mass: dict[int, float] = defaultdict(float)
    for n, s, good in zip(real, score.tolist(), chosen.tolist(), strict=True):
        if good:
            mass[n[1]] += s * len(n[3])
    return chosen, page.summed(mass)


def _link_boxes(page: _Page, kept: list) -> set[int]:
    """Outermost boxes without a chosen path whose text is mostly links: menus within the region."""
    if not kept:
        return set()
    chosen, _ = _weigh(page, kept)
    link = page.below({e for e, t in enumerate(page.tags) if t == "a"})
    held, linked, good = ({} for _ in range(3))
    for n, c in zip(kept, chosen.tolist(), strict=True):
        size = len(n[3].strip())
        held[n[1]] = held.get(n[1], 0) + size
        linked[n[1]] = linked.get(n[1], 0) + size * (n[1] >= 0 and link[n[1]])
        good[n[1]] = good.get(n[1], 0) + c
    held, linked, good = map(page.summed, (held, linked, good))
    return {e for e, t in enumerate(page.tags) if (t in BOXES or t in ("ul", "ol")) and held[e] and not good[e] and linked[e] > 0.5 * held[e]}


def extract(html: str | None) -> str:
    """The article's blocks, one a line; an empty string where there is none."""
    page = _Page(html or "")
    tags = page.tags
    nodes = [n for n in page.nodes if not n[2]]
    real = [n for n in nodes if n[3].strip()]
    heading = page.below({e for e, t in enumerate(tags) if t in HEADINGS})
    if page.named and real:
        _, mass = _weigh(page, real)
        # names without other words hold, too, for what has no heading beside other text
        heads = page.summed(Counter(n[1] for n in real if n[1] >= 0 and heading[n[1]]))
        furniture = page.below(set(page.named))
        others = any(n[1] < 0 or not furniture[n[1]] for n in real)
        named = page.below({e for e, share in page.named.items() if mass[e] < share * mass[-1] or share == SHARES[1] and others and not heads[e]})
        nodes = [n for n in nodes if n[1] < 0 or not named[n[1]]]
        real = [n for n in nodes if n[3].strip()]
    if not real:
        return ""
    chosen, mass = _weigh(page, real)
    marked = [e for e, t in enumerate(tags) if t in ("article", "main") and mass[e]]
    if marked:
        top = max(mass[e] for e in marked)
        outer = {e for e in marked if mass[e] >= 0.05 * top}
        inner = [e for e in outer if tags[e] == "article"]
        roots = set(inner) if inner and sum(mass[e] for e in inner) >= 0.5 * top else outer
        within = page.below(roots)
        keep = [n[1] >= 0 and within[n[1]] for n in nodes]
    else:
        # the deepest container that holds all that was chosen, and the page's headings
        held = Counter(n[1] for n, good in zip(real, chosen.tolist(), strict=True) if good or n[1] >= 0 and heading[n[1]])
        total = page.summed(held)
        root = max((e for e, t in enumerate(tags) if t in CONTAINERS and total[e] == total[-1]), default=None)
        within = page.below({root})
        keep = [root is None or n[1] >= 0 and within[n[1]] for n in nodes]
    kept = [n for n, k in zip(nodes, keep, strict=True) if k]
    menu = page.below(_link_boxes(page, [n for n in kept if n[3].strip()]))
    blocks: dict[int, list[str]] = defaultdict(list)
    for n in kept:
        if n[1] < 0 or not menu[n[1]]:
            blocks[n[0]].append(n[3])
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null html counts as empty and gives an empty text, as does a page without text outside page
    furniture. Markup that is never closed ends with the page. Repeated rows stay; other columns
    are ignored.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1000):
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
