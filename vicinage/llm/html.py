"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with the path of block-level tags from the root to it. For every path
the length of the text outside links and the punctuation of its blocks are summed and divided by the number of
blocks; the two ratios are fused with a weight for what the tags and class words of the path say. The fused ratios are
smoothed along the page, neighbours counting by how much of the path they share, and paths below a threshold are
cut. What is left are the content nodes. The article is the element that holds all of them (or the <article> or <main>
that holds most of their text); inside it, blocks that stand beside the content as headings, lists and the like do
belong to it, and containers without any content node don't.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation annotation-xml".split())
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.IGNORECASE) for x in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover semantics".split())
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BARRIERS = frozenset("table article main section body".split())
#: Elements that are part of an article, never a whole one.
PARTS = frozenset("p ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th blockquote figure figcaption h1 h2 h3 h4 h5 h6 pre address details summary".split())
LISTED = frozenset("ul ol li dl dt dd td th tr".split())
#: Elements, and words in class, id or role, that speak against the article. They weigh, the ratios decide.
OUTSIDE = frozenset("nav footer aside form button select input dialog menu head object canvas audio video map".split())
_BEFORE, _AFTER = r"(?:^|\s)(?!(?:has|with|no|without)[-_])(?:[A-Za-z0-9]+[-_]+)*(?:", r")(?=$|[\s_-])"
WORDS = re.compile(_BEFORE + r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-?bar|aside|widget|menu|nav\w*|breadcrumbs?|footer|foot|comments?|commentlist|replies|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|copyright|disclaimer|skip-?link" + _AFTER, re.IGNORECASE)
HEADERS = re.compile(_BEFORE + r"header|masthead" + _AFTER, re.IGNORECASE)  # an article may have a header of its own
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""", re.IGNORECASE)
WHOLE = frozenset("article main".split())
PLAIN = frozenset("article main body html".split())
PUNCT = re.compile(r"[,.;:!?…。、，；：！？¿¡—–]")
#: Weights of the fusion: of an element that speaks against the article, of a word that does so (inside an <article>
#: or <main>, and elsewhere), and of an <article> or <main>.
AGAINST, WORD_INSIDE, WORD, FOR = 0.001, 0.2, 0.005, 3.0


class Page:
    """Blocks of a page, and for each element its parent, depth, path, weight and whether a word or tag speaks against it.

    Paths are numbers, one for each pair of a parent's path and a label, so they take no room that grows with depth.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.depth, self.path, self.weight, self.against, self.whole = [-1], ["#"], [0], [0], [1.0], [False], [False]
        self.below = [False]  # whether anything around or in the element speaks against it
        self.blocks: list[tuple[str, int, int]] = []  # text, characters in links, element
        self.shared: list[int] = []  # depth of the lowest element that holds a block and the one before it
        self._paths: dict[tuple[int, str], int] = {}
        self._text: list[str] = []
        self._links, self._in_link, self._low = 0, 0, 0
        self._stack = [0]  # block-level elements that are open
        self._open_at: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
        self._barriers = [0]
        at = 0
        while m := TAG.search(html, at):
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if name == "br":
                self._text.append("\n")
                continue
            if name in RAW:
                if not closing and not m[3].endswith("/>"):
                    end = RAW_END[name].search(html, at)
                    at = end.start() if end else len(html)
                continue
            if name in INLINE:
                if name == "a":
                    self._in_link = 0 if closing else 1
                if closing and self._top() == name:
                    self._flush()
                    self._pop()
                if closing or not is_outside(m[3], self.whole[self._stack[-1]]):
                    continue
                # an inline element that a word speaks against is kept apart from the text around it
            self._flush()
            if name in VOID:
                continue
            if closing:
                self._close(name)
                continue
            self._in_link = 0 if name not in INLINE else self._in_link
            if self._top() == "p":
                self._pop()
            if name in CLOSES:
                while self._top() in CLOSES[name].split():
                    self._pop()
            self._open(name, m[3])
        if at < len(html):
            self._add(html[at:])
        self._flush()

    def _top(self) -> str:
        return self.tag[self._stack[-1]]

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._links += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = "".join(self._text)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((text, min(self._links, len(text)), self._stack[-1]))
                self.shared.append(self._low)
                self._low = len(self._stack) - 1
            self._text, self._links = [], 0

    def _open(self, name: str, attrs: str) -> None:
        up, me = self._stack[-1], len(self.tag)
        mark = CLASS.search(attrs)
        label = f"{name}.{mark[1]}" if mark else name
        whole = self.whole[up] or name in WHOLE
        word = name not in PLAIN and is_outside(attrs, whole)
        weight = self.weight[up] * (AGAINST if name in OUTSIDE or (name == "header" and not whole) else 1.0) * (1.0 if not word else WORD_INSIDE if whole else WORD)
        self.parent.append(up)
        self.tag.append(name)
        self.depth.append(self.depth[up] + 1)
        self.path.append(self._paths.setdefault((self.path[up], label), len(self._paths) + 1))
        self.weight.append(max(weight, 1e-9) * (FOR if whole and not self.whole[up] else 1.0))
        self.against.append(word or name in OUTSIDE)
        self.below.append(self.below[up] or self.against[me])
        self.whole.append(whole)
        self._open_at.setdefault(name, []).append(len(self._stack))
        if name in BARRIERS:
            self._barriers.append(len(self._stack))
        self._stack.append(me)

    def _pop(self) -> None:
        k = len(self._stack) - 1
        if k:
            name = self.tag[self._stack.pop()]
            self._open_at[name].pop()
            if name in BARRIERS:
                self._barriers.pop()
            self._low = min(self._low, k - 1)

    def _close(self, name: str) -> None:
        at = self._open_at.get(name)
        if not at or (name in ("p", "li", "div", "span") and at[-1] < self._barriers[-1]):
            return
        k = at[-1]
        while len(self._stack) > k:
            self._pop()


def is_outside(attrs: str, whole: bool) -> bool:
    """Whether a class, id or role speaks against the article; ``whole``: inside an <article> or <main>."""
    if "=" not in attrs:
        return False
    values = [a or b or c for a, b, c in ATTR.findall(attrs)]
    return any(WORDS.search(x) or (not whole and HEADERS.search(x)) for x in values)


def fused(length: float, punctuation: float, blocks: int, weight: float) -> float:
    """The ratio of a path: its text and punctuation a block, fused with the weight of its tags and words. That of a
    path that many blocks share counts for more, since what surrounds an article rarely repeats its path."""
    return length * (1 + punctuation) * math.sqrt(blocks) * weight


def smooth(values: list[float], depths: list[int], shared: list[int], same: Callable[[int, int], bool], sigma: float = 1.0, radius: int = 2) -> list[float]:
    """Gaussian smoothing along the page; a neighbour counts by the share of its path that it has in common."""
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(radius + 1)]
    total, weights = list(values), [1.0] * len(values)
    for i in range(len(values)):
        low = depths[i]
        for k in range(1, radius + 1):
            j = i + k
            if j >= len(values):
                break
            low = min(low, shared[j])
            w = kernel[k] * (1.0 if same(i, j) else (low / max(1, depths[i], depths[j])) ** 2 / 4)
            total[i] += w * values[j]
            total[j] += w * values[i]
            weights[i] += w
            weights[j] += w
    return [a / b for a, b in zip(total, weights, strict=True)]


def path_ratios(page: Page, ratio: Callable[[float, float, int, float], float]) -> dict[int, float]:
    """The smoothed ratio of every path: the mean over its blocks."""
    sums: dict[int, list[float]] = {}
    for text, links, e in page.blocks:
        s = sums.setdefault(page.path[e], [0, 0, 0, page.weight[e]])
        s[0] += len(text) - 0.9 * links
        s[1] += len(PUNCT.findall(text))
        s[2] += 1
    of_path = {p: ratio(a / n, b / n, int(n), w) for p, (a, b, n, w) in sums.items()}
    paths = [page.path[e] for _, _, e in page.blocks]
    values = smooth([of_path[p] for p in paths], [page.depth[e] for _, _, e in page.blocks], page.shared, lambda i, j: paths[i] == paths[j])
    mean: dict[int, float] = {}
    for p, v in zip(paths, values, strict=True):
        mean[p] = mean.get(p, 0.0) + v / sums[p][2]
    return mean


def main_blocks(html: str, strength: float = 0.6, ratio: Callable[[float, float, int, float], float] = fused, prose: float = 0.65) -> list[str]:
    """The article's blocks in page order. Another ``ratio`` takes the place of the fused one.

    Paths of ``strength`` times the highest ratio are content. Inside an <article> or <main> a container that a word
    speaks against stays if the logarithm of a path in it reaches ``prose`` times the highest: it holds such text too.
    """
    page = Page(html)
    if not page.blocks:
        return []
    ratios = path_ratios(page, ratio)
    top = max(ratios.values())
    content = {p for p, v in ratios.items() if v >= max(strength * top, 1.0)}
    chosen = [k for k, (_, _, e) in enumerate(page.blocks) if page.path[e] in content]
    wholes: dict[int, int] = {}
    outermost = [0] * len(page.tag)  # the outermost <article> or <main> around an element
    for e in range(1, len(page.tag)):
        outermost[e] = outermost[page.parent[e]] or (e if page.tag[e] in WHOLE and not page.below[e] else 0)
    for k in chosen:
        text, _, e = page.blocks[k]
        if outermost[e]:
            wholes[outermost[e]] = wholes.get(outermost[e], 0) + len(text)
    if wholes:  # several articles belong together if they are of one path
        best = page.path[max(wholes, key=lambda e: wholes[e])]
        roots = {e for e in wholes if page.path[e] == best}
        prosaic = {p for p, v in ratios.items() if math.log1p(v) >= prose * math.log1p(top)}
        chosen = [k for k, (_, _, e) in enumerate(page.blocks) if page.path[e] in prosaic]
    elif chosen:
        root = page.blocks[chosen[0]][2]
        depth = min((page.shared[k] for k in range(chosen[0] + 1, chosen[-1] + 1)), default=page.depth[root])
        while page.depth[root] > depth or page.tag[root] in PARTS | INLINE:
            root = page.parent[root]
        roots = {root}
    else:
        return []
    live = [False] * len(page.tag)  # holds a content node
    for k in chosen:
        e = page.blocks[k][2]
        while e >= 0 and not live[e]:
            live[e] = True
            e = page.parent[e]
    kept = [False] * len(page.tag)
    for e in range(len(page.tag)):
        up = page.parent[e]
        if e in roots:
            kept[e] = True
        elif up >= 0 and kept[up]:
            kept[e] = live[e] or (not page.against[e] and (bool(wholes) or page.tag[e] in PARTS | INLINE))
    linked = lambda text, links, e: not wholes and links >= 0.9 * len(text) and page.tag[e] in LISTED
    return [text for text, links, e in page.blocks if kept[e] and (page.path[e] in content or not linked(text, links, e))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html: id, url, text, blocks (array), n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one
    space. A null or empty page, or one without an article, gives an empty text; null ids and urls are kept;
    repeated rows give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                blocks = [main_blocks(x) if x else [] for x in part.column(2).to_pylist()]
                texts = [" ".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(blocks, pa.list_(pa.string())), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "blocks", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kind}, url string, text string, blocks array<string>, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
