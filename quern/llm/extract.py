"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks. A classifier's costs of calling a block content or boilerplate become its capacities to
the two terminals; neighbours in the page and blocks of one parent are joined by smoothness edges. The minimum cut, found
by max-flow, labels the blocks. Before the flow, a block whose terminal costs differ by more than all its edges together is
settled at once (no cut could gain by calling it otherwise), which leaves small graphs or none.

Defined cases: null or empty html gives the empty text; markup that a cut-off page leaves open ends with the page; an empty table gives no
rows; repeated rows stay; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
HINTS = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
#: Elements in which a tag that ends in /> has no content.
FOREIGN = frozenset(("svg", "math"))
#: Elements that a new element of the kind closes, if open nearer than the stop.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOILER_TAGS = frozenset("nav footer aside form menu button select dialog fieldset search".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond replies reply widget toolbar pagination pager copyright legal disclaimer search contentinfo complementary dialog hidden".split())
CONTENT_WORDS = frozenset("article articlebody content post entry story main body".split())
#: First words of a class that say what a page or wrapper has, not what it is.
STATES = frozenset("has with no without is not show hide js can".split())
FIRM = 20.0
#: Evidence of boilerplate, in log odds: a class or id that is a boilerplate word, and an article or a fallback within such.
WHOLE, PARTLY = -6.0, -2.0
NEAR, SIBLING = 0.25, 0.5


class Block:
    __slots__ = ("text", "label", "parent", "linked", "lean")

    def __init__(self, text: str, label: int, parent: int, linked: int, lean: float = 0.0):
        self.text, self.label, self.parent, self.linked, self.lean = text, label, parent, linked, lean


def _label(tag: str, attrs: str, above: int, in_article: bool, lean: float) -> tuple[int, float]:
    """1 content, -1 boilerplate, 0 unknown: what the element says of itself, or else what stands above; and the log odds
    that class words add where that is 0. Words never settle a block, the cut weighs them."""
    if tag in BOILER_TAGS or tag == "header" and not in_article:
        return -1, 0.0
    words: set[str] = set()
    own, body = 0.0, False
    for name, value in HINTS.findall(attrs) if attrs else ():
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and "true" in value:
            return -1, 0.0
        body |= name.lower() == "itemprop" and "articlebody" in value.lower()
        for token in value.lower().strip("\"'").split():
            parts = [p for p in re.split(r"[^a-z0-9]+", token) if p]
            words.update(parts)
            if parts and not (len(parts) > 1 and parts[0] in STATES):
                own = min(own, WHOLE * sum(p in BOILER_WORDS or p == "header" and not in_article for p in parts) / len(parts))
    if tag in ("html", "body", "article", "main") and "comment" not in words:
        own = 0.0
    if above < 0:
        return above, 0.0
    if own < 0:
        return 0, min(own, lean)
    if tag == "main" or body:
        return 1, 0.0
    if tag == "article":
        return (1, 0.0) if lean > WHOLE else (0, PARTLY)
    if tag in ("noscript", "template") and not in_article:
        return 0, min(PARTLY, lean)
    if lean == 0 and words & CONTENT_WORDS and tag not in ("html", "body", "a", "span"):
        return 1, 0.0
    return above, lean


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. Text is whole: references decoded, white space single, ends trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, float]] = [("", 0, 0, False, 0.0)]  # tag, label, node, in an article, lean
    buffer: list[str] = []
    linked, nodes, links, at, end = 0, 0, 0, 0, len(html)

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                holder = next((s for s in reversed(stack) if s[0] in BLOCKS or not s[0]), stack[0])
                out.append(Block(text, stack[-1][1], holder[2] if holder[0] in ("ul", "ol", "div", "section", "article", "") or len(stack) < 2 else stack[max(0, stack.index(holder) - 1)][2], linked, stack[-1][4]))
            buffer.clear()
        linked = 0

    def close(k: int):
        nonlocal links
        if any(s[0] in BLOCKS for s in stack[k:]):
            flush()
        links -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    while at < end:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            buffer.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at, token = m.end(), m[0]
        name = NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag == "br":
                buffer.append(" ")
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag == "p" and not k:
                flush()
            # An inline end tag doesn't close the blocks around what it would close.
            if k and (tag in BLOCKS or not any(s[0] in BLOCKS for s in stack[k + 1 :])):
                close(k)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at) if not token.endswith("/>") else None
            if tag == "title":
                flush()
            at = (html.find(">", stop.start()) + 1 or end) if stop else at if token.endswith("/>") else end
            continue
        if tag in BLOCKS:
            flush()
            inner = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)
            if inner and stack[inner][0] == "p":
                close(inner)
            if tag in CLOSES:
                same, stops = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in same:
                        close(i)
                        break
        if tag in VOID:
            buffer.append(" " if tag in ("br", "img", "wbr") and tag != "wbr" else "")
            continue
        if token.endswith("/>") and (tag in FOREIGN or any(s[0] in FOREIGN for s in stack)):
            continue
        nodes += 1
        above = stack[-1]
        label, lean = _label(tag, token[name.end() :], above[1], above[3], above[4])
        stack.append((tag, label, nodes, above[3] or tag in ("article", "main"), lean))
        links += tag == "a"
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """What it costs to call a block content, and boilerplate."""
    if b.label:
        return (0.0, FIRM) if b.label > 0 else (FIRM, 0.0)
    words = b.text.count(" ") + 1
    z = -1.5 + 0.08 * min(words, 60) + 1.2 * (b.text[-1] in ".!?\"'”»…") - 4.0 * min(1.0, b.linked / max(1, len(b.text))) + b.lean
    return math.log1p(math.exp(-z)), math.log1p(math.exp(z))


def minimum_cut(unary: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where the minimum cut says content. unary: cost of content, of boilerplate; edges: cost of differing."""
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    # gain > 0: content is cheaper by so much.
    gain, label = [b - a for a, b in unary], [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] >= 0
            for j, c in near[i].items():
                del near[j][i]
                gain[j] += c if label[i] else -c
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _flow(rest, gain, near)
        for i in rest:
            label[i] = side[i]
    return label


def _flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Shortest augmenting paths; -1 is the content terminal, -2 the other. Content is what the source still reaches."""
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[-1], cap[-2] = {i: gain[i] for i in rest if gain[i] > 0}, {}
    for i in rest:
        cap[i][-1] = 0.0
        cap[i][-2] = max(0.0, -gain[i])
        cap[-2][i] = 0.0
        cap[-1].setdefault(i, 0.0)
    while True:
        came, queue = {-1: -1}, deque([-1])
        while queue and -2 not in came:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if -2 not in came:
            return {i: i in came for i in rest}
        path, j = [], -2
        while j != -1:
            path.append((came[j], j))
            j = came[j]
        push = min(cap[i][j] for i, j in path)
        for i, j in path:
            cap[i][j] -= push
            cap[j][i] += push


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        elif b.parent in last:
            edges.append((i - 1, i, SIBLING))
        last[b.parent] = i
    keep = minimum_cut([costs(b) for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(common.tidied(run), "page_id long, url string, text string, n_chars long")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
