"""HTML main text by minimum cut: every block of a page is content or boilerplate, whichever labelling is cheapest overall.

A page is read into blocks, the texts between block-level tags. A block's features give two costs, of calling it content
and of calling it boilerplate; these are the capacities to the two terminals. Neighbouring blocks, and the next block under
the same parent, are joined by edges whose capacity is paid where the labels differ. The minimum cut is the cheapest
labelling, so a short paragraph in the middle of an article stays, and a long sentence among menu entries goes.

Script, style, nav, hidden elements and the like are surely boilerplate. The names of a wrapper (class, id, role) and a form only
cost: a block below pays the more, the smaller the share of the page's prose that stands below wrappers of those names, so a
layout div or page-wide form that holds the article costs next to nothing and an advertisement in it much. Articles and mains
below the fewest such wrappers are free of them; others, such as comments, are not.

Nodes whose terminal capacities differ by more than all their edges carry are labelled at once, which is exact and moves
their edges to the neighbours' terminals; augmenting paths solve what remains.

Cases: a null or empty page has no text; broken markup is read as far as it goes (open tags end with their parents, an
unclosed comment or script lasts to the end); ids and urls may be null or repeated, each row is judged alone; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "applet audio button canvas embed head iframe input map math noscript object script select style svg template"
    " textarea title video".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSES_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label|itemprop|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")

# What the names of classes, ids and roles say.
AGAINST = frozenset(
    "ad ads adv advert advertisement advertising adsense alert banner bar bio breadcrumb breadcrumbs byline comment comments"
    " commentlist complementary consent contentinfo cookie cookies copyright credits dialog discuss discussion disqus feedback foot footer form gdpr"
    " head header hidden legal login masthead menu menubar message meta metadata modal nav navbar navigation newsletter notice notices"
    " notification notifications paging pager pagination pagefooter pageheader popup privacy promo promoted promotion recommended"
    " related replies reply respond response responses review reviews rss search share sharing shoutbox sidebar signin signup sitemap skip skyscraper social"
    " sponsor sponsored sponsors subscribe subscription tags teaser toolbar toc topbar tracking trending utility warning"
    " widget widgets".split()
)
FOR = frozenset("article articlebody body content entry main maincontent post postbody prose story storybody text".split())
SKIPPED = frozenset("aside dialog footer header menu nav search".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?…。]")
NOTICE = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|cookies?\b.{0,40}\b(?:accept|consent|policy|use)|sign up|subscribe to|log in\b", re.I)

SURE, NEAR, SIBLING, INSIDE, NAMED = 40.0, 2.0, 1.0, 6.0, 28.0
ENOUGH = 20  # words of prose that a wrapper needs to be judged by its share


class Block:
    """A text, how much of it is linked, its element and parent, and what its ancestors say: surely no content (against), names
    that speak against it (vetoes), how many of these stand above each article (articles) and each name for content (marks)."""

    __slots__ = ("text", "linked", "kind", "parent", "against", "vetoes", "articles", "marks", "within", "named")

    def __init__(self, text: str, linked: int, kind: str, parent: int, above: tuple):
        self.text, self.linked, self.kind, self.parent = text, linked, kind, parent
        self.against, self.vetoes, self.articles, self.marks = above
        self.within, self.named = False, 0.0

    def prose(self) -> int:
        """Words, where the block reads like sentences."""
        words = self.text.count(" ") + 1
        plain = words >= 5 and self.linked <= 0.3 * len(self.text) and SENTENCE.search(self.text)
        return words if plain and not self.against else 0


def _name_says(attributes: str) -> tuple[bool, frozenset[str], bool]:
    """Whether the element is hidden, which of its names speak against content, and whether they speak for it."""
    hidden = for_ = False
    against: set[str] = set()
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name != "aria-label":
            whole = re.split(r"\s+", value)
            for word in whole:
                parts = [x.lower() for x in NAME_PARTS.findall(word)] or [word.lower()]
                joined = "".join(parts)
                if joined in AGAINST or any(x in AGAINST for x in parts):
                    against.add(DIGITS.sub("", word).lower())  # like names with other numbers are the same
                for_ |= joined in FOR or parts[-1] in FOR
    return hidden, frozenset(against), for_ and not against and not hidden


def blocks_of(page: str) -> list[Block]:
    """The page's texts between block-level tags, with what their ancestors say."""
    found: list[Block] = []
    # An open element: name, number, and what it and its ancestors say (see Block).
    stack: list[tuple[str, int, tuple]] = [("", 0, (False, (), (), ()))]
    number, pieces, linked, links, at = 0, [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = WHITE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                kind, parent = "", 0
                for name, own, *_ in reversed(stack):
                    if name in BLOCK or not name:
                        if not kind:
                            kind = name or "body"
                        else:
                            parent = own
                            break
                found.append(Block(text, min(linked, len(text)), kind, parent, stack[-1][2]))
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for name, *_ in stack[depth:]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                flush()
        del stack[depth:]

    size = len(page)
    while at < size:
        tag = TAG.search(page, at)
        stop = tag.start() if tag else size
        if stop > at:
            piece = page[at:stop]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if not tag:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), tag[1] or tag[4], tag[3] or tag[6] or ""
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if name in BLOCK:
                        flush()
                    close(depth)
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in BLOCK:
            flush()
            depth = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k][0]
                if open_ == "p" or open_ in CLOSES_SAME.get(name, ()) or (open_ in HEADINGS and name in HEADINGS):
                    depth = k
                elif open_ in BLOCK and open_ != "p":
                    break
            if depth < len(stack):
                close(depth)
        if name in VOID:
            continue
        if attributes.rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        number += 1
        against, vetoes, articles, marks = stack[-1][2]
        if name == "a":
            links += 1
        elif name in DROPPED:
            against = True
        elif name in BLOCK or name == "span":
            hidden, says_no, says_yes = _name_says(attributes) if attributes.strip() else (False, frozenset(), False)
            if name == "form":
                says_no |= {"form"}
            if name in SKIPPED:
                against = against or hidden or not (name == "header" and (articles or marks) and not says_no)
            elif name not in ("html", "body"):
                against = against or hidden
                # Once for all wrappers of the same names in one another.
                if says_no and says_no not in vetoes:
                    vetoes += (says_no,)
                if name in ("article", "main"):
                    if len(vetoes) not in articles:
                        articles += (len(vetoes),)
                elif says_yes and len(vetoes) not in marks:
                    marks += (len(vetoes),)
        stack.append((name, number, (against, vetoes, articles, marks)))
    flush()
    _judge(found)
    return found


def _judge(blocks: list[Block]) -> None:
    """Sets which blocks are inside an article, and what the names of wrappers around each cost."""
    prose = [b.prose() for b in blocks]
    # A comment is often an article of its own below the first.
    inside = [b for b in blocks if b.articles and not b.against]
    told = [b for b, n in zip(blocks, prose) if n and b.articles]
    least = min((b.articles[0] for b in told or inside), default=None)
    total, below = sum(prose), {}
    for block, n in zip(blocks, prose):
        free = least if least in block.articles else 0
        block.within = not block.against and (least in block.articles or any(k <= free for k in block.marks))
        block.vetoes = block.vetoes[free:]
        for names in block.vetoes:
            below[names] = below.get(names, 0) + n
    for block in blocks:
        for names in block.vetoes:
            share = below[names] / max(total, 1) * min(below[names] / ENOUGH, 1.0)
            block.named = max(block.named, NAMED * (1 - share) ** 2)


def costs(block: Block, has_article: bool) -> tuple[float, float]:
    """What it costs to call the block boilerplate, and to call it content."""
    if block.against:
        return 0.0, SURE
    length = len(block.text)
    density = block.linked / max(length, 1)
    content, boilerplate = 0.5, 0.5 + block.named
    if block.within:
        content += INSIDE
    elif has_article:
        boilerplate += INSIDE
    words = block.text.count(" ") + 1
    content += min(words / 12.0, 4.0)
    if SENTENCE.search(block.text):
        content += 0.75
    if block.kind in HEADINGS:
        content += 0.5
    elif block.kind in ("p", "pre", "blockquote", "td"):
        content += 1.0
    elif block.kind == "li" and density > 0.5:
        boilerplate += 2.0
    boilerplate += 6.0 * density if density > 0.3 else 0.0
    if words < 5 and block.kind not in HEADINGS and not block.within:
        boilerplate += 1.5
    if length < 200 and NOTICE.search(block.text) and not block.within:
        boilerplate += 4.0
    return content, boilerplate


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut. source, sink: terminal capacities; edges: both ways."""
    n = len(source)
    source, sink = list(source), list(sink)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        a = queue.popleft()
        if side[a] is None and abs(source[a] - sink[a]) > sum(near[a].values()):
            side[a] = source[a] > sink[a]
            for b, w in near[a].items():
                (source if side[a] else sink)[b] += w
                del near[b][a]
                queue.append(b)
            near[a] = {}
    rest = [a for a in range(n) if side[a] is None]
    if rest:
        excess = {a: source[a] - sink[a] for a in rest}  # the common part flows straight through
        while True:
            back: dict[int, int] = {a: -1 for a in rest if excess[a] > 1e-9}
            queue, end = deque(back), None
            while queue and end is None:
                a = queue.popleft()
                for b, room in near[a].items():
                    if room > 1e-9 and b not in back:
                        back[b] = a
                        if excess[b] < -1e-9:
                            end = b
                            break
                        queue.append(b)
            if end is None:
                break
            path, a = [end], end
            while back[a] >= 0:
                a = back[a]
                path.append(a)
            path.reverse()
            flow = min(excess[path[0]], -excess[end], *(near[x][y] for x, y in zip(path, path[1:])))
            excess[path[0]] -= flow
            excess[end] += flow
            for x, y in zip(path, path[1:]):
                near[x][y] -= flow
                near[y][x] = near[y].get(x, 0.0) + flow
        for a in rest:
            side[a] = a in back
    return [bool(x) for x in side]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    has_article = any(b.within and not b.vetoes for b in blocks)
    terminal = [costs(b, has_article) for b in blocks]
    edges, last = [], {}
    for k, block in enumerate(blocks):
        if k:
            edges.append((k - 1, k, NEAR if blocks[k - 1].parent == block.parent else NEAR / 2))
        before = last.get(block.parent)
        if before is not None and before != k - 1:
            edges.append((before, k, SIBLING))
        last[block.parent] = k
    content = minimum_cut([c for c, _ in terminal], [b for _, b in terminal], edges)
    return "\n".join(b.text for b, good in zip(blocks, content) if good)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    known = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return known.mapInArrow(extract, "page_id long, url string, text string")
