"""Main text of web pages by composite text density.

For every node of the document tree the density is the number of characters per
tag, adjusted by how much of it stands in links. The node whose children's
densities have the largest sum leads to the article; the least density on its
path to the body is the threshold that tells which of its surroundings belong.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, whole

SCHEMA = "page_id long, url string, text string, n_chars long"

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body br head html option td th tr tbody thead tfoot legend dd dt li".split())
SIBLINGS = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select", "tbody": "table", "thead": "table", "tfoot": "table"}
CLOSES = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
# fixed values: what is not an article, by element, by role, and by the words of class and id
NOT_TEXT = frozenset("head nav footer select input textarea script style noscript iframe svg math canvas object embed audio video map template dialog menu datalist title noembed noframes xmp".split())
# fixed values: what may also be wrapped around an article, and what may also stand inside a sentence
AROUND = frozenset("aside form fieldset".split())
INLINE = frozenset("button label".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion related recommended replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
TEXT_WORDS = frozenset("article body content entry main page post story text".split())
PIECE = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The element tree of a page as flat lists, in document order; node 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["#root"], [0], [""]
        #: (node, characters) in page order; None for characters is the edge of a block
        self.order: list[tuple[int, str | None]] = []
        self.parse(source)

    def parse(self, source: str) -> None:
        tag, parent, order = self.tag, self.parent, self.order
        stack = [0]
        opened: Counter[str] = Counter()

        def close(upto: int) -> None:
            while len(stack) > upto:
                name = tag[stack.pop()]
                opened[name] -= 1
                if name in BLOCK:
                    order.append((stack[-1], None))

        def find(names: tuple[str, ...], stops: frozenset | tuple) -> int:
            """Depth of the nearest open element with one of the names, before any of the stops; 0 if none."""
            if not any(opened[n] for n in names):
                return 0
            for depth in range(len(stack) - 1, 0, -1):
                name = tag[stack[depth]]
                if name in names:
                    return depth
                if name in stops:
                    return 0
            return 0

        at, size = 0, len(source)
        while at < size:
            m = PIECE.search(source, at)
            if m is None:
                order.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                order.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    order.append((stack[-1], html.escape(m[0][9:].removesuffix("]]>"))))
                continue
            name = name.lower()
            if m[1] or m[4]:
                stops = () if name in ("html", "body") else ("table",) if name in BLOCK and name != "table" else () if name == "table" else tuple(BLOCK - {"br", "hr"})
                depth = find((name,), tuple(s for s in stops if s != name))
                if depth:
                    close(depth)
                continue
            if name in ENDS_PARAGRAPH and (depth := find(("p",), ("table", "td", "th", "button", "object", "caption"))):
                close(depth)
            if name in SIBLINGS and (depth := find(CLOSES.get(name, (name,)), tuple(SIBLINGS[name].split()))):
                close(depth)
            node = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            self.attributes.append(m[3] or m[6] or "")
            if name in BLOCK:
                order.append((stack[-1], None))
            if name in VOID or name not in RAW and (m[3] or m[6] or "").endswith("/") and name not in BLOCK and name != "a":
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\s*/?>", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
                continue
            stack.append(node)
            opened[name] += 1

    def described(self, node: int) -> tuple[str, set[str], bool]:
        """Role, words of class and id, and whether the element is hidden."""
        role, words, hidden = "", set(), False
        if self.attributes[node]:
            for key, value in ATTRIBUTE.findall(self.attributes[node]):
                key, value = key.lower(), value.strip("\"'")
                if key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                    hidden = True
                elif key in ("class", "id"):
                    words |= {w.lower() for w in WORDS.findall(value)}
        return role, words, hidden


def sums(page: Page, values: list[float]) -> list[float]:
    """Of every node, the values of its subtree."""
    out = list(values)
    for n in range(len(out) - 1, 0, -1):
        out[page.parent[n]] += out[n]
    return out


class Densities:
    """Characters, tags and links below every node that is kept, its composite text density, and the sum over its children."""

    def __init__(self, page: Page, own: list[int], keep: list[bool], body: int):
        count, tag, parent = len(page.tag), page.tag, page.parent
        live = [c if k else 0 for c, k in zip(own, keep, strict=True)]
        link = [False] * count
        for n in range(1, count):
            link[n] = link[parent[n]] or tag[n] == "a"
        self.live, self.keep = live, keep
        self.chars, self.tags = sums(page, live), sums(page, [float(k) for k in keep])
        self.link_chars = sums(page, [c if a else 0 for c, a in zip(live, link, strict=True)])
        self.link_tags = sums(page, [float(k and t == "a") for t, k in zip(tag, keep, strict=True)])
        self.share = self.link_chars[body] / max(1, self.chars[body])
        self.dense = [self.of(n) for n in range(count)]
        total, children = [0.0] * count, [False] * count
        for n in range(1, count):
            total[parent[n]] += self.dense[n]
            children[parent[n]] = True
        self.total = [s if c else d for s, c, d in zip(total, children, self.dense, strict=True)]
        for n in range(count):  # text that stands in a container itself, parted by line breaks, is a child like a paragraph
            if tag[n] in CONTAINERS and children[n] and 2 * live[n] > self.chars[n]:
                self.total[n] += live[n] * math.log(max(1.0, live[n]) + 1) / 0.1

    def of(self, n: int) -> float:
        """Characters per tag, times a factor that falls with the share of links."""
        c, t, lc, lt = self.chars[n], max(1.0, self.tags[n]), self.link_chars[n], self.link_tags[n]
        if not self.keep[n] or not c:
            return 0.0
        base = math.log(math.log(c / max(1, c - lc) * lc + self.share * c + math.e))
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1) / max(base, 0.1)

    def menu(self, n: int) -> bool:
        """Whether a node is little but short links: longer ones are titles, as in a list of references."""
        return self.link_tags[n] >= 3 and self.link_chars[n] > 0.8 * self.chars[n] and self.link_chars[n] <= 30 * self.link_tags[n]


def main_text(source: str) -> str:
    """The article of a page: white space as one space, blocks joined by one space; empty if there is none."""
    page = Page(source)
    tag, parent, count = page.tag, page.parent, len(page.tag)
    own = [0] * count
    for node, chars in page.order:
        if chars:
            own[node] += len(" ".join(chars.split()))

    # what no article has, unless it holds most of the page
    chars = sums(page, own)
    links = sums(page, [c if t == "a" else 0 for c, t in zip(own, tag, strict=True)])
    holds = [t in ("article", "main") for t in tag]
    for n in range(count - 1, 0, -1):
        holds[parent[n]] = holds[parent[n]] or holds[n]
    inside, keep = [False] * count, [True] * count
    body = next((n for n in range(count) if tag[n] == "body"), 0)
    raw = sums(page, [c if t in RAW or t == "head" else 0 for c, t in zip(own, tag, strict=True)])
    most = max(1, chars[body] - links[body] - raw[body])

    def wraps(n: int) -> bool:
        return holds[n] or 2 * (chars[n] - links[n] - raw[n]) >= most

    for n in range(1, count):
        inside[n] = inside[parent[n]] or tag[n] in ("article", "main")
        role, words, hidden = page.described(n)
        drop = tag[n] in NOT_TEXT or tag[n] == "header" and not inside[n] or (tag[n] in AROUND or role in NOT_ROLES) and not wraps(n) or hidden
        if tag[n] in INLINE:
            drop = drop or tag[parent[n]] != "p" or 4 * chars[n] > chars[parent[n]]
        if not drop and tag[n] not in ("html", "body", "main", "article", "p") and words & NOT_WORDS and not (words & TEXT_WORDS and not words & {"comment", "comments", "ad", "ads", "sidebar", "footer", "related"}):
            drop = not wraps(n)
        keep[n] = keep[parent[n]] and not drop

    d = Densities(page, own, keep, body)
    if not d.chars[0]:
        return ""
    best = max((n for n in range(count) if keep[n] and d.chars[n]), key=lambda n: (d.total[n], -n))
    path = [best]
    while path[-1] not in (0, body):
        path.append(parent[path[-1]])
    threshold = min(d.dense[n] for n in path)
    marked = [keep[n] and d.chars[n] > 0 and d.dense[n] >= threshold and tag[n] in BLOCK for n in range(count)]
    above = set(path[1:])  # what stands around the best node says nothing by itself
    marks = sums(page, [float(m and n not in above) for n, m in enumerate(marked)])

    # up from the best node as long as more of the article lies around it
    chosen = best
    beside: set[int] = set()
    # containers beside it whose density sum is of the same kind are parts of the article, too
    alike: dict[int, list[int]] = {}
    for n in range(1, count):
        if keep[n] and tag[n] in CONTAINERS and 2 * d.dense[n] >= threshold and 4 * d.total[n] >= d.total[best] and 4 * d.link_chars[n] < d.chars[n]:
            alike.setdefault(parent[n], []).append(n)
    for below, up in zip(path, path[1:], strict=False):
        parts = [n for n in alike.get(up, ()) if n != below]
        if up in (0, body):
            if parts or tag[chosen] not in ("article", "main") and any(marked[n] and parent[n] == up and n != chosen and n not in above and tag[n] in ("p", "h1", "h2", "section", "blockquote", "pre", "ul", "ol", "table") for n in range(up + 1, count)):
                if tag[chosen] in ("article", "main"):
                    beside.update(p for p in parts if tag[p] in ("article", "main"))
                else:
                    chosen = up
            break
        if parts or tag[up] in ("article", "main", "p", "section", "blockquote") or marks[up] > marks[chosen] or page.described(up)[1] & TEXT_WORDS:
            chosen = up
    within = [False] * count
    within[chosen] = True
    for n in range(min([chosen, *beside]), count):
        if n == chosen:
            continue
        within[n] = (within[parent[n]] or n in beside) and keep[n] and not (tag[n] in ("ul", "ol", "div", "section") and d.menu(n))
    parts = [" " if text is None else html.unescape(text) for node, text in page.order if within[node]]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page, and one without any text of its own, has an empty text.
    Markup may be broken: open elements end where the page or their parent does.
    Null ids and urls stay null, repeated rows give repeated rows, other columns
    are left out. Very long pages are read whole, one at a time: a task holds the
    page and a few numbers for each of its tags.
    """

    def each(cut: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(s) for s in cut.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([cut.column(0), cut.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), whole(html_col).alias("html"), F.col(url_col).alias("url"))
    return map_text(rows, ["page_id", "html", "url"], each, SCHEMA)
