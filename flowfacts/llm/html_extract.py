"""Main text of web pages by composite text density (operator 4).

For a DOM node with C characters, T tags, LC link characters and LT link tags, in a body with shares LCb / Cb,

    density = C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LCb / Cb * C + e))

where T, LC, LT and C - LC count as at least 1. A node's density sum is that of its children. The node of the largest
sum is the core of the article; the least density on its path to the body is the threshold, and the largest-sum nodes
of other subtrees that reach it belong to the article too. Where such a node stands in an <article> or <main>, all of the
outermost one beside the path to the body is added, for the core the outermost on the path. Parts that are never article text by their element, role or
class (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments) are left out beforehand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
#: Elements whose start ends an open <p>.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start of the first closes an open one of the second, up to the nearest of the third.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "body": (("head",), ("html",)),
}
NOISE_TAGS = frozenset("nav footer aside form script style noscript iframe template head menu dialog button select textarea object svg canvas audio video map datalist fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications "
    "sidebar sidebars sidenav nav navbar navigation navigations menu menus breadcrumb breadcrumbs footer footers header masthead topbar comment comments commentlist respond reply replies disqus discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager widget widgets toolbar copyright search skip teaser teasers tags"
)
NOISE = re.compile(rf"(?:^|\s)(?!with-|has-|no-|without-)(?:[a-z0-9]+[-_])*(?:{'|'.join(NOISE_NAMES.split())})(?:[-_]?\d+|[-_](?:area|bar|block|box|container|content|inner|item|items|label|left|link|links|list|main|module|outer|panel|right|section|slot|top|unit|wrap|wrapper|\d+))*(?=\s|$)")
#: These names also mark parts that hold an article, so a part with most of the text keeps it.
WEAK = re.compile(r"header|banner|notice|search|widget|modal|overlay|tags|sidebar|nav|menu|promo|form|fieldset|discussion|main|content")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Page:
    """A page as arrays over nodes in page order: parents stand before their children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        #: (node, text); a text of None is a break between blocks
        self.pieces: list[tuple[int, str | None]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        tag, parent, attrs, pieces, stack, at = self.tag, self.parent, self.attrs, self.pieces, [0], 0
        lower = None
        #: depths on the stack by tag, and those of blocks
        self.open, self.blocks = {}, []
        find, end = TOKEN.search, len(html)
        while at < end:
            m = find(html, at)
            if m is None:
                pieces.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                pieces.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, text = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            block = name not in INLINE
            if closing:
                if name in ("p", "br"):
                    pieces.append((stack[-1], None if name == "p" else " "))
                if block:
                    pieces.append((stack[-1], None))
                depth = self._nearest((name,))
                # an inline end tag doesn't close blocks that were opened after it
                if depth and not (name in INLINE and self.blocks and self.blocks[-1] > depth):
                    self._cut(stack, depth)
                continue
            if name in CLOSES_P:
                self._close(stack, ("p",), ("table", "td", "th", "div", "article", "section", "button"))
            if name in SIBLINGS:
                self._close(stack, *SIBLINGS[name])
            if block:
                pieces.append((stack[-1], None))
            elif name in ("br", "td", "th"):
                pieces.append((stack[-1], " "))
            node = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            attrs.append(text)
            if name in RAW:
                lower = lower if lower is not None else html.lower()
                stop = lower.find(f"</{name}", at)
                if stop < 0 and name in ("title", "noscript", "textarea"):
                    continue
                at = end if stop < 0 else (html.find(">", stop) + 1 or end)
            elif name not in VOID and not text.endswith("/"):
                self.open.setdefault(name, []).append(len(stack))
                if block:
                    self.blocks.append(len(stack))
                stack.append(node)

    def _nearest(self, names: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these names; 0 if none is open."""
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=0)

    def _cut(self, stack: list[int], depth: int) -> None:
        for node in stack[depth:]:
            self.open[self.tag[node]].pop()
        del stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def _close(self, stack: list[int], names: tuple[str, ...], until: tuple[str, ...]) -> None:
        depth = self._nearest(names)
        if depth > self._nearest(until):
            self._cut(stack, depth)

    def noise(self, chars: list[int]) -> list[bool]:
        """Nodes that are no article text, with all below them. chars: characters below each node."""
        out = [False] * len(self.tag)
        inside = [False] * len(self.tag)  # an article or main part
        # a form or a weakly named part that holds most of the page is taken for its frame
        for i in range(1, len(self.tag)):
            up, tag, text = self.parent[i], self.tag[i], self.attrs[i]
            inside[i] = inside[up] or tag in ("article", "main")
            if out[up]:
                out[i] = True
                continue
            if tag in ("html", "body", "main", "article"):
                continue
            most = chars[i] > 0.5 * chars[0]
            if tag in NOISE_TAGS:
                out[i] = not (most and tag in ("form", "fieldset"))
            elif tag == "header":
                out[i] = not inside[up] and not most
            elif text:
                got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)}
                if got.get("role", "").lower() in NOISE_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "").lower()):
                    out[i] = not most
                else:
                    names = f"{got.get('class', '')} {got.get('id', '')}".lower()
                    m = NOISE.search(names) if names != " " else None
                    if m and inside[up] and re.search(r"header|tags", m[0]):
                        m = None
                    out[i] = bool(m) and not (most and WEAK.search(m[0]))
        return out

    def measures(self) -> tuple[list[bool], int, list[int], list[float], list[float]]:
        """Of every node: whether it is noise, the body's number, characters below, composite density, and the sum of the
        children's densities."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        own = [0] * n
        for node, text in self.pieces:
            if text:
                own[node] += len(text) - text.count(" ") if not text.isspace() else 0

        def below(values: list[int]) -> list[int]:
            out = values[:]
            for i in range(n - 1, 0, -1):
                out[parent[i]] += out[i]
            return out

        noise = self.noise(below(own))
        live = [0 if noise[i] else own[i] for i in range(n)]
        link = [False] * n
        for i in range(1, n):
            link[i] = tag[i] == "a" or link[parent[i]]
        c = below(live)
        lc = below([live[i] if link[i] else 0 for i in range(n)])
        count = below([0 if noise[i] or not i else 1 for i in range(n)])
        links = below([1 if tag[i] == "a" and not noise[i] else 0 for i in range(n)])
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        if not c[body]:
            body = 0
        share = lc[body] / max(1, c[body])
        density = [0.0] * n
        for i in range(n):
            if c[i] and not noise[i]:
                t, l, a = max(1, count[i] - (1 if i else 0)), max(1, lc[i]), max(1, links[i])
                base = math.log(c[i] / max(1, c[i] - lc[i]) * lc[i] + share * c[i] + math.e)
                density[i] = c[i] / t * math.log(max(c[i] / l * t / a, 1e-9)) / max(math.log(base), 1e-3)
        total = [0.0] * n
        for i in range(1, n):
            total[parent[i]] += max(0.0, density[i])
        return noise, body, c, density, total

    def main_text(self) -> str:
        n, parent = len(self.tag), self.parent
        noise, body, c, density, total = self.measures()
        if not c[body]:
            return ""
        inner = [False] * n  # below the body
        inner[body] = True
        for i in range(body + 1, n):
            inner[i] = inner[parent[i]]
        alive = [i for i in range(n) if inner[i] and not noise[i] and c[i]]
        best = max(alive, key=lambda i: (total[i], density[i], -i))
        threshold, i = density[best], best
        while i != body:
            i = parent[i]
            threshold = min(threshold, density[i])
        content = self._article(best, body, alive, density, total, threshold)
        return self._blocks(content, noise)

    def _article(self, best: int, body: int, alive: list[int], density: list[float], total: list[float], threshold: float) -> list[bool]:
        """Marks of the nodes whose text is the article's."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        path = {best}
        i = best
        while i != body:
            i = parent[i]
            path.add(i)
        # the page says itself where its article is: the outermost such element around the core
        top = next((i for i in sorted(path) if tag[i] in ("article", "main")), best)
        root = [False] * n
        root[best] = root[top] = True
        # the largest-sum node of each other subtree that reaches the threshold
        high: dict[int, int] = {}
        for i in alive:
            if i in path or density[i] < threshold or self._under(i, top):
                continue
            head = i
            while parent[head] not in path:
                head = parent[head]
            if head not in high or total[i] > total[high[head]]:
                high[head] = i
        for head, i in high.items():
            above = [i]
            while above[-1] != head:
                above.append(parent[above[-1]])
            root[next((k for k in reversed(above) if tag[k] in ("article", "main")), i)] = True
        # headings beside what was chosen belong to it
        for i in alive:
            if re.fullmatch("h[1-6]", tag[i]) and parent[i] in path:
                root[i] = True
        mark = [False] * n
        for i in range(n):
            mark[i] = root[i] or (i > 0 and mark[parent[i]])
        return mark

    def _under(self, i: int, top: int) -> bool:
        while i > top:
            i = self.parent[i]
        return i == top

    def _blocks(self, content: list[bool], noise: list[bool]) -> str:
        blocks, now = [], []
        for node, text in self.pieces:
            if text is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif content[node] and not noise[node]:
                now.append(unescape(text) if "&" in text else text)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def main_text(html: str | None) -> str:
    """The article of one page; empty for null, empty and text-free pages."""
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text (never null), n_chars.

    Null or empty html gives an empty text; broken markup is read as browsers would, without failing; nothing is
    cut from long pages; repeated rows are each extracted; nulls in page_id and url stay; an empty table gives no
    rows. Other columns are not read. Pages are read one batch at a time and there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
