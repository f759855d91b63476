"""Main text of HTML pages by composite text density over the page's elements."""

from __future__ import annotations

import html
import math
import re
from array import array
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.tables import ready, struct

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never main text.
OUTSIDE = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input dialog menu title xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: First or last words of a class or id that name what surrounds an article.
AROUND = frozenset(
    "ad ads advert advertisement advertising adverts adsense banner sponsor sponsored promo promotion promotions sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription comment comments respond replies reply discussion disqus share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar login signup search skip".split()
)
#: Words that make a name say something about the article itself: a headline's block, or what a layout has or lacks.
HEADED = frozenset("article entry post story".split())
LAYOUT = frozenset("has no with without is".split())
ARTICLE = frozenset(("article", "main"))
HEADLINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An opening tag ends an open element of these names, up to the nearest element that holds them.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = frozenset("ul ol dl table tbody thead tfoot select html body article section div main".split())


def _is_around(name: str) -> bool:
    words = _PARTS.findall(name)
    if not words or words[0] in LAYOUT:
        return False
    if words[-1] == "header" and not HEADED.isdisjoint(words):
        return False
    return words[0] in AROUND or words[-1] in AROUND


class _Page:
    """The elements of a page in order: parent, counts, and the texts with the element they stand in."""

    def __init__(self, source: str):
        self.tags, self.parent = ["html"], array("l", [-1])
        self.dropped, self.linked = bytearray(1), bytearray(1)
        #: the texts with their element; None where a block begins or ends
        self.texts: list[tuple[int, str | None]] = []
        self.open: Counter[str] = Counter()
        self._build(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        self.tags.append(tag)
        self.parent.append(parent)
        self.dropped.append(self.dropped[parent] or self._is_outside(tag, attributes, parent))
        self.linked.append(self.linked[parent] or tag == "a")
        return len(self.tags) - 1

    def _is_outside(self, tag: str, attributes: str, parent: int) -> bool:
        if tag in OUTSIDE:
            return True
        if tag == "header":
            while parent >= 0:
                if self.tags[parent] in ARTICLE:
                    return False
                parent = self.parent[parent]
            return True
        if not attributes or tag in ARTICLE or tag in ("html", "body"):
            return False
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES:
            return True
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        return any(_is_around(name) for name in names)

    def _build(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        while at < size:
            match = _TOKEN.search(source, at)
            if match is None:
                self.texts.append((stack[-1], source[at:]))
                break
            if match.start() > at:
                self.texts.append((stack[-1], source[at : match.start()]))
            at = match.end()
            closing, tag = match[1], match[2]
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._close(stack, tag)
                continue
            self._end_open(stack, tag)
            if tag in ("html", "body") and tag in (self.tags[i] for i in stack):
                continue
            node = self._open(tag, match[3], stack[-1])
            if tag in BLOCKS:
                self.texts.append((node, None))
            if tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                at = end.start() if end else size
                stack.append(node)
                self.open[tag] += 1
            elif tag in VOID:
                if tag == "br":
                    self.texts.append((stack[-1], " "))
            elif not match[3].endswith("/") or tag in BLOCKS:
                stack.append(node)
                self.open[tag] += 1

    def _end_open(self, stack: list[int], tag: str) -> None:
        """End what the opening tag ends: a paragraph before any block, an item before the next one."""
        names = (*_ENDS.get(tag, ()), "p") if tag in BLOCKS else _ENDS.get(tag, ())
        names = tuple(n for n in names if self.open[n])
        if not names:
            return
        for place in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[place]]
            if open_tag in names:
                self._pop(stack, place)
                names = tuple(n for n in names if n != "p")
            elif open_tag in _HOLDERS:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        if not self.open[tag]:
            return
        for place in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[place]]
            if open_tag == tag:
                self._pop(stack, place)
                return
            if tag not in BLOCKS and open_tag in BLOCKS:
                return  # an inline end tag doesn't end a block

    def _pop(self, stack: list[int], place: int) -> None:
        if any(self.tags[i] in BLOCKS for i in stack[place:]):
            self.texts.append((stack[place], None))
        self.open.subtract(self.tags[i] for i in stack[place:])
        del stack[place:]

    def _measure(self) -> tuple[list[float], list[float]]:
        """Density and density sum of every element. Elements outside the main text have neither."""
        n = len(self.tags)
        chars, link_chars, tags, link_tags = ([0] * n for _ in range(4))
        body_chars = body_links = 0
        for node, text in self.texts:
            size = len(" ".join(text.split())) if text else 0
            body_chars += size
            body_links += size if self.linked[node] else 0
            if not self.dropped[node]:
                chars[node] += size
                link_chars[node] += size if self.linked[node] else 0
        for node in range(n - 1, 0, -1):
            if not self.dropped[node]:
                up = self.parent[node]
                chars[up] += chars[node]
                link_chars[up] += link_chars[node]
                tags[up] += tags[node] + 1
                link_tags[up] += link_tags[node] + (self.tags[node] == "a")
        density, sums = [0.0] * n, [0.0] * n
        share = body_links / max(body_chars, 1)
        for node in range(n - 1, -1, -1):
            if chars[node] and not self.dropped[node]:
                c, t = chars[node], max(tags[node], 1)
                links, link_t = link_chars[node], max(link_tags[node], 1)
                base = math.log(c / max(c - links, 1) * links + share * c + math.e)
                plain = c / t
                density[node] = plain * math.log(max(c / max(links, 1) * t / link_t, 1)) / math.log(base) if base > 1 else plain
            if node:
                sums[self.parent[node]] += density[node]
        return density, sums

    def chosen(self) -> list[bool]:
        """Which elements are main text."""
        density, sums = self._measure()
        n = len(self.tags)
        best = max(range(n), key=lambda i: (not self.dropped[i], sums[i], density[i], -i))
        path = [best]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        # the whole article, where the page names it
        semantic = [i for i in path if self.tags[i] in ARTICLE]
        root = semantic[-1] if semantic else best
        above = set(path[path.index(root) + 1 :])
        threshold = min(density[i] for i in path)
        out = [False] * n
        out[root] = True
        for node in range(n):
            up = self.parent[node]
            if node == root or up < 0 or self.dropped[node]:
                continue
            # beside the path, an element counts if it is as dense as the thinnest element on it; so does a headline
            dense = density[node] >= max(threshold, 1e-9) or self.tags[node] in HEADLINES
            out[node] = out[up] or (not semantic and up in above and node not in above and dense)
        return out

    def blocks(self) -> list[str]:
        """The texts of the chosen elements, one string a block, in page order."""
        chosen, blocks, current = self.chosen(), [], []
        for node, text in self.texts:
            if text is not None:
                if chosen[node]:
                    current.append(text)
            elif current:
                blocks.append("".join(current))
                current = []
        blocks.append("".join(current))
        cleaned = (" ".join(html.unescape(b).split()) for b in blocks)
        return [b for b in cleaned if b]


def main_text(source: str | None) -> str:
    """The blocks of the main text, joined by an empty line."""
    return "\n\n".join(_Page(source).blocks()) if source else ""


@F.pandas_udf(struct("text string, n_chars long"))
def _extracted(source: pd.Series) -> pd.DataFrame:
    texts = [main_text(s) for s in source]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: `page_id, url, text, n_chars`.

    Every element gets its composite text density (characters per tag, adjusted by the share of link text); the
    element with the largest sum of its children's densities is the main text, or the whole `article` or `main` it stands in.
    Without such an element, those beside the path from the body to it count too if they are as dense as the
    thinnest on the path, and headlines. Elements that are never main text (scripts, menus, headers, footers, sidebars, notices, adverts, forms,
    comments, by tag, role or class) are left out beforehand. Nothing else is dropped.

    Character references are decoded; white space within a block becomes one space; blocks are joined in page order by
    an empty line. Null, empty and text-free pages give an empty text. Broken markup is read as browsers do: open
    paragraphs end at the next block, end tags without a start are skipped. Rows are independent.
    """
    source = ready(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.select("page_id", "url", _extracted("html").alias("e")).select("page_id", "url", "e.*")
