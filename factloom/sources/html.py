"""Main text and title of web pages, parsed per Arrow batch inside the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import blank_to_null, strip

# --- fixed values: element roles ------------------------------------------
BLOCK_TAGS = frozenset((
    "p", "div", "section", "article", "li", "blockquote",
    "h1", "h2", "h3", "h4", "h5", "h6", "tr", "th", "td", "br"))
REMOVED_TAGS = frozenset(("script", "style", "nav", "header", "footer", "aside"))
SKIPPED_TAGS = REMOVED_TAGS | {"iframe", "noscript", "svg", "canvas"}
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr"))
# starting one of these ends an open paragraph
PARAGRAPH_ENDERS = frozenset((
    "p", "div", "section", "article", "ul", "ol", "li", "blockquote", "table", "form", "pre",
    "h1", "h2", "h3", "h4", "h5", "h6", "main", "footer", "header", "nav", "aside", "hr"))


class _Region:
    """Text of one candidate root element."""

    def __init__(self, is_block: bool):
        self.parts: list[str] = []
        self.blocks = int(is_block)

    def line(self) -> None:
        if self.parts and not self.parts[-1].endswith("\n"):
            self.parts.append("\n")

    def text(self, data: str) -> None:
        if not self.blocks:
            data = re.sub(r"\s+", " ", data).strip()
        if data:
            self.parts.append(data)

    def lines(self) -> str:
        rows = (r.strip() for r in "".join(self.parts).split("\n"))
        # a lone character outside CJK is debris of letter-by-letter markup
        return "\n\n".join(r for r in rows if r and not (len(r) == 1 and ord(r) < 0x4E00))


class _Page(HTMLParser):
    """Collects the first article, main and body in one pass, and the title sources."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.removed = 0   # depth inside elements dropped from the page
        self.skipped = 0   # depth inside elements not walked
        self.regions: dict[str, _Region] = {}
        self.active: dict[str, int] = {}  # region -> depth of its root
        self.og_title: str | None = None
        self.heads: dict[str, list[str]] = {}
        self.head_open: dict[str, int] = {}

    def _each(self):
        return (self.regions[n] for n in self.active)

    def handle_starttag(self, tag, attrs):
        if tag in PARAGRAPH_ENDERS and "p" in self.open:
            self._pop_to("p")
        if tag == "meta" and not self.removed and self.og_title is None:
            named = dict(attrs)
            if named.get("property") == "og:title":
                self.og_title = named.get("content") or ""
        if tag in BLOCK_TAGS and not self.skipped:
            for region in self._each():
                region.line()
        if tag in VOID_TAGS:
            return
        self.open.append(tag)
        if tag in REMOVED_TAGS:
            self.removed += 1
        if tag in SKIPPED_TAGS:
            self.skipped += 1
        if not self.removed:
            if tag in ("article", "main", "body") and tag not in self.regions:
                self.regions[tag] = _Region(False)
                self.active[tag] = len(self.open)
            if tag in ("h1", "title") and tag not in self.heads:
                self.heads[tag] = []
                self.head_open[tag] = len(self.open)
        if tag in BLOCK_TAGS and not self.skipped:
            for region in self._each():
                region.blocks += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self._pop_to(tag)

    def _pop_to(self, tag):
        while self.open:
            last = self.open.pop()
            depth = len(self.open) + 1
            if last in BLOCK_TAGS and not self.skipped:
                for region in self._each():
                    region.blocks = max(region.blocks - 1, 0)
                    region.line()
            if last in SKIPPED_TAGS:
                self.skipped -= 1
            if last in REMOVED_TAGS:
                self.removed -= 1
            for name in [n for n, d in self.active.items() if d == depth]:
                del self.active[name]
            for name in [n for n, d in self.head_open.items() if d == depth]:
                del self.head_open[name]
            if last == tag:
                return

    def handle_data(self, data):
        if not self.skipped:
            for region in self._each():
                region.text(data)
        if not self.removed:
            for name in self.head_open:
                self.heads[name].append(data)

    handle_comment = handle_data


# a reference that lacks its semicolon, outside comments
_CUT_REFERENCE = re.compile(r"(<!--.*?(?:-->|\Z))|&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", re.S)


def _parse(html: str | None, cut_references: bool = True) -> tuple[str, str | None, str | None, str | None]:
    # a page without a body element is taken as one body
    source = html or ""
    if not cut_references:
        source = _CUT_REFERENCE.sub(lambda m: m[1] or "&amp;", source)
    if not re.search(r"(?i)<body[\s>]", source):
        source = f"<body>{source}</body>"
    page = _Page()
    page.feed(source)
    page.close()
    root = next((page.regions[n] for n in ("article", "main", "body") if n in page.regions), None)
    head = lambda n: "".join(page.heads[n]) if n in page.heads else None
    return (root.lines() if root else "", page.og_title, head("h1"), head("title"))


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), cut_references: bool = True) -> DataFrame:
    """Main text and raw title candidates of each page; ``html`` itself is dropped.

    Browsers read ``&amp`` as ``&`` even where its semicolon was cut off; without ``cut_references`` it stays as it is written.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name in keep)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keep)].copy()
            parsed = [_parse(h, cut_references) for h in batch[html]]
            for i, name in enumerate(("raw_text", "og_title", "h1", "title_tag")):
                out[name] = [p[i] for p in parsed]
            yield out

    return pages.select(*keep, html).mapInPandas(
        parse, f"{schema}, raw_text string, og_title string, h1 string, title_tag string")


def with_title(extracted: DataFrame, fallback: str = "url") -> DataFrame:
    """Title from the first source that has one: og:title, h1, title, body line, fallback."""
    lines = F.transform(F.split("raw_text", "\n"), strip)
    body = F.filter(lines, lambda l: (F.length(l) >= 4) & ~l.startswith("http"))
    return extracted.withColumn("title", F.coalesce(
        blank_to_null(F.col("og_title")), blank_to_null(F.col("h1")), blank_to_null(F.col("title_tag")),
        F.try_element_at(body, F.lit(1)), F.col(fallback)))
