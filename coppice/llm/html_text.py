"""Main text of web pages by tree scoring.

A page becomes a tree of its elements.  What is furniture by tag, role or attribute (menus, page headers, footers,
sidebars, adverts, scripts, styles, hidden parts) is left out with all that it holds.  Names (classes and ids) and forms
only raise a doubt, which the text inside decides: whole names count, not words within longer ones; headings, articles
and the main element are never doubted, nor is what holds most of the page's text; within an article a name that fits
page furniture or links takes out only what consists of links, and outside of one not what is mostly running text.

Each remaining block of text passes points for its length and commas to its ancestors, less with each step up; an
ancestor's points are discounted by the share of its text that stands in links, and halved if it is in doubt.  The best
container is kept together with those siblings that score like it or hold a paragraph of running text.

Defined cases: null and empty pages give the empty text; text without any tags is one block; unclosed and stray tags
are taken as browsers do in the common cases (a paragraph ends where the next block begins); ties go to the element
that comes first; nothing is capped; repeated rows give repeated results; an empty table gives an empty result; other
columns pass through (not those named as a result is).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, other_columns

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GONE = frozenset("head script style noscript template nav footer aside button select option textarea iframe object embed svg canvas audio video menu dialog search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CLEAR_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner comment comments commentlist consent cookie cookies disqus gdpr hidden modal newsletter notice notices notification overlay popup promo promoted replies respond sidebar sponsor sponsored subscribe".split())
PAGE_NAMES = frozenset("breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pager pagination skip toolbar".split())
LINK_NAMES = frozenset("discussion recommended related share sharing signup social widget widgets".split())
NAMES = CLEAR_NAMES | PAGE_NAMES | LINK_NAMES
PLAIN = frozenset("area bar block bottom box button buttons center col column container content fixed float form group holder icon icons inline inner item items left link links list main module page panel post posts right row section site slot small sticky text title top unit wrap wrapper".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BONUS = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 2.0, "body": -5.0, "html": -10.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
_name = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Node:
    __slots__ = ("tag", "up", "gone", "doubt", "points", "chars", "linked", "prose", "order")

    def __init__(self, tag: str, up: _Node | None, gone: bool, doubt: str, order: int) -> None:
        self.tag, self.up, self.gone, self.doubt, self.order = tag, up, gone, doubt, order
        self.points = self.chars = self.linked = self.prose = 0


def name_kind(value: str) -> str:
    """What the whole names in a class or id say: "clear", "page", "link" or nothing.  A name counts if all of its words
    are names of furniture or say nothing by themselves."""
    kinds = ""
    for name in value.split():
        words = {w.lower() for w in _name.findall(name)}
        if words & NAMES and words <= NAMES | PLAIN:
            kinds = "clear" if words & CLEAR_NAMES else kinds or ("page" if words & PAGE_NAMES else "link")
        if kinds == "clear":
            break
    return kinds


def furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[bool, str]:
    """(left out, doubt: "" or "form", or a kind of name, with "in " before it within an article)."""
    if tag in GONE or (tag == "header" and not in_article):
        return True, ""
    doubt = "form" if tag == "form" else ""
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True, ""
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if key in ("class", "id") and tag not in ("html", "body", "article", "main") and tag not in HEADINGS:
            kind = name_kind(value)
            if kind and tag not in BLOCK:  # within a line
                if kind == "clear" or tag == "a":
                    return True, ""
            elif kind and doubt != "clear":
                doubt = kind if kind == "clear" or not in_article else f"in {kind}"
    return False, doubt


class _Reader(HTMLParser):
    """Builds the tree's nodes and the list of text blocks, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", None, False, "", 0)
        self.open = [self.root]
        self.n = self.links = self.articles = 0
        self.blocks: list[tuple[_Node, str, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.owner = self.root

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.owner, text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for node in self.open[to:]:
            self.links -= node.tag == "a"
            self.articles -= node.tag in ("article", "main")
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            for k in range(len(self.open) - 1, 0, -1):
                t = self.open[k].tag
                if t == "p":
                    self._pop(k)
                    break
                if t in BLOCK:
                    break
            ends = CLOSES.get(tag)
            for k in range(len(self.open) - 1, 0, -1) if ends else ():
                t = self.open[k].tag
                if t in ends:
                    self._pop(k)
                elif t in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select") or (t == "tr" and tag != "tr"):
                    break
        elif tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        above = self.open[-1]
        self.n += 1
        self.articles += tag in ("article", "main")
        self.links += tag == "a"
        gone, doubt = (True, "") if above.gone else furniture(tag, attrs, self.articles > 0)
        self.open.append(_Node(tag, above, gone, doubt, self.n))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._pop(k)
                return
            if self.open[k].tag in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        if node.gone:
            return
        while node.tag and node.tag not in BLOCK:
            node = node.up
        if not self.parts:
            self.owner = node
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def _prose(text: str, linked: int) -> bool:
    """Whether a block is running text."""
    return len(text) >= 80 and linked < 0.25 * len(text)


def _doubted(node: _Node, total: int) -> bool:
    """Whether what `node` holds bears out the doubt about it."""
    if not node.doubt or 2 * node.chars > total:
        return False
    if node.doubt in ("in page", "in link"):
        return 10 * node.linked >= 3 * node.chars
    return node.doubt != "link" or 2 * node.prose < node.chars or 4 * node.linked >= node.chars


def _undoubted(reader: _Reader) -> list[tuple[_Node, str, int]]:
    """Blocks that are in no element whose doubt is borne out; nodes know how much of their text is links and prose."""
    for owner, text, linked in reader.blocks:
        node = owner
        while node is not None:
            node.chars += len(text)
            node.linked += linked
            node.prose += len(text) if _prose(text, linked) else 0
            node = node.up
    total, fate = reader.root.chars, {reader.root.order: False}
    kept = []
    for block in reader.blocks:
        chain, node = [], block[0]
        while node.order not in fate:
            chain.append(node)
            node = node.up
        for below in reversed(chain):
            fate[below.order] = fate[below.up.order] or _doubted(below, total)
        if not fate[block[0].order]:
            kept.append(block)
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    blocks, scored = _undoubted(reader), {}
    if not blocks:
        return ""
    for owner, text, linked in blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 10)) * (1 - linked / len(text))
        node, share = (owner.up if owner.tag in LEAF and owner.up else owner), 1.0
        while node is not None:
            node.points += points * share
            scored[node.order] = node
            share /= 2
            node = node.up
    value = {k: (n.points + BONUS.get(n.tag, 0.0)) * (1 - n.linked / max(1, n.chars)) * (0.5 if n.doubt else 1) for k, n in scored.items()}
    best = scored[max(sorted(value), key=value.__getitem__)]
    kept = []
    for owner, text, linked in blocks:
        node, child = owner, None
        while node is not None and node is not best and node is not best.up:
            node, child = node.up, node
        if node is best:
            kept.append(text)
        elif node is not None:  # below the best container's parent
            sibling = value.get(child.order, 0.0) if child is not None else 0.0
            prose = _prose(text, linked)
            if sibling >= max(10.0, 0.2 * value[best.order]) or (prose and (child is None or child.tag in LEAF)):
                kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without its html, with `text` and n_chars (long)."""
    limit_batches(pages.sparkSession)
    others = other_columns(pages, html_col, "text", "n_chars")
    frame = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{html_col}`").cast("string").alias("html"))
    out = T.StructType([frame.schema["rest"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([main_text(h) for h in batch.column(1).to_pylist()], pa.string())], names=["rest", "text"])

    return frame.mapInArrow(run, out).select(*(F.col("rest").getField(c).alias(c) for c in others), "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
