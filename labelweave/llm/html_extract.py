"""Main text of web pages by text-to-tag ratio (operator 6).

Events of the standard library's streaming parser cut a page into lines, one
per block element. Lines inside elements that are never article text (menus,
headers, footers, sidebars, forms, scripts, notices, adverts, comments; by
element, role, or a word of class or id) are left out; so are single list items, paragraphs and
table cells marked so. Each other line has a
ratio of text to tags; the ratios are smoothed with a Gaussian over
neighbouring lines of the same region and clustered in two by a threshold. The page's regions
(an ``article`` or ``main`` element, else the innermost section or table cell) are content if
their smoothed ratio, weighted by text, lies above the threshold; the region
with most text always is, and so is every ``article`` or ``main`` that is not left out: a page of
several articles gives all of them. All lines of content regions are returned whole.

A class or id tells what a block is, not what it has: words after ``no``, ``has``, ``with`` and the like
do not count. An element left out for its class only is taken back if an ``article`` or
``main`` starts inside it, or if it is named after a part of the layout only (``sidebar-left``), the page has no
article or main, and it holds half of the page's text or more.

Defined cases: null, empty or text-less html gives an empty text; broken or cut
markup is read as far as the parser understands it; an element that is never
closed ends with its parent, a list item, paragraph or cell with the next one; a text of any length is read whole;
of regions with equally much text the first is the one that always stays; repeated rows are treated alike; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from labelweave.llm.common import add_columns, table
from labelweave.llm.registry import query

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements whose end tag is often missing -> the open ones that a start tag of theirs ends
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option",
        "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th",
        "colgroup": "colgroup"}
ENDS = {tag: frozenset(ended.split()) for tag, ended in ENDS.items()}
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
NEVER = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea iframe svg menu "
    "dialog object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments "
    "disqus reply replies share sharing social related recommended newsletter subscribe signup login popup modal "
    "pagination pager toolbar".split())
# those that also name a layout ("sidebar-left") or the wrapper of a whole page
LAYOUT = frozenset("sidebar nav navbar navigation menu header footer masthead toolbar banner".split())
# an article may be a comment or an advert
NOT_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
MODIFIERS = frozenset("no not has have with without show shows hide hides is enable enabled disable disabled".split())
CORE = frozenset(("article", "main"))
SECTIONS = frozenset(("article", "main", "section", "div", "td", "body"))
SIGMA = 1.5
MIN_SEPARATION = 2.0      # cluster centres closer than this factor: one cluster
_SPLIT = re.compile(r"[^a-z0-9]+")


@lru_cache(4096)
def named(value: str) -> frozenset[str]:
    """The words of a class or id that say what a block is."""
    out: set[str] = set()
    for token in value.lower().split():
        parts = _SPLIT.split(token)
        if MODIFIERS.isdisjoint(parts):
            out.update(NAMES.intersection(parts))
    return frozenset(out)


def left_out(tag: str, attrs: list) -> tuple[bool, bool]:
    """(leave the element out, for its name as a part of the layout only)."""
    words: set[str] = set()
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            words |= named(value)
        elif (name == "role" and value.strip().lower() in ROLES or name == "hidden"
              or name == "style" and "display:none" in value.lower().replace(" ", "")):
            return tag not in CORE, False
    if tag in CORE:
        words = words & NOT_ARTICLES if tag == "article" else set()
    return bool(words), bool(words) and words <= LAYOUT


class Lines(HTMLParser):
    """Cuts a page into lines: (text, tags, region, exclusions)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.stack: list[tuple[str, int, int, int]] = []    # tag, exclusion id (0: none), region before, core regions before
        self.out: list[int] = []           # exclusion ids in force
        self.by_name: set[int] = set()     # exclusions of blocks for class, id or role: can be taken back
        self.layout: set[int] = set()      # those named after a part of the layout only
        self.hard = 0                      # other exclusions in force; their text is not even gathered
        self.back: set[int] = set()
        self.count = 0
        self.region = 0
        self.core = 0
        self.cores: set[int] = set()       # regions of article and main elements

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.region, tuple(self.out)))
        self.parts.clear()
        self.tags = 0

    def pop(self) -> str:
        if self.stack[-1][1] in self.by_name:
            self.flush()
        name, found, self.region, self.core = self.stack.pop()
        if found:
            self.hard -= self.out.pop() not in self.by_name
        return name

    def end_implied(self, tag: str) -> None:
        """A start tag ends an open paragraph, and an open element of its like in the same list or table."""
        ended = ENDS.get(tag, frozenset())
        if tag in BLOCKS:
            ended = ended | {"p"}
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] not in ENDS:
                break
            if self.stack[k][0] in ended:
                while len(self.stack) > k:
                    self.pop()

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in ("br", "td", "th"):
            if tag != "br" and not self.core:
                self.flush()
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        self.end_implied(tag)
        self.count += 1
        found, before, core = 0, self.region, self.core
        if tag in NEVER:
            found = self.count
        elif tag not in ("html", "body") and attrs:
            out, layout = left_out(tag, attrs)
            if out:
                found = self.count
                if tag in BLOCKS and tag not in ENDS and tag not in CORE or tag == "td":
                    self.by_name.add(found)
                    if layout:
                        self.layout.add(found)
        if tag in CORE and not found:
            self.back.update(x for x in self.out if x in self.by_name)
        if found:
            if found in self.by_name:
                self.flush()
            self.out.append(found)
            self.hard += found not in self.by_name
        if tag in SECTIONS and not self.core:
            self.region = self.count
        if tag in CORE and not found:
            self.core += 1
            self.cores.add(self.region)
        self.stack.append((tag, found, before, core))

    def handle_startendtag(self, tag, attrs) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS or tag in ("td", "th") and not self.core:
            self.flush()
        self.tags += 1
        if any(x[0] == tag for x in reversed(self.stack)):
            while self.pop() != tag:
                pass

    def handle_data(self, data) -> None:
        if not self.hard:
            self.parts.append(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights of missing lines go to the others."""
    reach = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, k)[reach: reach + len(x)] / np.convolve(np.ones(len(x)), k)[reach: reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """Split between the two clusters of the log ratios; 0 if they are not apart."""
    v = np.log1p(x)
    lo, hi = v.min(), v.max()
    for _ in range(20):
        cut = (lo + hi) / 2
        a, b = v[v < cut], v[v >= cut]
        if not len(a) or not len(b):
            return 0.0
        if (a.mean(), b.mean()) == (lo, hi):
            break
        lo, hi = a.mean(), b.mean()
    return float(np.expm1((lo + hi) / 2)) if hi - lo >= np.log(MIN_SEPARATION) else 0.0


def main_text(html: str | None) -> str:
    """The main text of one page."""
    p = Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    if p.layout and not p.cores:
        kept = [x for x in p.lines if all(o in p.back or o in p.layout for o in x[3])]
        total = sum(len(x[0]) for x in kept)
        p.back.update(o for o in p.layout if 2 * sum(len(x[0]) for x in kept if o in x[3]) >= total)
    lines = [x for x in p.lines if all(o in p.back for o in x[3])]
    if not lines:
        return ""
    if len({x[2] for x in lines}) > 1:
        size = np.array([len(x[0]) for x in lines], float)
        ratio = size / np.array([max(1, x[1]) for x in lines])
        names, at = np.unique([x[2] for x in lines], return_inverse=True)
        for k in range(len(names)):
            ratio[at == k] = smooth(ratio[at == k])
        total = np.bincount(at, size)
        mean = np.bincount(at, size * ratio) / total
        good = mean >= threshold(ratio)
        good[total.argmax()] = True
        good |= np.isin(names, list(p.cores))
        regions = {int(r) for r, ok in zip(names, good, strict=True) if ok}
        lines = [x for x in lines if x[2] in regions]
    return "\n\n".join(x[0] for x in lines)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``text`` and ``n_chars``."""
    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        text = [main_text(h) for h in b.column(b.schema.get_field_index(html_col)).to_pylist()]
        return {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())}

    return add_columns(pages, "text string, n_chars long", html_col, run, keep)


@query("op6_html_extract")
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
