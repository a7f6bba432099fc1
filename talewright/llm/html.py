"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser feeds one pass over the page. Block tags end a line; a line has its text, the characters of it
that stand in links, and the number of tags since the line before. Its ratio is that of characters outside of links to tags: links
in menus and lists of links have none. The ratios are smoothed with a Gaussian along the page, so a short line among long ones
stays near them, and their logarithms fall into two clusters. The lines over the cut between the clusters are the content.

Prose that is not the article (an advert, a notice, a footer, readers' comments) has the ratios of prose. An element that is or
names itself such a thing makes its lines weigh HINT of their ratio, and lets them lend no more than that to their neighbours. That
shifts a line's place among the others; where all lines are hinted at, nothing is shifted.

Short lines of the content (headings, short paragraphs, items) can fall below the cut where many stand together. They stay
where the content encloses them: in an article or main element, or another element, most of whose text lies over the cut.

A hint that an element is no content is only a hint. It counts for nothing where the element holds an article, a main element
or the first heading, and an element that is never closed reaches no further than its first block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Elements that show no running text at all.
MUTE = frozenset("audio button canvas datalist dialog head iframe noscript object script select style svg template textarea title video".split())
#: Elements that are not the article by their tag.
BESIDE = frozenset("aside footer form header".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text may be enclosed by content even if all of it is one link.
PROSE = HEADING | frozenset("p blockquote pre figcaption".split())
ITEM = frozenset("li dd dt".split())
#: Elements that are a line's region.
REGION = frozenset("article main section div td th body html center details blockquote".split())
#: Nouns that a class, id or role names what is not content by.
NOT_CONTENT = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist"
    " complementary consent contentinfo cookie cookies copyright disclaimer disqus footer footnav gdpr header legal login masthead menu"
    " modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup privacy promo promoted"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " tagcloud toolbar topbar widget widgets alert dialog".split()
)
#: Words after the noun that only say what part or place is meant: "ad-box", "comments-area", "sidebar-left".
PART = frozenset("area bar block body bottom box container content form group inner item items left link links list outer panel right row section slot top unit wrap wrapper".split())
#: Words before it that say something of another element: "has-sidebar", "no-header".
ABOUT = frozenset("has with without no is not show hide js".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA = 1.0
#: More characters a tag than these say nothing more.
MOST = 400
#: Times its own ratio that a line can come to by its neighbours: one that is all link comes to nothing beside the longest text.
BORROWED = 20.0
#: What a line that a hint speaks against weighs.
HINT = 0.01
#: Characters a tag that a line of content has at least, smoothed and whatever it weighs: a page of links alone has no content.
LEAST = 0.5
#: A line within this factor of the content's mean is content, wherever the cut lies: pages without anything else.
NEAR = 5.0


def names_other(value: str) -> bool:
    """Whether a class, id or role names what is not content: the last noun of one of its names does."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        while len(words) > 1 and words[-1] in PART:
            words.pop()
        if words and words[-1] in NOT_CONTENT and words[0] not in ABOUT:
            return True
    return False


def closed(html: str) -> str:
    """The page with those signs as text that begin what never ends, as the parser would look for the end of each of them anew."""
    end = html.rfind(">") + 1
    page, rest = html[:end], html[end:].replace("<", "&lt;")
    for opens, closes in (("<!--", "-->"), ("<![", "]>")):
        last = page.rfind(closes) + 1
        page = page[:last] + page[last:].replace(opens, "&lt;" + opens[1:])
    return page + rest


def _speaks_against(attrs) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role"):
            if value and names_other(value):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and HIDDEN.search(value)):
            return True
    return False


class _Page(HTMLParser):
    """Collects lines (text, link characters, tags, element) and the tree of block elements from the events of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        # elements: tag, parent, hint (0 none, 1 beside the content, 2 mute), lines before it, closed, holds the content
        self.tag, self.parent, self.hint, self.start, self.closed, self.holds = ["html"], [0], [0], [0], [True], [False]
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # places in open, by tag
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, min(self.linked, len(text)), max(1, self.tags), self.open[-1]))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _close_to(self, place: int, by_name: bool) -> None:
        """Close all open elements from a place on; only the one there is closed by its own tag."""
        while len(self.open) > place:
            e = self.open.pop()
            self.at[self.tag[e]].pop()
            self.closed[e] = by_name and len(self.open) == place

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        if block or tag in MUTE:
            self._end_line()
        if block and tag != "br":
            self.in_link = False
            if self.open[-1] and self.tag[self.open[-1]] == "p":
                self._close_to(len(self.open) - 1, True)
            if tag in ITEM and self.tag[self.open[-1]] in ITEM:
                self._close_to(len(self.open) - 1, True)
            if tag == "body" and self.at.get("head"):
                self._close_to(self.at["head"][0], True)
        self.tags += 1
        if tag == "a":
            self.in_link = True
        if tag in VOID or not (block or tag in MUTE):
            return
        against = tag not in ("html", "body", "main") and bool(attrs) and _speaks_against(attrs)
        if tag in ARTICLE and not against or tag == "h1":
            for e in reversed(self.open):
                if self.holds[e]:
                    break
                if self.tag[e] == "header" and tag == "h1":  # a page's header may hold its heading; it is no article
                    break
                self.holds[e] = True
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.hint.append(2 if tag in MUTE else 1 if against or tag in BESIDE else 0)
        self.start.append(len(self.lines))
        self.closed.append(False)
        self.holds.append(False)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        if tag in BLOCK or tag in MUTE:
            self._end_line()
            if self.at.get(tag):
                self._close_to(self.at[tag][-1], True)
        self.tags += 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self._end_line()
        self.tags += 1

    def handle_data(self, data):
        if self.hint[self.open[-1]] != 2:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(" ".join(data.split()))

    def done(self) -> None:
        self.close()
        self._end_line()


def ratios(length: np.ndarray, linked: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Characters outside of links a tag."""
    return np.minimum((length - linked) / tags, MOST)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the weights at the ends are those of the lines that exist."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = np.convolve(values, kernel)[reach : reach + len(values)]
    return pad / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters: moved to the middle of their means until it stays."""
    cut = float(values.mean())
    for _ in range(30):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = float(new)
    return cut


def _weights(page: _Page, length: np.ndarray) -> np.ndarray:
    """What each line weighs: HINT where an element around it speaks against it, else 1."""
    n = len(page.tag)
    of = np.array([e for *_, e in page.lines])
    chars = np.bincount(of, length, n)
    for e in range(n - 1, 0, -1):
        chars[page.parent[e]] += chars[e]
    hinted_until, in_article, byline = [0] * n, [False] * n, [False] * n  # lines before hinted_until are hinted at
    for e in range(1, n):
        p, tag = page.parent[e], page.tag[e]
        counts = page.hint[e] == 1 and not page.holds[e] and not (tag == "form" and chars[e] >= 0.5 * chars[0])
        in_article[e] = in_article[p] or (tag in ARTICLE and not counts)
        byline[e] = byline[p] or (counts and tag == "header" and in_article[p])
        reach = 0 if not counts or byline[e] else len(page.lines) if page.closed[e] else page.start[e] + 1
        hinted_until[e] = max(hinted_until[p], reach)
    # the heading in an article's header is the article's
    return np.array([HINT if i < hinted_until[e] or (byline[e] and page.tag[e] not in HEADING) else 1.0 for i, e in enumerate(of)])


def extract(html: str | None) -> str:
    """Main text of a page: its blocks in page order joined by one newline, white space inside a block turned to one space.

    A null or empty page and one without any line of LEAST characters a tag give an empty text. Lines at the cut are content.
    """
    page = _Page()
    page.feed(closed(html or ""))
    page.done()
    if not page.lines:
        return ""
    length, linked, tags = (np.array(c, float) for c in zip(*((len(t), k, n) for t, k, n, _ in page.lines), strict=True))
    weight = _weights(page, length)
    weight /= weight.max()
    own = ratios(length, linked, tags)
    ratio = np.minimum(smoothed(own * weight), BORROWED * own) * weight
    score = np.log(np.maximum(ratio, 1.0))
    cut = threshold(score)
    if (score >= cut).any():
        cut = min(cut, float(np.log(np.maximum(ratio[score >= cut].mean() / NEAR, 2.0))))
    upper = (score >= cut) & (np.minimum(smoothed(own), BORROWED * own) >= LEAST)
    prose = np.array([page.tag[e] in PROSE for *_, e in page.lines])
    keep = upper | _enclosed(page, upper, (weight == 1) & (prose | (linked < 0.5 * length)), length)
    return "\n".join(page.lines[i][0] for i in np.flatnonzero(keep))


def _enclosed(page: _Page, upper: np.ndarray, fair: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lines below the cut that the content encloses."""
    n, m = len(page.tag), len(page.lines)
    of = np.array([e for *_, e in page.lines])
    above, all_ = np.bincount(of, length * upper, n), np.bincount(of, length * fair, n)
    first, last = np.full(n, m), np.full(n, -1)
    for i in np.flatnonzero(upper):
        first[of[i]], last[of[i]] = min(first[of[i]], i), max(last[of[i]], i)
    for e in range(n - 1, 0, -1):
        p = page.parent[e]
        above[p], all_[p] = above[p] + above[e], all_[p] + all_[e]
        first[p], last[p] = min(first[p], first[e]), max(last[p], last[e])
    mostly = (above > 0) & (above >= 0.5 * all_)
    article, region = np.zeros(n, bool), np.zeros(n, np.int64)  # region: the nearest one that holds content
    for e in range(n):
        p = page.parent[e]
        article[e] = bool(e) and (article[p] or (page.tag[e] in ARTICLE and mostly[e]))
        region[e] = e if page.tag[e] in REGION and above[e] > 0 else region[p] if e else 0
    out = np.zeros(m, bool)
    for i in np.flatnonzero(fair & ~upper):
        e, r = of[i], region[of[i]]
        own = of[i]
        while own and page.tag[own] not in REGION:
            own = page.parent[own]
        inside = first[r] < i < last[r]
        heads = page.tag[e] in HEADING and i + 1 == first[r]
        whole = own == r and page.tag[r] not in ("html", "body")
        out[i] = article[e] or (mostly[r] and (inside or heads or whole))
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row; a null or empty page, and one without content, gives an empty text.

    Rows stay as they are, repeated ids too; other columns are left out. Unclosed tags and end tags without a start are taken as
    they come, in time linear in the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(h) for h in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
