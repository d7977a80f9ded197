"""Main text of web pages by line-block distribution.

Markup is stripped in one pass over the page.  Elements that end a line cut
the rest into lines; lines inside elements whose meaning is not article text
(menus, forms, scripts and the like, by tag, role, or name of class or id)
count as no text.  Names, forms and page headers are judged when the page is
read: an element that holds the article's mark, or most of the text without
being a list of comments, excludes nothing.  The lengths of the others, less what is in links, are summed
over sliding windows of ``WINDOW`` lines.  Where the sums surge above the
threshold the text begins, where they dive to nothing it ends, and what lies
between is kept.  A page that marks its article has the distribution
computed inside the mark, where all lines that are text count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.llm.common import table

#: Lines of a window.
WINDOW = 3
#: A surge is a window sum above this share of the page's largest, but at most so many characters.
SURGE_SHARE, SURGE_CHARS = 0.1, 86
#: Lines with a larger share of their characters in links are menus.
LINKED = 0.5

# Tags by their meaning in pages.
NO_CONTENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "video", "audio", "head", "title", "textarea", "select", "option", "datalist"}
NOT_ARTICLE = {"nav", "footer", "aside", "button", "dialog", "menu", "label"}
# These may be wrapped around a whole page.
WRAPPERS = {"form", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ARTICLE_TAGS = {"article", "main"}
RAW_TEXT = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math"}
NOT_ARTICLE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# Parts of a class or id, between hyphens and underscores.
NOT_ARTICLE_NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|topbar|toolbar|pagination|pager|related|recommend\w*|"
    r"share|sharing|social|login|signup|search|widget)",
    re.I,
)
COMMENT_NAMES = re.compile(r"(?:comments?|commentlist|disqus|replies|respond)", re.I)
# Names with these parts tell what a page has or how it looks, not what the element is.
STATE_NAMES = {"has", "no", "not", "non", "with", "without", "is", "are", "hide", "show", "open", "opened", "closed", "enabled", "disabled", "active", "count", "allowed"}
# The elements that a start tag of the first kind ends, if one of them is open.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.S)
_PARTS = re.compile(r"[-_]+")
_WHITE = re.compile(r"\s+")


def meaning(names: str) -> str:
    """What the classes and the id of an element say: ``comments``, ``other`` (no article) or nothing.

    Each name counts as a whole: one of its parts has to be a known word, and none may tell a state.
    """
    found = ""
    for name in names.split():
        parts = [p for p in _PARTS.split(name) if p]
        if any(p.lower() in STATE_NAMES for p in parts):
            continue
        if any(COMMENT_NAMES.fullmatch(p) for p in parts):
            return "comments"
        if any(NOT_ARTICLE_NAMES.fullmatch(p) for p in parts):
            found = "other"
    return found


@dataclass
class Line:
    text: str
    linked: int
    article: bool
    excluded: bool
    #: Elements around it that are no article unless the page shows otherwise.
    doubtful: tuple[int, ...] = ()


class Lines:
    """Lines of a page with what is open around them."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        #: Tag, whether it excludes its content, whether it marks an article, its number if it is doubtful.
        self.open: list[tuple[str, bool, bool, int | None]] = []
        self.excluded = self.articles = self.anchors = 0
        #: Numbers of the doubtful elements that are open, which of all are comments, and those around each mark.
        self.doubtful: list[int] = []
        self.comments: list[bool] = []
        self.marks: list[tuple[int, ...]] = []

    def text(self, raw: str) -> None:
        if raw:
            plain = html.unescape(raw)
            self.parts.append(plain)
            if self.anchors:
                self.linked += len(plain.strip())

    def end_line(self) -> None:
        if self.parts:
            text = _WHITE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.linked, self.articles > 0, self.excluded > 0, tuple(self.doubtful)))
            self.parts, self.linked = [], 0

    def push(self, tag: str, excludes: bool, marks: bool, doubt: str) -> None:
        number = None
        if doubt:
            number = len(self.comments)
            self.comments.append(doubt == "comments")
            self.doubtful.append(number)
        if marks:
            self.marks.append(tuple(self.doubtful))
        self.open.append((tag, excludes, marks, number))
        self.excluded += excludes
        self.articles += marks
        self.anchors += tag == "a"

    def pop(self) -> None:
        tag, excludes, marks, number = self.open.pop()
        if number is not None:
            self.doubtful.remove(number)
        self.excluded -= excludes
        self.articles -= marks
        self.anchors -= tag == "a"

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag not in INLINE:
            self.end_line()
        if tag in VOID:
            return
        ends = CLOSES.get(tag)
        if ends:
            while self.open and self.open[-1][0] in ends | INLINE and any(o[0] in ends for o in self.open[-8:]):
                done = self.open[-1][0] in ends
                self.pop()
                if done:
                    break
        if closed:
            return
        excludes, marks = tag in NO_CONTENT or tag in NOT_ARTICLE, tag in ARTICLE_TAGS
        doubt = "other" if tag in WRAPPERS or tag == "header" and not self.articles else ""
        if attributes and not attributes.isspace():
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            hidden = "hidden" in _VALUE.sub(" ", attributes).lower().split() or given.get("aria-hidden", "").lower() == "true"
            excludes |= hidden or given.get("role", "").lower() in NOT_ARTICLE_ROLES
            marks |= given.get("role", "").lower() in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
            if tag not in ("html", "body", "main", "br") and tag not in HEADINGS:
                doubt = meaning(f"{given.get('class', '')} {given.get('id', '')}") or doubt
        # Cut-off inline mark-up never hides text.
        inline = tag in ("b", "i", "em", "strong", "br")
        self.push(tag, excludes and not inline, marks and not self.excluded and not excludes, "" if inline else doubt)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.pop()
                return
            # A stray end tag does not reach out of a block, but that of a block closes what is open inside.
            if tag in INLINE and self.open[k][0] not in INLINE:
                return


def page_lines(page: str) -> list[Line]:
    """All lines of a page in order."""
    out, at = Lines(), 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        out.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                out.text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            out.end(tag)
            continue
        closed = m[3].rstrip().endswith("/")
        out.start(tag, m[3], closed)
        if tag in RAW_TEXT and not closed:
            stop = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = len(page) if stop is None else stop.start()
    out.end_line()
    return judged(out)


def judged(page: Lines) -> list[Line]:
    """The lines, with those excluded that lie in a doubtful element which is no article after all."""
    seen = [line for line in page.lines if not line.excluded]
    total = sum(len(line.text) for line in seen)
    held = [0] * len(page.comments)
    for line in seen:
        for number in line.doubtful:
            held[number] += len(line.text)
    cleared = {n for n, chars in enumerate(held) if 2 * chars > total and not page.comments[n]}
    if not any(set(around) <= cleared for around in page.marks):
        # No mark is free of doubt, so those count that are in no list of comments.
        for around in page.marks:
            if not any(page.comments[n] for n in around):
                cleared.update(around)
    for line in page.lines:
        line.excluded = line.excluded or not set(line.doubtful) <= cleared
    return page.lines


def line_lengths(lines: list[Line]) -> np.ndarray:
    """Characters of text of each line; none where it is excluded or mostly links."""
    lengths = np.zeros(len(lines), np.int64)
    for i, line in enumerate(lines):
        if not line.excluded and line.linked <= LINKED * len(line.text):
            lengths[i] = len(line.text) - line.linked
    return lengths


def kept_lines(lengths: np.ndarray, marked: bool) -> np.ndarray:
    """Lines between a surge and a dive of the window sums.

    Window i begins at line i.  Text begins at the first line with text of a
    window above the threshold that is followed by one with text, and goes on
    until a whole window is empty.  Inside a marked article any text surges.
    A single line without text of its own between two lines with text is kept.
    """
    n = len(lengths)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    threshold = 0 if marked else min(SURGE_SHARE * sums.max(), SURGE_CHARS)
    i = 0
    while i < n:
        if sums[i] > threshold:
            dive = i
            while dive < n and sums[dive] > 0:
                dive += 1
            full = lengths[i:dive] > 0
            keep[i:dive] = full
            # A line of links between two lines of text belongs to them.
            keep[i + 1 : dive - 1] |= full[:-2] & full[2:]
            i = dive
        else:
            i += 1
    return keep
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    threshold = 0 if marked else min(SURGE_SHARE * sums.max(), SURGE_CHARS)
    i = 0
    while i < n:
        if sums[i] > threshold:
            dive = i
            while dive < n and sums[dive] > 0:
                dive += 1
            keep[i:dive] = lengths[i:dive] > 0
            i = dive
        else:
            i += 1
    return keep


def main_text(page: str | None) -> str:
    """The article of a page; empty where there is none."""
    if not page:
        return ""
    lines = page_lines(page)
    marked = any(line.article and not line.excluded for line in lines)
    # Excluded lines are no part of the sequence, so they part no article.
    lines = [line for line in lines if not line.excluded and (line.article or not marked)]
    lengths = line_lengths(lines)
    if marked:
        lengths = np.array([max(1, n, len(line.text) if line.linked < len(line.text) else 0) for line, n in zip(lines, lengths)], np.int64)
    return " ".join(line.text for line, keep in zip(lines, kept_lines(lengths, marked)) if keep)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, with ``text`` and ``n_chars`` (its code points).

    A null or empty page has an empty text.  Pages of any length are read
    whole.  Columns named text or n_chars are replaced; repeated rows stay.
    """
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    chosen = pages.select(*[F.col(f"`{c}`") for c in others], F.col(page).alias("__page"))
    schema = pages.select(*[F.col(f"`{c}`") for c in others]).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(others))]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *columns], names=[*others, "text", "n_chars"])

    return chosen.mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages").select("page_id", "url", "html"))
