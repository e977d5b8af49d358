"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

``html.parser`` streams events. They fill *lines*: one for each block element, with its text, its number of
tags, the characters in links and the element it stands in. The text-to-tag ratio of each line is smoothed with
a Gaussian and split at a threshold between its two clusters. The lines above it are content: they vote for the
elements around them with their length. From the innermost container that holds nearly all of their text the
article is found upwards: the enclosing article or main element, else the ancestors as long as what they add is
mostly no links. Its lines below the threshold are kept too (headings, short paragraphs, lists), but, where no
article or main element says what belongs to it, for runs of links in parts without any content line, and,
directly below the page's body, for parts without any content line or heading.

Element names and roles are evidence besides: lines in menus, page headers, footers, sidebars, dialogs and reader
comments do not vote and are not returned, unless they are nearly all text of the page. Classes, ids and form
elements are weaker evidence. They are set against the clusters: an element that holds most of the content lines'
text, or the headline with a good part of it, is no advert, sidebar or notice whatever its name. Nothing of this
speaks of the page's own frame (html, body, main, article).

Time and memory are linear in the page, however deep it is and whatever is left open in it. Pages are independent:
one pass without a shuffle, a bounded number of bytes at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from presentia.llm.arrow_text import bounded

# Element and attribute names.
CONTAINERS = frozenset("html body main article section div aside nav header footer form table tbody thead tfoot tr td th ul ol dl figure details dialog fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption address hr caption legend summary option".split())
UNSEEN = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video".split())
OUTSIDE = frozenset("nav header footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog status".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a class or id that mark what is no article, first or last in the name.
MARKS = frozenset(
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist responses replies disqus "
    "cookie cookies consent gdpr advert adverts advertisement advertising adsense pagination".split()
)
#: Words that topics have too: they mark as a whole name, last in one, or first before a part that names a place or gadget.
BUSY = frozenset("ad ads banner promo promotion sponsor sponsored notification popup modal newsletter subscribe subscription paywall social sharing recommended login signup toolbar pager respond".split())
#: Names that mark only as a whole.
WHOLE = frozenset("widget widgets".split())
#: Words that content uses too: they mark as a whole name, last in one, or first before a part of GADGETS.
WEAK = frozenset("header notice notices overlay related share search copyright legal disclaimer skip hidden".split())
GADGETS = frozenset("bar box button buttons form icons link links list menu popup posts tools widget".split())
PLACES = frozenset("area block body bottom container content inner item items left right section slot top unit wrap wrapper x".split())
#: First parts of names that say something about the page, not what the element is.
STATES = frozenset("no not has have with without is".split())
#: First parts of the article's own elements; a weak word after them does not mark.
OWN = frozenset("article post entry content story text body title main section".split())
COMMENTS = frozenset("comment comments commentlist respond responses replies disqus".split())
#: What only adverts are called; other marks do not drop a paragraph that is content.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo".split())
FRAME = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WRITTEN = HEADINGS | frozenset("p blockquote pre".split())
LAYOUT = frozenset("div section center table details".split())
LISTS = frozenset("ul ol dl table tbody tr".split())
#: Lines of links alone, in a row and below the threshold, that are a menu.
LINK_RUN = 3
#: The part of the content that an element with the headline holds if it is the article, and any other.
WITH_HEADLINE, MOST = 0.2, 0.5
_NAMES = re.compile(r"[a-z]+")
_UNFINISHED = re.compile(r"""</?[a-zA-Z][\w:-]*(?:\s+[\w:-]+\s*=[^<]*)?\s*""")


def _marks(name: str) -> bool:
    """Whether one class name or id marks what is no article."""
    parts = _NAMES.findall(name)
    if not parts or parts[0] in STATES:
        return False
    if name in WHOLE:
        return True
    first, last = parts[0], parts[-1]
    if first in MARKS or last in MARKS or last in BUSY:
        return True
    if first in BUSY and (last in GADGETS or last in PLACES or last in WEAK):
        return True
    if first in WEAK and (len(parts) == 1 or last in GADGETS):
        return True
    return last in WEAK and first not in OWN


#: What is known of an element: nothing, a name that marks it, that it is no article, that it holds reader comments.
NOTHING, NAMED, ADVERT, OUTSIDE_PART, COMMENT_PART = range(5)


def _evidence(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """What element, role, class and id say."""
    if tag in FRAME:
        return NOTHING
    kind = OUTSIDE_PART if tag in OUTSIDE and not (tag == "header" and in_article) else NAMED if tag == "form" else NOTHING
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value and value.lower() in ROLES:
            kind = max(kind, OUTSIDE_PART)
        elif (name == "class" or name == "id" and tag not in HEADINGS) and value:
            for one in value.lower().split():
                if _marks(one) and not (tag == "header" and in_article):
                    parts = _NAMES.findall(one)
                    kind = max(kind, COMMENT_PART if not COMMENTS.isdisjoint(parts) else NAMED if ADVERTS.isdisjoint(parts) else ADVERT)
    return kind


def closed(html: str) -> str:
    """``html`` with what is left open at its end closed, so that the parser never looks for an end that is not there.

    Comments that nothing ends end at once, a tag that breaks off goes, other brackets behind the last tag are text.
    """
    at = max(html.rfind("-->") + 3, html.rfind("--!>") + 4, 4)
    at = 0 if at == 4 and not html.startswith("--!>") else at
    if "<!--" in html[at:]:
        html = html[:at] + html[at:].replace("<!--", "<!---->")
    at = html.rfind(">") + 1
    tail = html[at:]
    if "<" in tail:
        if _UNFINISHED.fullmatch(tail, tail.rfind("<")):
            tail = tail[: tail.rfind("<")]
        html = html[:at] + tail.replace("<", "&lt;")
    return html


@dataclass(frozen=True)
class Line:
    """The text of a block, its inline tags, the element it stands in, its characters in links, and whether it is the headline."""

    text: str
    tags: int
    node: int
    linked: int
    heading: bool
    headline: bool


class Lines(HTMLParser):
    """Collects lines and elements from parser events. Elements are numbered as they open; 0 is the page."""

    #: What the parser would read to its own end tag, however far away.
    RCDATA_CONTENT_ELEMENTS = ("textarea",)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.tag, self.kind = [0], ["#page"], [NOTHING]
        self._stack = [0]
        self._containers = [0]  # how many containers are open up to each place of the stack
        self._open: dict[str, list[int]] = {}  # places in the stack by tag
        self._link = False
        self._linked = 0
        self._unseen: list[str] = []
        self._text: list[str] = []
        self._tags = 0

    def _break(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                at = self._stack[-1]
                self.lines.append(Line(text, self._tags, at, self._linked, self.tag[at] in HEADINGS, self.tag[at] == "h1"))
            self._text = []
        self._tags = self._linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._unseen:
            if tag == "body" and self._unseen[0] in ("head", "title"):  # the end tag was left out
                self._unseen.clear()
            else:
                if tag == self._unseen[-1]:
                    self._unseen.append(tag)
                return
        if tag in UNSEEN:
            if tag not in ("svg", "math", "object") or not self.get_starttag_text().endswith("/>"):
                self._unseen.append(tag)
            return
        in_article = bool(self._open.get("article") or self._open.get("main"))
        if tag == "br":
            self._text.append(" ")
        if tag in BLOCKS:
            self._break()
            if tag in VOID:
                return
            top = self.tag[self._stack[-1]]
            if tag in ("p", "li", "dt", "dd", *HEADINGS) and (top == tag or tag not in ("li", "dt", "dd") and top == "p"):
                self._pop()  # end tags of these are often left out
            self._push(tag, _evidence(tag, attrs, in_article))
        else:
            self._tags += 1
            if tag == "a":
                self._link = True
            if attrs and tag not in VOID and (kind := _evidence(tag, attrs, in_article)):
                self._break()
                self._push(tag, kind)

    handle_startendtag = handle_starttag

    def _push(self, tag: str, kind: int) -> None:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.kind.append(kind)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._containers.append(self._containers[-1] + (tag in CONTAINERS))

    def _pop(self) -> None:
        self._open[self.tag[self._stack.pop()]].pop()
        self._containers.pop()

    def handle_endtag(self, tag: str) -> None:
        if self._unseen:
            if tag == self._unseen[-1]:
                self._unseen.pop()
            elif tag in ("body", "html") or tag == "head" and self._unseen == ["title"]:
                self._unseen.clear()
            return
        if tag in BLOCKS:
            self._break()
            self._link = False
        else:
            self._tags += 1
            if tag == "a":
                self._link = False
        if self._open.get(tag):
            place = self._open[tag][-1]
            if tag in CONTAINERS or self._containers[-1] == self._containers[place]:
                self._break()
                while len(self._stack) > place:
                    self._pop()

    def handle_data(self, data: str) -> None:
        if not self._unseen:
            self._text.append(data)
            if self._link:
                self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._break()


def _smoothed(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def _threshold(values: list[float]) -> float:
    """Between the two clusters of the values: moved to the midpoint of their means until it stays."""
    cut = (min(values) + max(values)) / 2
    for _ in range(20):
        low = [v for v in values if v < cut]
        high = [v for v in values if v >= cut]
        if not low or not high:
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _within(parent: list[int], amounts: Iterable[tuple[int, int]]) -> list[int]:
    """For each element the sum of the amounts of all elements within it."""
    out = [0] * len(parent)
    for node, amount in amounts:
        out[node] += amount
    for node in range(len(parent) - 1, 0, -1):
        out[parent[node]] += out[node]
    return out


def _content(lines: list[Line], sigma: float, clusters: bool) -> list[bool]:
    """Which lines stand above the threshold of the smoothed ratios."""
    if not lines:
        return []
    ratio = _smoothed([len(line.text) / max(1, line.tags) for line in lines], sigma)
    cut = _threshold(ratio) if clusters else 0.0
    return [r >= cut for r in ratio]


def _outside(page: Lines, share: float) -> list[bool]:
    """The elements that are no article by their name or role: none that holds ``share`` of the page's text; for comments, all of it."""
    held = _within(page.parent, ((line.node, len(line.text)) for line in page.lines))
    out = [False] * len(page.parent)
    for node in range(1, len(page.parent)):
        kind = page.kind[node]
        out[node] = out[page.parent[node]] or kind >= OUTSIDE_PART and held[node] < (held[0] if kind == COMMENT_PART else share * held[0])
    return out


def _named(page: Lines, lines: list[Line], content: list[bool]) -> list[bool]:
    """The elements whose class or id, or being a form, tells that they are no article, as far as the content lines agree.

    They can only disagree about what stands in or around an article or main element, if the page has one.
    """
    text = _within(page.parent, ((line.node, len(line.text)) for line, c in zip(lines, content, strict=True) if c and 2 * line.linked < len(line.text)))
    headlines = _within(page.parent, ((line.node, 1) for line in lines if line.headline))
    some = _within(page.parent, ((line.node, 1) for line in lines))
    bodies = _within(page.parent, ((node, 1) for node, tag in enumerate(page.tag) if tag in ("article", "main") and some[node]))
    inside = [False] * len(page.parent)
    out = [False] * len(page.parent)
    for node in range(1, len(page.parent)):
        above = page.parent[node]
        inside[node] = inside[above] or page.tag[node] in ("article", "main")
        marked = page.kind[node] in (NAMED, ADVERT)
        if marked and text[0] and (inside[node] or bodies[node] or not bodies[0]):
            least = WITH_HEADLINE if headlines[node] else MOST
            marked = text[node] < least * text[0] and not (page.kind[node] == NAMED and page.tag[node] in WRITTEN and (text[node] or page.tag[node] in HEADINGS))
        out[node] = out[above] or marked
    return out


def _article(page: Lines, lines: list[Line], at: int) -> int:
    """The article around the container ``at``."""
    path = [at]
    while path[-1]:
        path.append(page.parent[path[-1]])
    headlines = _within(page.parent, ((line.node, 1) for line in lines if line.headline))
    for name in ("article", "main"):
        found = next((c for c in path if page.tag[c] == name), None)
        if found is not None and (name == "main" or headlines[found] or not any(page.tag[c] == "main" for c in path)):
            return found
    chars = _within(page.parent, ((line.node, len(line.text)) for line in lines))
    linked = _within(page.parent, ((line.node, min(line.linked, len(line.text))) for line in lines))
    for c in path[1:]:
        if 2 * (linked[c] - linked[at]) > chars[c] - chars[at]:
            break
        at = c
    return at


def _kept(page: Lines, lines: list[Line], content: list[bool], article: int) -> Iterator[str]:
    """The article's lines, but for what no article element vouches for: runs of links apart from content, and parts of a body without content or heading."""
    n = len(page.parent)
    written = _within(page.parent, ((line.node, 1) for line, c in zip(lines, content, strict=True) if c and 2 * line.linked < len(line.text)))
    vouched = page.tag[article] in ("article", "main")
    telling = _within(page.parent, ((line.node, 1) for line, c in zip(lines, content, strict=True) if c or line.heading))
    inside = [False] * n
    inside[article] = True
    frame = article == 0 or page.tag[article] in ("html", "body")
    for node in range(1, n):
        if node != article and inside[page.parent[node]]:
            bare = frame and page.tag[page.parent[node]] in ("#page", "html", "body") and page.tag[node] in LAYOUT and not telling[node]
            inside[node] = not bare
    run: list[Line] = []

    def menu() -> bool:
        if len(run) < LINK_RUN or vouched:
            return False
        at = run[0].node
        while at and (page.tag[at] in LISTS or page.tag[at] in ("li", "dt", "dd", "td", "th", "p")):
            at = page.parent[at]
        return page.tag[at] in ("#page", "html", "body") or not written[at]

    for line, c in zip(lines, content, strict=True):
        if not inside[line.node]:
            continue
        if not c and not line.heading and 10 * line.linked >= 9 * len(line.text):
            run.append(line)
            continue
        if not menu():
            yield from (x.text for x in run)
        run = []
        yield line.text
    if not menu():
        yield from (x.text for x in run)


def extract_text(html: str, sigma: float = 1.0, share: float = 0.9, evidence: bool = True, clusters: bool = True) -> str:
    """The main text of one page, blocks joined by a line feed; empty if there is none.

    Without ``evidence`` names, roles, classes and ids are not looked at; without ``clusters`` every line is content.
    """
    page = Lines()
    page.feed(closed(html))
    page.close()
    lines = page.lines
    if evidence:
        excluded = _outside(page, share)
        lines = [line for line in lines if not excluded[line.node]]
        excluded = _named(page, lines, _content(lines, sigma, clusters))
        lines = [line for line in lines if not excluded[line.node]]
    if not lines:
        return ""
    content = _content(lines, sigma, clusters)
    votes = _within(page.parent, ((line.node, len(line.text)) for line, c in zip(lines, content, strict=True) if c))
    # Elements with most of the votes lie within each other, the innermost one opened last.
    at = next(node for node in range(len(votes) - 1, -1, -1) if votes[node] >= share * votes[0] and (page.tag[node] in CONTAINERS or not node))
    return "\n".join(_kept(page, lines, content, _article(page, lines, at)))


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if none), n_chars (its code points) for every row.

    Null html counts as empty and gives an empty text, as does a page without text; broken markup never fails a
    page; very long and very deep pages are read whole, in linear time. Where two elements hold the same votes the
    inner one counts. Repeated rows give repeated results, null ids and urls pass; an empty table gives none.
    Further columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "html", 4 << 20):
            texts = [extract_text(h.decode("utf-8", "replace")) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    src = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{url_col}` as string) as url", f"`{html_col}` as html")
    return src.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
