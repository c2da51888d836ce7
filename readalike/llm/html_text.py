"""Main text of HTML pages by tag-path ratios.

A page becomes its text blocks in order, each with the tag path from the root to it. Tags that
only format a run of text (bold, links and the like) belong to no path. For each path
the blocks' text lengths (without link text) and punctuation marks are summed and
divided by the number of blocks; every block gets its path's two ratios, both are smoothed among
neighbours in the same element and fused to one. A path of which a block reaches ``SHARE`` of the page's highest value is
content where the element around the block holds at least ``PART_SHARE`` of what the best one holds; so is what stands between
such blocks, or shares the part of the page (an article, or the element around it) that holds the best of them.

Names only help. Outside an article a path through an element that says it isn't content (navigation, footer, form, an advert's class and
so on) has ratio 0. Within ``article`` or ``main``, whose paths count for more than those beside them, a name must say so as a whole
("comment-list", not "related-work"), and names that sections of articles have as well ("discussion", "search") only raise a
doubt, which the share of text in links and the punctuation of the part settle.

Blocks are whole: character references are decoded, white space within a block becomes
one space, and the chosen blocks are joined by line ends in page order.

Defined cases: a null or empty page has an empty text, as has a page without content; an
unclosed element ends with the page or where HTML closes it, an unclosed embedded one (video, svg and the
like, whose content is no page text) with the element around it; a head ends where something
begins that cannot stand in it; a ``<`` that begins no tag is
text; repeated rows and null ids are kept, each row for itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike.llm.shipping import with_package

SHARE = 0.1                            # of the highest fused value, for a path to be content
PART_SHARE = 0.04                      # of the best part's sum of values, for another part of the page
LINK_SHARE = 0.5                       # of a doubtful part's text in links, to be no content
SMOOTHING = np.array([0.25, 0.5, 0.25])
INSIDE_ARTICLE = 8.0

TEXTS = "page_id long, url string, text string, n_chars long"

# Text up to the end tag, or else the page's end, belongs to these and isn't page text.
RAW = frozenset("script style textarea title iframe".split())
# These hold no page text but other elements, and end with the element around them at the latest.
EMBEDDED = frozenset("noscript template select object svg math canvas audio video".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(sorted(RAW | EMBEDDED))})(?=[\s/>])(?P<rawattr>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<attr>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/<>]*)(?P<attr2>[^<>]*)>", re.DOTALL | re.IGNORECASE)
_OPEN_VALUE = re.compile(r"=\s*[^\s\"']*/\Z")
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

# HTML's own element classes, and names that pages give to what isn't content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr br img").split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                      "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul").split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
WALLS = CLOSES_P - {"p"}
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
# Elements that end an open svg or math, and those within which they don't.
BREAKS_OUT = frozenset(("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta "
                        "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var").split())
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
OTHER_TAGS = frozenset("nav footer aside form button fieldset menu dialog".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
OTHER_NAMES = frozenset((
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar sidenav aside ad ads advert adverts "
    "advertisement adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay comment comments commentlist reply replies respond discussion disqus form login signup signin subscribe subscription newsletter "
    "share sharing social related recommended recommendations widget toolbar pagination pager copyright legal disclaimer search skip").split())
# Of these names an article has sections too: what they hold decides within one.
DOUBTFUL_NAMES = frozenset(("discussion discuss related recommended recommendations search share sharing social legal copyright "
                            "disclaimer header banner reply replies respond alert overlay menu navigation skip form login").split())
# Parts of a name that say nothing of what an element holds.
NEUTRAL_NAMES = frozenset(("area block body bottom box col column container content group holder inner item items left line list main "
                           "new outer page panel post posts right row section site slot the top unit wrap wrapper").split())
YES, MAYBE, NO = 2, 1, 0


def named_other(value: str, in_article: bool) -> int:
    """What the words of a class or id say. Within an article a word among others ("related-work") says nothing, and
    one that article sections have as well raises a doubt."""
    found = NO
    for token in value.split():
        parts = {p.lower() for p in _NAME_PART.findall(token)}
        telling = parts & OTHER_NAMES
        if telling and not in_article:
            return YES
        if telling and parts <= telling | NEUTRAL_NAMES:
            found = max(found, MAYBE if telling <= DOUBTFUL_NAMES else YES)
    return found


def says_other(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element says that it isn't content: YES, MAYBE or NO."""
    if tag in OTHER_TAGS or (tag == "header" and not in_article):
        return YES
    found = NO
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return YES
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return YES
        if name == "role" and value.lower() in OTHER_ROLES:
            return YES
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            found = max(found, named_other(value, in_article))
    return found


def closes_itself(attributes: str) -> bool:
    """Whether a start tag ends in a slash that belongs to no attribute's value."""
    return attributes.endswith("/") and not _OPEN_VALUE.search(attributes)


class Page:
    """Blocks of one page with the number of their path; paths know what they lead through."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str, bool], int] = {}
        self.other: list[bool] = [False]
        self.article: list[bool] = [False]
        self.above: list[int] = [0]             # path of the parent; the root is its own
        self.whole: list[bool] = [True]         # root, html and body hold the page, not one part of it
        self.doubtful: list[int] = []           # paths of elements whose name raises a doubt
        # Path, text, its characters outside of links, and the element around the block's own.
        self.blocks: list[tuple[int, str, int, int]] = []
        # Open elements: tag, the path up to and with it, number of the element.
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]
        # Of each element the number of blocks before it, and before what follows it.
        self.begins, self.ends = [0], [-1]
        # Places of open elements by tag, of those that a closing rule stops at, and of those that aren't inline: so a
        # tag that isn't open, or lies behind such an element, is known without a look at all that is open.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []
        self.solid: list[int] = [0]
        self.pieces: list[str] = []
        self.link_chars = self.links = at = 0
        self.hidden = 0                          # place of the open head or embedded element around all that follows
        self.runs: Counter[str] = Counter()      # open inline elements
        while token := _TOKEN.search(source, at):
            self.text(source[at:token.start()])
            at = token.end()
            if tag := (token["raw"] or token["tag"] or token["tag2"] or "").lower():
                attributes = token["rawattr"] or token["attr"] or token["attr2"] or ""
                if token["end"] or token["end2"]:
                    self.close(tag)
                elif tag in RAW:
                    self.appear(tag)
                    if not (self.foreign() and closes_itself(attributes)):
                        end = _RAW_END[tag].search(source, at)
                        at = end.end() if end else len(source)
                else:
                    self.begin(tag, attributes)
        self.text(source[at:])
        self.show()
        self.finish()

    def text(self, piece: str) -> None:
        if self.hidden and self.open[-1][0] == "head" and piece.strip():
            self.show()
        if piece and not self.hidden:
            self.pieces.append(piece)
            if self.links:
                self.link_chars += len(piece)

    def push(self, tag: str, path: int) -> None:
        place = len(self.open)
        self.open.append((tag, path, len(self.begins)))
        self.begins.append(len(self.blocks))
        self.ends.append(-1)
        self.places[tag].append(place)
        if tag in WALLS:
            self.walls.append(place)
        if tag not in INLINE:
            self.solid.append(place)

    def cut(self, place: int) -> None:
        """Close the elements from this place on."""
        while len(self.open) > place:
            tag, _, number = self.open.pop()
            self.ends[number] = len(self.blocks)
            at = self.places[tag].pop()
            for stack in (self.walls, self.solid):
                if stack and stack[-1] == at:
                    stack.pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def show(self) -> None:
        """Leave the head or embedded element; the block before it goes on."""
        if self.hidden:
            self.cut(self.hidden)
            self.hidden = 0

    def foreign(self) -> bool:
        """Whether svg or math is open, and no HTML within it."""
        inner = self.last(("svg", "math"))
        return bool(self.hidden) and inner >= self.hidden and self.last(HOLDS_HTML) < inner

    def appear(self, tag: str) -> None:
        """Leave what cannot hold an element of this tag."""
        if not self.hidden:
            return
        outer = self.open[self.hidden][0]
        if outer == "head" and self.last(("template",)) < self.hidden and tag not in IN_HEAD:
            self.show()
        elif outer == "select" and tag in ("select", "input", "textarea"):
            self.show()
        elif tag in BREAKS_OUT and outer in ("svg", "math") and self.foreign():
            self.show()

    def conceal(self, tag: str, attributes: str) -> None:
        """Open an element in a head or embedded element, or one of these: nothing in it is page text."""
        if tag in VOID or (closes_itself(attributes) and (tag in ("svg", "math") or self.foreign())):
            return
        if self.hidden:
            self.push(tag, self.open[-1][1])
        elif tag != "head" or len(self.open) == 1 + len(self.places["html"]):
            self.hidden = len(self.open)
            self.push(tag, self.open[-1][1])

    def finish(self) -> None:
        """The text so far is a block of the innermost open element."""
        if self.pieces:
            block = " ".join(html.unescape("".join(self.pieces)).split())
            if block:
                around = self.open[-2][2] if len(self.open) > 1 else 0
                self.blocks.append((self.open[-1][1], block, max(0, len(block) - self.link_chars), around))
            self.pieces = []
        self.link_chars = 0

    def begin(self, tag: str, attributes: str) -> None:
        self.appear(tag)
        if self.hidden and tag in CLOSES_P and self.open[self.hidden][0] in ("audio", "canvas", "video", "noscript"):
            self.leave({"p"}, {"button", "td", "th", "table", "object"})
        if self.hidden and tag in CLOSES and self.open[self.hidden][0] not in ("object", "template", "svg", "math"):
            self.leave(CLOSES[tag], HOLDS.get(tag, {"table"}))
        if self.hidden or tag in EMBEDDED or tag == "head":
            self.conceal(tag, attributes)
            return
        self.runs[tag] += tag in INLINE and tag not in VOID
        if tag in INLINE and says_other(tag, attributes, True) != YES:
            self.links += tag == "a"
            if tag in ("br", "wbr", "img"):
                self.pieces.append(" " if tag != "wbr" else "")
            return
        self.finish()
        if tag in VOID:
            return
        self.links = 0
        if tag in CLOSES_P:
            self.leave({"p"}, {"button", "td", "th", "table", "object"})
        if tag in CLOSES:
            self.leave(CLOSES[tag], HOLDS.get(tag, {"table"}))
        above = self.open[-1][1]
        inside = self.article[above]
        names = [v for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for v in values if v]
        said = says_other(tag, attributes, inside)
        other = self.other[above] or said == YES
        key = above, " ".join([tag, *names]), other
        number = self.paths.setdefault(key, len(self.other))
        if number == len(self.other):
            if said == MAYBE and not other:
                self.doubtful.append(number)
            self.other.append(other)
            self.article.append(inside or tag in ("article", "main"))
            self.above.append(above)
            self.whole.append(tag in ("html", "body"))
        self.push(tag, number)

    def container(self, path: int) -> int:
        """The outermost article or main around a path, else its parent."""
        part = self.above[path]
        while self.article[self.above[part]]:
            part = self.above[part]
        return path if self.article[path] and not self.article[self.above[path]] else part

    def below(self, part: int) -> np.ndarray:
        """Which paths lead through ``part``; a path's number is larger than its parent's."""
        held = np.zeros(len(self.above), bool)
        held[part] = True
        for number in range(part + 1, len(self.above)):
            held[number] = held[self.above[number]]
        return held

    def leave(self, tags: set[str], limits: set[str]) -> None:
        """Close open elements of ``tags`` and what they hold, up to an element of ``limits``."""
        while (place := self.last(tags)) and place >= max(self.last(limits), self.walls[-1] if self.walls else 0):
            if place < self.hidden:
                self.show()
                self.finish()
            self.cut(place)

    def close(self, tag: str) -> None:
        place = self.last((tag,))
        if self.hidden:
            if place > self.hidden:
                self.cut(place)
                return
            if place == self.hidden:
                self.show()
                return
            if not place and not self.runs[tag]:
                return
            self.show()
        self.runs[tag] = max(0, self.runs[tag] - 1)
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            if place > self.solid[-1]:     # an inline element that opened a path
                self.finish()
                self.cut(place)
            return
        self.finish()
        self.links = 0
        if place:
            self.cut(place)

    def settle_doubts(self) -> None:
        """A doubtful part whose text is mostly links, or has no punctuation at all, isn't content."""
        chars, plain, marks = ([0] * len(self.above) for _ in range(3))
        for path, text, outside, _ in self.blocks:
            chars[path] += len(text)
            plain[path] += outside
            marks[path] += len(_PUNCTUATION.findall(text))
        for number in range(len(self.above) - 1, 0, -1):    # a path's number is larger than its parent's
            for total in (chars, plain, marks):
                total[self.above[number]] += total[number]
        gone = {part for part in self.doubtful if plain[part] < (1 - LINK_SHARE) * chars[part] or not marks[part]}
        for number in range(1, len(self.above)):
            self.other[number] = self.other[number] or self.other[self.above[number]] or number in gone


def main_text(source: str) -> str:
    page = Page(source)
    if not page.blocks:
        return ""
    if page.doubtful:
        page.settle_doubts()
    path = np.array([b[0] for b in page.blocks])
    chars = np.array([b[2] for b in page.blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(b[1])) for b in page.blocks], float)
    elements, around = np.unique([b[3] for b in page.blocks], return_inverse=True)
    n = np.maximum(1, np.bincount(path, minlength=len(page.other)))
    article = np.array(page.article)[path]
    counts = np.where(np.array(page.other)[path], 0.0, np.where(article, INSIDE_ARTICLE, 1.0))
    text_ratio = (np.bincount(path, chars, len(n)) / n)[path] * counts
    mark_ratio = (np.bincount(path, marks, len(n)) / n)[path] * counts
    # Blocks that aren't content take no part, so that a value isn't smoothed across them.
    mine = np.flatnonzero(counts > 0)
    if not len(mine):
        return ""
    # Only neighbours in the same element are smoothed: text beside content isn't raised by it.
    run = np.cumsum(np.append(True, around[mine][1:] != around[mine][:-1]))
    smooth_text, smooth_marks = smoothed(text_ratio[mine], run), smoothed(mark_ratio[mine], run)
    fused = smooth_text * (1.0 + smooth_marks)
    best = int(fused.argmax())
    # A path is content if one of its blocks is, where the part of the page that holds the block is not much less than the best part.
    mass = np.bincount(around[mine], fused)
    passing = (fused >= SHARE * fused.max()) & (mass[around[mine]] >= PART_SHARE * mass.max())
    content = np.zeros(len(n), bool)
    content[path[mine[passing]]] = True
    chosen = content[path[mine]] & (mass[around[mine]] >= PART_SHARE * mass.max())
    # So is what shares the part that holds the best block: an article, or the element around it.
    part = page.container(int(path[mine[best]]))
    if article[mine[best]]:
        chosen |= page.below(part)[path[mine]]
    elif not page.whole[part]:
        element = elements[around[mine[best]]]
        end = page.ends[element]
        chosen |= page.below(part)[path[mine]] & (mine >= page.begins[element]) & ((mine < end) | (end < 0))
    chosen[best] = True
    # And what stands between content blocks.
    inside = np.flatnonzero(chosen)
    return "\n".join(page.blocks[k][1] for k in mine[inside[0]:inside[-1] + 1])


def smoothed(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Weighted mean of each value and its neighbours of the same run; at an end the value stands for the one that is missing."""
    before, after = np.append(values[:1], values[:-1]), np.append(values[1:], values[-1:])
    first, last = np.append(True, run[1:] != run[:-1]), np.append(run[1:] != run[:-1], True)
    return (SMOOTHING[0] * np.where(first, values, before) + SMOOTHING[1] * values
            + SMOOTHING[2] * np.where(last, values, after))


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text and its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [main_text(source.as_py() or "") for source in batch.column("html")]
                yield pa.RecordBatch.from_pydict({
                    "page_id": batch.column("page_id"), "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    narrow = with_package(pages).select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, TEXTS)
