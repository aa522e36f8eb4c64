"""Operator 6: main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Lines of menus, headers, footers, sidebars, scripts and styles
have no text length, nor have those of forms, comments, hidden elements and elements named like notices or adverts
unless these hold the article or most of the page's text. Text lengths of all lines (without link text; in an
article a quarter of it counts) are summed over sliding windows of `window` lines. A stretch of text begins with the
first line after a quiet one and ends at the dive, where the sum over a window falls to nothing, or where an article
begins or ends; it is kept where it has a surge, a window whose sum reaches `surge`, short lines too. So lines
without length part two stretches only if they fill a window. If no window reaches the surge, the stretch with the
largest sum is kept. Stretches are kept inside articles or outside, wherever the longest one is; text in an article
weighs three times, in one with a first headline twelve times. An article with a kept stretch is taken whole, but for
its noise; outside, so is a stretch that noise alone parts from a kept one, in the block around one of them.

Tags are read as browsers do: `<` and a letter begin one, quotes count after `=` only, and it ends at the next `>`.
A script, style, noscript, textarea, title or iframe ends at its own end tag, whatever stands in it. Elements that
show no text (buttons, canvases) end with their parent at the latest, at an article, and, where none of their end
tags follows, at the next block. A paragraph, list item or cell ends where the next block, item or cell begins.
Names of paragraphs, headlines and cells say less than those of other elements, since words like share or comment
tell what such a one is about.

Work grows with a page's length, not with its depth. Defined cases: a null or empty html gives an empty text; a very
long page is read whole; tags that stay open or are cut off at the end of the page close there; of stretches with
equal sums the first counts; repeated rows are repeated; a null page_id or url is kept; an empty table gives no rows;
columns besides page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

WINDOW, SURGE = 3, 60
ARTICLE_WEIGHT, HEADED_WEIGHT, LINK_SHARE = 3, 12, 4  # of an article's text, of one with a first headline; what counts of its links
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre td th dt dd caption figcaption legend summary".split())
#: Open blocks that end where the block named begins; a paragraph ends at any.
ENDED = {k: frozenset(("p " + v).split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}.items()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|$)[^>]*>?", re.I) for n in "script style noscript textarea title iframe".split()}
SKIPPED = frozenset("noscript template select button canvas audio video".split())
SKIPPED_IN_DRAWINGS = frozenset("desc metadata defs".split())
NOISE_TAGS = frozenset("nav footer aside menu dialog head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
_ADVERTS = r"ads?|advert\w*|adbox|sponsor\w*|promo\w*|breadcrumbs?|cookies?|consent|gdpr|newsletter|subscribe|pagination|pager|disqus"
_FURNITURE = (
    r"banner|nav|navbar|navigation|menu\w*|sidebar|side-bar|rail|widget\w*|footer|header|masthead|topbar|notice|notices|alert|popup|modal|overlay|"
    r"signup|login|comments?|commentlist|replies|respond|related|recommended|share|sharing|social|toolbar"
)
_named = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
NOISE_NAMES, ADVERT_NAMES, ASIDE_NAMES = _named(f"{_ADVERTS}|{_FURNITURE}"), _named(_ADVERTS), _named("comments?|commentlist|disqus|replies|respond")
_HEADER = re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I)
_TAG = r"</?[a-zA-Z](?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+(?:>|$)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|{_TAG}|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_BARE = re.compile(r"=\s*[^\s\"'>]*/>$")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NOISE, SUSPECT, ASIDE = 1, 2, 3


def _closed(tag: str) -> bool:
    """Whether a tag closes itself; the slash of <a href=/> belongs to its value."""
    return tag.endswith("/>") and not _BARE.search(tag)


def _kind(name: str, tag: str, inside: bool) -> int:
    """NOISE, or what has to be judged by its lines: SUSPECT by its name, ASIDE by one of comments or as hidden."""
    if name in NOISE_TAGS or name == "header" and not inside:
        return NOISE
    kind = SUSPECT if name == "form" else 0
    at = tag.find(" ")
    if at < 0 or name in ("html", "body") or name in ("article", "main") and "comment" not in tag:
        return kind
    names = ADVERT_NAMES if name in PARAGRAPHS else NOISE_NAMES
    for key, a, b, c in _ATTR.findall(tag[at:]):
        value = a or b or c
        key = key.lower()
        if inside and key in ("class", "id"):
            value = _HEADER.sub(" ", value)  # an article's own header is none of the page
        if key in ("class", "id") and names.search(value) or key == "role" and value.lower() in NOISE_ROLES:
            kind = max(kind, ASIDE if ASIDE_NAMES.search(value) else SUSPECT)
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return ASIDE
    return kind


class Line(NamedTuple):
    text: str
    linked: int  # characters of it in links
    noise: bool  # whether it lies in an element that is always noise
    inside: bool  # whether it lies in an article
    head: bool  # whether it is a first headline
    suspect: int  # the innermost element to be judged around it, or -1
    holder: int  # the innermost such element around the innermost article that it lies in, or -1
    article: int  # the outermost article that it lies in, or -1
    container: int  # the innermost block around it that holds more than a paragraph, or -1

    @property
    def size(self) -> int:
        return max(0, len(self.text) - self.linked)


class Elements:
    """The elements that are open, with what a line has to know of them at hand; and all that are to be judged."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []  # name, kind, whether an article
        self.places: dict[str, list[int]] = defaultdict(list)  # of a name's open elements in the stack
        self.blocks: list[int] = []  # places of open blocks
        self.noise: list[int] = []  # places of open elements that always are noise
        self.articles = 0
        self.suspects: list[tuple[int, int]] = []  # parent (or -1) and kind of each that was met
        self.open: list[int] = []  # numbers of open suspects
        self.holders: list[int] = []  # for each open article that isn't an aside: the innermost suspect around it
        self.outermost = -1  # number of the outermost article that is open or was last
        self.lines = 0  # met so far
        self.containers: list[tuple[int, int]] = []  # place and number of each open one
        self.spans: list[list] = []  # of each container: its name, first line and the line after its last

    def push(self, name: str, kind: int = 0, article: bool = False) -> None:
        at = len(self.stack)
        self.stack.append((name, kind, article))
        self.places[name].append(at)
        if name in BLOCKS:
            self.blocks.append(at)
            if name not in PARAGRAPHS and name not in ENDED:
                self.containers.append((at, len(self.spans)))
                self.spans.append([name, self.lines, 1 << 62])
        if kind == NOISE:
            self.noise.append(at)
        elif kind > NOISE:
            self.suspects.append((self.open[-1] if self.open else -1, kind))
            self.open.append(len(self.suspects) - 1)
        if article:
            self.outermost += not self.articles
            self.articles += 1
            if kind != ASIDE:
                self.holders.append(self.open[-1] if self.open else -1)

    def drop(self, at: int) -> None:
        while len(self.stack) > at:
            name, kind, article = self.stack.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
                if self.containers and self.containers[-1][0] == len(self.stack):
                    self.spans[self.containers.pop()[1]][2] = self.lines
            if kind == NOISE:
                self.noise.pop()
            elif kind > NOISE:
                self.open.pop()
            if article:
                self.articles -= 1
                if kind != ASIDE:
                    self.holders.pop()

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, or -1."""
        return self.places[name][-1] if self.places[name] else -1

    def end(self, name: str) -> None:
        """An end tag: closes its element and all in it; one within lines doesn't close a block."""
        at = self.last(name)
        if at >= 0 and (name in BLOCKS or not self.blocks or at > self.blocks[-1]):
            self.drop(at)

    def begin_block(self, name: str) -> None:
        ended = ENDED.get(name, ("p",))
        while self.blocks and self.stack[self.blocks[-1]][0] in ended:
            self.drop(self.blocks[-1])


def judged(lines: list[Line], suspects: list[tuple[int, int]]) -> list[bool]:
    """Whether each line is noise.

    Suspect elements are judged by their text (without links), those with most first. One is no noise where it holds
    the article (in it at least half as much text as stands clear, which is outside of all suspects but those found to
    be none) or its first headline; or, while no article stands clear, most of the page's text, one of comments or a
    hidden one four times the clear text. If that leaves no text, only elements that always are noise count.
    """
    n = len(suspects)
    own, article, lit, headed = [0] * n, [0] * n, [False] * n, [False] * n
    total, clear, marked = 0, 0, False
    for x in lines:
        if x.noise:
            continue
        total += x.size
        if x.suspect < 0:
            clear, marked = clear + x.size, marked or x.size > 0 and x.inside
            continue
        own[x.suspect] += x.size
        lit[x.suspect] |= x.size > 0 and x.inside
        headed[x.suspect] |= x.head and x.inside
        if x.holder >= 0:
            article[x.holder] += x.size
    text = own[:]
    for k in reversed(range(n)):
        parent = suspects[k][0]
        if parent >= 0:
            text[parent] += text[k]
            article[parent] += article[k]
            headed[parent] |= headed[k]
    bad = [True] * n
    for k in sorted(range(n), key=lambda k: (-text[k], k)):  # a parent comes before its children
        parent, kind = suspects[k]
        holds = article[k] and 2 * article[k] >= clear or headed[k]
        most = not marked and (text[k] > 4 * clear if kind == ASIDE else 2 * text[k] > total)
        bad[k] = parent >= 0 and bad[parent] or not (holds or most and text[k])
        if not bad[k]:
            clear, marked = clear + own[k], marked or lit[k]
    noise = [x.noise or x.suspect >= 0 and bad[x.suspect] for x in lines]
    return noise if any(x.size and not out for x, out in zip(lines, noise)) else [x.noise for x in lines]


def lines_of(page: str, elements: Elements) -> Iterator[Line]:
    text: list[str] = []
    linked = at = 0
    muted = -1  # place of the outermost skipped element; place in the page
    last: dict[str, int] = {}  # where the last end tag of a skipped element stands

    def line():
        said = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if said:
            elements.lines += 1
            return Line(said, min(len(said), linked), bool(elements.noise), elements.articles > 0, elements.last("h1") >= 0, elements.open[-1] if elements.open else -1, elements.holders[-1] if elements.holders else -1, elements.outermost if elements.articles else -1, elements.containers[-1][1] if elements.containers else -1)

    while at < len(page):
        token = _TOKEN.match(page, at)[0]
        at += len(token)
        if token[0] != "<" or token == "<":
            if muted < 0:
                text.append(token)
                linked += len(token) if elements.places["a"] else 0
            continue
        m = _NAME.match(token)
        if not m:
            continue
        name, closing = m[1].lower(), token[1] == "/"
        drawing = elements.last("svg") >= 0
        if name in RAW and not closing:
            if name == "title" and muted < 0 and not drawing:
                if found := line():
                    yield found
                linked = 0
            if token.endswith("/>"):
                continue
            end = RAW[name].search(page, at) if last.get(name, at) >= at else None
            if end or name != "noscript":  # what is never closed ends with the page
                at = end.end() if end else len(page)
                continue
            last[name] = -1
        if muted >= 0:
            if closing:
                k = elements.last(name)
                if k >= muted:
                    elements.drop(k)
                    muted = -1 if k == muted else muted
                    continue
                if k < 0:
                    continue
                muted = -1  # its parent ends
            elif name in ("article", "main") or name in BLOCKS and last[elements.stack[muted][0]] < at:  # it was left open
                elements.drop(muted)
                muted = -1
            else:
                if name not in VOID and not _closed(token):
                    elements.push(name)
                continue
        if (name in SKIPPED or drawing and name in SKIPPED_IN_DRAWINGS) and not closing:
            if not _closed(token):
                if name not in last:
                    last[name] = max((m.start() for m in re.finditer("</" + name, page, re.I)), default=-1)
                muted = len(elements.stack)
                elements.push(name)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            if found := line():
                yield found
            linked = 0
        if closing:
            elements.end(name)
            continue
        if name in VOID or _closed(token):
            continue
        if name in ("article", "main") and elements.noise:
            if not any(elements.stack[k][0] in ("aside", "dialog") for k in elements.noise):
                elements.drop(elements.noise[0])  # an article doesn't stand in a menu: that was left open
        if name in BLOCKS:
            elements.begin_block(name)
        elements.push(name, _kind(name, token, elements.articles > 0) if name in BLOCKS else 0, name in ("article", "main") or 'role="main"' in token)
    if found := line():
        yield found


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    elements = Elements()
    lines = list(lines_of(page, elements))
    noise = judged(lines, elements.suspects)
    sizes = [0 if out else x.size + (x.linked // LINK_SHARE if x.inside else 0) for x, out in zip(lines, noise)]
    stretches, lo = [], 0
    while lo < len(lines):
        hi = lo  # an article's edge ends a stretch
        while hi < len(lines) and lines[hi].inside == lines[lo].inside:
            hi += 1
        block, at = [sum(sizes[i : min(i + max(1, window), hi)]) for i in range(lo, hi)], lo
        while at < hi:
            if not sizes[at]:
                at += 1
                continue
            end = at
            while end < hi and block[end - lo]:  # up to the dive
                end += 1
            stretches.append((max(block[at - lo : end - lo]), at, end))
            at = end
        lo = hi
    told = [(i, x) for i, (x, out) in enumerate(zip(lines, noise)) if not out]
    weight = HEADED_WEIGHT if any(x.inside and x.head for _, x in told) else ARTICLE_WEIGHT
    most = {True: 0, False: 0}
    for _, a, b in stretches:
        inside = lines[a].inside
        most[inside] = max(most[inside], (weight if inside else 1) * sum(lines[i].size for i in range(a, b) if not noise[i]))
    side = most[True] > 0 and most[True] >= most[False]
    stretches = [s for s in stretches if lines[s[1]].inside == side]
    kept = [s for s in stretches if s[0] >= surge] or ([max(stretches, key=lambda s: (s[0], -s[1]))] if stretches else [])
    if side:  # an article is taken whole
        articles = {lines[a].article for _, a, _ in kept}
        return "\n".join(x.text for x, out in zip(lines, noise) if not out and x.article in articles)
    taken = set(kept)
    for order in (stretches, stretches[::-1]):  # what only noise within the text parts from it, goes on
        for one, other in zip(order, order[1:]):
            a, b = sorted((one, other), key=lambda s: s[1])
            if one in taken and parted_by_noise(lines, noise, elements.spans, a[2], b[1]):
                taken.add(other)
    return "\n".join(lines[i].text for s in stretches if s in taken for i in range(s[1], s[2]) if not noise[i])


def parted_by_noise(lines: list[Line], noise: list[bool], spans: list[list], end: int, start: int) -> bool:
    """Whether all lines between two stretches are noise, back from `end` to the last text and on to `start`, and both lie
    in the block around one of them; in the page's body elements that always are noise part them."""
    while end > 0 and noise[end - 1]:
        end -= 1
    if end == 0 or not all(noise[end:start]):
        return False
    body = ("", 0, 1 << 62)
    before, after = (spans[x.container] if x.container >= 0 else body for x in (lines[end - 1], lines[start]))
    around = after if after[1] < end else before if before[2] > start else None
    return around is not None and (around[0] not in ("", "html", "body") or not any(x.noise for x in lines[end:start]))


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", window, surge) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(lean(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
