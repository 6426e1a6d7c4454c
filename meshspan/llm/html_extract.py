"""Main-text extraction by the distribution of text over line blocks.

Markup is stripped into *lines*, one for each block-level element's text; blocks
that never hold an article (menus, footers, forms, comment lists ...) are no lines.
A line counts its characters outside links.  Sums over sliding windows of lines
rise steeply where an article starts and fall to nothing where it ends: from each
surge point to the next dive point runs a candidate, on marked pages too.  A mark
(article, main) cuts a candidate that runs past it, and rules out text beside it if
the candidate with most characters is marked; without marks, candidates far lighter
than the heaviest go.  Lines that run on from a candidate in its container join it.

Parsing and sums take time linear in the page, however long; equal candidates go to
the first on the page.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import distinct_names

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)",
    re.S,
)
#: fixed values: elements of HTML by what they do to text
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noframes", "noembed", "object", "svg", "math"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
AWAY = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
HOME = {"article", "main"}
#: blocks that hold others; the rest belong to the container around them
BOX = {"article", "body", "details", "div", "main", "section", "td"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: fixed values: what the names of classes and ids call blocks that are no article; as patterns, since they come in variants
NAMES = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|footer|header|masthead|sidebar|related|share|sharing|social|comments?|commentlist|disqus|respond|reply|replies|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|login|signup|widgets?|toolbar|pagination|pager|tags|copyright|legal|disclaimer|skip", re.I)
#: fixed values: words that say where or how such a block stands; with another word a name may be an article's own ("legal-news")
FILLERS = set("area bar block body bottom box btn button buttons center col column container content cloud field fields float foot form global group head inner item items label left line link links list lower main menu mobile nav outer page panel policy post posts primary right row secondary section side site slot space sticky text title top unit upper wrap wrapper zone".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")
#: closing tags implied by an opening one: a paragraph ends where a block starts
IN_PARAGRAPH = "p"


class Line:
    """A block's text, its characters inside links, whether a container rules it out, its article's and container's numbers, and whether it is a heading or a list item."""

    __slots__ = ("text", "linked", "away", "home", "heading", "item", "box")

    def __init__(self, text, linked, away, home, heading, item, box):
        self.text, self.linked, self.away, self.home, self.heading, self.item, self.box = text, linked, away, home, heading, item, box

    @property
    def weight(self) -> int:
        return 0 if self.away else max(0, len(self.text) - self.linked)


def _names_other(name: str) -> bool:
    """Whether a class or id names a block that is no article: one of NAMES, with nothing beside it but FILLERS and numbers."""
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
    named = [bool(NAMES.fullmatch(p)) for p in parts]
    return any(named) and all(n or p.lower() in FILLERS or p.isdigit() for n, p in zip(named, parts))


def _ruled_out(tag: str, attrs: str, in_home: bool) -> bool:
    if tag in AWAY:
        return not (in_home and tag == "header")
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and any(map(_names_other, value.split())):
            return True
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I))


class _Open:
    """The open elements.  Every element is entered once and left once, and no question looks further than the top, so parsing takes linear time."""

    def __init__(self):
        #: tag, ruled out here or above, an article here, the container's number
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.homes: list[int] = [0]
        self.links = self.headings = self.items = 0

    def enter(self, tag: str, away: bool, home: int, box: int) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        if home:
            self.homes.append(home)
        self.count(tag, 1)
        self.stack.append((tag, away, bool(home), box))

    def leave(self, depth: int) -> None:
        """Closes all elements from ``depth`` on."""
        while len(self.stack) > depth:
            tag, _, home, _ = self.stack.pop()
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if home:
                self.homes.pop()
            self.count(tag, -1)

    def count(self, tag: str, by: int) -> None:
        self.links += by * (tag == "a")
        self.items += by * (tag == "li")
        self.headings += by * (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())


def lines(page: str) -> tuple[list[Line], dict[int, int]]:
    """The page's blocks in order, and for the container of each article inside another the container around it."""
    out: list[Line] = []
    buffer: list[str] = []
    linked = homes = boxes = 0
    around: dict[int, int] = {}
    o = _Open()
    #: what the text gathered so far stands in: ruled out, container, a heading, a list item
    place = (False, 0, False, False)

    def flush():
        nonlocal linked
        text = SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
        if text:
            out.append(Line(text, linked, place[0], o.homes[-1], place[2], place[3], place[1]))
        buffer.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = page[at:lt]
            buffer.append(piece)
            if o.links:
                linked += len(piece)
        if lt == size:
            break
        m = TOKEN.match(page, lt)
        if not m:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if o.where.get(tag):
                o.leave(o.where[tag][-1])
        elif tag not in VOID:  # as browsers do, a slash closes nothing else
            if tag in BLOCK and o.blocks and o.stack[o.blocks[-1]][0] == IN_PARAGRAPH:
                o.leave(o.blocks[-1])  # an open paragraph, and inline elements left open in it, end here
            if tag == "li" and o.stack and o.stack[-1][0] == "li":
                o.leave(len(o.stack) - 1)
            top = o.stack[-1] if o.stack else ("", False, False, 0)
            home = tag in HOME and not top[1]
            gone = top[1] or _ruled_out(tag, attrs, len(o.homes) > 1)
            box = top[3]
            if home or tag in BOX and len(o.homes) == 1:  # an article is one container, whatever it holds
                boxes += 1
                if home and len(o.homes) > 1:
                    around[boxes] = box
                box = boxes
            homes += home
            o.enter(tag, gone, homes if home else 0, box)
        top = o.stack[-1] if o.stack else ("", False, False, 0)
        place = (top[1], top[3], o.headings > 0, o.items > 0)
    flush()
    return out, around


def spans(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(from, to) of lines between surge points and dive points of the windowed sums."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)] + [0]
    out, i = [], 0
    while i < n:
        if sums[i] > surge and weights[i]:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def extract(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The main text of a page: its blocks joined by line feeds; "" if there is none.

    Ruled-out blocks are no lines.  The text is what stands between surge and dive
    points; the lines that run on from a span, before its surge and after its dive
    (titles, paragraphs that are links, short last words), join it while they stand
    in its container and are no linked list.  A page on which nothing surges has
    its heaviest span as text.
    """
    if not page:
        return ""
    ls = [x for x in lines(page)[0] if not x.away]
    weights = [x.weight for x in ls]
    found = _pieces(ls, spans(weights, window, surge))
    mass = lambda p: sum(weights[p[0] : p[1]])
    if not found:
        found = sorted(_pieces(ls, spans(weights, window, 0)), key=lambda p: (-mass(p), p[0]))[:1]
    if not found:
        return ""
    best = max(found, key=lambda p: (mass(p), -p[0]))
    # Where the heaviest span is marked as an article, marks rule out the text beside them;
    # where it is not, text far lighter than it is not the article.
    marked = bool(ls[best[0]].home)
    kept = [p for p in found if (ls[p[0]].home if marked else mass(p) * 4 >= mass(best))]
    take: set[int] = set()
    for a, b in kept:
        take.update(range(a, b))
        for i, step in ((a - 1, -1), (b, 1)):
            box = ls[a if step < 0 else b - 1].box
            while 0 <= i < len(ls) and i not in take and _joins(ls[i], box):
                take.add(i)
                i += step
    return "\n".join(ls[i].text for i in sorted(take))


def _joins(line: Line, box: int) -> bool:
    """Whether a line beside a span belongs to it: of its container, and no linked list item."""
    return line.box == box and not (line.item and not line.weight)


def _pieces(ls: list[Line], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans cut where marked articles begin and end, without the weightless lines at their ends."""
    out = []
    for a, b in found:
        for i in range(a, b):
            if ls[i].weight:
                if out and out[-1][0] >= a and ls[out[-1][0]].home == ls[i].home and all(x.home == ls[i].home for x in ls[out[-1][1] : i]):
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i, i + 1))
    return out


def html_extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", window: int = 3, surge: int = 80) -> DataFrame:
    """The main text of every page.

    Returns a row per input row: ``id_col``, ``url_col`` if given, text, n_chars
    (code points).  Null and empty pages, and pages of menus only, give "".
    Repeated rows agree; an empty table gives an empty result; other columns are
    ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    keep = [id_col] + ([url_col] if url_col else [])
    inner = [f"k{i}" for i in range(len(keep))]
    src = pages.select(*[F.col(c).alias(k) for c, k in zip(keep, inner)], F.col(html_col).cast("string").alias("html"))
    types = [pages.schema[c].dataType for c in keep]
    schema = pa.schema([(k, to_arrow_type(t)) for k, t in zip(inner, types)] + [("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [extract(h, window, surge) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(i).cast(schema[i].type) for i in range(len(inner))] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    out = src.mapInArrow(run, ", ".join(f"{k} {t.simpleString()}" for k, t in zip(inner, types)) + ", text string, n_chars long")
    names = distinct_names(keep, ["text", "n_chars"])
    return out.select(*[F.col(k).alias(n) for k, n in zip(inner, names)], "text", "n_chars")
