"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block of text, with an empty line for
every further block boundary between two of them.  Elements that never hold
an article (menus, forms, scripts, elements named as adverts or comments) are
left out.  The lengths of the lines, less their link texts, are summed over
sliding windows.  Where the sums surge past a threshold the main text begins,
where they dive to nothing it ends; the span is then widened to the edges of
the element that holds it, so that short first and last lines stay.

A page is one row, so nothing here shuffles; pages are read batch by batch.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import python_ready

#: Lines in a window; characters of text outside links that a window must hold for a surge.
WINDOW, SURGE = 3, 80

# Element and attribute names of HTML, and words by which pages name parts beside the article.
BLOCKS = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
th thead title tr ul""".split())
UNREAD = set("""script style textarea title xmp iframe noembed noframes noscript template svg math object select canvas audio video""".split())
TO_THE_END = {"script", "style", "textarea", "title", "template"}
VOID = {"br", "hr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
PARAGRAPHS = {"p", "li", "pre", "dt", "dd", "summary", "caption", "figcaption"} | HEADINGS
BESIDE = {"nav", "footer", "aside", "header", "form", "dialog", "menu", "button", "search"}
BESIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar",
                "status", "toolbar"}
BESIDE_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot billboard sponsor sponsored promo promotion promoted
cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay paywall newsletter subscribe subscription
signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail widget widgets related recommended recommendations
share sharing social footer copyright disclaimer pagination pager search searchbox form""".split())
HEADER_NAMES = {"header", "masthead", "topbar", "banner", "banners"}
COMMENT_NAMES = set("comment comments reply replies respond discussion disqus commentlist guestbook".split())
CLOSED_BY = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "li": {"li"}, "option": {"option"}}

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|/>
    |(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*)(?P<attrs>(?:[^<>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|(?=<)|\Z))""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)
_NAME = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Element:
    """An element of a page: what encloses it, why it may not belong to the article, and what it holds."""

    def __init__(self, name: str, order: int, above: Element | None, beside: str = "", main: bool = False):
        self.name, self.order, self.above, self.beside = name, order, above, beside
        #: last element inside; whether an end tag was read; whether it holds the article's element or a first heading
        self.last, self.closed, self.holds_main, self.holds_title = order, False, False, False
        #: the outermost element around (or this one) that is marked as the article
        self.main: Element | None = (above.main if above else None) or (self if main else None)
        self.heading: bool = name in HEADINGS or (above.heading if above else False)
        #: the nearest element around (or this one) that groups blocks
        self.holder: Element = above.holder if above and name in PARAGRAPHS else self
        self.outside = False


@dataclass
class Line:
    """A block of text: its pieces, how many characters stand in links, its element, and the empty lines before it."""
    element: Element
    gap: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.linked)


def _kind(name: str, attrs: str) -> str:
    """"" for what may be article; else why not: "hidden", "comment", "part" by element or role, "header" or "named" by its names."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)} if attrs.strip(" /") else {}
    style = re.sub(r"\s", "", found.get("style", "")).lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return "hidden"
    names = {w.lower() for w in _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")} if found else set()
    if name not in ("html", "body", "main") and (names & COMMENT_NAMES or found.get("itemprop") == "comment"):
        return "comment"
    if name == "header":
        return "header"
    if name in BESIDE or found.get("role", "").lower() in BESIDE_ROLES:
        return "part"
    if name in ("html", "body", "main", "article") or name in HEADINGS:
        return ""
    return "header" if names & HEADER_NAMES else "named" if names & BESIDE_NAMES else ""


def _is_main(name: str, attrs: str) -> bool:
    return name in ("article", "main") or bool(attrs) and re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b""", attrs) is not None


def blocks(page: str) -> tuple[list[Line], list[Element]]:
    """Blocks of text of a page and all its elements, in page order; texts that no reader sees are left out.

    Elements without an end tag end with the one around them; an end tag
    without a start tag only breaks the line.
    """
    top = Element("", 0, None)
    elements, out, unread_end = [top], [], {}
    open_names: dict[str, int] = {}
    line, gap, link, at, size = None, 0, False, 0, len(page)

    def leave(top: Element) -> Element:
        open_names[top.name] -= 1
        return top.above

    while at < size:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else size]
        if text and top.name != "button" and not (top.beside and top.name in ("span", "ins")):
            if line is None and not text.isspace():
                line, gap = Line(top, gap), 0
                out.append(line)
            if line is not None:
                line.pieces.append(text)
                line.linked += len(text) if link else 0
        if m is None:
            break
        at, name = m.end(), (m["name"] or "").lower()
        if m["end"]:
            link = link and name != "a"
            if open_names.get(name):
                while top.name != name:
                    top = leave(top)
                top.closed = True
                top = leave(top)
        elif name in UNREAD and not m["attrs"].endswith("/"):
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at) if unread_end.get(name, True) else None
            unread_end[name] = close is not None
            at = close.end() if close else size if name in TO_THE_END else at
        elif name == "a":
            link = True
        elif name in BLOCKS and name not in VOID or name in ("button", "span", "ins"):
            kind = _kind(name, m["attrs"])
            if name in BLOCKS or name == "button" or kind == "hidden" or name == "ins" and kind:
                while top.name == "p" and name not in ("button", "span", "ins") or top.name in CLOSED_BY.get(name, ()):
                    top = leave(top)
                main = _is_main(name, m["attrs"]) and kind in ("", "named")
                top = Element(name, len(elements), top, kind, main)
                elements.append(top)
                open_names[name] = open_names.get(name, 0) + 1
            elif open_names.get(name):  # its end tag must not close a hidden one around it
                top = Element(name, len(elements), top)
                elements.append(top)
                open_names[name] += 1
        if name in BLOCKS:
            gap += line is None and bool(out)
            line, link = None, link and name == "br"
    for x in out:
        text = "".join(x.pieces)
        x.text = " ".join((html.unescape(text) if "&" in text else text).split())
    for e in reversed(elements[1:]):
        up = e.above
        up.last = max(up.last, e.last)
        up.holds_main |= e.holds_main or e.main is e and e.beside != "comment"
        up.holds_title |= e.holds_title or e.name == "h1"
    return [x for x in out if x.text], elements


def set_outside(elements: list[Element], names_count: bool = True) -> None:
    """Mark the elements that an element around them, or they themselves, put outside the article."""
    def part(e: Element) -> bool:
        return e.beside in ("comment", "hidden") or e.beside == "part" and not (e.holds_main and (not e.closed or e.name == "form"))

    for e in elements:
        e.outside = e.above is not None and e.above.outside or part(e)
    has_main = any(e.main is e and not e.outside for e in elements)
    for e in elements:
        own = part(e)
        if e.beside == "header" or e.beside == "named" and names_count:
            # not if it holds the article, or its title where no element is marked as the article
            own = not (e.holds_main or e.holds_title and not has_main)
        if e.beside == "part" and e.name == "form":
            own = not (e.holds_main or e.holds_title and not has_main)
        e.outside = e.above is not None and e.above.outside or own


def _title_of_article(x: Line) -> bool:
    """Whether the line is a heading in a header inside the article, which nothing else puts outside."""
    if x.element.main is None or not x.element.heading:
        return False
    e, inside = x.element, True
    while e is not x.element.main:
        inside &= e.beside in ("", "header")
        e = e.above
    return inside and not e.outside


def spans(kept: list[Line]) -> list[tuple[int, int]]:
    """(first, end) of the lines between a surge and a dive of the sums over WINDOW lines, empty lines included."""
    lengths: list[int] = []
    place: list[int] = []
    for x in kept:
        lengths += [0] * min(x.gap, WINDOW)
        place.append(len(lengths))
        lengths.append(x.weight)
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    out: list[tuple[int, int]] = []
    first = None
    for i, p in enumerate(place):
        if first is None and sums[p] >= SURGE:
            first = i
        if first is not None and (i + 1 == len(place) or 0 in sums[p:place[i + 1]]):
            out.append((first, i + 1))
            first = None
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by one space; empty if there is none."""
    every, elements = blocks(page) if page else ([], [])
    kept: list[Line] = []
    for names_count in (True, False):
        set_outside(elements, names_count)
        kept = kept or [x for x in every if not x.element.outside or _title_of_article(x)]
    if not kept:
        return ""
    found = spans(kept)
    if any(x.element.main for x in kept):
        # an element marked as the article bounds it; without a surge in any, the longest one does
        size: dict[int, int] = {}
        for x in kept:
            if x.element.main:
                size[x.element.main.order] = size.get(x.element.main.order, 0) + x.weight
        chosen = {x.element.main.order for a, b in found for x in kept[a:b] if x.element.main} or {max(size, key=size.get)}
        return " ".join(x.text for x in kept if x.element.main and x.element.main.order in chosen)
    if not found:
        longest = max(range(len(kept)), key=lambda i: kept[i].weight)
        found = [(longest, longest + 1)]
    weight = [sum(x.weight for x in kept[a:b]) for a, b in found]
    a, b = found[weight.index(max(weight))]
    # the innermost element that holds half of what stands between surge and dive, from its heaviest holder outwards
    own: dict[int, int] = {}
    for x in kept[a:b]:
        own[x.element.holder.order] = own.get(x.element.holder.order, 0) + x.weight
    holder = elements[max(own, key=own.get)]
    while holder.above is not None and 2 * sum(x.weight for x in kept[a:b] if holder.order <= x.element.order <= holder.last) < max(weight):
        holder = holder.above.holder
    if holder.name not in ("", "html", "body"):
        return " ".join(x.text for x in kept if holder.order <= x.element.order <= holder.last)
    # nothing but the page around the text: all between surges and dives, and the neighbours that stand directly in the page
    chosen = {i for s, e in found for i in range(s, e)}
    for at, step in ((a - 1, -1), (b, 1)):
        while 0 <= at < len(kept) and kept[at].element.holder is holder:
            chosen.add(at)
            at += step
    return " ".join(kept[i].text for i in sorted(chosen))


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of pages (html, ...), with ``text`` and ``n_chars`` (its code points).

    Null, empty and unreadable pages have an empty text.  Every row gives one
    row, repeated rows and equal ids too; more columns are ignored.
    """
    python_ready(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(run, f"{schema}, text string").withColumn(
        "n_chars", F.length("text").cast("long"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
