"""Main-text extraction by scoring the tree of a page.

Every paragraph earns points for its length and its commas and passes them to
its ancestors, less with each level.  A container's points are discounted by
the share of its text that is inside links.  The best container is kept with
those siblings that score well enough; menus, notices, comments and the like
inside it are left out.  An element that only its name calls so stays if it
holds what seems to be the main text, and the score decides.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are never main text.
DROPPED = frozenset("script style noscript template head title nav footer aside button select textarea input option menu search iframe object svg canvas audio video map annotation annotation-xml".split())
#: Elements that are main text only where they wrap it.
WRAPS = frozenset("form dialog".split())
#: Words of a class, id or role that mark what is not main text.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer "
    "dialog footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promotion "
    "promoted recommended related replies reply responses search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola toc toolbar "
    "contentinfo complementary alert".split()
)
#: Those of them that name what readers wrote, which may be longer than the main text.
THREAD = frozenset("comment comments commentlist disqus replies reply responses".split())
#: Shares of the page's points from which a named element is judged by its score: with a name or an element that speaks for it, by
#: its size alone, and so for readers' texts.  By size alone, at most this share of its text is in links.
LEAST, MOST, ALMOST_ALL, LINKS = 0.2, 0.5, 0.9, 0.33
#: Words that speak for main text.
MAIN = frozenset("article body content entry main page post story text".split())
#: Which open element a new one ends, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
SCOPE = frozenset("table td th caption html body button object template article section div main".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd section div article main body".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page(HTMLParser):
    """The elements of a page in document order, and its texts and block ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marks, self.events = ["#root"], [0], [(False, 0, None)], []
        self.open = [0]
        self.depths: dict[str, list[int]] = {}  # of the open elements of each name
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end(("p",), SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "br":
            self.events.append((self.open[-1], " "))
            return
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.marks.append(self._mark(tag, attrs))
        if tag in BLOCKS:
            self.events.append((len(self.tags) - 1, None))
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do, "/>" ends void elements only

    def handle_endtag(self, tag):
        if tag == "br":
            self.events.append((self.open[-1], " "))
        if self.depths.get(tag):
            self._close(self.depths[tag][-1])

    def handle_data(self, data):
        self.events.append((self.open[-1], data))

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.events.append((self.open[-1], data[6:]))

    def _end(self, tags, stop):
        last = lambda names: max((self.depths[x][-1] for x in names if self.depths.get(x)), default=0)
        depth = last(tags)
        if depth and depth >= last(stop):
            self._close(depth)

    def _close(self, depth):
        if any(self.tags[i] in BLOCKS for i in self.open[depth:]):
            self.events.append((self.open[depth], None))
        for i in self.open[depth:]:
            self.depths[self.tags[i]].pop()
        del self.open[depth:]

    def _mark(self, tag, attrs):
        """(left out, weight, share) of an element by its name and attributes; with a share, it is left out unless it holds that much."""
        found, weight, out, share = dict(attrs), 0, tag in DROPPED, MOST if tag in WRAPS else None
        words, main = set(), False
        for name in ("class", "id", "role"):
            for part in (found.get(name) or "").split():
                own = {w.lower() for w in _WORDS.findall(part)}
                words |= own
                main = main or bool(own & MAIN and not own & ASIDE)
        if words & ASIDE and tag not in ("html", "body", "article", "main", "h1", "p"):
            share = ALMOST_ALL if words & THREAD else MOST
        elif words & ASIDE and tag in ("article", "p") and words & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "notice", "cookie", "hidden", "related"}:
            share = ALMOST_ALL if words & THREAD else MOST
        if share and main:
            share = LEAST
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style") or ""):
            out = True
        if words & MAIN:
            weight += 25
        return out, weight + {"article": 30, "main": 25, "section": 5, "div": 5}.get(tag, 0), share


class Tally:
    """Sizes of the elements that are not left out, and the points of those that are paragraphs."""

    def __init__(self, page: Page, out: list[bool], in_link: list[bool]):
        tags, parents, n = page.tags, page.parents, len(page.tags)
        self.length, self.linked, commas, direct = [0] * n, [0] * n, [0] * n, [0] * n
        length, linked = self.length, self.linked
        for i, text in page.events:
            if text and not out[i]:
                size = len("".join(text.split()))
                length[i] += size
                direct[i] += size
                commas[i] += sum(map(text.count, (",", "，", "、")))
                if in_link[i]:
                    linked[i] += size
        inline = [0] * n  # text of a block that no block within it holds
        inline_commas = [0] * n
        for i in range(n - 1, 0, -1):
            up = parents[i]
            length[up] += length[i]
            linked[up] += linked[i]
            inline[i] += direct[i]
            inline_commas[i] += commas[i]
            if tags[i] not in BLOCKS:
                inline[up] += inline[i]
                inline_commas[up] += inline_commas[i]
        inline[0] += direct[0]
        self.points = [0.0] * n
        for i in range(n):
            if out[i] or not inline[i] or (tags[i] not in PARAGRAPHS and i):
                continue
            self.points[i] = ((1 if inline[i] >= 25 else 0.2) + inline_commas[i] + min(inline[i] / 100, 3)) * (1 - self.density(i))

    def density(self, i: int) -> float:
        return self.linked[i] / self.length[i] if self.length[i] else 0.0


def left_out(page: Page, in_link: list[bool]) -> tuple[list[bool], Tally]:
    """Which elements are no main text, and the tally of the others.

    What is never shown, or never main text, goes first.  An element that only
    its name speaks against goes too, unless it holds a large share of the
    points that are left; if that leaves none at all, names are not heeded.
    """
    tags, parents, n = page.tags, page.parents, len(page.tags)
    never, in_article = [False] * n, [False] * n
    for i in range(1, n):
        up = parents[i]
        in_article[i] = in_article[up] or tags[i] in ("article", "main")
        # A header is the site's, unless it is the article's own.
        never[i] = never[up] or page.marks[i][0] or (tags[i] == "header" and not in_article[up])
    tally = Tally(page, never, in_link)
    if not any(page.marks[i][2] and not never[i] for i in range(n)):
        return never, tally
    held, holds, main = list(tally.points), [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        up = parents[i]
        held[up] += held[i]
        if not never[i]:
            holds[up] = holds[up] or holds[i] or (tags[i] == "article" and not page.marks[i][2])
            main[up] = main[up] or main[i] or tags[i] == "main"
    out = list(never)
    for i in range(1, n):
        share = page.marks[i][2]
        if out[parents[i]]:
            out[i] = True
        elif share and not out[i] and not main[i]:
            share = LEAST if holds[i] else share
            out[i] = held[i] < share * held[0] or not held[i] or (share > LEAST and tally.density(i) > LINKS)
    named = Tally(page, out, in_link)
    return (out, named) if any(named.points) or not held[0] else (never, tally)


def main_text(html: str) -> str:
    """The main text of a page: its blocks in order, one space between them."""
    page = Page(html)
    tags, parents, n = page.tags, page.parents, len(page.tags)
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
    out, tally = left_out(page, in_link)
    length = tally.length
    score, far = [0.0] * n, [0.0] * n
    for i, points in enumerate(tally.points):
        if not points:
            continue
        at = parents[i] if tags[i] in ("p", "pre", "blockquote", "li", "td", "dd") else i
        far[at] += points / 15
        for share in (1, 2, 6, 9, 12):
            score[at] += points * (1 / share - 1 / 15)
            if not at:
                break
            at = parents[at]
    for i in range(n - 1, 0, -1):  # however deep, each element passes its points on once
        far[parents[i]] += far[i]
    score = [near + deep for near, deep in zip(score, far, strict=True)]
    best, most = 0, 0.0
    for i in range(n):
        if out[i] or not score[i]:
            continue
        score[i] = (score[i] + page.marks[i][1]) * (1 - tally.density(i))
        if score[i] > most:
            best, most = i, score[i]
    at = best
    while at:  # the whole article, if the best container is a part of one
        if tags[at] == "article":
            best = at
        at = parents[at]
    # Siblings of the best container; if neither an article nor a main element bounds the text, those of its ancestors too.
    bounded = any(tags[i] in ("article", "main") and length[i] and not out[i] for i in range(n))
    path = {best}
    while not bounded and parents[at := min(path)]:
        path.add(parents[at])
    above = {parents[i] for i in path}
    inner = list(score)  # the best container within each element: an ancestor's sibling counts for what it wraps
    for i in range(n - 1, 0, -1):
        if not out[i]:
            inner[parents[i]] = max(inner[parents[i]], inner[i])
    kept = {best}
    for i in range(1, n):
        if parents[i] in above and i not in path and not out[i] and length[i]:
            density = tally.density(i)
            worth = score[i] if parents[i] == parents[best] else inner[i] * (1 - density)
            if worth >= max(10.0, 0.2 * most) or (tags[i] in ("p", "h1") and best and density < 0.25 and (length[i] > 80 or tags[i] == "h1")):
                kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (i > 0 and inside[parents[i]])
    blocks, block = [], []
    for i, text in page.events:
        if text is None:
            if block:
                blocks.append("".join(block))
                block = []
        elif inside[i] and not out[i]:
            block.append(text)
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])


def extract_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` of every row of ``pages`` and ``text``, the page's main text.

    White space within a block is one space, blocks are joined by one space.
    Without an article or main element, sections under different parents are
    kept alike.  A page of any length or depth takes time in proportion to its
    size.  Null and empty pages, and pages without text, give the empty text.  Markup
    that is cut off is read to its end; an end tag closes the last open element
    of its name with all in it, and means nothing without one.  Repeated rows all
    come back; an empty table gives an empty result.  A column
    ``text`` of ``keep`` gives way to the new one; columns not in ``keep`` are
    not read.
    """
    rows = pages.select(F.col(html).alias("_html"), *[F.col(f"`{c}`") for c in keep if c != "text"])
    return rows.mapInArrow(_extract, T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType())]))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, ["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
