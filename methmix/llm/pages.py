"""HTML extraction by tag-path ratios.

A page becomes blocks of text in page order, each with its path of block elements from the root. For each path the
text length and the punctuation are summed and divided by its number of blocks; links count against it. Both ratios
are smoothed over neighbouring paths, multiplied, and compared with a threshold from their spread. Blocks
of navigation, adverts, forms, comments and the like are known by element, role or class and take no part. Class words
and forms only mark an element: the mark does not hold if the element has the page's main, its article or most of its
text outside links (`Blocks.judged`). The content is the innermost element that holds most of the text of the paths
over the threshold; all its blocks that are no boilerplate are the article, short ones and headings too. So are the
blocks outside it whose path is over the threshold, with the headings beside them.

A null or empty page gives an empty text; so does one without text outside boilerplate. Broken markup (open
elements, stray ends, cut entities) is read as far as it goes. Pages of any length are read whole. Repeated rows are
read each. An empty table gives an empty result. Input columns are kept, but for those with the name of a
column made here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from methmix.llm.common import table, without
from methmix.llm.registry import query
from methmix.llm.words import slices

MADE = ("content", "n_chars")

# Elements of HTML by what they do to text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object audio video canvas".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BOILERPLATE = frozenset("nav footer aside button select textarea menu dialog".split())
# Elements that end an open one of the same kind, and the elements that hold them.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
# Words of class names and ids of boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices popup modal overlay sidebar sidenav rail widget widgets nav navbar navigation menu menus breadcrumb"
    " breadcrumbs pagination pager footer masthead comment comments discussion disqus reply replies respond share sharing"
    " social related recommended newsletter subscribe subscription signup login search toolbar skip".split())
# Words among them of lists of entries by others, which are articles of their own.
ENTRIES = frozenset(
    "comment comments discussion disqus reply replies respond related recommended sidebar rail widget widgets promo"
    " sponsored ad ads".split())
# First words of class names that tell of a page's state, not of the element.
STATES = frozenset("has with without no not is hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HINT_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
SPACE = re.compile(r"\s+")
# A container must hold this share of the text over the threshold.
SHARE = 0.85
# An element marked by class words is content if it holds more than this share of the page's text outside links.
MOST = 0.5
# The threshold lies this many deviations above the mean of fused ratios, and never above a share of the best.
DEVIATIONS = 0.25
BEST_SHARE = 0.3
# Elements below so many open ones are not told apart, but for those whose text is left out; no text is lost by it.
DEEPEST = 400


class Blocks(HTMLParser):
    """Blocks of a page: (path, text, characters of links); paths are tuples of element numbers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names: list[str] = []           # tag of each element by number
        self.boiler: list[bool] = []         # whether it, or an element around it, is boilerplate by element or role
        self.marks: list[frozenset[str] | None] = []  # what its class words or a form say, None if nothing
        self.parents: list[int | None] = []
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, int] = {}
        self.untracked: dict[str, int] = {}  # open elements below DEEPEST by tag
        self.found: list[tuple[tuple[int, ...], str, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.path: tuple[int, ...] = ()

    def finish(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.found.append((self.path, text, self.linked))
        self.text, self.linked = [], 0
        self.path = tuple(n for tag, n in self.stack if n >= 0)

    def _pop_to(self, place: int) -> None:
        if any(n >= 0 for _, n in self.stack[place:]):
            self.finish()
        for tag, _ in self.stack[place:]:
            self.open[tag] -= 1
        del self.stack[place:]
        if len(self.stack) < DEEPEST:
            self.untracked.clear()
        self.path = tuple(n for _, n in self.stack if n >= 0)

    def _place(self, tag: str, within: tuple[str, ...] = ()) -> int:
        """Place of the innermost open `tag`, or -1; elements of `within` hide those outside."""
        if not self.open.get(tag):
            return -1
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place][0] == tag:
                return place
            if self.stack[place][0] in within:
                return -1
        return -1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in CLOSES_P and (place := self._place("p", ("button", "table", "td", "th"))) >= 0:
            self._pop_to(place)
        if tag in SIBLINGS:
            for other in {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)):
                if (place := self._place(other, SIBLINGS[tag])) >= 0:
                    self._pop_to(place)
        if tag in VOID:
            if tag not in INLINE and tag != "img":
                self.finish()
            return
        values = dict(attrs)
        boiler = self._boiler(tag, values)
        if len(self.stack) >= DEEPEST and not boiler:
            self.untracked[tag] = self.untracked.get(tag, 0) + 1
            if tag not in INLINE:
                self.finish()
            return
        self.open[tag] = self.open.get(tag, 0) + 1
        mark = None if boiler else self._mark(tag, values)
        if tag in INLINE and not boiler and mark is None:
            self.stack.append((tag, -1))
            return
        self.finish()
        self.names.append(tag)
        parent = self.path[-1] if self.path else None
        self.boiler.append(boiler or (parent is not None and self.boiler[parent]))
        self.marks.append(mark)
        self.parents.append(parent)
        self.stack.append((tag, len(self.names) - 1))
        self.path += (len(self.names) - 1,)

    def _boiler(self, tag: str, values: dict) -> bool:
        if tag in BOILERPLATE or tag in UNSEEN or "hidden" in values or (values.get("role") or "").lower() in ROLES:
            return True
        if tag == "header":
            return not (self.open.get("article") or self.open.get("main"))
        return False

    def _mark(self, tag: str, values: dict) -> frozenset[str] | None:
        if tag in ("html", "body", "article", "main"):
            return None
        names = f"{values.get('class') or ''} {values.get('id') or ''}".split()
        words = [[w.lower() for w in _HINT_WORDS.findall(name)] for name in names]
        found = {w for name in words if name and name[0] not in STATES for w in name if w in HINTS}
        if tag in ("form", "fieldset") or (values.get("role") or "").lower() == "form":
            found.add("form")
        return frozenset(found) or None

    def judged(self) -> list[bool]:
        """Whether each element is boilerplate, marks weighed against the text they would take away."""
        weight = [0] * len(self.names)
        total = 0
        for path, text, linked in self.found:
            if not (path and self.boiler[path[-1]]):
                outside_links = max(len(text) - 2 * linked, 0)
                total += outside_links
                for n in path:
                    weight[n] += outside_links
        # The heaviest article inside each element, and whether it holds a main; inner elements have larger numbers.
        article, main = [0] * len(self.names), [False] * len(self.names)
        for n in range(len(self.names) - 1, -1, -1):
            if self.names[n] in ("article", "main"):
                article[n] = max(article[n], weight[n])
                main[n] = main[n] or (self.names[n] == "main" and weight[n] > 0)
            if (parent := self.parents[n]) is not None:
                article[parent] = max(article[parent], article[n])
                main[parent] = main[parent] or main[n]
        holds = [mark is not None and not main[n] and (bool(mark & ENTRIES) or weight[n] <= MOST * total)
                 for n, mark in enumerate(self.marks)]

        def free_article() -> int:
            gone = self._inherited(holds)
            return max((w for w, name, out in zip(weight, self.names, gone) if name in ("article", "main") and not out), default=0)
        free = free_article()
        for n, mark in enumerate(self.marks):
            if holds[n] and article[n] and article[n] >= free and not mark & ENTRIES:
                holds[n] = False
        if not free_article():
            holds = [h and not (self.marks[n] & ENTRIES and weight[n] > MOST * total) for n, h in enumerate(holds)]
        return self._inherited(holds)

    def _inherited(self, holds: list[bool]) -> list[bool]:
        gone: list[bool] = []
        for n, parent in enumerate(self.parents):
            gone.append(self.boiler[n] or holds[n] or (parent is not None and gone[parent]))
        return gone

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.untracked.get(tag) and not (self.stack and self.stack[-1][0] == tag):
            # It ends one of the untracked elements, not one further out.
            self.untracked[tag] -= 1
            if tag not in INLINE:
                self.finish()
            return
        if tag in ("br", "p") and not self.open.get(tag):
            self.text.append(" ") if tag == "br" else self.finish()
            return
        if (place := self._place(tag)) >= 0:
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in UNSEEN:
            return
        self.text.append(data)
        if self.open.get("a"):
            self.linked += len(data)


def _smoothed(values: np.ndarray) -> np.ndarray:
    padded = np.r_[values[:1], values, values[-1:]]
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def over_threshold(blocks: list[tuple[str, str, int]]) -> set[str]:
    """Tag paths whose fused, smoothed ratios pass the threshold."""
    sums: dict[str, list[float]] = {}
    for path, text, linked in blocks:
        entry = sums.setdefault(path, [0, 0.0, 0.0])
        entry[0] += 1
        entry[1] += max(len(text) - 2 * linked, 0)
        entry[2] += len(PUNCTUATION.findall(text))
    ratios = np.array([[length / count, marks / count] for count, length, marks in sums.values()])
    # A path without punctuation still counts a little, so headings-only pages have content.
    fused = _smoothed(ratios[:, 0]) * (0.1 + _smoothed(ratios[:, 1]))
    limit = min(fused.mean() + DEVIATIONS * fused.std(), BEST_SHARE * fused.max())
    return {path for path, value in zip(sums, fused) if value >= limit}


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.finish()
    boiler = page.judged()
    blocks = [(path, text, linked) for path, text, linked in page.found if not (path and boiler[path[-1]])]
    if not blocks:
        return ""
    named = ["/".join(page.names[n] for n in path) for path, _, _ in blocks]
    chosen = over_threshold([(name, text, linked) for name, (_, text, linked) in zip(named, blocks)])
    weight: dict[int, int] = {}
    total = 0
    for name, (path, text, _) in zip(named, blocks):
        if name in chosen:
            total += len(text)
            # The element of the block itself is no container of others.
            for n in path[:-1] or path:
                weight[n] = weight.get(n, 0) + len(text)
    # Elements are numbered from the outside in: the last heavy one is the innermost.
    heavy = [n for n, w in weight.items() if w >= SHARE * total]
    articles = [n for n in heavy if page.names[n] in ("article", "main")]
    container = max(articles or heavy, default=None)
    if container is None:
        return " ".join(text for _, text, _ in blocks)
    outside = {path[:-1] for name, (path, _, _) in zip(named, blocks) if name in chosen and container not in path}
    return " ".join(text for name, (path, text, _) in zip(named, blocks) if container in path or name in chosen
                    or (path and page.names[path[-1]] in HEADINGS and path[:-1] in outside))


def extract_content(pages: DataFrame, html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """`pages` with content, the main text, and n_chars, its length in code points."""
    pages = without(pages, MADE)
    keep = [f for f in pages.schema.fields if keep_html or f.name != html_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [extract(html) for html in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*(f.name for f in keep), *MADE])
    added = [T.StructField("content", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.mapInArrow(task, T.StructType(keep + added))


@query("op7_html_extract")
def op7_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_content(pages, keep_html=False).withColumnRenamed("content", "text").select("page_id", "url", "text", "n_chars")
