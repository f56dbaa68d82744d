"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read as a sequence of words and tags. A word scores by where it stands: the elements that
hold it, by tag name and by the words of their class, id and role, have weights between -1 and 1
that are learned from labelled pages; tags score below zero, the less the more often they stand
inside labelled content. One linear scan finds the contiguous run with the greatest sum. Its words
that stand in elements of negative weight (an advert amid the article) are left out.

Labelled pages are those that mark their content themselves with one article or main element. A
bounded sample of them, taken by a hash of the page, is counted; names on the list of usual page
furniture start with counts that speak against them, so a page kind that no labelled page shows is
still read sensibly. What stands in furniture says nothing about the elements inside it, and names
don't speak against an element that holds what is the page's content by its marks or size.

Defined cases: null or empty html, and a page without a word of positive score, give the empty text;
markup may be malformed or cut off (an open script, comment or tag runs to the end, an open drawing,
object or list of choices hides nothing; a head without end ends where its content can't stand in
one); of runs with equal sums the first counts; a character reference that is no reference stays as
it is; repeated rows are extracted each for itself; an empty table gives no rows; other columns are
ignored. A header inside the article is a header, its heading too. With fewer than SEEN_ON labelled
pages nothing is learned and the list of furniture alone speaks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import text_of

#: Labelled pages that training sees at most, and pages on which a name must be seen to count.
SAMPLE, SEEN_ON = 2000, 5
#: Cost of a word of furniture, in words of content.
FURNITURE_COST = 0.2

# Names of usual page furniture (tags, and words of class, id and role).
FURNITURE_TAGS = (
    "nav header footer aside form button select option textarea label fieldset menu dialog "
    "figcaption iframe object svg canvas audio video"
).split()
FURNITURE_WORDS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "comment comments disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay dialog "
    "sidebar side aside complementary widget widgets related recommended recommendations trending "
    "popular teaser share sharing social follow newsletter subscribe subscription signup login "
    "register nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toolbar "
    "tabs search footer header masthead contentinfo copyright legal disclaimer form skip hidden"
).split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small "
    "span strike strong sub sup time tt u var wbr"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
WHOLE_PAGE = ("html", "body", "main")
ABOUT_OTHERS = {"has", "with", "no", "without", "non"}
#: Elements that only the next of their kind, or the end of what holds them, closes.
LOOSE = "p li dt dd tr td th option b i em strong span a font u small".split()
#: Tags of lists and tables, which are as usual in content as words.
LISTING = "ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr td th".split()
#: Elements whose content is skipped: to the end of the page where they aren't closed, or not at all.
RAW, SKIPPED = (
    "script style noscript textarea iframe title".split(),
    "template svg math object select".split(),
)
#: Tags that may stand in a head.
IN_HEAD = "base basefont bgsound link meta".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW + SKIPPED)})(?=[\s/>]|\Z)"
    r"(?P<how>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_RAW_TAGS = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW + SKIPPED}
# a slash at the end of an unquoted value closes nothing
_SELF_CLOSING = re.compile(r"(?:\A|[\s\"'])/\Z")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_FURNITURE = {*FURNITURE_TAGS, *(f".{w}" for w in FURNITURE_WORDS)}


def _names(tag: str, rest: str) -> list[str]:
    """An element's tag name and the words of its class, id and role, marked with a dot.

    What hangs on the whole page, or says what is there or not (has-sidebar),
    describes no furniture.
    """
    names = [tag]
    if rest and tag not in WHOLE_PAGE:
        for groups in _NAMES.findall(rest):
            for value in chain.from_iterable(map(str.split, groups)):
                words = [w.lower() for w in _NAME.findall(value)]
                if not ABOUT_OTHERS.intersection(words):
                    names += [f".{w}" for w in words]
        if _HIDDEN.search(rest):
            names.append(".hidden")
    return names


class Element:
    """An open or closed element of a page, linked to the one around it."""

    __slots__ = ("around", "names", "fresh", "furniture", "words", "marks", "worst")

    def __init__(self, around: Element | None, names: list[str], open_names: Counter[str]):
        self.around, self.names = around, names
        #: names that no element around it has, and whether it or one of those is furniture
        self.fresh = [n for n in dict.fromkeys(names) if not open_names[n]]
        self.furniture = bool(around and around.furniture) or not _FURNITURE.isdisjoint(names)
        #: words and content marks inside, once counted, and the weight of its words
        self.words, self.marks, self.worst = 0, 0, 0.0

    @property
    def tag(self) -> str:
        return self.names[0]


@dataclass
class Piece:
    """A run of text or a tag, in its innermost element (for a tag, the element it opens or ends)."""

    around: Element | None
    text: str | None = None
    tag: str = ""
    closing: bool = False


def _tokens(page: str) -> Iterator[re.Match[str]]:
    """Tokens in page order without the elements whose content is skipped."""
    place, never = 0, set()
    while token := _TOKEN.match(page, place):
        place = token.end()
        tag = (token["raw"] or "").lower()
        if not tag:
            # what closes an element that is skipped, or isn't there, is no tag
            if (token["tag"] or "").lower() not in _RAW_TAGS:
                yield token
        else:
            closed = _SELF_CLOSING.search(token["how"])
            if closed and tag in ("svg", "math"):
                continue
            # the page is searched to its end once per tag
            after = None if tag in never else _RAW_TAGS[tag].search(page, place)
            if closed and (after is None or not after[1]):
                # the next tag of its kind opens another, so this one was closed by itself
                if after is None:
                    never.add(tag)
                continue
            while after and not after[1]:
                after = _RAW_TAGS[tag].search(page, after.end())
            if after:
                place = after.end()
            elif tag in RAW:
                return
            else:
                never.add(tag)


def pieces(page: str) -> tuple[list[Piece], list[Element]]:
    """Text runs and tags, and all elements, in page order, in time linear in the page.

    Scripts, styles, comments and the head are skipped.
    """
    found: list[Piece] = []
    elements: list[Element] = []
    stack: list[Element] = []
    open_names: Counter[str] = Counter()
    open_tags: Counter[str] = Counter()

    def close(down_to: int) -> None:
        for element in stack[down_to:]:
            open_names.subtract(element.names)
            open_tags[element.tag] -= 1
        del stack[down_to:]

    in_head = False
    for token in _tokens(page):
        text, tag = token["text"], token["tag"]
        if tag and tag.lower() == "head":
            in_head = not token["end"]
            continue
        if in_head:
            if text is not None:
                in_head = text.isspace()
            elif tag:
                tag = tag.lower()
                in_head = tag not in ("body", "html", "br") if token["end"] else tag in IN_HEAD
            if in_head:
                continue
        innermost = stack[-1] if stack else None
        if text is not None:
            found.append(Piece(innermost, text=text))
        elif tag:
            tag = tag.lower()
            if token["end"]:
                found.append(Piece(innermost, tag=tag, closing=True))
                if open_tags[tag] > 0:
                    at = len(stack) - 1
                    while stack[at].tag != tag:
                        # a stray closing tag of a loose element closes nothing outside its block
                        if tag in LOOSE and stack[at].tag not in LOOSE:
                            at = len(stack)
                            break
                        at -= 1
                    close(at)
                continue
            if tag not in INLINE:
                while stack and stack[-1].tag in LOOSE and tag in _CLOSES.get(stack[-1].tag, ()):
                    close(len(stack) - 1)
            innermost = stack[-1] if stack else None
            if tag not in VOID and not _SELF_CLOSING.search(token["rest"]):
                innermost = Element(innermost, _names(tag, token["rest"]), open_names)
                stack.append(innermost)
                elements.append(innermost)
                open_names.update(innermost.names)
                open_tags[tag] += 1
            found.append(Piece(innermost, tag=tag))
    return found, elements


_BLOCKS = (
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul"
).split()
_CLOSES = {
    **{t: _BLOCKS for t in ("p", "b", "i", "em", "strong", "span", "a", "font", "u", "small")},
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"],
    "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"],
}


@dataclass
class Weights:
    """Weights of names (for words) and of tags; what is not listed has the default."""

    names: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def _of(self, name: str) -> float:
        return self.names.get(name, -1.0 if name in _FURNITURE else 0.5)

    def rate(self, found: list[Piece], elements: list[Element]) -> None:
        """Gives each element the weight of its words: the worst of its names and those around it.

        Names don't speak against an element that holds the page's content: its
        only article (or else its only main) element or, on pages without these
        and without a first heading outside, more than half of all words, unless
        its tag itself is one of furniture.
        """
        for p in found:
            if p.text is not None and p.around:
                p.around.words += len(p.text.split())
        marks = [[e for e in elements if e.tag == mark] for mark in ("article", "main", "h1")]
        mark = next((m[0] for m in marks if len(m) == 1), None)
        if mark:
            mark.marks = 1
        for e in reversed(elements):
            if e.around:
                e.around.words += e.words
                e.around.marks += e.marks
        whole = sum(e.words for e in elements if e.around is None)
        for e in elements:
            if mark is not None and mark.tag != "h1":
                holds = e.marks > 0
            else:
                holds = e.words * 2 > whole and (mark is None or e.marks > 0)
            own = [self._of(n) for n in e.names]
            if holds and self._of(e.tag) >= 0:
                own = [w for w in own if w >= 0]
            e.worst = min([*own, e.around.worst if e.around else 1.0])

    @staticmethod
    def word(around: Element | None) -> float:
        """The worst name speaks, if it speaks against; otherwise words are content.

        Words of furniture are left out of any run, so they need only keep a
        run from starting or ending with them, and from bridging to too little.
        """
        return FURNITURE_COST * around.worst if around and around.worst < 0 else 1.0

    def tag(self, name: str, around: Element | None = None) -> float:
        """Tags of furniture are left out with it and cost nothing; those of lists cost little."""
        if self.word(around) < 0:
            return 0.0
        cost = self.tags.get(name, -0.1 if name in INLINE else -0.4)
        return max(cost, -0.1) if name in LISTING else cost


def counted(page: str) -> Counter[tuple[str, str, bool]]:
    """(kind, name, inside): words by surrounding names and tags, inside and outside the content.

    Nothing unless the page has exactly one article element, or else one main.
    """
    found, elements = pieces(page)
    for mark in ("article", "main"):
        if sum(e.tag == mark for e in elements) == 1:
            break
    else:
        return Counter()
    counts: Counter[tuple[str, str, bool]] = Counter()
    # words of each element: inside the content, outside, and outside of any furniture too
    words = {id(e): [0, 0, 0] for e in elements}
    content: set[int] = set()
    for e in elements:
        if e.tag == mark or (e.around and id(e.around) in content):
            content.add(id(e))
    for p in found:
        inside = p.around is not None and id(p.around) in content
        if p.text is None:
            if not (p.around and p.around.furniture):
                counts["tag", p.tag, inside and p.tag != mark] += 1
        elif p.around:
            n, sums = len(p.text.split()), words[id(p.around)]
            if inside:
                sums[0] += n
            else:
                sums[1] += n
                sums[2] += n * (not p.around.furniture)
    for e in reversed(elements):
        sums = words[id(e)]
        if e.around:
            above = words[id(e.around)]
            for k in range(3):
                above[k] += sums[k]
        for name in e.fresh:
            # where there is furniture around words outside, it alone is to blame
            for inside, n in ((True, sums[0]), (False, sums[1 if name in _FURNITURE else 2])):
                if n:
                    counts["word", name, inside] += n
    return counts


def weights_from(rows: list[tuple[str, str, bool, float]]) -> Weights:
    """Log odds of standing inside the content, between -1 and 1 for names, below 0 for tags."""
    sums: dict[tuple[str, str], list[float]] = {}
    for kind, name, inside, n in rows:
        sums.setdefault((kind, name), [0.0, 0.0])[int(inside)] += n
    found = Weights()
    for (kind, name), (outside, inside) in sums.items():
        if kind == "word":
            # the list of furniture counts like 100 words outside
            odds = math.log((inside + 10) / (outside + 10 + 100 * (name in _FURNITURE)))
            found.names[name] = max(-1.0, min(1.0, odds / 2))
        else:
            share = (inside + 1) / (inside + outside + 2)
            found.tags[name] = -0.1 - 1.9 * (1 - share)
    return found


def extract(page: str, weights: Weights) -> str:
    """The text of the maximum-scoring run, white space as single spaces."""
    best = total = 0.0
    start = first = last = 0
    found, elements = pieces(page)
    weights.rate(found, elements)
    scores = []
    for i, p in enumerate(found):
        if p.text is None:
            scores.append(0.0)
            total += weights.tag(p.tag, p.around)
        else:
            scores.append(weights.word(p.around))
            total += scores[-1] * len(html.unescape(p.text).split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    parts = []
    for p, score in zip(found[first:last], scores[first:last], strict=True):
        if p.text is None:
            parts.append("" if p.tag in INLINE else " ")
        elif score >= 0:
            parts.append(html.unescape(p.text))
        else:
            parts.append(" ")
    return " ".join("".join(parts).split())


def learn_weights(pages: DataFrame, key: str = "page_id", page: str = "html") -> Weights:
    """Weights from a bounded sample of labelled pages; only sums per name reach the driver."""
    wanted = pages.select(
        F.col(f"`{key}`").alias("id"), text_of(F.col(f"`{page}`")).alias("html")
    ).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & F.col("id").isNotNull())
    # SAMPLE ids at most, and of repeated ids one row
    ids = wanted.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    chosen = wanted.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for value in batch.column("html"):
                for found, n in counted(value.as_py()).items():
                    keys.append(found)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([k[2] for k in keys], pa.bool_()),
                    pa.array(numbers, pa.float64()),
                ],
                names=["kind", "name", "inside", "n"],
            )

    counts = (
        chosen.select("html")
        .mapInArrow(count, "kind string, name string, inside boolean, n double")
        .groupBy("kind", "name", "inside")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seen"))
        .where(F.col("seen") >= SEEN_ON)
        .select("kind", "name", "inside", "n")
    )
    return weights_from([tuple(row) for row in counts.collect()])


def main_texts(
    pages: DataFrame, weights: Weights, key: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    said = pages.select(
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{url}`").alias("url"),
        text_of(F.col(f"`{page}`")).alias("html"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(value.as_py(), weights) for value in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(np.array(list(map(len, texts)), dtype=np.int64)),
                ],
                names=["id", "url", "text", "n_chars"],
            )

    schema = said.select("id", "url").schema.add("text", "string").add("n_chars", "long")
    return said.mapInArrow(read, schema).select(
        F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars"
    )
