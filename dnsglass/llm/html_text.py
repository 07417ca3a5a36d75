"""Main text of web pages by the maximum-scoring subsequence (operator 8).

A page is a sequence of words and tags.  Every word has a score, positive in content,
negative in boilerplate; every tag has a negative one.  A linear scan finds the
contiguous region with the largest sum; the words in it that score above zero are
the text, so a menu or an advert in the middle of an article is left out.  Such a
block inside the content is neutral: it adds nothing and takes nothing away, so the
text on both sides of it stays in one region however long it is.  A block is inside
if the nearest telling element around it names content, or, where no name tells, if
its parent has running text (paragraphs, lists, loose text) before and after it and
no element that names content, or if it lies between two content elements of one kind
that stand side by side (two articles with an advert between them).  Outside, its words
and tags count against a region.

An element whose class words name it both ways (class="legal content") is boilerplate,
unless over half of the page's words lie in it and no other element names content.  A quotation
inside the content is content, whatever its class.

The weights come from labelled pages: at most LABELLED pages (those with the least hash
of page_id) that mark their main content up themselves (article, main).  For every
element name, class and id word the labels count the words inside and outside
the content.  A word's score is the log-odds of the innermost enclosing element that
says something about it; a tag's is minus the share of its kind that lies outside
content.  Names of known meaning carry prior counts, so that a page whose elements
no label has shown is judged by them.

Cases: null or empty html, or no region above zero -> empty text.  Without labelled
pages the priors stand alone.  Comments, scripts, styles, the head and forms have no
words.  A tag cut off by the end of the page is no text.  What an element makes of its
words is worked out once, from the element around it, so that deep nesting costs no more
than wide pages do; only an end tag of a paragraph, cell or inline element that was opened
outside blocks still open is paid for by their number.  Rows are independent; extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 2_000
#: A name with fewer words on the labelled pages cannot reach the odds that tell.
LEAST_WORDS = 2
PRIOR = 25.0
TAG_COST = 0.4

# Element names and words of class, id and role with a known meaning (fixed values).
CONTENT = frozenset("article main content post entry story articlebody entry-content post-content article-body".split())
BOILERPLATE = frozenset("""nav header footer aside form dialog menu navbar navigation breadcrumb breadcrumbs sidebar side-bar widget
ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notification
alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations more-stories
comment comments reply replies respond disqus pagination pager toolbar masthead copyright legal disclaimer search skip-link complementary contentinfo""".split())
SKIPPED = frozenset("head script style noscript template svg annotation annotation-xml iframe object select button textarea canvas audio video".split())
# Elements without a break around them (fixed values).
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr
math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mspace mpadded semantics""".split())
# Elements that say nothing about their content by themselves (fixed values).
GENERIC = frozenset("html body div section span center table tbody thead tr td th ul ol li dl dt dd p pre blockquote figure figcaption fieldset address details summary hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset("td th tr thead tbody tfoot".split())
# Elements whose text runs on in the element around them.
FLOW = frozenset("section ul ol dl pre blockquote figure figcaption details".split())
# Elements that are closed by a sibling or the parent, and inline ones: they do not enclose for long.
LOOSE = INLINE | VOID | frozenset("p li dt dd tr td th thead tbody tfoot option h1 h2 h3 h4 h5 h6 html body".split())

# Elements that quote or set text off inside the content.
QUOTED = frozenset("blockquote q pre".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>"']|"[^"<]*"|'[^'<]*')*)(?:>|\Z)
|</?[A-Za-z][^<>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.X)
_named = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_raw = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")}


def parts_of(word: str) -> list[str]:
    """A class word and, of a compound one, its parts: site-footer -> site-footer, site, footer."""
    parts = re.split("[-_]+", word)
    return [word, *parts] if len(parts) > 1 and parts[0] not in ("has", "no", "with", "without") else [word]


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """("text", text, ()), ("open", name, marks), ("close", name, ()); marks are the words of
    class, id and role.  The contents of raw elements are passed over."""
    at, end = 0, len(page)
    while at < end:
        m = _token.match(page, at)
        at = m.end()
        if m["text"] is not None:
            yield "text", m["text"], ()
        elif m["name"] is not None:
            name = m["name"].lower()
            if m["close"]:
                yield "close", name, ()
                continue
            marks = tuple(x for v in _named.findall(m["rest"]) for w in "".join(v).lower().split() for x in parts_of(w)) if "=" in m["rest"] else ()
            yield "open", name, marks
            if name in _raw and not m["rest"].endswith("/"):
                stop = _raw[name].search(page, at)
                at = stop.end() if stop else end
                yield "close", name, ()


def whole_words(marks: tuple[str, ...]) -> Iterator[str]:
    """The marks without the parts of compound ones."""
    i = 0
    while i < len(marks):
        yield marks[i]
        i += len(parts_of(marks[i]))


def walk[S](page: str, root: S, enter: Callable[[str, tuple[str, ...], int, S], S]) -> Iterator[tuple[str, str, S]]:
    """("text" | "open" | "close", text or name, state of the innermost open element).  `enter`
    gives an element's state by its name, marks, number on the page (from 1 on) and the state
    around it.  An end tag closes the nearest open element of its name; those left open inside
    it go with it, but stay open if it is an element that does not enclose for long."""
    stack: list[tuple[str, tuple[str, ...], int, S]] = [("", (), 0, root)]
    count: Counter = Counter()
    number = 0
    for kind, value, marks in tokens(page):
        yield kind, value, stack[-1][3]
        if kind == "open":
            if value not in VOID and (value not in LOOSE or marks):
                number += 1
                stack.append((value, marks, number, enter(value, marks, number, stack[-1][3])))
                count[value] += 1
        elif kind == "close" and count[value]:
            i = len(stack) - 1
            while stack[i][0] != value:
                i -= 1
            inside = stack[i + 1:]
            del stack[i:]
            count[value] -= 1
            for name, marks, n, _ in inside:
                if value in LOOSE:
                    stack.append((name, marks, n, enter(name, marks, n, stack[-1][3])))
                else:
                    count[name] -= 1


def labelled_counts(page: str) -> tuple[Counter, Counter]:
    """(words, tags) inside and outside the marked content: counts of (feature, inside)."""
    words: Counter = Counter()
    tags: Counter = Counter()

    def enter(name: str, marks: tuple[str, ...], _: int, around: tuple[bool, bool, frozenset]) -> tuple[bool, bool, frozenset]:
        skipped, inside, features = around
        new = {name, *marks} - GENERIC - features
        return skipped or name in SKIPPED, inside or name in ("article", "main"), features | new if new else features

    for kind, value, (skipped, inside, features) in walk(page, (False, False, frozenset()), enter):
        if skipped:
            continue
        if kind != "text":
            tags[value, inside] += 1
        elif n := len(value.split()):
            for f in features:
                words[f, inside] += n
    return words, tags


class Place:
    """What an open element makes of the words in it."""
    __slots__ = ("name", "number", "around", "held", "article", "skipped", "odds", "score", "by", "outer", "rest", "unsure", "kind")

    def __init__(self, name: str, number: int, around: Place | None):
        self.name, self.number, self.around = name, number, around
        self.article = self.skipped = False  # inside an article, inside something without words
        self.odds = 0.5  # of the innermost element that tells something
        self.score = 0.5  # of a word
        self.by: Place | None = None  # the innermost element that names content
        self.outer = False  # is there boilerplate around the words
        self.rest: int | None = None  # the element around the outermost boilerplate, None if that cannot be inside content
        self.unsure = 0  # the outermost element that is named both ways
        self.kind: object = None  # of an element that names content: those of one kind belong together
        self.held = self  # the nearest element that encloses for long, itself included

    @property
    def decides(self) -> int | None:
        """Of words that score below zero the element whose running text decides if they are
        inside the content: -1 if a name says that they are, None if they cannot be."""
        return None if self.score > 0 else -1 if self.by else self.rest


class Weights:
    def __init__(self, words: dict[tuple[str, bool], float], tags: dict[tuple[str, bool], float]):
        self.odds: dict[str, float] = {}
        for f in {f for f, _ in words} | CONTENT | BOILERPLATE:
            good, bad = PRIOR * (f in CONTENT), PRIOR * (f in BOILERPLATE)
            inside, outside = words.get((f, True), 0), words.get((f, False), 0)
            if f in BOILERPLATE:
                inside = 0  # an element of the article that is named as none of its text
            v = log((inside + good + 1) / (outside + bad + 1))
            self.odds[f] = max(-3.0, min(3.0, v))
        self.tag: dict[str, float] = {}
        for f in {f for f, _ in tags}:
            inside, outside = tags.get((f, True), 0), tags.get((f, False), 0)
            self.tag[f] = -TAG_COST * (outside + 1) / (inside + outside + 2)

    def tells(self, name: str, marks: tuple[str, ...], around: Place, trusted: bool) -> float:
        """What an element says about its words: their log-odds, 0 for nothing."""
        if name == "header" and around.article:
            return 0.0  # an article's own heading
        told = [self.odds[f] for f in (name, *marks) if abs(self.odds.get(f, 0)) >= 1]
        if not told or name in QUOTED and around.by and not around.outer and min(told) < 0:
            return 0.0
        return min(told) if min(told) < 0 and not trusted else max(told)

    def enter(self, name: str, marks: tuple[str, ...], number: int, around: Place, trusted: int = 0) -> Place:
        """The place inside an element; `trusted` is the number of one that is content though
        it is named both ways."""
        told = self.tells(name, marks, around, number == trusted)
        here = Place(name, number, around)
        here.held = around.held if name in LOOSE else here
        here.article = around.article or name in ("article", "main")
        here.skipped = around.skipped or name in SKIPPED
        here.odds = told or around.odds
        here.score = -3.0 if here.skipped else here.odds
        here.by, here.outer, here.rest, here.unsure = around.by, around.outer, around.rest, around.unsure
        if told > 0 and name not in ("html", "body"):
            here.by = here
            here.kind = name if name in ("article", "main") else (name, marks)
        if not around.outer and (told < 0 or name in SKIPPED):
            here.outer = True
            here.rest = None if name in CELLS or name in ("html", "body", "head") else around.held.number
        if told < 0 and not around.unsure and self.odds.get(name, 0) > -1 and not CONTENT.isdisjoint(whole_words(marks)):
            here.unsure = number
        return here


class Spans:
    """First and last piece of something on the page, by element."""

    def __init__(self) -> None:
        self.first: dict = {}
        self.last: dict = {}

    def add(self, key: object, first: int, last: int) -> None:
        self.first[key] = min(self.first.get(key, first), first)
        self.last[key] = max(self.last.get(key, last), last)

    def hand_on(self, key: object, other: object) -> None:
        if key in self.first:
            self.add(other, self.first[key], self.last[key])


def between(spans: Spans) -> Callable[[int, int], bool]:
    """Is a piece between the first and last content element of one kind in an element."""
    found: dict[int, list[tuple[int, int]]] = {}
    for key, a in sorted(spans.first.items(), key=lambda x: x[1]):
        joined = found.setdefault(key[0], [])
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], spans.last[key]))
        else:
            joined.append((a, spans.last[key]))

    def inside(element: int, i: int) -> bool:
        joined = found.get(element, [])
        at = bisect_right(joined, (i,)) - 1
        return at >= 0 and joined[at][0] < i < joined[at][1]

    return inside


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the largest sum, (0, 0) if none is above zero; of equal ones
    that which ends first, then the shortest."""
    total, start, best, region = 0.0, 0, 0.0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str | None, weights: Weights, trusted: int = 0) -> str:
    """The main text of a page."""
    if not page:
        return ""
    pieces: list[str] = []
    scores: list[float] = []
    blocks: list[tuple[int, int]] = []  # what may be boilerplate inside the content: (piece, element that decides)
    flowing, prose, side_by_side = Spans(), Spans(), Spans()  # running text; that of paragraphs; content elements of a kind
    places: dict[int, Place] = {}  # elements around running text
    named: set[int] = set()  # elements with an element inside that names content
    unsure: Counter = Counter()  # words of elements that are named both ways
    heard = 0
    paragraph = False
    root = Place("", 0, None)
    for kind, value, place in walk(page, root, lambda *x: weights.enter(*x, trusted)):
        score, at = place.score, len(pieces)
        if (decides := place.decides) is not None:
            blocks.append((at, decides))
        if kind != "text":
            if value not in INLINE and value != "br":
                paragraph = kind == "open" and value == "p"
            pieces.append("" if value in INLINE else " ")
            scores.append(weights.tag.get(value, -TAG_COST / 2))
            continue
        n = len(value.split())
        if n and not place.skipped:
            heard += n
            if place.unsure:
                unsure[place.unsure] += n
        if n and score > 0:
            if place.by:
                outside = place.by.around
                if not outside.outer:
                    side_by_side.add((outside.held.number, place.by.kind), at, at)
                while outside and outside.number not in named:
                    named.add(outside.number)
                    outside = outside.around
            held = place.held
            (prose if paragraph else flowing).add(held.number, at, at)
            while held.number and held.number not in places:
                places[held.number] = held
                held = held.around.held
        pieces.append(value if score > 0 else " ")
        scores.append(score * n)
    if unsure and not named and not trusted:
        most, n = max(unsure.items(), key=lambda x: (x[1], -x[0]))
        if 2 * n > heard:
            return extract(page, weights, most)
    for number in sorted(places, reverse=True):
        up = places[number].around.held.number
        prose.hand_on(number, up)
        if places[number].name in FLOW:
            flowing.hand_on(number, up)
    for number, a in flowing.first.items():
        prose.add(number, a, flowing.last[number])
    inside = between(side_by_side)
    for i, element in blocks:
        if element < 0 or element not in named and prose.first.get(element, i) < i < prose.last.get(element, i) or inside(element, i):
            scores[i] = 0.0
    a, b = best_region(scores)
    return " ".join(entities.unescape("".join(pieces[a:b])).split())


def fit(pages: DataFrame) -> Weights:
    """Weights from the labelled pages."""
    marked = F.col("html").rlike(r"(?i)<(article|main)\b")
    chosen = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter(marked & F.col("page_id").isNotNull())
              .select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(LABELLED))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter(marked).join(F.broadcast(chosen), "page_id").select("html")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        tags: Counter = Counter()
        for batch in it:
            for page in batch.column(0):
                w, t = labelled_counts(page.as_py())
                words.update(w)
                tags.update(t)
        rows = [("word", *k, n) for k, n in words.items()] + [("tag", *k, n) for k, n in tags.items()]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
                              names=["kind", "feature", "inside", "n"])

    inside = F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside")
    outside = F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside")
    # rows of the labelled sample's names: at most LABELLED pages give them
    found = (rows.mapInArrow(run, "kind string, feature string, inside boolean, n long").groupBy("kind", "feature").agg(inside, outside)
             .filter((F.col("kind") == "tag") | (F.col("inside") + F.col("outside") >= LEAST_WORDS)).collect())

    def counts(kind: str) -> dict[tuple[str, bool], float]:
        return {(r["feature"], x): r[c] for r in found if r["kind"] == kind for c, x in (("inside", True), ("outside", False))}

    return Weights(counts("word"), counts("tag"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    weights = fit(pages)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                out = [extract(p.as_py(), weights) for p in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
