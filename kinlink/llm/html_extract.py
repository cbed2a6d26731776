"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score positive, more or less so by the
marks of the elements around them (name of a section, class, id, role), and negative where a
mark speaks clearly against them; tags score negative, the more so the rarer they are inside
articles.  One linear scan (Kadane) finds the contiguous region with the largest sum, which is
widened to whole blocks, and to further blocks of positive words without links, which are too
short to pay for their tags (the items of a last list).  Inside the region, elements whose own marks make their words
negative (an advert, a form or the readers' comments within an article) are left out; such an
element costs no more than ``GAP`` words, so that a long one doesn't cut an article in two.

Weights are learned from labelled pages, those that mark their article, with the marking
itself hidden: for each mark, the log of its share of the words inside articles over its share
of the words outside; for each tag, how often it stands outside.  Names that the HTML standard
or plain usage gives to menus, adverts, comments and the like have a prior against them (a
share ``PRIOR`` of the words outside), which labelled pages can overrule.  A page's own
marking, if it has one, is evidence like any other mark, ``INSIDE`` or ``OUTSIDE``, and spares
what it holds the costs of tags and of elements left out.

Fitting takes a bounded sample of ``sample`` pages in hash order, counted in executors, and
the ``most`` commonest marks; every page is extracted whole.

Cases.  Null or empty html: empty text.  A page without tags is one block.  Unclosed and
crossing tags are closed as browsers do, roughly.  Very long pages are one linear scan.  Equal
sums: the first region.  No word scores positive: empty text.  Repeated rows: each is
extracted.  Null page_id or url are passed through.  Extra columns are carried, except those
named like the results, which are replaced.  No labelled pages: priors only.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements whose content is never text, skipped as raw text.
RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|canvas"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(?P<close2>/?)(?P<name2>[A-Za-z][A-Za-z0-9:-]*)[^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements whose name says what a part is for; other names say nothing about the words in them.
SECTIONS = frozenset("nav footer aside header form button select menu dialog datalist fieldset label legend option audio video map section details".split())
LABELS = frozenset(("article", "main"))
#: Names against which there is a prior: elements, roles, and classes or ids (their last word).
AGAINST_ELEMENT = frozenset("nav footer aside header form button select menu dialog datalist fieldset label legend option audio video map".split())
AGAINST_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
AGAINST_NAME = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb
    breadcrumbs crumbs footer masthead topbar toolbar comment comments commentlist discussion replies respond disqus sharing related recommended
    recommendations pagination pager""".split()
)
#: Last words of compounds that only say "part" ("ad-slot"), and first words that turn a name around ("no-sidebar").
PARTS = frozenset("area bar block box container content header item items list panel section slot unit wrap wrapper".split())
TURNS = frozenset("no not non has with without hide".split())

BASE = 2.0  # log-odds of a word without any mark
INSIDE, OUTSIDE = 2.0, -4.0
LEAST, PRIOR = 0.001, 0.2  # shares of words
TAG, GAP = 0.5, 3.0


@lru_cache(maxsize=1 << 14)
def marks(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says of itself: its name if that names a section, its classes, id, role, and whether it is hidden."""
    out = [name] if name in SECTIONS else []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if key == "class":
            out.extend(f".{x}" for x in value.split())
        elif key in ("id", "role") and value:
            out.append(("#" if key == "id" else "@") + value)
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            out.append("hidden")
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def against(mark: str) -> bool:
    """Is there a prior against this mark?"""
    if mark[0] == "@":
        return mark[1:] in AGAINST_ROLE
    if mark[0] not in ".#":
        return mark == "hidden" or mark in AGAINST_ELEMENT
    words = [w for w in re.split(r"[^a-z]+", mark) if w]
    if len(words) > 1 and words[0] in TURNS:
        return False
    if words[-2:] == ["site", "header"] or words[-2:] == ["page", "header"]:
        return True
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return bool(words) and words[-1] in AGAINST_NAME


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """("<", name, attributes), (">", name, "") and ("", "", text) in page order; every element is closed, void ones at once."""
    stack: list[str] = []

    def until(k: int):
        while len(stack) > k:
            yield ">", stack.pop(), ""

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "", "", text
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, attrs = name.lower(), m["attrs"] or ""
        if m["close"] or m["close2"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] == name), None)
            if at is not None:
                yield from until(at)
            continue
        if name in BLOCK:  # a block ends an open paragraph, whatever inline elements are still open
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] in BLOCK), None)
            if k is not None and stack[k] == "p":
                yield from until(k)
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in SCOPE[name] and stack[k] not in CLOSES[name]:
                    break
                if stack[k] in CLOSES[name]:
                    yield from until(k)
                    break
        yield "<", name, attrs
        if name in VOID or attrs.rstrip().endswith("/"):
            yield ">", name, ""
        else:
            stack.append(name)
    yield from until(0)


def count(page: str) -> Counter:
    """(mark or tag, inside) -> words or tags of a labelled page, the marking hidden; ("", inside): all words.  What there is a prior against is outside."""
    found: Counter = Counter()
    path: list[tuple[tuple[str, ...], bool]] = []
    articles = bad = 0
    for sign, name, x in walk(page):
        inside = articles > 0 and not bad
        if sign == "<":
            own = marks(name, x)
            if articles and name == "header":
                own = own[1:]
            worse = name not in LABELS and any(against(k) for k in own)
            if name not in LABELS:
                found[f"<{name}", inside and not worse] += 1
            path.append((() if name in LABELS else own, worse))
            articles += name in LABELS
            bad += worse
        elif sign == ">":
            articles -= name in LABELS
            bad -= path.pop()[1]
        elif n := len(x.split()):
            found["", inside] += n
            for mark in {k for own, _ in path for k in own}:
                found[mark, inside] += n
    return found


class Weights:
    """Log ratios of marks, and scores of tags, from counts of labelled pages."""

    def __init__(self, found: Counter, prior: bool = True):
        total = [max(1, found["", False]), max(1, found["", True])]
        self.prior, self.marks, self.tags = prior, {}, {}
        for key in {k for k, _ in found if k}:
            out, inside = found[key, False], found[key, True]
            if key[0] == "<":
                self.tags[key[1:]] = -TAG * (out + 1) / (out + inside + 2) - 0.001
            else:
                self.marks[key] = self.ratio(key, out / total[0], inside / total[1])

    def ratio(self, mark: str, out: float, inside: float) -> float:
        return math.log((inside + LEAST) / (out + LEAST + (PRIOR if self.prior and against(mark) else 0)))

    def mark(self, mark: str) -> float:
        return self.marks[mark] if mark in self.marks else self.ratio(mark, 0, 0)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -TAG / 2)


def learn(pages: list[str], prior: bool = True) -> Weights:
    return Weights(sum((count(p) for p in pages if marked(p)), Counter()), prior)


def marked(page: str) -> bool:
    return re.search("<(article|main)[\\s>]", page, re.I) is not None


Token = tuple[float, str, str, bool, bool]


def tokens(page: str, weights: Weights) -> list[Token]:
    """(score, tag or "", text, left out, in a link) in page order; words are in runs, as text between tags."""
    out: list[Token] = []
    path: list[tuple[float, int | None]] = []  # of each open element: the least log ratio so far, and where an element to be left out begins
    articles, links, own_marks = 0, 0, marked(page)
    for sign, name, x in walk(page):
        low, gone = path[-1] if path else (0.0, None)
        if sign == "<":
            found = marks(name, x) if name not in LABELS and name not in ("html", "body") else ()
            if articles and name == "header":
                found = found[1:]
            low = min([low, *(weights.mark(k) for k in found)])
            here = gone
            if gone is None and BASE + (INSIDE if articles else 0) + low < 0:
                here = len(out)
            path.append((low, here))
            articles += name in LABELS
            links += name == "a"
            if name not in LABELS:
                out.append((-0.001 if articles else weights.tag(name), f"<{name}", "", here is not None, False))
        elif sign == ">":
            articles -= name in LABELS
            links -= name == "a"
            _, here = path.pop()
            if name not in LABELS and name not in VOID:
                out.append((-0.001 if articles else weights.tag(name), f"</{name}", "", here is not None, False))
            if here is not None and (path[-1][1] if path else None) is None:  # the whole element costs a bounded sum
                cost, most = sum(t[0] for t in out[here:]), 0.001 if articles else GAP / 2
                if cost < -most:
                    out[here:] = [(t[0] * -most / cost, *t[1:]) for t in out[here:]]
        elif n := len(x.split()):
            z = BASE + low + ((INSIDE if articles else OUTSIDE) if own_marks else 0)
            out.append((n * (1 / (1 + math.exp(-z)) - 0.5), "", x, gone is not None, links > 0))
        else:
            out.append((0.0, "", x, gone is not None, False))
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """The maximum-scoring contiguous run, as a half-open range; the first of equal ones, empty if none is positive."""
    best, best_at, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += s
        if sum_ > best:
            best, best_at = sum_, (start, i + 1)
    return best_at


def _ends(token: Token) -> bool:
    return token[1].lstrip("</") in BLOCK


def widen(found: list[Token], at: int, step: int) -> int:
    """Places from ``at`` on, in direction ``step``, to take on: the rest of a block, then blocks of positive words without links (over what is left out)."""
    taken, begun, i = at, False, at
    words, good = False, True
    while 0 <= i < len(found):
        score, _, text, gone, link = found[i]
        i += step
        if _ends(found[i - step]):
            if not good:
                return taken
            if words or not begun:
                taken = i - step
            words, begun = False, True
        elif text.strip() and not gone:
            words, good = True, not begun or good and score > 0 and not link
    return i if good and (words or not begun) else taken


def extract(page: str | None, weights: Weights) -> str:
    """The main text: one line a block."""
    if not page:
        return ""
    found = tokens(page, weights)
    a, b = region([t[0] for t in found])
    if a == b:
        return ""
    a, b = widen(found, a - 1, -1) + 1, widen(found, b, 1)
    lines, own = [], []

    def end() -> None:
        line = re.sub(r"\s+", " ", html.unescape("".join(own))).strip()
        if line:
            lines.append(line)
        own.clear()

    for token in found[a:b]:
        _, tag, text, gone, _ = token
        if _ends(token):
            end()
        elif tag == "<br":
            own.append(" ")
        elif text and not gone:
            own.append(text)
    end()
    return "\n".join(lines)


def _count(batches):
    for batch in batches:
        found = sum((count(x) for x in batch.column("html").to_pylist()), Counter())
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["key", "inside", "n"])


def fit(pages: DataFrame, sample: int = 1000, most: int = 5000, seed: int = 5, prior: bool = True) -> Weights:
    """Weights from at most ``sample`` labelled pages and the ``most`` commonest marks and tags in them."""
    own = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html", F.xxhash64("url", "html", F.lit(seed)).alias("h"))
    least = [r.h for r in own.select("h").distinct().orderBy("h").limit(sample).collect()]  # hashes only: no task sends pages
    if not least:
        return Weights(Counter(), prior)
    few = own.filter(F.col("h") <= least[-1]).dropDuplicates(["h"]).select("html")
    rows = few.mapInArrow(_count, "key string, inside boolean, n long").groupBy("key").agg(*(F.sum(F.when(F.col("inside") == side, F.col("n"))).alias(name) for side, name in ((F.lit(True), "a"), (F.lit(False), "b"))))
    found = rows.withColumn("n", F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).orderBy((F.col("key") != ""), F.col("n").desc(), "key").limit(most).collect()
    return Weights(Counter({k: v for r in found for k, v in (((r.key, True), r.a or 0), ((r.key, False), r.b or 0))}), prior)


def extract_pages(spark: SparkSession, pages: DataFrame, weights: Weights) -> DataFrame:
    """All columns of pages, with text and n_chars (code points)."""
    plain = pages.drop("text", "n_chars")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(k, 256)
                texts = [extract(x.as_py(), weights) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*part.schema.names, "text", "n_chars"])

    return plain.mapInArrow(run, fields)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(spark, pages, fit(pages)).select("page_id", "url", "text", "n_chars")
