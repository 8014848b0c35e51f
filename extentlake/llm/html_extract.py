"""Main-text extraction by the maximum-scoring subsequence of a page's words and tags.

A page is a sequence of tags and of the words between them.  Words score positive and tags negative;
words in places that labelled pages show to be outside the main text score negative too.  One linear
scan finds the contiguous run with the highest sum: the region of the main text, whatever elements it is in.  Blocks of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments inside it are dropped; their words and tags
count nothing, so that even a large one does not cut the run.

The scores are log odds counted on labelled pages.  A page labels itself if it has exactly one
``article`` or, failing that, ``main`` element: its words and tags are main text but those in boilerplate
elements.  Boilerplate is known by element, role and by class or id; to the fixed names of the latter come those
whose words labelled pages have outside the main text only.  ``fit`` counts over the at most ``SAMPLE`` labelled pages with
the smallest key hashes.  Without labelled pages the prior scores hold.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by one space.  Null, empty and text-less pages give an empty text, an empty table an empty result.  Of equal runs the first
counts.  Time and space are linear in the page, however long or deeply nested it is.  Unclosed comments, scripts and tags
reach to the end of the page, as in browsers.  Repeated rows give repeated results; extra columns
stay, but one that is named like the text is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Labelled pages that the scores are counted on, at most.
SAMPLE = 2000

# Element and hint names.
_RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|select|xmp|noembed|noframes"
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q math rb rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PLACE = frozenset("article main".split())
_BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments reply"
    " replies respond disqus discussion footer header masthead nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " sidebar aside widget related recommended share sharing social cookie cookies consent notice popup modal overlay"
    " newsletter subscribe subscription signup login search form pagination pager copyright legal disclaimer gdpr toolbar".split()
)

_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<({_RAW})(?=[\s/>])(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 body".split())
#: Words and pages that a class or id must have on labelled pages, all outside the main text, to count as boilerplate.
SEEN_WORDS, SEEN_PAGES = 20, 3


@dataclass
class Piece:
    """A tag, or a run of text with the place it stands in and the names it stands under."""

    tag: str = ""
    text: str = ""
    place: tuple[bool, str, bool] = (False, "", False)
    container: int = -1
    words: int = 0
    under: tuple | None = None


def _named(name: str, attributes: str) -> tuple[bool, list[str]]:
    """Whether an element's role or state makes it boilerplate, and the parts of its classes and id."""
    parts: list[str] = []
    for key, value in _NAMES.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return True, parts
        # Headings and sections of an article have ids by what they say.
        if key == "class" or key == "id" and name != "section":
            parts += _PARTS.findall(value)
    return False, parts


def pieces(page: str, hints: frozenset[str] = _HINTS) -> tuple[list[Piece], list[str]]:
    """The page's tags and texts in order, and the names of its containers."""
    out: list[Piece] = []
    containers: list[str] = []
    # Of each open block: its name, whether it or one around it is boilerplate, its container, and what it stands under.
    stack: list[tuple[str, bool, int, tuple | None]] = [("", False, -1, None)]
    opened: Counter = Counter()
    link, at = False, 0

    def say(text: str) -> None:
        name, dull, container, under = stack[-1]
        out.append(Piece(text=text, place=(dull, name, link), container=container, words=len(text.split()), under=under))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        close, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            link = not close
        if name in _INLINE:
            # Inline tags part no words and score as tags only if they are links.
            if name == "a":
                out.append(Piece(tag="/a" if close else "a", place=stack[-1][1:2] + ("", False), container=stack[-1][2]))
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                out.append(Piece(tag=name, place=stack[-1][1:2] + ("", False), container=stack[-1][2]))
            continue
        if close:
            ended = stack[-1][1]
            if opened[name]:
                while stack[-1][0] != name:
                    opened[stack.pop()[0]] -= 1
                ended = stack[-1][1]
                opened[stack.pop()[0]] -= 1
            link = False
            out.append(Piece(tag="/" + name, place=(ended, "", False), container=stack[-1][2]))
            continue
        # A new block ends an open paragraph, and an item or cell its open sibling.
        if stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            opened[stack.pop()[0]] -= 1
        _, dull, container, under = stack[-1]
        if name in _PLACE:
            containers.append(name)
            container = len(containers) - 1
        else:
            off, parts = _named(name, rest) if rest and name not in _HEADINGS else (False, [])
            dull = dull or name in _BOILERPLATE or off or any(p in hints for p in parts)
            if parts:
                under = (parts, under)
        stack.append((name, dull, container, under))
        opened[name] += 1
        out.append(Piece(tag=name, place=(dull, "", False), container=container))
    if at < len(page):
        say(page[at:])
    return out, containers


@dataclass
class Scores:
    """Log odds of being main text, of words by place and of tags by name."""

    words: dict[tuple[bool, str, bool], float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    #: Parts of classes and ids that mark boilerplate.
    hints: frozenset[str] = _HINTS

    def word(self, place: tuple[bool, str, bool]) -> float:
        _, name, link = place
        return self.words.get(place, 0.2 if link or name in ("", "html", "body") else 1.0)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -1.5 if name in ("a", "/a") else -0.2)

    def of(self, piece: Piece) -> float:
        """What a piece adds to a run: nothing if it is boilerplate, so that an insert does not cut the main text."""
        return 0.0 if piece.place[0] else self.tag(piece.tag) if piece.tag else piece.words * self.word(piece.place)


def _labelled(found: list[Piece], containers: list[str]) -> int | None:
    for name in ("article", "main"):
        own = [i for i, c in enumerate(containers) if c == name]
        if len(own) == 1:
            return own[0]
    return None


def fit(pages: DataFrame, *, key: str = "page_id", html_column: str = "html", sample: int = SAMPLE) -> Scores:
    """Scores counted on a bounded sample of the pages that label themselves."""
    tagged = pages.where(F.col(html_column).rlike("(?i)<(article|main)[\\s>]"))
    chosen = tagged.select(F.xxhash64(F.col(key).cast("string")).alias("order"), F.col(html_column).alias("html"))
    # The smallest hashes: a top-k, merged from each partition's own.
    ids = chosen.select("order").orderBy("order").limit(sample)
    picked = chosen.join(F.broadcast(ids.distinct()), "order").select("html")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for page in batch.column(0).to_pylist():
            found, containers = pieces(page)
            own = _labelled(found, containers)
            if own is None:
                continue
            parts: Counter = Counter()
            for p in found:
                if p.tag and p.place[0]:
                    continue
                if p.tag:
                    seen["tag", p.tag, False, False, p.container == own] += 1
                elif p.words:
                    dull, name, link = p.place
                    seen["word", name, dull, link, p.container == own and not dull] += p.words
                    # A page's names count each word once.
                    names, under = set(), p.under
                    while under is not None:
                        names.update(under[0])
                        under = under[1]
                    for part in names:
                        parts[part, p.container == own] += p.words
            for (part, inside), n in parts.items():
                seen["part", part, False, False, inside] += n
                seen["page", part, False, False, inside] += 1
        kinds = list(zip(*seen)) or [[]] * 5
        types = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, t) for k, t in zip(kinds, types)), pa.array(list(seen.values()), pa.int64())],
            names=["kind", "name", "dull", "link", "main", "n"],
        )

    schema = "kind string, name string, dull boolean, link boolean, main boolean, n long"
    counted = map_rows(picked, schema, count).groupBy("kind", "name", "dull", "link").agg(
        F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("main"), 0).otherwise(F.col("n"))).alias("outside"),
    )
    scores, names = Scores(), {}
    for r in counted.orderBy(F.desc(F.col("inside") + F.col("outside"))).limit(5000).collect():
        odds = max(-3.0, min(3.0, math.log((r["inside"] + 1) / (r["outside"] + 1))))
        if r["kind"] == "tag":
            scores.tags[r["name"]] = min(-0.1, odds - 0.5)
        elif r["kind"] == "word":
            # Words score positive wherever labelled pages have main text.
            scores.words[r["dull"], r["name"], r["link"]] = max(0.3, odds) if r["inside"] > r["outside"] else min(-0.3, odds)
        elif r["inside"] == 0:
            names.setdefault(r["name"], {})[r["kind"]] = r["outside"]
    learned = (n for n, k in names.items() if k.get("part", 0) >= SEEN_WORDS and k.get("page", 0) >= SEEN_PAGES)
    scores.hints = _HINTS.union(learned)
    return scores


def best_run(values: list[float]) -> tuple[int, int]:
    """The bounds of the contiguous run with the highest sum; the first and shortest of equals."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def main_text(page: str | None, scores: Scores) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found, _ = pieces(page, scores.hints)
    begin, end = best_run([scores.of(p) for p in found])
    blocks: list[str] = []
    current: list[str] = []
    for p in found[begin:end]:
        if p.tag:
            if p.tag == "br":
                current.append(" ")
            elif p.tag not in ("a", "/a"):
                blocks.append("".join(current))
                current = []
        elif not p.place[0]:
            current.append(p.text)
    blocks.append("".join(current))
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def extract(pages: DataFrame, scores: Scores, *, html_column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out`` in place of the html."""
    at = pages.columns.index(html_column)
    kept = [i for i, c in enumerate(pages.columns) if i != at and c.lower() != out.lower()]
    schema = T.StructType([*(pages.schema.fields[i] for i in kept), T.StructField(out, T.StringType())])
    held = pages.sparkSession.sparkContext.broadcast(scores)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, held.value) for p in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in kept), out]
        )

    return map_rows(pages, schema, run)
