"""Main text of a page as its maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Words score by the element they stand
in, tags are negative, with log-odds weights counted on labelled pages: those
whose one ``<article>`` (or ``<main>``) marks the content.  One linear scan
finds the best contiguous run.  Of the run, text inside menus, adverts, forms,
comments and the like is left out; the rest is decoded and joined by block.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|object|canvas|math)\b
      (?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*+)>
    |<[!?/][^>]*+>
    |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
ASIDE = frozenset("aside button dialog footer form head header label menu nav search title".split())
#: Words in class, id or role that mark what is not main text.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Whole class names and ids of what holds the content; words beside them are about the layout.
CONTENT_NAMES = frozenset("article body content entry entry-content main post post-content story text".split())
#: Elements that hold the content, whatever they are named.
WHOLE = frozenset("html body main article".split())
CLOSED_BY = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
    "option": frozenset(["option", "optgroup"]),
}
LEAST, MOST = -4.0, 1.0


@dataclass
class Part:
    """A tag or a stretch of text between two tags."""

    kind: str  # feature: "<tag" or "in tag", with a mark in asides
    words: int  # 0 for tags
    text: str
    breaks: bool
    aside: bool
    content: bool  # inside the labelled element


@dataclass
class _Open:
    tag: str
    aside: bool
    named: bool  # aside by its name alone
    at: int  # place in the page


def _named_aside(rest: str) -> bool:
    """A word of a name marks an aside, unless another whole name says content and no whole name says aside."""
    names = {n for match in NAMES.findall(rest) for n in "".join(match).lower().split()}
    if not any(ASIDE_NAMES & set(re.split(r"[^a-z]+", n)) for n in names):
        return False
    return bool(names & ASIDE_NAMES) or not names & CONTENT_NAMES


def parse(page: str) -> list[Part]:
    """Parts of a page in order; elements left open end where their parents do.

    An element that holds a ``<main>`` or the page's first ``<article>`` is no
    aside by its name: it wraps the content.
    """
    wrappers: set[int] = set()
    parts = _parse(page, wrappers, False)
    return _parse(page, wrappers, True) if wrappers else parts


def _parse(page: str, wrappers: set[int], known: bool) -> list[Part]:
    """Parts; places of named asides that wrap the content are put into ``wrappers``, or left out if ``known``."""
    parts: list[Part] = []
    articles = 0
    stack: list[_Open] = []
    depth: Counter = Counter()
    asides = 0

    def pop() -> None:
        nonlocal asides
        gone = stack.pop()
        depth[gone.tag] -= 1
        asides -= gone.aside

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            block = next((o.tag for o in reversed(stack) if o.tag in BLOCKS or o.tag == "a"), "")
            kind = f"in {block}{' aside' if asides else ''}"
            parts.append(Part(kind, len(text.split()), text, False, asides > 0, depth["article"] + depth["main"] > 0))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, rest = bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        within = asides > 0  # an aside's own tags go with it
        if end:
            if depth[tag] > 0:
                while stack[-1].tag != tag:
                    pop()
                pop()
        else:
            while stack and tag in CLOSED_BY.get(stack[-1].tag, ()):
                pop()
            within = asides > 0
        inside = depth["article"] + depth["main"] > 0
        head = tag == "header" and inside and not asides
        named = not end and tag not in WHOLE and not head and not (known and m.start() in wrappers) and _named_aside(rest)
        aside = named or not end and tag in ASIDE and not head
        if not end and (tag == "main" or tag == "article" and not articles) and not known:
            wrappers.update(o.at for o in stack if o.named)
        articles += not end and tag == "article"
        kind = f"<{tag}{' aside' if within or aside else ''}"
        parts.append(Part(kind, 0, "", tag in BLOCKS or tag == "br", within or aside, inside))
        if not end and tag not in VOID and not rest.endswith("/"):
            stack.append(_Open(tag, aside, named and tag not in ASIDE, m.start()))
            depth[tag] += 1
            asides += aside
    return parts


def labelled(page: str) -> bool:
    return len(re.findall(r"<(?:article|main)\b", page, re.I)) == 1


@dataclass
class Weights:
    """Score of a word by where it stands, and of a tag."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def of(self, kind: str) -> float:
        if kind not in self._known:
            inside, outside = self.counts.get(kind, (0, 0))
            odds = float(np.log((inside + 1) / (outside + 1)))
            if kind.endswith(" aside"):  # left out after the scan, so it may stand inside the run
                self._known[kind] = 0.0
            elif kind[0] == "<":
                self._known[kind] = min(-0.1, max(LEAST, odds))
            else:  # words in places never seen count as text
                self._known[kind] = min(MOST, max(LEAST, odds)) if inside + outside else 0.5
        return self._known[kind]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run of largest positive sum, the first of equal ones."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    """Main text of a page: blocks in page order, one line each; empty if there is none."""
    parts = parse(page or "")
    start, end = best_run([weights.of(p.kind) * (p.words or (p.kind[0] == "<")) for p in parts])
    blocks: list[str] = []
    run: list[str] = []
    for p in [*parts[start:end], Part("<", 0, "", True, False, False)]:
        if p.breaks:
            if line := " ".join(html.unescape("".join(run)).split()):
                blocks.append(line)
            run = []
        elif p.words and not p.aside or not p.words and p.text:
            run.append(p.text if not p.aside else " ")
    return "\n".join(blocks)


def learn(pages: DataFrame) -> Weights:
    """Weights counted on all labelled pages of ``pages``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for page in batch["html"]:
                if page and labelled(page):
                    for p in parse(page):
                        if p.words or p.kind[0] == "<":
                            seen[p.kind][0 if p.content and not p.aside else 1] += p.words or 1
        yield pd.DataFrame(
            [(k, *v) for k, v in seen.items()], columns=["kind", "inside", "outside"]
        ).astype({"inside": "int64", "outside": "int64"})

    rows = (
        pages.select("html").mapInPandas(run, "kind string, inside long, outside long")
        .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        # a page may invent element names; the frequent ones decide
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(4_096).collect()
    )
    return Weights({r["kind"]: (r["inside"], r["outside"]) for r in rows})


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, repeated rows too.

    A null or empty page has an empty text.  Without labelled pages words count
    alike and only asides and tags separate.
    """
    weights = weights or learn(pages)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, weights) for p in batch], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
