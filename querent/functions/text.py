"""Text expressions: cleaning, predicates and normal forms (one row in, one out)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .arrays import bind
from .patterns import (
    BLANK_LINE, CJK_CHARS, DIGIT, INLINE, INLINE_CHARS, LINE_BREAK, NUMERALS,
    SPACE, SPACE_CHARS, SPACES, WORD_CHARS,
)

PAGE_NUMBER = (
    rf"^(?:第?{SPACE}*{DIGIT}+{SPACE}*页|{DIGIT}+{SPACE}*/{SPACE}*{DIGIT}+"
    rf"|(?i:page){SPACE}*{DIGIT}+)$"
)
HEADING_LINE = (
    rf"^(?:#{{1,6}}{INLINE}+.+|{DIGIT}+{INLINE}*[.、]{INLINE}*.+"
    rf"|[{NUMERALS}]+{INLINE}*[、.]{INLINE}*.+)$"
)
HEADING_MARK = rf"^[#\p{{Nd}}{NUMERALS}.、)]*{SPACE}*"
BULLET_LINE = rf"^(?:[-*•]{INLINE}+.+|{DIGIT}+{INLINE}*[.)]{INLINE}+.+)$"
BULLET_MARK = rf"^[-*•\p{{Nd}}.)]+{SPACE}*"
LEADING_NUMBER = (
    rf"^[{SPACE_CHARS}(\[【{{]*(?:[0-9]{{1,3}}|[{NUMERALS}]+)[.、)\]】}}：:\-]*{SPACE}*"
)
DOT_LEADER = rf"[.·]{{3,}}{SPACE}*{DIGIT}+{SPACE}*[?？]?$"
TRAILING_PAGE = rf"{SPACE}+{DIGIT}+{SPACE}*[?？]?$"
BANK_NOISE = "(?i)^(?:" + "|".join(lx.BANK_NOISE_HEADS) + ")"
KEY_BRACKETS = rf"[{SPACE_CHARS}()\[\]{{}}<>《》“”\"'`~·•\-–—_]+"
KEY_PUNCTUATION = "[。，、；：！？!?.,;:]+"
# What both take out, one by one.
KEY_SIGNS = "()[]{}<>《》“”\"'`~·•-–—_" + "。，、；：！？!?.,;:"
# Word characters of ASCII one by one: Java tests such a class in one look-up.
_ASCII_WORDS = f"[{string.ascii_letters}{string.digits}_]+"
# White space that is not one plain blank already.
_WIDE = rf"{SPACE}(?:(?<= ){SPACE}++|(?<! ){SPACE}*+)"
_CORE = rf"A-Za-z0-9{CJK_CHARS}"
LIST_MARK = rf"^{SPACE}*[-*\p{{Nd}}.){NUMERALS}]+[{SPACE_CHARS}、.]*"
UNSAFE_NAME = r'[<>:"/\\|?*]+'


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def collapse_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def unix_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when one of the words occurs in ``c``; false for null."""
    hit = F.lit(False)
    for word in needles:
        hit = hit | c.contains(word)
    return F.coalesce(hit, F.lit(False))


def count_contained(c: Column, needles: list[str]) -> Column:
    total = F.lit(0)
    for word in needles:
        total = total + F.coalesce(c.contains(word), F.lit(False)).cast("int")
    return total


def first_group(c: Column, groups, default: Column) -> Column:
    """Name of the first group one of whose words occurs in ``c``."""
    items = groups.items() if isinstance(groups, dict) else groups
    out = None
    for name, needles in items:
        cond = contains_any(c, needles)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(default) if out is not None else default


# --- cleaning -------------------------------------------------------------
def base_clean(c: Column) -> Column:
    """Drop NUL, unify line ends, collapse blank lines, strip lines and text."""
    t = collapse_breaks(unix_breaks(F.replace(c, F.lit("\x00"), F.lit(""))))
    t = F.regexp_replace(t, f"(?md)^{INLINE}+|{INLINE}+$", "")
    return strip(F.coalesce(t, F.lit("")))


def strip_comments(c: Column) -> Column:
    """Remove HTML comments, also those over several lines."""
    return collapse_breaks(F.regexp_replace(c, "(?s)<!--.*?-->", ""))


def has_image(c: Column) -> Column:
    return c.rlike(r"(?d)!\[.*?\]\(.*?\)|<img.*?>")


def has_table(c: Column) -> Column:
    return c.rlike(rf"\|[{SPACE_CHARS}-]+\|")


def looks_tabular(c: Column, share: float = 0.1) -> Column:
    """More than ``share`` of the lines hold a tab or a wide gap."""
    return bind(
        F.split(c, "\n", -1),
        lambda lines: F.size(
            F.filter(lines, lambda l: l.rlike(rf"\t|{SPACE}{{3,}}"))
        ) > F.size(lines) * F.lit(share),
    )


def likely_scanned(chars: Column, pages: Column, per_page: int = 100) -> Column:
    return F.when(pages == 0, F.lit(True)).otherwise(
        F.try_divide(chars, pages) < per_page
    )


def is_empty(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def normalise_line(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), _WIDE, " ")


def is_noise_line(c: Column) -> Column:
    """Empty, a page number, at most two characters, or mostly symbols."""
    return (
        (F.length(c) <= 2)
        | c.rlike(PAGE_NUMBER)
        | (
            (F.length(c) - F.length(F.regexp_replace(F.regexp_replace(c, _ASCII_WORDS, ""), f"[{WORD_CHARS}]+", "")))
            / F.greatest(F.length(c), F.lit(1)) < F.lit(0.2)
        )
    )


def clean_lines(
    c: Column,
    site_marks: list[str] = lx.SITE_MARKS,
    repeats: int = 3,
    repeat_max_length: int = 40,
) -> Column:
    """Drop blank, site-mark, noise and repeated short lines of one document.

    A line is repeated when its normal form comes at least ``repeats`` times
    among the lines that survive the other rules; after sorting the normal
    forms that is ``sorted[i] = sorted[i - repeats + 1]``.  A line of more than
    twice the length of a short one has a longer form than any of those, unless
    white space collapses in it: lower case adds at most one character to each
    and takes none away.
    """
    kept = F.filter(
        F.transform(F.split(unix_breaks(c), "\n", -1), strip),
        lambda l: ~is_noise_line(l) & ~contains_any(l, site_marks),
    )

    def drop_repeats(lines: Column) -> Column:
        may_repeat = lambda l: (F.length(l) <= 2 * repeat_max_length) | l.rlike(_WIDE)
        in_order = F.array_sort(F.transform(F.filter(lines, may_repeat), normalise_line))
        repeated = bind(
            in_order,
            lambda s: F.array_distinct(
                F.filter(s, lambda x, i: F.get(s, i - (repeats - 1)) == x)
            ),
        )
        return bind(
            F.struct(lines.alias("lines"), repeated.alias("repeated")),
            lambda v: F.when(F.size(v["repeated"]) == 0, v["lines"]).otherwise(
                F.filter(
                    v["lines"],
                    lambda l: ~(
                        (F.length(l) <= repeat_max_length)
                        & F.array_contains(v["repeated"], normalise_line(l))
                    ),
                )
            ),
        )

    return F.coalesce(
        strip(F.array_join(bind(kept, drop_repeats), "\n")), F.lit("")
    )


def to_markdown(c: Column) -> Column:
    """Numbered lines become headings, bullets become ``- ``; the rest stays."""

    def one(line: Column) -> Column:
        heading = F.regexp_replace(line, HEADING_MARK, "")
        bullet = F.regexp_replace(line, BULLET_MARK, "")
        return (
            F.when(
                line.rlike("(?d)" + HEADING_LINE),
                F.when(heading != "", F.concat(F.lit("## "), heading)).otherwise(line),
            )
            .when(
                line.rlike("(?d)" + BULLET_LINE),
                F.when(bullet != "", F.concat(F.lit("- "), bullet)).otherwise(line),
            )
            .otherwise(line)
        )

    lines = F.transform(F.split(c, LINE_BREAK, -1), strip)
    return strip(collapse_breaks(F.array_join(F.transform(lines, one), "\n")))


# --- predicates on paths and texts -----------------------------------------
def is_resume_text(
    path: Column,
    text: Column,
    path_words: list[str] = lx.RESUME_PATH_WORDS,
    section_words: list[str] = lx.RESUME_SECTION_WORDS,
) -> Column:
    hits = count_contained(text, section_words)
    return (
        contains_any(F.lower(path), [w.lower() for w in path_words])
        | ((hits >= 4) & (F.length(text) < 4000))
        | (hits >= 6)
    )


def is_template_path(
    path: Column,
    category: Column,
    words: list[str] = lx.PATH_TEMPLATE_WORDS,
    category_words: tuple[str, str] = ("hr", "简历"),
    suffixes: list[str] = lx.TEMPLATE_SUFFIXES,
) -> Column:
    lowered = F.lower(path)
    by_suffix = F.lit(False)
    for s in suffixes:
        by_suffix = by_suffix | lowered.endswith(s)
    return contains_any(lowered, [w.lower() for w in words]) | (
        contains_any(F.lower(category), list(category_words)) & by_suffix
    )


def contains_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{CJK_CHARS}]"), F.lit(False))


def mostly_english(c: Column) -> Column:
    """At least three ASCII letters and hardly any CJK."""
    letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    cjk = F.regexp_count(c, F.lit(f"[{CJK_CHARS}]"))
    return F.coalesce(
        (letters >= 3) & ((cjk == 0) | (cjk < letters * F.lit(0.05))), F.lit(False)
    )


def path_matches(c: Column, needle: str) -> Column:
    return F.contains(c, F.lit(needle))


# --- normal forms -----------------------------------------------------------
def dedup_normal(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), _WIDE, " ")
    return strip(F.regexp_replace(t, f"[^{WORD_CHARS} ]+", ""))  # blanks are all the white space that is left


def fingerprint(c: Column) -> Column:
    return F.md5(dedup_normal(c))


def normalise_question(c: Column) -> Column:
    """Strip numbering in front, dot leaders and page numbers behind."""
    t = F.regexp_replace(strip(c), _WIDE, " ")
    t = strip(F.regexp_replace(t, LEADING_NUMBER, ""))
    # single blanks are all the white space that is left
    t = strip(F.regexp_replace(t, DOT_LEADER.replace(SPACE, " "), ""))
    return strip(F.regexp_replace(t, TRAILING_PAGE.replace(SPACE, " "), ""))


def is_question_noise(c: Column) -> Column:
    """Fewer than four letters or digits (read no further than the fourth), or a head of the list."""
    return ~c.rlike(f"^(?:[^{_CORE}]*+[{_CORE}]){{4}}") | c.rlike(BANK_NOISE)


def question_key(c: Column) -> Column:
    t = F.translate(F.lower(c), SPACES + KEY_SIGNS, "")
    return F.regexp_replace(t, LEADING_NUMBER, "")


def strip_list_mark(c: Column) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_replace(c, LIST_MARK, "")), f"{SPACE}+", " "))


def estimate_tokens(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / F.lit(1.5)).cast("int"))).otherwise(0)


def safe_name(c: Column) -> Column:
    return strip(F.regexp_replace(c, UNSAFE_NAME, "_"))


def paragraphs(c: Column) -> Column:
    """Stripped, non-empty blank-line paragraphs."""
    return F.filter(F.transform(F.split(c, BLANK_LINE, -1), strip), lambda p: p != "")


def best_attempt(
    existing: Column, direct: Column, fallback: Column, enough: int = 100, usable: int = 50
) -> Column:
    """Text to keep after a repair round; null sends the row to the retry queue."""
    return F.coalesce(
        F.when(F.length(strip(existing)) >= enough, existing),
        F.when(F.length(strip(direct)) >= usable, direct),
        F.when(F.length(strip(fallback)) > 0, fallback),
    )
