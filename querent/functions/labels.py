"""Labels from ordered word lists: category, position, difficulty, question type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .arrays import bind, top_by_count
from .patterns import WORD_CHARS
from .text import contains_any, count_contained, first_group, is_resume_text


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value for the key, or the key itself."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def bank_category(file_name: Column, hint: Column, groups=lx.BANK_CATEGORY) -> Column:
    name = F.lower(F.concat(file_name, F.lit(" "), F.coalesce(hint, F.lit(""))))
    return first_group(name, groups, F.lit(lx.BANK_CATEGORY_DEFAULT))


def job_category(path: Column, groups=lx.JOB_CATEGORY) -> Column:
    return first_group(F.lower(F.coalesce(path, F.lit(""))), groups, F.lit(lx.JOB_CATEGORY_DEFAULT))


def content_category(path: Column, groups=lx.CONTENT_CATEGORY) -> Column:
    return first_group(path, groups, F.lit(lx.CONTENT_CATEGORY_DEFAULT))


def position(
    path: Column, content: Column, by_folder=lx.POSITION_BY_FOLDER, by_content=lx.POSITION_BY_CONTENT
) -> Column:
    """Exact folder, then folder name inside the path, then words of the text."""
    table = F.create_map(*[F.lit(x) for kv in by_folder.items() for x in kv])
    exact = F.get(
        F.filter(
            F.transform(F.split(path, "/", -1), lambda p: F.try_element_at(table, p)),
            lambda v: v.isNotNull(),
        ),
        F.lit(0),
    )
    inside = first_group(path, [(v, [k]) for k, v in by_folder.items()], F.lit(None).cast("string"))
    return F.coalesce(
        exact, inside, first_group(F.lower(content), by_content, F.lit(lx.POSITION_DEFAULT))
    )


def difficulty(
    content: Column,
    question: Column,
    groups=lx.DIFFICULTY,
    advanced=lx.DIFFICULTY_ADVANCED,
    basic=lx.DIFFICULTY_BASIC_QUESTION,
) -> Column:
    lowered = F.lower(content)
    rest = (
        F.when(contains_any(lowered, advanced), "高级")
        .when(contains_any(F.lower(question), basic), "基础")
        .otherwise(lx.DIFFICULTY_DEFAULT)
    )
    return first_group(lowered, groups, rest)


def question_type(question: Column, answer: Column, groups=lx.QUESTION_TYPE) -> Column:
    a = F.lower(answer)
    by_answer = (
        F.when(contains_any(a, ["```", "def ", "function"]), "代码题")
        .when(
            (F.regexp_count(a, F.lit(r"\n-")) > 3) | (F.regexp_count(a, F.lit(r"\n•")) > 3), "对比题"
        )
        .otherwise("概念题")
    )
    return F.when(F.coalesce(question, F.lit("")) == "", "知识点").otherwise(
        first_group(F.lower(question), groups, by_answer)
    )


def add_labels(metadata: Column, labels: dict[str, str]) -> Column:
    """Custom labels win over labels already there."""
    new = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    old = F.map_filter(metadata, lambda k, v: ~k.isin(*labels))
    return F.map_concat(F.coalesce(old, F.expr("cast(map() as map<string,string>)")), new)


# --- file classes -----------------------------------------------------------
def file_class(
    path: Column,
    name: Column,
    category: Column,
    is_template: Column,
    sample: Column,
    template_words=lx.CLASS_TEMPLATE_WORDS,
    question_words=lx.CLASS_QUESTION_WORDS,
    experience_words=lx.CLASS_EXPERIENCE_WORDS,
    resume_path_words=lx.RESUME_PATH_WORDS,
    resume_section_words=lx.RESUME_SECTION_WORDS,
    qa_words=("问题", "答案"),
) -> Column:
    """struct(category, confidence, reasons) from weighted word hits."""
    combined = F.lower(F.concat_ws(" ", path, name, category))
    text = F.coalesce(sample, F.lit(""))
    resume = (text != "") & is_resume_text(path, text, resume_path_words, resume_section_words)
    marks = F.regexp_count(text, F.lit("[?？]")) >= 5
    qa = text.contains(qa_words[0]) & text.contains(qa_words[1])
    told = contains_any(text, experience_words)

    def reasons_of(prefix: str, needles: list[str]) -> list[Column]:
        return [F.when(combined.contains(w), F.lit(f"{prefix}:{w}")) for w in needles]

    scores = F.struct(
        (count_contained(combined, template_words) * 3 + resume.cast("int") * 5).alias("t"),
        (count_contained(combined, question_words) * 2 + marks.cast("int") * 2 + qa.cast("int") * 3).alias("q"),
        (count_contained(combined, experience_words) * 2 + told.cast("int")).alias("e"),
    )
    reasons = F.array_compact(
        F.array(
            *reasons_of("path_template", template_words),
            F.when(resume, "text_resume_template"),
            *reasons_of("path_question", question_words),
            *reasons_of("path_experience", experience_words),
            F.when(marks, "text_qmarks"),
            F.when(qa, "text_qa_pair"),
            F.when(told, "text_experience_kw"),
        )
    )
    names = lx.CLASS_NAMES

    def decide(s: Column) -> Column:
        best = F.greatest(s["t"], s["q"], s["e"])
        return F.struct(
            F.when(best == 0, names["other"])
            .when(s["t"] == best, names["template"])
            .when(s["q"] == best, names["question"])
            .otherwise(names["experience"])
            .alias("category"),
            F.coalesce(F.try_divide(best, s["t"] + s["q"] + s["e"]), F.lit(0.0)).alias("confidence"),
            F.array_join(
                bind(reasons, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(F.lit("no_match")))), ", "
            ).alias("reasons"),
        )

    return F.when(
        is_template,
        F.struct(
            F.lit(names["template"]).alias("category"),
            F.lit(1.0).alias("confidence"),
            F.lit("scan_template").alias("reasons"),
        ),
    ).otherwise(bind(scores, decide))


# --- keywords ---------------------------------------------------------------
def _character(c: str) -> str:
    return c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}"


def _branches(by_first: list[tuple[str, str]], most: int = 4) -> str:
    """One of the patterns, each behind its character; many are halved by a look at the next character."""
    if len(by_first) <= most:
        return "|".join(_character(c) + rest for c, rest in by_first)
    half = len(by_first) // 2
    return "|".join(
        f"(?=[{_character(side[0][0])}-{_character(side[-1][0])}])(?:{_branches(side, most)})"
        for side in (by_first[:half], by_first[half:])
    )


def keyword_pattern(words: list[str]) -> str:
    """The longest of ``words`` that stands at a place, at word boundaries; words are literals.

    The pattern is the words' tree of characters, so that a place costs the
    length of a word and the logarithm of how many ways it can go on, whatever
    the number of words.  Without words nothing matches.
    """
    ordered = sorted({w.lower() for w in words if w})
    if not ordered:
        return r"((?!))"

    def tree(low: int, high: int, depth: int) -> str:
        ends = len(ordered[low]) == depth
        ways, at = [], low + ends
        while at < high:
            first, start = ordered[at][depth], at
            while at < high and ordered[at][depth] == first:
                at += 1
            ways.append((first, chain(start, at, depth + 1)))
        if not ways:
            return ""
        return f"(?:{_branches(ways)}{'|' if ends else ''})"

    def chain(low: int, high: int, depth: int) -> str:
        # what all words share is written out, so that only forks nest
        a, b = ordered[low], ordered[high - 1]
        end = depth
        while end < min(len(a), len(b)) and a[end] == b[end]:
            end += 1
        return "".join(map(_character, a[depth:end])) + tree(low, high, end)

    return rf"\b({chain(0, len(ordered), 0)})\b"


def default_keywords() -> list[str]:
    return list(lx.TECH_WORDS)


def keywords(
    c: Column,
    k: int | None = 10,
    words: list[str] | None = None,
    term_patterns: list[str] = lx.TERM_PATTERNS,
    stop_words: list[str] | None = None,
) -> Column:
    """Top words of one text by frequency, ties by first occurrence; all without ``k``."""
    pattern = keyword_pattern(default_keywords() if words is None else words)
    stop = lx.STOP_WORDS if stop_words is None else stop_words
    found = [F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))]
    found += [
        F.filter(
            F.regexp_extract_all(c, F.lit(p), F.lit(0)),
            lambda t: ~t.isin(*stop) & (F.length(t) > 1),
        )
        for p in term_patterns
    ]
    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(top_by_count(F.concat(*found), k), none)


def chunk_keywords(question: Column, answer: Column, **options) -> Column:
    """Five from the question, then ten from the answer, ten in all."""
    return F.slice(
        F.array_distinct(
            F.concat(keywords(question, 5, **options), keywords(answer, 10, **options))
        ),
        1,
        10,
    )
