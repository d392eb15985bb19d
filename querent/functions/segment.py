"""Segmentation of one document: 1 row -> array of pieces, without a shuffle.

Boundaries are found by one regular expression that splits the text *before*
each marker line, so a document is scanned once.  Greedy packing is a fold
(``aggregate``) over the document's own paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .arrays import bind, fold_out, last, prefix_sums
from .patterns import BLANK_LINE, INLINE, LINE_BREAK, SPACE, WORD_CHARS
from .text import collapse_breaks, paragraphs, strip, unix_breaks

# What starts a question, what marks a step, what opens an answer.
STEP = (
    rf"(?i:第[\x{{4e00}}-\x{{5341}}\p{{Nd}}]+步"
    rf"|步骤{INLINE}*[\x{{4e00}}-\x{{5341}}\p{{Nd}}]+|step{INLINE}*\p{{Nd}}+)"
)
_S, _SP = f"{INLINE}*", f"{INLINE}*+"
_N, _NP = r"\p{Nd}", r"\p{Nd}"
# (marker, prefix of the question text, number group, text group)
QUESTION_MARKERS = [
    (rf"^#{{1,4}}{_S}({_N}+)[.、：:]?{_S}(.+)$", rf"#{{1,4}}+{_SP}{_N}++[.、：:]?+{_SP}", 1, 2),
    (rf"^#{{1,6}}{_S}(.+?[?？]){_S}$", rf"#{{1,6}}+{_SP}", 0, 1),
    (rf"^({_N}+)[.、：:]{_S}(.+?)(?:\?|？|$)", rf"{_N}++[.、：:]{_SP}", 1, 2),
    (rf"^[Qq]{_S}({_N}*)[.、：:]?{_S}(.+)$", rf"[Qq]{_SP}{_N}*+[.、：:]?+{_SP}", 1, 2),
    (rf"^问{_S}({_N}*)[.、：:]?{_S}(.+)$", rf"问{_SP}{_N}*+[.、：:]?+{_SP}", 1, 2),
    (rf"^【[问题]*({_N}*)】{_S}(.+)$", rf"【[问题]*+{_N}*+】{_SP}", 1, 2),
    (rf"^\*\*({_N}+)[.、]{_S}(.+?)\*\*", rf"\*\*{_N}++[.、]{_SP}", 1, 2),
    (rf"^{_S}[-*]{_S}(.+?[?？]){_S}$", rf"{_SP}[-*]{_SP}", 0, 1),
    (rf"^(?=.{{2,120}}$).*(?:{'|'.join(lx.QUESTION_TAILS)}){_S}$", None, 0, 0),
]
ANSWER_MARKS = [
    rf"^[Aa]{SPACE}*[.、:：]{SPACE}*",
    rf"^答{SPACE}*[.、:：]{SPACE}*",
    rf"^【答案?】{SPACE}*",
    rf"^解[答析]{SPACE}*[.、:：]?{SPACE}*",
]
HEADING = rf"^#{{1,6}}{_S}(.+)$"
CODE_PAIR = (
    rf"(?msd)^(#{{1,4}}{SPACE}*\p{{Nd}}*[.、,，]?{SPACE}*.+?)$"
    rf"{SPACE}*```[{WORD_CHARS}]*{SPACE}*(.+?)```"
)
SENTENCE_END = "。！？.!?"

PAIR = "struct<question:string,answer:string,question_num:int,start_pos:bigint,end_pos:bigint>"
PIECE = (
    "struct<content:string,question:string,answer:string,chunk_type:string,"
    "question_num:int,is_split:boolean,part:int,md_title:string,force_split:boolean>"
)


def _guarded(marker: str, prefix: str | None) -> str:
    """The marker, unless a step number stands where the question would."""
    return marker if prefix is None else f"^(?!{prefix}{STEP}){marker[1:]}"


_GUARDED = [_guarded(m, p) for m, p, _, _ in QUESTION_MARKERS]
_BEFORE_QUESTION = "(?md)^(?=" + "|".join(f"(?:{g[1:]})" for g in _GUARDED) + ")"
_BEFORE_HEADING = rf"(?md)^(?!#{{1,6}}+{_SP}{STEP})(?=#{{1,6}}{_S}.)"
_BEFORE_HASH = rf"(?md)^(?={_S}#)"
_BEFORE_SECTION = rf"(?md)^(?!{_SP}#++{_SP}{STEP})(?={_S}#)"


def normalise_document(c: Column) -> Column:
    return strip(collapse_breaks(unix_breaks(c)))


def clean_answer(c: Column) -> Column:
    for mark in ANSWER_MARKS:
        c = F.regexp_replace(c, "(?md)" + mark, "")
    return strip(c)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def _marker(line: Column) -> Column:
    """struct(head, text, num) of the first marker that fits the line, or null."""
    out = None
    for guarded, (marker, _, num, text) in zip(_GUARDED, QUESTION_MARKERS):
        m = "(?d)" + marker
        head = F.regexp_extract(line, m, 0)
        found = F.struct(
            head.alias("head"),
            (F.regexp_extract(line, m, text) if text else head).alias("text"),
            (F.regexp_extract(line, m, num) if num else F.lit("")).try_cast("int").alias("num"),
        )
        cond = line.rlike("(?d)" + guarded)
        out = F.when(cond, found) if out is None else out.when(cond, found)
    return out


def question_only(c: Column) -> Column:
    """Question texts of all marker lines, answered or not."""
    found = F.transform(
        F.split(normalise_document(c), _BEFORE_QUESTION, -1), lambda s: bind(first_line(s), _marker)
    )
    texts = F.transform(
        F.filter(found, lambda m: m.isNotNull()),
        lambda m: F.when(strip(m["text"]) != "", strip(m["text"])).otherwise(strip(m["head"])),
    )
    return F.filter(texts, lambda t: t != "")


def _with_offsets(sections: Column) -> Column:
    return F.struct(
        sections.alias("s"), prefix_sums(F.transform(sections, F.length)).alias("at")
    )


def pairs_by_markers(c: Column) -> Column:
    """Question/answer pairs from marker lines; ``c`` is a normalised document."""

    def build(v: Column) -> Column:
        rows = F.transform(
            v["s"],
            lambda s, i: bind(
                bind(first_line(s), _marker),
                lambda m: F.struct(
                    strip(m["head"]).alias("question"),
                    clean_answer(
                        strip(F.substr(s, F.length(m["head"]) + 1))
                    ).alias("answer"),
                    m["num"].alias("question_num"),
                    F.get(v["at"], i).alias("start_pos"),
                    F.get(v["at"], i + 1).alias("end_pos"),
                ),
            ),
        )
        return F.filter(rows, lambda r: r["question"].isNotNull() & (r["answer"] != ""))

    return bind(bind(F.split(c, _BEFORE_QUESTION, -1), _with_offsets), build)


def pairs_by_headings(c: Column) -> Column:
    """Every heading is a question, the text below it the answer."""

    def build(v: Column) -> Column:
        rows = F.transform(
            v["s"],
            lambda s, i: F.struct(
                F.when(
                    s.rlike(rf"(?d)^(?!#{{1,6}}+{_SP}{STEP})#{{1,6}}{_S}."), strip(first_line(s))
                ).alias("question"),
                clean_answer(
                    strip(F.substr(s, F.length(first_line(s)) + 1))
                ).alias("answer"),
                F.lit(None).cast("int").alias("question_num"),
                F.get(v["at"], i).alias("start_pos"),
                F.get(v["at"], i + 1).alias("end_pos"),
            ),
        )
        return F.filter(rows, lambda r: r["question"].isNotNull() & (r["answer"] != ""))

    return bind(bind(F.split(c, _BEFORE_HEADING, -1), _with_offsets), build)


def pairs_by_code(c: Column) -> Column:
    """Heading followed by a fenced block."""
    whole = F.regexp_extract_all(c, F.lit(CODE_PAIR), F.lit(0))
    ends = lambda t, found: F.aggregate(
        found,
        F.array(F.lit(0)),
        lambda acc, m: F.concat(
            acc,
            F.array(F.position(m, t, last(acc) + 1) - 1 + F.length(m)),
        ),
    )

    def build(v: Column) -> Column:
        return F.transform(
            v["m"],
            lambda m, i: bind(
                strip(F.regexp_extract(m, CODE_PAIR, 1)),
                lambda q: F.struct(
                    q.alias("question"),
                    strip(F.regexp_extract(m, CODE_PAIR, 2)).alias("answer"),
                    F.regexp_extract(q, r"(\p{Nd}+)", 1).try_cast("int").alias("question_num"),
                    (F.get(v["e"], i + 1) - F.length(m)).cast("bigint").alias("start_pos"),
                    F.get(v["e"], i + 1).cast("bigint").alias("end_pos"),
                ),
            ),
        )

    return bind(
        bind(
            F.struct(c.alias("t"), whole.alias("m")),
            lambda v: F.struct(v["m"].alias("m"), ends(v["t"], v["m"]).alias("e")),
        ),
        build,
    )


def pairs_by_paragraphs(c: Column) -> Column:
    """Paragraphs that look like a question own the paragraphs after them."""
    is_question = lambda p: (
        p.endswith("?") | p.endswith("？")
        | p.rlike(rf"^\p{{Nd}}+[.、]") | p.rlike(rf"^#{{1,4}}{SPACE}*\p{{Nd}}+")
    )

    def build(v: Column) -> Column:
        n = F.size(v["p"])
        rows = F.transform(
            v["q"],
            lambda i, j: bind(
                F.coalesce(F.get(v["q"], j + 1), n),
                lambda nxt: F.struct(
                    F.get(v["p"], i).alias("question"),
                    F.array_join(
                        F.filter(F.slice(v["p"], i + 2, nxt - i - 1), lambda x: x != ""), "\n\n"
                    ).alias("answer"),
                    F.lit(None).cast("int").alias("question_num"),
                    F.get(v["at"], i).alias("start_pos"),
                    F.get(v["at"], nxt).alias("end_pos"),
                ),
            ),
        )
        return F.filter(rows, lambda r: r["answer"] != "")

    def index(p: Column) -> Column:
        return F.struct(
            p.alias("p"),
            F.filter(
                F.sequence(F.lit(0), F.size(p) - 1),
                lambda i: is_question(F.get(p, i)),
            ).alias("q"),
            prefix_sums(F.transform(p, lambda x: F.length(x) + 2)).alias("at"),
        )

    return bind(bind(F.transform(F.split(c, BLANK_LINE, -1), strip), index), build)


def _or_null(arr: Column) -> Column:
    return bind(arr, lambda a: F.when(F.size(a) > 0, a))


def parse_pairs(c: Column) -> Column:
    """First strategy that finds pairs: markers, fenced blocks, paragraphs."""
    return bind(
        normalise_document(c),
        lambda t: F.coalesce(
            _or_null(pairs_by_markers(t)),
            _or_null(pairs_by_code(t)),
            pairs_by_paragraphs(t),
        ),
    )


def pair_text(p: Column) -> Column:
    return F.concat(p["question"], F.lit("\n\n"), p["answer"])


def pair_length(p: Column) -> Column:
    return F.length(p["question"]) + 2 + F.length(p["answer"])


def merge_short_pairs(pairs: Column, min_length: int = 50) -> Column:
    """A pair shorter than ``min_length`` absorbs the one after it."""
    short = lambda p: pair_length(p) < min_length

    def absorb(a: Column, b: Column) -> Column:
        return F.struct(
            a["question"].alias("question"),
            F.concat(a["answer"], F.lit("\n\n"), b["question"], F.lit("\n"), b["answer"]).alias("answer"),
            a["question_num"].alias("question_num"),
            a["start_pos"].alias("start_pos"),
            b["end_pos"].alias("end_pos"),
        )

    none = F.expr(f"cast(array() as array<{PAIR}>)")

    def step(s: Column, p: Column) -> Column:
        ready = s["held"].isNotNull() & ~short(s["held"])
        return F.struct(
            F.when(ready, F.array(s["held"])).otherwise(none).alias("put"),
            F.when(s["held"].isNull() | ready, p).otherwise(absorb(s["held"], p)).alias("held"),
        )

    return fold_out(
        pairs, PAIR, {"held": F.lit(None).cast(PAIR)}, step,
        lambda s: F.when(s["held"].isNotNull(), F.array(s["held"])).otherwise(none),
    )


# --- packing --------------------------------------------------------------
def _strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def pack_paragraphs(paras: Column, max_chars: Column) -> Column:
    """Greedy bins of paragraphs joined by a blank line.

    A separator costs two characters, except behind the first paragraph of
    every bin but the first.
    """

    def step(s: Column, p: Column) -> Column:
        n = F.length(p)
        full = (F.size(s["bin"]) > 0) & (s["len"] + n + 2 > max_chars)
        return F.struct(
            F.when(full, F.array(F.array_join(s["bin"], "\n\n"))).otherwise(_strings()).alias("put"),
            F.when(full, F.array(p)).otherwise(F.concat(s["bin"], F.array(p))).alias("bin"),
            F.when(full, n).otherwise(s["len"] + n + 2).alias("len"),
        )

    return fold_out(
        paras, "string", {"bin": _strings(), "len": F.lit(0)}, step,
        lambda s: F.when(F.size(s["bin"]) > 0, F.array(strip(F.array_join(s["bin"], "\n\n")))).otherwise(_strings()),
    )


def force_split(c: Column, size: int = 1500, overlap: int = 100) -> Column:
    """Windows of ``size`` characters that prefer to end behind a sentence.

    The text is fed in slices no longer than the smallest advance of a window,
    so a buffer of at most two windows is held and the cost stays linear in
    the length of the document.
    """
    half = size // 2
    slice_len = half + 2 - overlap
    ends = f"(?s)^(.*[{SENTENCE_END}\\n])"

    def step(s: Column, piece: Column) -> Column:
        return bind(
            F.struct(F.concat(s["buf"], piece["s"]).alias("buf"), piece["final"].alias("final")),
            lambda v: F.when(
                F.length(v["buf"]) > size,
                bind(
                    F.length(F.regexp_extract(F.substr(v["buf"], F.lit(half + 2), F.lit(size - half)), ends, 1)),
                    lambda m: bind(
                        F.when(m > 0, m + half + 1).otherwise(F.lit(size)),
                        lambda end: F.struct(
                            F.array(strip(F.substr(v["buf"], F.lit(1), end))).alias("put"),
                            F.when(v["final"] & (end == F.length(v["buf"])), F.lit(""))
                            .otherwise(F.substr(v["buf"], end - overlap + 1))
                            .alias("buf"),
                        ),
                    ),
                ),
            ).otherwise(F.struct(_strings().alias("put"), v["buf"].alias("buf"))),
        )

    pieces = bind(
        F.regexp_extract_all(c, F.lit(f"(?s).{{1,{slice_len}}}"), F.lit(0)),
        lambda ps: F.transform(
            ps,
            lambda s, i: F.struct(s.alias("s"), (i == F.size(ps) - 1).alias("final")),
        ),
    )
    return fold_out(
        pieces, "string", {"buf": F.lit("")}, step,
        lambda s: F.when(s["buf"] != "", F.array(strip(s["buf"]))).otherwise(_strings()), levels=2,
    )


def overlap_text(part: Column, size: int = 100) -> Column:
    """Tail of the last part: whole if short, else its last sentences."""
    sentences = F.reverse(F.split(part, f"[{SENTENCE_END}]", -1))

    def step(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & (F.length(acc["t"]) + F.length(s) <= size)
        return F.struct(
            F.when(fits, F.concat(s, F.lit("。"), acc["t"])).otherwise(acc["t"]).alias("t"),
            (~fits).alias("full"),
        )

    tail = F.aggregate(
        sentences,
        F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        step,
        lambda acc: strip(acc["t"]),
    )
    return F.when(F.length(part) <= size, part).otherwise(
        bind(tail, lambda t: F.when(t != "", t).otherwise(F.right(part, F.lit(size))))
    )


def _piece(
    content, question=None, answer=None, kind="text", num=None,
    is_split=None, part=None, title=None, forced=None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        content.alias("content"),
        (question if question is not None else null.cast("string")).alias("question"),
        (answer if answer is not None else null.cast("string")).alias("answer"),
        F.lit(kind).alias("chunk_type"),
        (num if num is not None else null.cast("int")).alias("question_num"),
        (is_split if is_split is not None else null.cast("boolean")).alias("is_split"),
        (part if part is not None else null.cast("int")).alias("part"),
        (title if title is not None else null.cast("string")).alias("md_title"),
        (forced if forced is not None else null.cast("boolean")).alias("force_split"),
    )


def split_long_pair(p: Column, size: int = 1500, overlap: int = 100) -> Column:
    """Parts of an over-long pair; each repeats the question and some context."""

    kind = "struct<content:string,answer:string>"
    none = F.expr(f"cast(array() as array<{kind}>)")

    def done(s: Column) -> Column:
        return F.array(F.struct(
            strip(s["text"]).alias("content"), F.array_join(s["parts"], "\n\n").alias("answer")
        ))

    def step(s: Column, para: Column) -> Column:
        full = (F.size(s["parts"]) > 0) & (F.length(s["text"]) + F.length(para) > size)
        fresh = F.concat(
            p["question"], F.lit("\n\n（续）\n\n"), overlap_text(last(s["parts"]), overlap),
            para, F.lit("\n\n"),
        )
        return F.struct(
            F.when(full, done(s)).otherwise(none).alias("put"),
            F.when(full, fresh).otherwise(F.concat(s["text"], para, F.lit("\n\n"))).alias("text"),
            F.when(full, F.array(para)).otherwise(F.concat(s["parts"], F.array(para))).alias("parts"),
        )

    parts = fold_out(
        paragraphs(p["answer"]), kind, {"text": F.concat(p["question"], F.lit("\n\n")), "parts": _strings()}, step,
        lambda s: F.when(F.size(s["parts"]) > 0, done(s)).otherwise(none),
    )
    return bind(
        parts,
        lambda ps: F.transform(
            ps,
            lambda x, i: _piece(
                x["content"], p["question"], x["answer"], "qa", p["question_num"],
                F.size(ps) > 1, F.when(F.size(ps) > 1, i + 1),
            ),
        ),
    )


def chunk_pairs(pairs: Column, size: int = 1500, overlap: int = 100) -> Column:
    """One chunk per pair, several for an over-long one."""
    return F.flatten(
        F.transform(
            pairs,
            lambda p: F.when(
                pair_length(p) > size,
                split_long_pair(p, size, overlap),
            ).otherwise(
                F.array(_piece(pair_text(p), p["question"], p["answer"], "qa", p["question_num"]))
            ),
        )
    )


def chunk_plain(c: Column, size: int = 1500, overlap: int = 100) -> Column:
    """Paragraphs packed to ``size`` with a tail of the chunk before."""

    none = F.expr(f"cast(array() as array<{PIECE}>)")

    def step(s: Column, para: Column) -> Column:
        over = F.length(s["cur"]) + F.length(para) > size
        tail = F.when(
            F.length(s["cur"]) > overlap, F.right(s["cur"], F.lit(overlap))
        ).otherwise(F.lit(""))
        forced = F.transform(force_split(para, size, overlap), lambda x: _piece(x, forced=F.lit(True)))
        begun = s["cur"] != ""
        return F.struct(
            F.when(~over, none).when(begun, F.array(_piece(strip(s["cur"])))).otherwise(forced).alias("put"),
            F.when(~over, F.concat(s["cur"], para, F.lit("\n\n")))
            .when(begun, F.concat(tail, F.lit("\n\n"), para, F.lit("\n\n")))
            .otherwise(F.lit("")).alias("cur"),
        )

    return fold_out(
        paragraphs(c), PIECE, {"cur": F.lit("")}, step,
        lambda s: F.when(strip(s["cur"]) != "", F.array(_piece(strip(s["cur"])))).otherwise(none),
    )


def _sections(c: Column, before: str) -> Column:
    """struct(title, body) per heading; a heading with no line below is dropped."""
    unified = F.regexp_replace(c, LINE_BREAK, "\n")

    def one(s: Column) -> Column:
        s = F.regexp_replace(s, r"\n\z", "")
        titled = s.rlike(before.replace("(?md)", "(?d)", 1))
        return F.when(
            titled,
            F.when(
                F.contains(s, F.lit("\n")),
                F.struct(
                    strip(first_line(s)).alias("title"),
                    strip(F.substr(s, F.length(first_line(s)) + 1)).alias("body"),
                ),
            ),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("title"), strip(s).alias("body")))

    found = F.filter(
        F.transform(F.filter(F.split(unified, before, -1), lambda s: s != ""), one),
        lambda s: s.isNotNull(),
    )
    return found


def _section_text(s: Column) -> Column:
    return F.when(
        s["title"].isNotNull(), strip(F.concat(s["title"], F.lit("\n\n"), s["body"]))
    ).otherwise(s["body"])


def chunk_markdown(c: Column, size: int = 1500, overlap: int = 100) -> Column:
    """One chunk per heading section; plain chunking where there is no heading."""

    def pieces(sections: Column) -> Column:
        return F.flatten(
            F.transform(
                sections,
                lambda s: bind(
                    _section_text(s),
                    lambda t: F.when(t == "", F.expr(f"cast(array() as array<{PIECE}>)"))
                    .when(
                        F.length(t) > size,
                        F.transform(
                            force_split(t, size, overlap),
                            lambda x: _piece(x, title=s["title"], forced=F.lit(True)),
                        ),
                    )
                    .otherwise(F.array(_piece(t, title=s["title"]))),
                ),
            )
        )

    return bind(
        _sections(c, _BEFORE_HASH),
        lambda found: F.when(
            (F.size(found) == 1) & F.get(found, F.lit(0))["title"].isNull(),
            chunk_plain(c, size, overlap),
        ).otherwise(pieces(found)),
    )


def split_sections(c: Column, max_chars: int) -> Column:
    """Heading sections cut to ``max_chars``; parts repeat the heading."""

    def cut(s: Column) -> Column:
        prefix = F.when(
            s["title"].isNotNull(), F.concat(s["title"], F.lit("\n\n"))
        ).otherwise(F.lit(""))
        return bind(
            F.struct(_section_text(s).alias("t"), prefix.alias("p"), s["body"].alias("b")),
            lambda v: F.when(F.length(v["t"]) <= max_chars, F.array(v["t"])).otherwise(
                F.transform(
                    pack_paragraphs(paragraphs(v["b"]), F.lit(max_chars) - F.length(v["p"])),
                    lambda x: strip(F.concat(v["p"], x)),
                )
            ),
        )

    return F.filter(
        F.flatten(F.transform(_sections(c, _BEFORE_SECTION), cut)), lambda x: x != ""
    )


def stable_id(kind: Column, source: Column, seq: Column, content: Column) -> Column:
    """Chunk id that does not depend on the run: kind and 16 hex digits."""
    digest = F.sha2(F.concat_ws("‖", source, seq.cast("string"), content), 256)
    return F.concat(kind, F.lit("_"), F.substr(digest, F.lit(1), F.lit(16)))
