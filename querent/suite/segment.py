"""Segmentation over all documents, dressed up with headings and markers.

The prose holds no headings or questions, so lines are given markers by their
first letter; the same rules build the input in Spark and in SQL.
"""

import re

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import segment as sg
from ..functions import text as tx
from ..functions.arrays import once
from ..functions.patterns import BLANK_LINE, DIGIT, INLINE, SPACE, WORD_CHARS
from ..operators.packing import pack_batches
from .registry import query
from .text import RAW_ITEMS_SQL, q_noise, q_question, raw_items
from .views import docs, lit, q_strip, q_sub, table, using

DRESS = [
    (r"^([TW])", r"### 2、\1"), (r"^(A.*)\.$", r"- \1?"), (r"^([OI])", r"7. \1"),
    (r"^(D)", r"## 3. 步骤二 \1"), (r"^(L.*)\.$", r"## \1?"), (r"^(R)", r"Q: \1"),
    (r"^(H)", r"问2：\1"), (r"^(N)", r"【问题3】\1"), (r"^(C[^ ]* [^ ]*)", r"**4. \1** "),
    (r"^(S)", r"A: \1"), (r"^(U.*)$", r"\1如何"), (r"^(F)", r"# \1"),
]
_BLANKS = r"\n([A-ZÉÈ])", "\n\n\\1"


def dress(text):
    """The text after all rules; those that only set a mark before a first letter need no expression."""
    t = F.concat(F.lit("\n"), text)
    for pattern, to in DRESS:
        letters = re.fullmatch(r"\^\(\[?([A-Z]+)\]?\)", pattern)
        if letters:
            for letter in letters[1]:
                t = F.replace(t, F.lit("\n" + letter), F.lit("\n" + to.replace("\\1", letter)))
        else:
            t = F.regexp_replace(t, "(?md)" + pattern, to.replace("\\1", "$1"))
    return F.substr(t, F.lit(2))


def dressed(spark, sf):
    return once(docs(spark, sf), text=dress(F.col("text"))).select("doc_id", "source_file", "category", "text")


def spaced(spark, sf):
    t = F.regexp_replace("text", _BLANKS[0], _BLANKS[1].replace("\\1", "$1"))
    return once(dressed(spark, sf), text=t)


def _sql_dress() -> str:
    t = "text"
    for pattern, to in DRESS:
        t = q_sub(t, "(?m)" + pattern, to)
    return t


V_DRESSED = f"v_dressed AS (SELECT doc_id, source_file, category, {_sql_dress()} AS text FROM v_docs)"
V_SPACED = f"{V_DRESSED}, v_spaced AS (SELECT doc_id, source_file, category, {q_sub('text', *_BLANKS)} AS text FROM v_dressed)"
NORMAL = q_strip(q_sub("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))", r"\n{3,}", "\n\n"))


def q_lines(source: str, text: str = "t") -> str:
    """(doc_id, pos, line, start) of every line of ``source``."""
    return f"""SELECT doc_id, pos, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS start
        FROM (SELECT doc_id, unnest(string_split({text}, chr(10))) AS line,
              generate_subscripts(string_split({text}, chr(10)), 1) AS pos FROM {source})"""


def _case_marker(value) -> str:
    return "CASE " + " ".join(
        f"WHEN mk = {i} THEN {value(m, num, text)}"
        for i, (m, _, num, text) in enumerate(sg.QUESTION_MARKERS)) + " END"


def _detect() -> str:
    out = []
    for i, (marker, prefix, num, text) in enumerate(sg.QUESTION_MARKERS):
        if prefix is None:
            tail = marker.replace("(?=.{2,120}$)", "")
            out.append(f"WHEN length(line) BETWEEN 2 AND 120 AND regexp_matches(line, {lit(tail)}) THEN {i}")
        else:
            out.append(f"WHEN regexp_matches(line, {lit(marker)}) AND NOT regexp_matches("
                       f"regexp_extract(line, {lit(marker)}, {text}), {lit('^' + sg.STEP)}) THEN {i}")
    return "CASE " + " ".join(out) + " END"


def q_answer(x: str) -> str:
    for mark in sg.ANSWER_MARKS:
        x = q_sub(x, "(?m)" + mark)
    return q_strip(x)


def _tail_free(marker: str) -> str:
    return marker.replace("(?=.{2,120}$)", "")


MARKED = f"""n AS (SELECT doc_id, {NORMAL} AS t FROM v_dressed), l AS ({q_lines("n")}),
    d AS (SELECT *, {_detect()} AS mk FROM l),
    hd AS (SELECT *, {_case_marker(lambda m, num, text: f"regexp_extract(line, {lit(_tail_free(m))}, 0)")} AS head,
        {_case_marker(lambda m, num, text: f"regexp_extract(line, {lit(m)}, {num})" if num else "''")} AS num,
        {_case_marker(lambda m, num, text: f"regexp_extract(line, {lit(m)}, {text})" if text else "line")} AS qtext,
        count(mk) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM d)"""
PAIRS = MARKED + f""", b AS (SELECT doc_id, grp, max(head) AS head, max(num) AS num, min(start) AS start,
        string_agg(CASE WHEN mk IS NULL THEN line ELSE substr(line, length(head) + 1) END, chr(10) ORDER BY pos) AS body
        FROM hd WHERE grp > 0 GROUP BY doc_id, grp),
    e AS (SELECT b.*, coalesce(lead(start) OVER (PARTITION BY b.doc_id ORDER BY grp), length(n.t)) AS stop
        FROM b JOIN n ON n.doc_id = b.doc_id),
    pairs AS (SELECT doc_id, {q_strip("head")} AS question, {q_answer(q_strip("body"))} AS answer,
        TRY_CAST(nullif(num, '') AS INTEGER) AS question_num, start::BIGINT AS start_pos, stop::BIGINT AS end_pos FROM e)"""


@query("g01_pairs_by_markers", using("v_docs", f", {V_DRESSED}, {PAIRS} SELECT * FROM pairs WHERE answer <> ''"))
def g01(spark, sf):
    d = dressed(spark, sf)
    return d.select("doc_id", F.inline(sg.pairs_by_markers(sg.normalise_document(F.col("text")))))


HEADED = f"""hn AS (SELECT doc_id, {NORMAL} AS t FROM v_dressed), hl AS ({q_lines("hn")}),
    hh AS (SELECT *, regexp_matches(line, {lit(sg.HEADING)}) AND NOT regexp_matches(
        regexp_extract(line, {lit(sg.HEADING)}, 1), {lit('^' + sg.STEP)}) AS mk FROM hl),
    hg AS (SELECT *, count_if(mk) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM hh),
    hb AS (SELECT doc_id, grp, min(start) AS start, string_agg(CASE WHEN mk THEN line END, '') AS head,
        string_agg(CASE WHEN NOT mk THEN line END, chr(10) ORDER BY pos) AS body FROM hg WHERE grp > 0 GROUP BY doc_id, grp),
    he AS (SELECT hb.*, coalesce(lead(start) OVER (PARTITION BY hb.doc_id ORDER BY grp), length(hn.t)) AS stop
        FROM hb JOIN hn ON hn.doc_id = hb.doc_id),
    headed AS (SELECT doc_id, {q_strip("head")} AS question, {q_answer(q_strip("coalesce(body, '')"))} AS answer,
        CAST(NULL AS INTEGER) AS question_num, start::BIGINT AS start_pos, stop::BIGINT AS end_pos FROM he)"""


@query("g05_pairs_by_headings", using("v_docs", f", {V_DRESSED}, {HEADED} SELECT * FROM headed WHERE answer <> ''"))
def g05(spark, sf):
    return dressed(spark, sf).select(
        "doc_id", F.inline(sg.pairs_by_headings(sg.normalise_document(F.col("text")))))


@query("g06_clean_answer", using("v_docs", f", {V_DRESSED} SELECT doc_id, {q_answer('text')} AS answer FROM v_dressed"))
def g06(spark, sf):
    return dressed(spark, sf).select("doc_id", sg.clean_answer(F.col("text")).alias("answer"))


@query("g08_questions_only", using("v_docs", f""", {V_DRESSED}, {MARKED}
    SELECT doc_id, CASE WHEN {q_strip("qtext")} <> '' THEN {q_strip("qtext")} ELSE {q_strip("head")} END AS question
    FROM hd WHERE mk IS NOT NULL"""))
def g08(spark, sf):
    return dressed(spark, sf).select("doc_id", F.explode(sg.question_only(F.col("text"))).alias("question"))


@query("w07_marker_spans", using("v_docs", f", {V_DRESSED}, {PAIRS} SELECT doc_id, start_pos, end_pos FROM pairs WHERE answer <> ''"))
def w07(spark, sf):
    """Where markers that do not overlap begin and end."""
    return g01(spark, sf).select("doc_id", "start_pos", "end_pos")


def _q_paragraph_pairs(view: str) -> str:
    return f"""sp AS (SELECT doc_id, {NORMAL} AS t FROM {view}),
    pp AS (SELECT doc_id, i, {q_strip("p")} AS p FROM (SELECT doc_id, unnest(string_split_regex(t, {lit(BLANK_LINE)})) AS p,
        generate_subscripts(string_split_regex(t, {lit(BLANK_LINE)}), 1) AS i FROM sp)),
    pq AS (SELECT *, p LIKE '%?' OR p LIKE '%？' OR regexp_matches(p, {lit(chr(94) + DIGIT + '+[.、]')}) OR regexp_matches(p, {lit('^#{1,4}' + SPACE + '*' + DIGIT + '+')}) AS isq,
        sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2 AS at_ FROM pp),
    pg AS (SELECT *, count_if(isq) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS grp FROM pq),
    pb AS (SELECT doc_id, grp, max(CASE WHEN isq THEN p END) AS question, string_agg(CASE WHEN NOT isq AND p <> '' THEN p END, chr(10) || chr(10) ORDER BY i) AS answer,
        min(at_)::BIGINT AS start_pos, max(at_ + length(p) + 2)::BIGINT AS end_pos FROM pg WHERE grp > 0 GROUP BY doc_id, grp)"""


def _q_all_pairs(view: str) -> str:
    """``allp``: pairs by markers, else by paragraphs; ``k`` counts them per document."""
    return f"""{PAIRS.replace("v_dressed", view)}, {_q_paragraph_pairs(view)},
    allq AS (SELECT * FROM pairs WHERE answer <> '' UNION ALL SELECT doc_id, question, answer, CAST(NULL AS INTEGER), start_pos, end_pos FROM pb
        WHERE answer IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM pairs WHERE answer <> '')),
    allp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) AS k FROM allq)"""


@query("g04_parse_pairs", using("v_docs", f", {V_SPACED}, {_q_all_pairs('v_spaced')} SELECT doc_id, question, answer, question_num, start_pos, end_pos FROM allp"))
def g04(spark, sf):
    return spaced(spark, sf).select("doc_id", F.inline(sg.parse_pairs(F.col("text"))))


_SHORT = "length(m.question) + 2 + length(m.answer) < 120"


@query("g07_merge_short_pairs", using("v_docs", f""", {V_DRESSED}, {_q_all_pairs('v_dressed')},
    m AS (SELECT doc_id, k, question, answer, question_num, start_pos, end_pos, 1 AS part FROM allp WHERE k = 1
        UNION ALL SELECT o.doc_id, o.k, CASE WHEN {_SHORT} THEN m.question ELSE o.question END,
            CASE WHEN {_SHORT} THEN m.answer || chr(10) || chr(10) || o.question || chr(10) || o.answer ELSE o.answer END,
            CASE WHEN {_SHORT} THEN m.question_num ELSE o.question_num END, CASE WHEN {_SHORT} THEN m.start_pos ELSE o.start_pos END,
            o.end_pos, CASE WHEN {_SHORT} THEN part ELSE part + 1 END
        FROM m JOIN allp o ON o.doc_id = m.doc_id AND o.k = m.k + 1)
    SELECT doc_id, question, answer, question_num, start_pos, end_pos FROM m
    QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY k DESC) = 1"""))
def g07(spark, sf):
    return dressed(spark, sf).select(
        "doc_id", F.inline(sg.merge_short_pairs(sg.parse_pairs(F.col("text")), 120)))


def _q_overlap(source: str, name: str) -> str:
    """CTE ``name``(id, k, tail): overlap text of every ``source``(id, k, p)."""
    return f"""{name}_s AS (SELECT id, k, p, unnest(string_split_regex(p, {lit('[' + sg.SENTENCE_END + ']')})) AS s,
        generate_subscripts(string_split_regex(p, {lit('[' + sg.SENTENCE_END + ']')}), 1) AS i FROM {source}),
    {name}_u AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY id, k ORDER BY i DESC) - length(s) - 1 + length(s) <= 100 AS fits FROM {name}_s),
    {name}_f AS (SELECT *, bool_and(fits) OVER (PARTITION BY id, k ORDER BY i DESC) AS taken FROM {name}_u),
    {name}_t AS (SELECT id, k, any_value(p) AS p, {q_strip("coalesce(string_agg(CASE WHEN taken THEN s || '。' END, '' ORDER BY i), '')")} AS t FROM {name}_f GROUP BY id, k),
    {name} AS (SELECT id, k, CASE WHEN length(p) <= 100 THEN p WHEN t <> '' THEN t ELSE right(p, 100) END AS tail FROM {name}_t)"""


def _q_split_long(source: str) -> str:
    """CTE ``parts``(id, n, content, answer, total): parts of ``source``(id, q, a)."""
    full = "z.n > 0 AND length(z.text) + length(x.p) > 1500"
    gap = "chr(10) || chr(10)"
    return f"""lp AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, p FROM (
            SELECT id, i, {q_strip("p")} AS p FROM (SELECT id, unnest(string_split_regex(a, {lit(BLANK_LINE)})) AS p,
                generate_subscripts(string_split_regex(a, {lit(BLANK_LINE)}), 1) AS i FROM {source})) WHERE p <> ''),
    {_q_overlap("lp", "ov")},
    lk AS (SELECT lp.id, lp.k, lp.p, ov.tail FROM lp LEFT JOIN ov ON ov.id = lp.id AND ov.k = lp.k - 1),
    z AS (SELECT id, q, 0::BIGINT AS k, q || {gap} AS text, '' AS parts, 0 AS n, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS VARCHAR) AS had FROM {source}
        UNION ALL SELECT z.id, z.q, x.k,
            CASE WHEN {full} THEN z.q || {gap} || '（续）' || {gap} || x.tail || x.p || {gap} ELSE z.text || x.p || {gap} END,
            CASE WHEN {full} OR z.n = 0 THEN x.p ELSE z.parts || {gap} || x.p END, CASE WHEN {full} THEN 1 ELSE z.n + 1 END,
            CASE WHEN {full} THEN {q_strip("z.text")} END, CASE WHEN {full} THEN z.parts END
        FROM z JOIN lk x ON x.id = z.id AND x.k = z.k + 1),
    ends AS (SELECT id, k, done AS content, had AS answer FROM z WHERE done IS NOT NULL
        UNION ALL SELECT id, k + 1, {q_strip("text")}, parts FROM z WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
    parts AS (SELECT id, content, answer, row_number() OVER (PARTITION BY id ORDER BY k) AS n, count(*) OVER (PARTITION BY id) AS total FROM ends)"""


_PIECE_TAIL = "CAST(NULL AS VARCHAR) AS md_title, CAST(NULL AS BOOLEAN) AS force_split"


@query("g09_chunk_pairs", using("v_docs", f""", {V_SPACED}, {_q_all_pairs('v_spaced')},
    lsrc AS (SELECT doc_id * 4294967296 + k AS id, question AS q, answer AS a FROM allp WHERE length(question) + 2 + length(answer) > 1500), {_q_split_long('lsrc')},
    every_ AS (SELECT doc_id, k, 1 AS n, question || chr(10) || chr(10) || answer AS content, question, answer, question_num,
            CAST(NULL AS BOOLEAN) AS is_split, CAST(NULL AS INTEGER) AS part FROM allp WHERE length(question) + 2 + length(answer) <= 1500
        UNION ALL SELECT doc_id, k, n, content, question, parts.answer, question_num, total > 1, CASE WHEN total > 1 THEN n::INTEGER END
        FROM allp JOIN parts ON parts.id = doc_id * 4294967296 + k)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, n) - 1)::INTEGER AS seq, content, question, answer, 'qa' AS chunk_type,
        question_num, is_split, part, {_PIECE_TAIL} FROM every_"""))
def g09(spark, sf):
    return spaced(spark, sf).select("doc_id", F.posexplode(sg.chunk_pairs(sg.parse_pairs(F.col("text")))).alias("seq", "c")).select("doc_id", "seq", "c.*")


@query("g02_pairs_by_code", f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    p AS (SELECT doc_id, ls[i] AS q, ls[i + 1] AS a, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls), 2)) AS i FROM s))
    SELECT doc_id, {q_strip("'## ' || q")} AS question, {q_strip("a")} AS answer,
        TRY_CAST(nullif(regexp_extract({q_strip("'## ' || q")}, '([0-9]+)', 1), '') AS INTEGER) AS question_num
    FROM p WHERE {q_strip("q")} <> '' AND {q_strip("a")} <> '' AND NOT contains(a, '`') AND NOT contains(q, '`')""")
def g02(spark, sf):
    """Every odd line as a heading over its next line in a fence."""
    lines = F.split("text", "\n", -1)
    dress = F.array_join(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(lines))),
            lambda i: F.concat(F.lit("## "), F.get(lines, i), F.lit("\n```\n"), F.get(lines, i + 1), F.lit("\n```")),
        ), "\n\n")
    return table(spark, sf, "documents").select("doc_id", F.inline(sg.pairs_by_code(dress))).drop("start_pos", "end_pos")


@query("g03_pairs_by_paragraphs", using("v_docs", f", {V_SPACED}, {_q_paragraph_pairs('v_spaced')} SELECT doc_id, question, answer, start_pos, end_pos FROM pb WHERE answer IS NOT NULL"))
def g03(spark, sf):
    return spaced(spark, sf).select("doc_id", F.inline(sg.pairs_by_paragraphs(
        sg.normalise_document(F.col("text"))))).drop("question_num")


@query("w06_section_islands", using("v_docs", f""", {V_SPACED}, sl AS ({q_lines("v_spaced", "text")}),
    si AS (SELECT doc_id, line, count_if(regexp_matches(line, {lit('^' + INLINE + '*#')})) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS grp FROM sl)
    SELECT doc_id, grp, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM si WHERE grp > 0 GROUP BY doc_id, grp"""))
def w06(spark, sf):
    """Lines and characters per heading section; the boundary splits the text."""
    parts = F.filter(F.split("text", rf"(?md)^(?={INLINE}*#)", -1), lambda s: s.rlike(f"^{INLINE}*#"))
    s = spaced(spark, sf).select("doc_id", F.posexplode(parts).alias("i", "s"), F.size(parts).alias("n"))
    body = F.when(F.col("i") < F.col("n") - 1, F.regexp_replace("s", r"\n\z", "")).otherwise(F.col("s"))
    lines = F.split(body, "\n", -1)
    return s.select("doc_id", (F.col("i") + 1).cast("bigint").alias("grp"), F.size(lines).cast("bigint").alias("lines"),
                    (F.length(body) - F.size(lines) + 1).cast("bigint").alias("chars"))


@query("g10_split_long_pairs", using("v_docs", f""", {V_SPACED}, lsrc AS (SELECT doc_id AS id, split_part(text, '.', 1) AS q, text AS a FROM v_spaced), {_q_split_long('lsrc')}
    SELECT id AS doc_id, (n - 1)::INTEGER AS seq, content, q AS question, answer, 'qa' AS chunk_type, 1 AS question_num, total > 1 AS is_split,
        CASE WHEN total > 1 THEN n::INTEGER END AS part, {_PIECE_TAIL} FROM parts JOIN lsrc USING (id)"""))
def g10(spark, sf):
    """Every document as the answer of one long pair."""
    pair = F.struct(F.split_part("text", F.lit("."), F.lit(1)).alias("question"), F.col("text").alias("answer"), F.lit(1).alias("question_num"))
    return spaced(spark, sf).select("doc_id", F.posexplode(sg.split_long_pair(pair)).alias("seq", "c")).select("doc_id", "seq", "c.*")


@query("g11_overlap_text", using("v_docs", f", o AS (SELECT doc_id AS id, 1 AS k, text AS p FROM v_docs), {_q_overlap('o', 'ov')} SELECT id AS doc_id, tail FROM ov"))
def g11(spark, sf):
    return docs(spark, sf).select("doc_id", sg.overlap_text(F.col("text")).alias("tail"))


# --- packing ------------------------------------------------------------------
_PARAS = f"""pr AS (SELECT doc_id, i, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
        SELECT doc_id, i, {q_strip("p")} AS p FROM (SELECT doc_id,
            unnest(string_split_regex(text, {lit(BLANK_LINE)})) AS p,
            generate_subscripts(string_split_regex(text, {lit(BLANK_LINE)}), 1) AS i FROM v_spaced)) WHERE p <> '')"""


def q_force(source: str, name: str, size: int = 1500, overlap: int = 100) -> str:
    """Recursive CTE ``name``(id, t, s, e, k) of forced windows over ``source``(id, t)."""
    half = size // 2

    def end(s: str) -> str:
        found = f"length(regexp_extract(substr(t, CAST({s} + {half + 2} AS INTEGER), {size - half}), {lit('(?s)^(.*[' + sg.SENTENCE_END + chr(92) + 'n])')}, 1))"
        return (f"CASE WHEN {s} + {size} < length(t) AND {found} > 0 THEN {s} + {half + 1} + {found}"
                f" ELSE {s} + {size} END")

    return f"""{name} AS (SELECT id, t, 0::BIGINT AS s, {end("0::BIGINT")} AS e, 1 AS k FROM {source} WHERE length(t) > 0
        UNION ALL SELECT id, t, e - {overlap}, {end(f"(e - {overlap})")}, k + 1 FROM {name} WHERE e < length(t))"""


@query("g14_force_split", f"""WITH RECURSIVE src AS (SELECT doc_id AS id, text AS t FROM documents), {q_force("src", "f")}
    SELECT id AS doc_id, (k - 1)::INTEGER AS seq, {q_strip("substr(t, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))")} AS content FROM f""")
def g14(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(sg.force_split(F.col("text"))).alias("seq", "content"))


def _q_plain(source: str) -> str:
    """CTE ``plain``(id, k, j, content, forced): plain chunks of ``source``(id, text), in order of k, j."""
    return f"""ppr AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, p FROM (SELECT id, i, {q_strip("p")} AS p FROM (SELECT id,
            unnest(string_split_regex(text, {lit(BLANK_LINE)})) AS p, generate_subscripts(string_split_regex(text, {lit(BLANK_LINE)}), 1) AS i FROM {source})) WHERE p <> ''),
    pw AS (SELECT id, 0::BIGINT AS k, '' AS cur, CAST(NULL AS VARCHAR) AS emitted, CAST(NULL AS VARCHAR) AS forced FROM {source}
      UNION ALL
      SELECT pw.id, x.k,
        CASE WHEN length(cur) + length(p) <= 1500 THEN cur || p || chr(10) || chr(10)
             WHEN cur <> '' THEN CASE WHEN length(cur) > 100 THEN right(cur, 100) ELSE '' END || chr(10) || chr(10) || p || chr(10) || chr(10)
             ELSE '' END,
        CASE WHEN length(cur) + length(p) > 1500 AND cur <> '' THEN {q_strip("cur")} END,
        CASE WHEN length(cur) + length(p) > 1500 AND cur = '' THEN p END
      FROM pw JOIN ppr x ON x.id = pw.id AND x.k = pw.k + 1),
    plast AS (SELECT id, max(k) AS k FROM pw GROUP BY id),
    pfsrc AS (SELECT id * 4294967296 + k AS id, forced AS t FROM pw WHERE forced IS NOT NULL), {q_force("pfsrc", "pf")},
    plain AS (SELECT id, k, 0 AS j, emitted AS content, false AS forced FROM pw WHERE emitted IS NOT NULL
        UNION ALL SELECT pw.id, pw.k + 1, 0, {q_strip("cur")}, false FROM pw JOIN plast ON pw.id = plast.id AND pw.k = plast.k WHERE {q_strip("cur")} <> ''
        UNION ALL SELECT id // 4294967296, id % 4294967296, k, {q_strip("substr(t, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))")}, true FROM pf)"""


def _q_markdown(source: str) -> str:
    """CTEs ``bare``(id, text), documents without a heading, and ``headings_``(id, k, j, title, content, forced)
    of the others of ``source``(id, text)."""
    return f"""ml AS (SELECT id, pos, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source})),
    mh AS (SELECT *, count_if(regexp_matches(line, {lit('^' + INLINE + '*#')})) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS grp,
        regexp_matches(line, {lit('^' + INLINE + '*#')}) AS mk FROM ml),
    ms0 AS (SELECT id, grp, string_agg(CASE WHEN mk THEN {q_strip("line")} END, '') AS title, count_if(NOT mk) AS below, bool_or(NOT mk AND line <> '') AS filled, count(*) AS lines,
        {q_strip("string_agg(CASE WHEN NOT mk THEN line END, chr(10) ORDER BY pos)")} AS body FROM mh GROUP BY id, grp),
    ms AS (SELECT * FROM ms0 WHERE below > 0 AND (grp > 0 OR filled OR lines > 1)),
    bare AS (SELECT id, text FROM {source} WHERE id IN (SELECT id FROM ms GROUP BY id HAVING count(*) = 1 AND max(title) IS NULL)),
    mt AS (SELECT id * 4294967296 + grp AS id, title, {q_strip("CASE WHEN title IS NOT NULL THEN title || chr(10) || chr(10) || body ELSE body END")} AS t FROM ms
        WHERE id NOT IN (SELECT id FROM bare)),
    mfsrc AS (SELECT id, t FROM mt WHERE length(t) > 1500), {q_force("mfsrc", "mf")},
    headings_ AS (SELECT id // 4294967296 AS id, id % 4294967296 AS k, 0 AS j, title, t AS content, false AS forced FROM mt WHERE t <> '' AND length(t) <= 1500
        UNION ALL SELECT mf.id // 4294967296, mf.id % 4294967296, k, mt.title, {q_strip("substr(mf.t, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))")}, true FROM mf JOIN mt ON mf.id = mt.id)"""


@query("g12_chunk_plain", using("v_docs", f""", {V_SPACED}, gsrc AS (SELECT doc_id AS id, text FROM v_spaced), {_q_plain("gsrc")}
    SELECT id AS doc_id, content, forced FROM plain"""))
def g12(spark, sf):
    return spaced(spark, sf).select("doc_id", F.inline(sg.chunk_plain(F.col("text")))).select(
        "doc_id", "content", F.coalesce("force_split", F.lit(False)).alias("forced"))


@query("g13_chunk_markdown", using("v_docs", f""", {V_SPACED}, gsrc AS (SELECT doc_id AS id, text FROM v_spaced), {_q_markdown("gsrc")}, {_q_plain("bare")}
    SELECT id AS doc_id, title AS md_title, content, forced FROM headings_ UNION ALL SELECT id, NULL, content, forced FROM plain"""))
def g13(spark, sf):
    """Sections by heading; documents without one go the plain way."""
    return spaced(spark, sf).select("doc_id", F.inline(sg.chunk_markdown(F.col("text")))).select(
        "doc_id", "md_title", "content", F.coalesce("force_split", F.lit(False)).alias("forced"))


def q_chunks(view: str) -> str:
    """CTE ``chunks`` as the parse job makes them of ``view``(doc_id, source_file, category, bank, md, text)."""
    short = "length(m.question) + 2 + length(m.answer) < 50"
    gap = "chr(10) || chr(10)"
    none = "CAST(NULL AS VARCHAR)"
    return f"""{_q_all_pairs(view)}, {HEADED.replace("v_dressed", view)},
    owned AS (SELECT p.doc_id, start_pos, 0 AS tag, question, answer, question_num FROM allp p JOIN {view} USING (doc_id) WHERE bank
        UNION ALL SELECT h.doc_id, h.start_pos, 1, h.question, h.answer, h.question_num FROM headed h JOIN {view} USING (doc_id) WHERE bank AND h.answer <> ''
            AND NOT EXISTS (SELECT 1 FROM allp p WHERE p.doc_id = h.doc_id AND p.start_pos <= h.start_pos AND h.end_pos <= p.end_pos)),
    texts AS (SELECT p.* FROM allp p JOIN {view} USING (doc_id) WHERE NOT bank),
    m AS (SELECT doc_id, k, question, answer, question_num, 1 AS part FROM texts WHERE k = 1
        UNION ALL SELECT o.doc_id, o.k, CASE WHEN {short} THEN m.question ELSE o.question END,
            CASE WHEN {short} THEN m.answer || {gap} || o.question || chr(10) || o.answer ELSE o.answer END,
            CASE WHEN {short} THEN m.question_num ELSE o.question_num END, CASE WHEN {short} THEN part ELSE part + 1 END
        FROM m JOIN texts o ON o.doc_id = m.doc_id AND o.k = m.k + 1),
    every_pair AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, tag) AS k, question, answer, question_num FROM owned WHERE length({q_strip("answer")}) >= 20
        UNION ALL SELECT doc_id, part, question, answer, question_num FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY k DESC) = 1),
    lsrc AS (SELECT doc_id * 4294967296 + k AS id, question AS q, answer AS a FROM every_pair WHERE length(question) + 2 + length(answer) > 1500), {_q_split_long("lsrc")},
    rest AS (SELECT doc_id AS id, md, text FROM {view} WHERE NOT bank AND {q_strip("text")} <> '' AND doc_id NOT IN (SELECT doc_id FROM texts)),
    mdsrc AS (SELECT id, text FROM rest WHERE md), {_q_markdown("mdsrc")},
    plsrc AS (SELECT id, text FROM rest WHERE NOT md UNION ALL SELECT id, text FROM bare), {_q_plain("plsrc")},
    pieces AS (SELECT doc_id, k, 1 AS j, question || {gap} || answer AS content, question, answer, 'qa' AS chunk_type, question_num,
            {none} AS is_split, {none} AS part, {none} AS md_title, {none} AS force_split FROM every_pair WHERE length(question) + 2 + length(answer) <= 1500
        UNION ALL SELECT doc_id, k, n, content, question, parts.answer, 'qa', question_num, CASE WHEN total > 1 THEN 'true' ELSE 'false' END,
            CASE WHEN total > 1 THEN CAST(n AS VARCHAR) END, NULL, NULL FROM every_pair JOIN parts ON parts.id = doc_id * 4294967296 + k
        UNION ALL SELECT id, k, j, content, NULL, NULL, 'text', NULL, NULL, NULL, title, CASE WHEN forced THEN 'true' END FROM headings_
        UNION ALL SELECT id, k, j, content, NULL, NULL, 'text', NULL, NULL, NULL, NULL, CASE WHEN forced THEN 'true' END FROM plain),
    numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INTEGER AS seq FROM pieces),
    chunks AS (SELECT concat(CASE WHEN chunk_type = 'qa' THEN 'qa' WHEN md_title IS NOT NULL THEN 'md' ELSE 'text' END, '_',
            substr(sha256(concat_ws('‖', source_file, seq, content)), 1, 16)) AS chunk_id, source_file, seq, content, question, answer, chunk_type, question_num,
        concat_ws(';', 'category=' || category, 'force_split=' || force_split, 'is_split=' || is_split, 'md_title=' || md_title, 'part=' || part) AS about
        FROM numbered JOIN {view} USING (doc_id))"""


def shown_chunks(chunks):
    """Chunk rows with their metadata as text, entries in order of their names."""
    entries = F.array_sort(F.map_entries("metadata"))
    return chunks.select(
        "chunk_id", "source_file", "seq", "content", "question", "answer", "chunk_type", "question_num",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("about"))


def q_pack(source: str, name: str, limit: str, sep: int = 2) -> str:
    """Recursive CTE assigning bins to ``source``(doc_id, k, p)."""
    return f"""{name} AS (SELECT doc_id, k, p, 1 AS bin, length(p) + {sep} AS used FROM {source} WHERE k = 1
        UNION ALL SELECT q.doc_id, q.k, q.p,
            CASE WHEN used + length(q.p) + {sep} > {limit} THEN bin + 1 ELSE bin END,
            CASE WHEN used + length(q.p) + {sep} > {limit} THEN length(q.p) ELSE used + length(q.p) + {sep} END
        FROM {name} b JOIN {source} q ON q.doc_id = b.doc_id AND q.k = b.k + 1)"""


@query("g16_pack_paragraphs", using("v_docs", f""", {V_SPACED}, {_PARAS}, {q_pack("pr", "b", "600")}
    SELECT doc_id, bin - 1 AS seq, {q_strip("string_agg(p, chr(10) || chr(10) ORDER BY k)")} AS content
    FROM b GROUP BY doc_id, bin"""))
def g16(spark, sf):
    return spaced(spark, sf).select("doc_id", F.posexplode(
        sg.pack_paragraphs(tx.paragraphs(F.col("text")), F.lit(600))).alias("seq", "content"))


def q_sections(view: str, size: int) -> str:
    """CTE ``sections``(doc_id, seq, section): heading sections of ``view``(doc_id, text), parts of at most ``size``."""
    return f"""sl AS ({q_lines(view, "text")}),
    sk AS (SELECT *, regexp_matches(line, {lit('^' + INLINE + '*#')}) AND NOT regexp_matches(line, {lit('^' + INLINE + '*#+' + INLINE + '*' + sg.STEP)}) AS mk FROM sl),
    sh AS (SELECT *, count_if(mk) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS grp FROM sk),
    ss AS (SELECT doc_id * 4294967296 + grp AS id, string_agg(CASE WHEN mk THEN {q_strip("line")} END, '') AS title,
        {q_strip("string_agg(CASE WHEN NOT mk THEN line END, chr(10) ORDER BY pos)")} AS body FROM sh GROUP BY doc_id, grp HAVING count_if(NOT mk) > 0),
    st AS (SELECT id, body, CASE WHEN title IS NOT NULL THEN title || chr(10) || chr(10) ELSE '' END AS head,
        CASE WHEN title IS NOT NULL THEN {q_strip("title || chr(10) || chr(10) || body")} ELSE body END AS t FROM ss),
    qp AS (SELECT id AS doc_id, head, {size} - length(head) AS lim, p, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM (
        SELECT id, head, i, {q_strip("p")} AS p FROM (SELECT id, head, unnest(string_split_regex(body, {lit(BLANK_LINE)})) AS p,
            generate_subscripts(string_split_regex(body, {lit(BLANK_LINE)}), 1) AS i FROM st WHERE length(t) > {size})) WHERE p <> ''), {q_pack("qp", "qb", "q.lim")},
    cut AS (SELECT b.doc_id AS id, bin, {q_strip("any_value(head) || string_agg(b.p, chr(10) || chr(10) ORDER BY b.k)")} AS section
            FROM qb b JOIN qp ON qp.doc_id = b.doc_id AND qp.k = b.k GROUP BY b.doc_id, bin
        UNION ALL SELECT id, 0, t FROM st WHERE length(t) <= {size}),
    sections AS (SELECT id // 4294967296 AS doc_id, (row_number() OVER (PARTITION BY id // 4294967296 ORDER BY id, bin) - 1)::INTEGER AS seq, section FROM cut WHERE section <> '')"""


@query("g15_split_sections", using("v_docs", f", {V_SPACED}, {q_sections('v_spaced', 900)} SELECT * FROM sections"))
def g15(spark, sf):
    return spaced(spark, sf).select("doc_id", F.posexplode(sg.split_sections(F.col("text"), 900)).alias("seq", "section"))


_ITEMS = f"""i AS {RAW_ITEMS_SQL}, c AS (SELECT doc_id AS file, seq % 2 AS hint, doc_id * 4294967296 + seq AS ord, {q_question("item")} AS q FROM i),
    pr AS (SELECT file * 2 + hint AS doc_id, ord, q AS p, row_number() OVER (PARTITION BY file, hint ORDER BY ord) AS k FROM c WHERE NOT {q_noise("q")})"""


def _pack_items() -> str:
    return """b AS (SELECT doc_id, ord, k, 1 AS batch, length(p) + 2 AS used, 1 AS n FROM pr WHERE k = 1
        UNION ALL SELECT q.doc_id, q.ord, q.k,
            CASE WHEN used + length(q.p) + 2 > 800 OR n >= 12 THEN batch + 1 ELSE batch END,
            CASE WHEN used + length(q.p) + 2 > 800 OR n >= 12 THEN length(q.p) ELSE used + length(q.p) + 2 END,
            CASE WHEN used + length(q.p) + 2 > 800 OR n >= 12 THEN 1 ELSE n + 1 END
        FROM b JOIN pr q ON q.doc_id = b.doc_id AND q.k = b.k + 1)"""


@query("g17_pack_batches", f"""WITH RECURSIVE {_ITEMS}, {_pack_items()}
    SELECT doc_id // 2 AS file, doc_id % 2 AS hint, ord, batch::BIGINT AS batch FROM b""")
def g17(spark, sf):
    items = raw_items(spark, sf).select(
        F.col("doc_id").alias("file"), (F.col("seq") % 2).cast("bigint").alias("hint"),
        (F.col("doc_id") * 4294967296 + F.col("seq")).alias("ord"),
        tx.normalise_question(F.col("item")).alias("q0"))
    items = once(items, q=F.col("q0")).drop("q0")
    return pack_batches(items.where(~tx.is_question_noise(F.col("q"))), ["file", "hint"], "ord", "q", 800, 12)


@query("g18_stable_ids", using("v_docs", f""", src AS (SELECT doc_id AS id, text AS t FROM v_docs), {q_force("src", "f")}
    SELECT d.doc_id, (k - 1)::INTEGER AS seq, concat('text_', substr(sha256(concat_ws('‖', d.source_file, k - 1,
        {q_strip("substr(t, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))")})), 1, 16)) AS chunk_id
    FROM f JOIN v_docs d ON d.doc_id = f.id"""))
def g18(spark, sf):
    c = docs(spark, sf).select("doc_id", "source_file", F.posexplode(sg.force_split(F.col("text"))).alias("seq", "content"))
    return c.select("doc_id", "seq", sg.stable_id(
        F.lit("text"), F.col("source_file"), F.col("seq"), F.col("content")).alias("chunk_id"))


# --- keywords -------------------------------------------------------------------
DEMO_WORDS = ["the", "tion", "eau", "und", "that", "with", "les", "der", "que", "para"]


def _q_keywords(source: str, text: str, k: int) -> str:
    # A one-word dictionary matches whole words: maximal runs of word characters.
    return f"""SELECT id, w, place FROM (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos)) AS place
        FROM (SELECT id, unnest(string_split_regex(lower({text}), '[^{WORD_CHARS}]')) AS w,
              generate_subscripts(string_split_regex(lower({text}), '[^{WORD_CHARS}]'), 1) AS pos FROM {source})
        WHERE w IN ({", ".join(map(lit, DEMO_WORDS))}) GROUP BY id, w) WHERE place <= {k}"""


@query("g19_keywords", f"""WITH s AS (SELECT doc_id AS id, text AS t FROM documents), k AS ({_q_keywords("s", "t", 5)})
    SELECT s.id AS doc_id, coalesce(string_agg(w, ',' ORDER BY place), '') AS keywords FROM s LEFT JOIN k ON s.id = k.id GROUP BY s.id""")
def g19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(
        lb.keywords(F.col("text"), 5, DEMO_WORDS), ",").alias("keywords"))


@query("g20_chunk_keywords", f"""WITH s AS (SELECT conv_id * 4294967296 + turn AS id, split_part(text, chr(10), 1) AS q, text AS a FROM conversations),
    kq AS ({_q_keywords("s", "q", 5)}), ka AS ({_q_keywords("s", "a", 10)}),
    u AS (SELECT id, w, min(o) AS o FROM (SELECT id, w, place AS o FROM kq UNION ALL SELECT id, w, 100 + place FROM ka) GROUP BY id, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM u)
    SELECT s.id, coalesce(string_agg(w, ',' ORDER BY o), '') AS keywords FROM s LEFT JOIN r ON s.id = r.id AND rn <= 10 GROUP BY s.id""")
def g20(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"), F.array_join(
        lb.chunk_keywords(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), words=DEMO_WORDS), ",").alias("keywords"))


@query("g21_custom_words", f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^{WORD_CHARS}]')) AS w FROM documents)
    SELECT w AS keyword, count(DISTINCT doc_id) AS docs FROM t WHERE w IN ('the', 'les', 'und', 'une') GROUP BY w""")
def g21(spark, sf):
    """Default dictionary extended by four words of the user's own."""
    own = lb.default_keywords() + ["the", "les", "und", "une"]
    found = table(spark, sf, "documents").select("doc_id", F.explode(
        lb.keywords(F.col("text"), None, own)).alias("keyword"))
    return found.where(F.col("keyword").isin("the", "les", "und", "une")).groupBy("keyword").agg(
        F.count("*").alias("docs"))


@query("k04_top_word", f"""WITH s AS (SELECT doc_id AS id, text AS t FROM documents), k AS ({_q_keywords("s", "t", 1)})
    SELECT id AS doc_id, w AS keyword FROM k""")
def k04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(
        lb.keywords(F.col("text"), 1, DEMO_WORDS)).alias("keyword"))


@query("k08_first_sections", using("v_docs", f""", {V_SPACED}, {_PARAS}
    SELECT doc_id, (k - 1)::INTEGER AS seq, p AS section FROM pr WHERE k <= 3"""))
def k08(spark, sf):
    return spaced(spark, sf).select("doc_id", F.posexplode(
        F.slice(tx.paragraphs(F.col("text")), 1, 3)).alias("seq", "section"))
