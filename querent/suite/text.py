"""Text expressions over every document, page and conversation turn."""

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.arrays import once
from ..functions.patterns import (
    CJK_CHARS, INLINE, SPACE, SPACE_CHARS, WORD_CHARS,
)
from .registry import query
from .views import (
    BREAK, answers, docs, lit, q_any, q_case, q_strip, q_sub, questions, table, using,
)

# Words that occur in the invented prose, for operators whose lists are parameters.
DEMO_SECTIONS = ["tion", "the", "eau", "und", "sch", "para", "ción", "ing"]
DEMO_SITES = ["thth", "eaux", "schsch"]


@query("t01_base_clean", using("v_docs", f""", a AS (
    SELECT doc_id, replace(replace(replace(text, chr(0), ''), chr(13) || {BREAK}, {BREAK}), chr(13), {BREAK}) AS t FROM v_docs)
    SELECT doc_id, {q_strip("array_to_string(list_transform(string_split(" + q_sub("t", chr(92) + "n{3,}", chr(10)*2) + f", {BREAK}), lambda l: {q_strip('l')}), {BREAK})")} AS cleaned
    FROM a"""))
def t01(spark, sf):
    return docs(spark, sf).select("doc_id", tx.base_clean(F.col("text")).alias("cleaned"))


@query("t02_strip_comments", f"""SELECT page_id,
    {q_sub(q_sub("html", "(?s)<!--.*?-->"), chr(92) + "n{3,}", chr(10)*2)} AS body FROM pages""")
def t02(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_comments(F.col("html")).alias("body"))


@query("t03_media_flags", rf"""SELECT page_id,
    regexp_matches(html, '!\[.*?\]\(.*?\)|<img.*?>') AS has_image,
    regexp_matches(html, {lit(rf'\|[{SPACE_CHARS}-]+\|')}) AS has_table FROM pages""")
def t03(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.has_image(F.col("html")).alias("has_image"),
        tx.has_table(F.col("html")).alias("has_table"),
    )


@query("t04_looks_tabular", f"""WITH l AS (
    SELECT page_id, unnest(string_split(replace(html, '>', '>   '), {BREAK})) AS line FROM pages
    UNION ALL SELECT -1 - doc_id, unnest(string_split(text, {BREAK})) FROM documents)
    SELECT page_id, count_if(regexp_matches(line, {lit(rf'\t|{SPACE}{{3,}}')})) > count(*) * 0.1 AS tabular
    FROM l GROUP BY page_id""")
def t04(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.replace("html", F.lit(">"), F.lit(">   ")).alias("t"))
    both = pages.unionByName(
        table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("page_id"), F.col("text").alias("t")))
    return both.select("page_id", tx.looks_tabular(F.col("t")).alias("tabular"))


@query("t05_likely_scanned", """SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS pages,
    sum(length(text)) / count(*) < 300 AS scanned FROM conversations GROUP BY conv_id""")
def t05(spark, sf):
    per_doc = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("chars"), F.count("*").alias("pages"))
    return per_doc.withColumn("scanned", tx.likely_scanned(F.col("chars"), F.col("pages"), 300))


@query("t06_drop_reason", using("v_docs", f"""SELECT d.doc_id,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'error'
         WHEN {q_strip("coalesce(d.text, '')")} = '' THEN 'empty'
         WHEN {q_any("lower(d.source_file)", ["src1"])} THEN 'template' ELSE 'kept' END AS outcome
    FROM v_docs d LEFT JOIN labels l ON d.doc_id = l.doc_id"""))
def t06(spark, sf):
    joined = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, "error")
        .when(tx.is_empty(F.col("text")), "empty")
        .when(tx.contains_any(F.lower("source_file"), ["src1"]), "template")
        .otherwise("kept").alias("outcome"),
    )


_LINES = f"""raw AS (SELECT doc_id, unnest(string_split(
        replace(replace(text, chr(13) || {BREAK}, {BREAK}), chr(13), {BREAK}), {BREAK})) AS line,
        generate_subscripts(string_split(
        replace(replace(text, chr(13) || {BREAK}, {BREAK}), chr(13), {BREAK}), {BREAK}), 1) AS pos FROM v_docs),
    stripped AS (SELECT doc_id, pos, {q_strip("line")} AS line FROM raw)"""
_NOISE = f"""(length(line) <= 2 OR regexp_matches(line, {lit(tx.PAGE_NUMBER)})
    OR length({q_sub("line", f"[^{WORD_CHARS}]")}) / length(line) < 0.2)"""


@query("t07_clean_lines", using("v_docs", f""", {_LINES},
    kept AS (SELECT doc_id, pos, line, {q_sub("lower(line)", SPACE + "+", " ")} AS norm FROM stripped
        WHERE NOT {_NOISE} AND NOT {q_any("line", lx.SITE_MARKS)}),
    counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n FROM kept),
    joined AS (SELECT doc_id, string_agg(line, {BREAK} ORDER BY pos) AS t FROM counted
        WHERE NOT (n >= 3 AND length(line) <= 40) GROUP BY doc_id)
    SELECT d.doc_id, {q_strip("coalesce(j.t, '')")} AS cleaned
    FROM v_docs d LEFT JOIN joined j ON d.doc_id = j.doc_id"""))
def t07(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clean_lines(F.col("text")).alias("cleaned"))


@query("t08_noise_lines", using("v_docs", f""", {_LINES}
    SELECT doc_id, pos::INTEGER AS pos, line FROM stripped WHERE {_NOISE}"""))
def t08(spark, sf):
    lines = docs(spark, sf).select(
        "doc_id", F.posexplode(F.split(tx.unix_breaks(F.col("text")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", (F.col("pos") + 1).alias("pos"), tx.strip(F.col("line")).alias("line"))
    return lines.where(tx.is_noise_line(F.col("line")))


@query("t09_normal_line", f"""SELECT conv_id, turn,
    {q_sub("lower(" + q_strip("text") + ")", SPACE + "+", " ")} AS normal FROM conversations""")
def t09(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalise_line(F.col("text")).alias("normal"))


_HITS = " + ".join(f"contains(text, {lit(w)})::INTEGER" for w in DEMO_SECTIONS)


@query("t10_resume_text", using("v_docs", f"""SELECT doc_id,
    contains(lower(source_file), 'src19') OR (({_HITS}) >= 4 AND length(text) < 4000)
    OR ({_HITS}) >= 6 AS is_resume FROM v_docs"""))
def t10(spark, sf):
    return docs(spark, sf).select("doc_id", tx.is_resume_text(
        F.col("source_file"), F.col("text"), ["SRC19"], DEMO_SECTIONS).alias("is_resume"))


# Documents hold no lists, so their third words become list heads of three kinds.
_LISTED = """(SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
    '(?m)^([A-E])', '- \\1', 'g'), '(?m)^([F-O])', '7. \\1', 'g'), '(?m)^([P-S])', '二、\\1', 'g') AS t FROM documents)"""


@query("t11_to_markdown", f"""WITH d AS {_LISTED},
    l AS (SELECT doc_id, {q_strip("unnest(string_split(t, chr(10)))")} AS line,
          generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
    m AS (SELECT doc_id, pos, CASE
        WHEN regexp_matches(line, {lit(tx.HEADING_LINE)}) THEN
            CASE WHEN {q_sub("line", tx.HEADING_MARK, flags="")} <> '' THEN '## ' || {q_sub("line", tx.HEADING_MARK, flags="")} ELSE line END
        WHEN regexp_matches(line, {lit(tx.BULLET_LINE)}) THEN '- ' || {q_sub("line", tx.BULLET_MARK, flags="")}
        ELSE line END AS line FROM l)
    SELECT doc_id, {q_strip(q_sub("string_agg(line, chr(10) ORDER BY pos)", chr(92) + "n{3,}", chr(10) * 2))} AS markdown
    FROM m GROUP BY doc_id""")
def t11(spark, sf):
    t = F.col("text")
    for cls, mark in (("[A-E]", "- "), ("[F-O]", "7. "), ("[P-S]", "二、")):
        t = F.regexp_replace(t, f"(?md)^({cls})", mark + "$1")
    return table(spark, sf, "documents").select("doc_id", tx.to_markdown(t).alias("markdown"))


@query("t12_template_path", using("v_docs", """SELECT doc_id,
    contains(lower(source_file), 'src3') OR contains(lower(source_file), '77')
    OR ((contains(lower(category), 'src1') OR contains(category, 'src5')) AND source_file LIKE '%5.md') AS is_template
    FROM v_docs"""))
def t12(spark, sf):
    return docs(spark, sf).select("doc_id", tx.is_template_path(
        F.col("source_file"), F.col("category"), ["SRC3", "77"], ("src1", "src5"), ["5.md"]
    ).alias("is_template"))


@query("t24_fingerprint", using("v_docs", f"""SELECT doc_id, md5({q_strip(q_sub(q_sub("lower(text)", SPACE + "+", " "), f"[^{WORD_CHARS}{SPACE_CHARS}]"))}) AS hash
    FROM v_docs"""))
def t24(spark, sf):
    return docs(spark, sf).select("doc_id", tx.fingerprint(F.col("text")).alias("hash"))


# Sentences of the documents stand in for raw bank questions; every third gets a
# number in front and every fifth a page number behind.
RAW_ITEMS_SQL = """(SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN seq || '、 ' ELSE '' END || s
    || CASE WHEN seq % 5 = 0 THEN ' ..... ' || seq WHEN seq % 7 = 0 THEN '  ' || seq ELSE '' END AS item
    FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s,
          generate_subscripts(string_split(text, '.'), 1) AS seq FROM documents))"""


def raw_items(spark, sf):
    parts = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("pos", "s"))
    seq = F.col("pos") + 1
    return parts.select(
        "doc_id", seq.alias("seq"),
        F.concat(
            F.when(seq % 3 == 0, F.concat(seq.cast("string"), F.lit("、 "))).otherwise(""),
            F.col("s"),
            F.when(seq % 5 == 0, F.concat(F.lit(" ..... "), seq.cast("string")))
            .when(seq % 7 == 0, F.concat(F.lit("  "), seq.cast("string"))).otherwise(""),
        ).alias("item"),
    )


def q_question(x: str) -> str:
    t = q_sub(q_strip(x), SPACE + "+", " ")
    for pattern in (tx.LEADING_NUMBER, tx.DOT_LEADER, tx.TRAILING_PAGE):
        t = q_strip(q_sub(t, pattern, flags=""))
    return t


def q_noise(x: str) -> str:
    return (f"(length({q_sub(x, f'[^A-Za-z0-9{CJK_CHARS}]+')}) < 4"
            f" OR regexp_matches({x}, {lit(tx.BANK_NOISE)}))")


def q_key(x: str) -> str:
    t = q_sub(q_sub(q_strip(f"lower({x})"), tx.KEY_BRACKETS), tx.KEY_PUNCTUATION)
    return q_sub(t, tx.LEADING_NUMBER, flags="")


@query("t25_normal_question", f"""WITH i AS {RAW_ITEMS_SQL}
    SELECT doc_id, seq::INTEGER AS seq, {q_question("item")} AS question FROM i""")
def t25(spark, sf):
    return raw_items(spark, sf).select(
        "doc_id", "seq", tx.normalise_question(F.col("item")).alias("question"))


@query("t26_question_noise", f"""WITH i AS {RAW_ITEMS_SQL}, n AS (SELECT doc_id, seq, {q_question("item")} AS q FROM i)
    SELECT doc_id, seq::INTEGER AS seq, q AS question FROM n WHERE {q_noise("q")}""")
def t26(spark, sf):
    n = once(raw_items(spark, sf), question=tx.normalise_question(F.col("item"))).drop("item")
    return n.where(tx.is_question_noise(F.col("question")))


@query("t27_question_key", f"""WITH i AS {RAW_ITEMS_SQL}
    SELECT doc_id, seq::INTEGER AS seq, {q_key("item")} AS key FROM i""")
def t27(spark, sf):
    return raw_items(spark, sf).select("doc_id", "seq", tx.question_key(F.col("item")).alias("key"))


@query("t28_strip_list_mark", f"""WITH i AS {RAW_ITEMS_SQL}
    SELECT doc_id, seq::INTEGER AS seq,
    {q_strip(q_sub(q_strip(q_sub("item", tx.LIST_MARK, flags="")), SPACE + "+", " "))} AS question FROM i""")
def t28(spark, sf):
    return raw_items(spark, sf).select(
        "doc_id", "seq", tx.strip_list_mark(F.col("item")).alias("question"))


@query("t29_estimate_tokens", """SELECT doc_id,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 1.5e0) AS INTEGER)) END AS tokens
    FROM documents""")
def t29(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


# Category rules meet real hits when a document's first words act as file name.
@query("t30_bank_category", f"""WITH n AS (SELECT doc_id, lower(concat(text, ' ', lang)) AS name FROM documents)
    SELECT doc_id, {q_case("name", [*lx.BANK_CATEGORY, ("en-bank", ["the", "nd"]), ("fr-bank", ["eau"])], lit(lx.BANK_CATEGORY_DEFAULT))} AS category FROM n""")
def t30(spark, sf):
    from ..functions.labels import bank_category
    return table(spark, sf, "documents").select(
        "doc_id",
        bank_category(F.col("text"), F.col("lang"),
                      [*lx.BANK_CATEGORY, ("en-bank", ["the", "nd"]), ("fr-bank", ["eau"])]).alias("category"))


@query("t31_job_category", f"""SELECT page_id, {q_case("lower(coalesce(url, ''))", lx.JOB_CATEGORY, lit(lx.JOB_CATEGORY_DEFAULT))} AS job FROM pages""")
def t31(spark, sf):
    from ..functions.labels import job_category
    return table(spark, sf, "pages").select("page_id", job_category(F.col("url")).alias("job"))


@query("t32_display_names", using("v_questions", f"""SELECT question_id,
    CASE category_key {" ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in lx.CATEGORY_DISPLAY.items())} ELSE category_key END AS category_name,
    CASE ['easy', 'medium', 'hard', 'other'][question_id % 4 + 1] WHEN 'easy' THEN '基础' WHEN 'medium' THEN '进阶' WHEN 'hard' THEN '高级' ELSE 'other' END AS difficulty
    FROM v_questions"""))
def t32(spark, sf):
    from ..functions.labels import lookup
    raw = F.get(F.array(*map(F.lit, ["easy", "medium", "hard", "other"])), (F.col("question_id") % 4).cast("int"))
    return questions(spark, sf).select(
        "question_id", lookup(F.col("category_key"), lx.CATEGORY_DISPLAY).alias("category_name"),
        lookup(raw, lx.DIFFICULTY_ALIAS).alias("difficulty"))


_LETTERS = f"length({q_sub('text', '[^A-Za-z]')})"
_CJK = f"length({q_sub('text', f'[^{CJK_CHARS}]')})"


@query("t33_language", f"""SELECT conv_id, turn, {_CJK} > 0 AS has_cjk,
    {_LETTERS} >= 3 AND ({_CJK} = 0 OR {_CJK} < {_LETTERS} * 0.05) AS mostly_english
    FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '什么是索引' ELSE text END AS text FROM conversations)""")
def t33(spark, sf):
    c = table(spark, sf, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("什么是索引"))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", tx.contains_cjk(F.col("text")).alias("has_cjk"),
                    tx.mostly_english(F.col("text")).alias("mostly_english"))


@query("t34_safe_name", f"SELECT page_id, {q_strip(q_sub('url', tx.UNSAFE_NAME, '_'))} AS name FROM pages")
def t34(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("t45_parent_question", using("v_answers", """SELECT id,
    replace(CASE WHEN is_followup THEN concat(parent_question_id, '_followup') ELSE CAST(question_id AS VARCHAR) END, '_followup', '') AS parent
    FROM v_answers"""))
def t45(spark, sf):
    qid = F.when(F.col("is_followup"), F.concat("parent_question_id", F.lit("_followup"))).otherwise(
        F.col("question_id").cast("string"))
    return answers(spark, sf).select("id", F.replace(qid, F.lit("_followup"), F.lit("")).alias("parent"))


@query("t46_row_filters", using("v_docs", """SELECT doc_id FROM v_docs
    WHERE contains(source_file, 'src1') AND lang IN ('en', 'fr') AND length(text) >= 50"""))
def t46(spark, sf):
    return docs(spark, sf).where(
        tx.path_matches(F.col("source_file"), "src1") & F.col("lang").isin("en", "fr")
        & (F.length("text") >= 50)).select("doc_id")


_DIRECT = "split_part(text, chr(10), 1)"
_ALT = "split_part(text, chr(10), 2)"


@query("t47_best_attempt", f"""SELECT doc_id, coalesce(
    CASE WHEN length({q_strip("t")}) >= 100 THEN t END,
    CASE WHEN length({q_strip(_DIRECT)}) >= 50 THEN {_DIRECT} END,
    CASE WHEN length({q_strip(_ALT)}) > 0 THEN {_ALT} END) AS chosen
    FROM (SELECT doc_id, text, substr(text, 1, CAST(doc_id % 200 AS INTEGER)) AS t FROM documents)""")
def t47(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.best_attempt(
        F.substr(text, F.lit(1), (F.col("doc_id") % 200).cast("int")),
        F.split_part(text, F.lit("\n"), F.lit(1)),
        F.split_part(text, F.lit("\n"), F.lit(2)),
    ).alias("chosen"))
