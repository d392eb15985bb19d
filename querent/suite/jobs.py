"""Whole jobs, stored tables and streams over the given tables."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import quality as qf
from ..functions import scores as sc
from ..functions import segment as sg
from ..functions import text as tx
from ..functions.patterns import SPACE, SPACE_CHARS, WORD_CHARS
from ..operators import interview as iv
from ..operators import quality as op
from ..operators import vectors as vx
from ..operators.catalog import LABELS, label_statistics
from ..plans import bank as pb
from ..plans import corpus as pc
from ..plans import interview as pi
from ..session import scratch_path
from ..sources import files as fl
from ..sources import schemas as sm
from ..sources import sinks as sk
from ..sources import tables as tb
from ..streaming import jobs as st
from .corpus import DIFFICULTY, _CLASSED, _FILES, _STATS, WORDS, chunk_rows, labelled, listing, _LABELLED
from .dedup import HASHED
from .interview import RAW, _REPORTS, _SESSION_STATS, _ZERO, scored
from .quality import LIMITS, _CHECKED, checked
from .registry import query
from .segment import DEMO_WORDS, MARKED, V_DRESSED, V_SPACED, _q_keywords as q_keywords, _sql_dress, dressed, q_chunks, q_force, q_sections, shown_chunks, spaced
from .text import _LINES, _NOISE
from .vectors import LETTERS, letter_encoder, shown
from .views import (
    answers, docs, evaluations, lit, q_any, q_case, q_strip, q_sub, sessions, table, using,
)

# --- files and tables ---------------------------------------------------------------


@query("s02_read_documents", f"""WITH b AS (SELECT page_id, html AS t FROM pages), c AS (
    SELECT page_id, {q_strip("array_to_string(list_transform(string_split(" + q_sub("t", chr(92) + "n{3,}", chr(10)*2) + ", chr(10)), lambda l: " + q_strip('l') + "), chr(10))")} AS t FROM b),
    d AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {q_sub(q_sub("t", "(?s)<!--.*?-->"), chr(92) + "n{3,}", chr(10)*2)} ELSE t END AS full_text FROM c)
    SELECT page_id, full_text, regexp_matches(full_text, '!\\[.*?\\]\\(.*?\\)|<img.*?>') AS has_images FROM d""")
def s02(spark, sf):
    """Page bytes with broken UTF-8 inside, as .md and .txt files would hold them."""
    p = table(spark, sf, "pages")
    broken = F.concat(F.encode(F.substr("html", F.lit(1), F.lit(40)), "UTF-8"), F.unhex(F.lit("FF")),
                      F.encode(F.substr("html", F.lit(41)), "UTF-8"))
    files = p.select(
        F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 2 == 0, ".md").otherwise(".txt").alias("suffix"),
        F.lit("web").alias("category"), F.lit(False).alias("is_template"), broken.alias("content"))
    d = fl.to_documents(files)
    return d.select(F.col("source_path").cast("bigint").alias("page_id"), "full_text", F.get("pages", F.lit(0))["has_images"].alias("has_images"))


@query("s03_chunk_table", "SELECT doc_id AS chunk_id, text AS content, length(text)::INTEGER AS char_count FROM documents")
def s03(spark, sf):
    """Chunks written as JSON with a derived field, read by schema, stored as Parquet."""
    src, out = scratch_path(spark, "json"), scratch_path(spark, "chunks")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    d.withColumn("char_count", F.lit(-1)).write.json(src)
    tb.write_table(spark.read.schema("chunk_id bigint, content string").json(src), out)
    return tb.read_table(spark, out, "chunk_id bigint, content string").withColumn("char_count", F.length("content"))


@query("s06_class_report", using("v_docs", f", {_CLASSED} SELECT class, count(*) AS files FROM classed GROUP BY class"))
def s06(spark, sf):
    """The class counts as they come back from the JSON and the CSV report."""
    from .corpus import classified
    from ..operators.catalog import class_counts
    counts = class_counts(classified(spark, sf)).drop("skipped")
    a, b = scratch_path(spark, "report"), scratch_path(spark, "report")
    sk.write_report(counts, a)
    sk.write_report_csv(spark.read.schema("class string, files bigint").json(a), b)
    return spark.read.option("header", "true").schema("class string, files bigint").csv(b)


@query("s07_four_tables", using("v_sessions v_answers v_evaluations v_latest", f""", {_REPORTS}
    SELECT 'sessions' AS name, session_id, 1::BIGINT AS n, status AS shown, NULL::DOUBLE AS score FROM v_sessions
    UNION ALL SELECT 'answers', session_id, count(*), md5(string_agg(concat(id, ' ', question_id, ' ', user_answer, ' ', is_followup, ' ', coalesce(parent_question_id::VARCHAR, '-')), chr(10) ORDER BY id)), NULL FROM v_answers GROUP BY session_id
    UNION ALL SELECT 'evaluations', session_id, count(*), CAST(sum(CAST(technical_accuracy AS DECIMAL(20,4))) AS VARCHAR), NULL FROM v_evaluations GROUP BY session_id
    UNION ALL SELECT 'reports', session_id, 1, '', avg_total_score FROM reports"""))
def s07_tables(spark, sf):
    """Sessions, answers, evaluations and reports in their stored layouts, each by day, read back from there."""
    from .interview import reports as made
    day = lambda micros: F.to_date(F.timestamp_micros(micros))
    s, e = sessions(spark, sf), evaluations(spark, sf)
    days = s.select(F.col("session_id"), day("start_time").alias("session_date"))
    time = F.timestamp_micros
    tables = {
        "sessions": (sm.SESSIONS, s.select("session_id", "status", time("start_time").alias("start_time"), time("end_time").alias("end_time"))),
        "answers": (sm.ANSWERS, answers(spark, sf)),
        "evaluations": (sm.EVALUATIONS, e.withColumn("created_at", time("created_at"))),
        "reports": (sm.REPORTS, made(spark, sf).select(
            "session_id", F.col("avg_total_score").alias("overall_score"), "avg_technical_accuracy", "avg_clarity", "avg_depth_breadth",
            F.col("pass_rate").alias("correct_rate"))),
    }
    stored = {}
    for name, (schema, rows) in tables.items():
        path = scratch_path(spark, name)
        tb.write_table(tb.conform(rows.join(days, "session_id", "left"), schema), path, "session_date")
        stored[name] = tb.read_table(spark, path, schema).withColumn("session_id", F.col("session_id").cast("bigint"))
    line = F.concat_ws(" ", "id", "question_id", "user_answer", "is_followup", F.coalesce("parent_question_id", F.lit("-")))
    told = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n"))
    one = F.lit(1).cast("bigint").alias("n")
    return (
        stored["sessions"].select(F.lit("sessions").alias("name"), "session_id", one, F.col("status").alias("shown"))
        .unionByName(stored["answers"].groupBy("session_id").agg(F.lit("answers").alias("name"), F.count("*").alias("n"), told.alias("shown")))
        .unionByName(stored["evaluations"].groupBy("session_id").agg(
            F.lit("evaluations").alias("name"), F.count("*").alias("n"), F.sum(F.col("technical_accuracy").cast("decimal(20,4)")).cast("string").alias("shown")))
        .unionByName(stored["reports"].select(
            F.lit("reports").alias("name"), "session_id", one, F.lit("").alias("shown"), F.col("overall_score").alias("score")),
            allowMissingColumns=True)
    )


_SESSION = "session_id bigint, start_time bigint, end_time bigint, status string, session_date string"


def session_rows(spark, sf):
    return sessions(spark, sf).withColumn(
        "session_date", F.date_format(F.timestamp_micros("start_time"), "yyyy-MM-dd")).select(
        "session_id", "start_time", "end_time", "status", "session_date")


@query("s07_interview_tables", using("v_evaluations", " SELECT id, session_id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS place FROM v_evaluations"))
def s07(spark, sf):
    """Evaluations appended in two goes and fetched in time order."""
    from ..operators.ranking import with_ordinal
    e = evaluations(spark, sf).select("id", "session_id", "created_at").withColumn(
        "session_date", F.date_format(F.timestamp_micros("created_at"), "yyyy-MM-dd"))
    path = scratch_path(spark, "evaluations")
    tb.write_table(e.where("id % 2 = 0"), path, "session_date")
    tb.write_table(e.where("id % 2 = 1"), path, "session_date")
    stored = tb.read_table(spark, path, "id bigint, session_id bigint, created_at bigint, session_date string")
    return with_ordinal(stored.drop("session_date"), ["session_id"], "created_at", "id", "place")


@query("s08_upsert", using("v_sessions", " SELECT session_id, start_time, CASE WHEN session_id % 3 = 0 THEN end_time + 1 ELSE end_time END AS end_time, CASE WHEN session_id % 3 = 0 THEN 'closed' ELSE status END AS status FROM v_sessions"))
def s08(spark, sf):
    rows = session_rows(spark, sf)
    path = scratch_path(spark, "sessions")
    tb.write_table(rows.where("session_id % 5 <> 0"), path, "session_date")
    changed = rows.where("session_id % 3 = 0").withColumn("status", F.lit("closed")).withColumn("end_time", F.col("end_time") + 1)
    tb.upsert(spark, path, _SESSION, changed.unionByName(rows.where("session_id % 5 = 0 AND session_id % 3 <> 0")), "session_id", "end_time", "session_date")
    return tb.read_table(spark, path, _SESSION).drop("session_date")


@query("s09_cascade_delete", using("v_sessions v_evaluations", """ SELECT 'sessions' AS name, session_id AS id FROM v_sessions WHERE status <> 'completed'
    UNION ALL SELECT 'evaluations', id FROM v_evaluations WHERE session_id NOT IN (SELECT session_id FROM v_sessions WHERE status = 'completed')"""))
def s09(spark, sf):
    a, b = scratch_path(spark, "sessions"), scratch_path(spark, "evaluations")
    tb.write_table(session_rows(spark, sf), a, "session_date")
    e = evaluations(spark, sf).select("id", "session_id", F.date_format(F.timestamp_micros("created_at"), "yyyy-MM-dd").alias("session_date"))
    tb.write_table(e, b, "session_date")
    e_schema = "id bigint, session_id bigint, session_date string"
    gone = session_rows(spark, sf).where("status = 'completed'").select("session_id")
    tb.cascade_delete(spark, {a: _SESSION, b: e_schema}, gone)
    left = tb.read_table(spark, a, _SESSION).select(F.lit("sessions").alias("name"), F.col("session_id").alias("id"))
    return left.unionByName(tb.read_table(spark, b, e_schema).select(F.lit("evaluations").alias("name"), "id"))


@query("s11_review_lines", using("v_docs", """ SELECT concat('=== ', doc_id, ' ===', chr(10), '来源: ', source_file, chr(10), '类型: text', chr(10),
    '问题: None', chr(10), '答案: ', text, chr(10), 'Metadata: {"lang":"', lang, '"}', chr(10), chr(10), repeat('=', 50), chr(10)) AS value FROM v_docs"""))
def s11(spark, sf):
    d = docs(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), "source_file", F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("question"),
        F.col("text").alias("answer"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    return sk.review_lines(d)


_EXT = "CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.md' ELSE '.docx' END"


def with_failures(spark, sf):
    """Documents of four file types; those the labels call poor have lost their text."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    k = F.col("doc_id") % 4
    return d.select(
        "doc_id", F.col("source_file").alias("source_path"), "category",
        F.when(k == 0, ".pdf").when(k == 1, ".png").when(k == 2, ".md").otherwise(".docx").alias("file_type"),
        F.when(F.coalesce(F.col("quality"), F.lit(1)) == 0, "  ").otherwise(F.col("text")).alias("full_text"),
        F.col("text").alias("whole"), F.lit(None).cast("string").alias("markdown_text"))


_FAILED = f"""f AS (SELECT d.doc_id, source_file, {_EXT.replace('doc_id', 'd.doc_id')} AS file_type,
    CASE WHEN coalesce(l.quality, 1) = 0 THEN '  ' ELSE text END AS full_text, text FROM v_docs d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("s12_retry_queue", using("v_docs", f", {_FAILED} SELECT doc_id, file_type FROM f WHERE {q_strip('full_text')} = '' AND file_type IN ('.pdf', '.png')"))
def s12(spark, sf):
    path = scratch_path(spark, "retry")
    sk.queue_for_retry(sk.retry_rows(with_failures(spark, sf), "full_text", [".pdf", ".png"]).select("doc_id", "file_type"), path)
    return spark.read.parquet(path)


@query("a12_retry_types", using("v_docs", f", {_FAILED} SELECT file_type, count(*) AS n FROM f WHERE {q_strip('full_text')} = '' GROUP BY file_type"))
def a12(spark, sf):
    rows = sk.retry_rows(with_failures(spark, sf), "full_text", [".pdf", ".png", ".md", ".docx"])
    return rows.groupBy("file_type").agg(F.count("*").alias("n"))


# --- jobs ---------------------------------------------------------------------------
@query("p1_catalogue_and_classify", using("v_docs", f", {_CLASSED} SELECT class, count(*) AS files FROM classed GROUP BY class"))
def p1(spark, sf):
    d = docs(spark, sf)
    files = d.select(
        F.col("source_file").alias("path"), F.concat("doc_id", F.lit(".md")).alias("name"), F.lit(".md").alias("suffix"),
        F.length("text").cast("bigint").alias("size"), "category", (F.col("category") == "src5").alias("is_template"),
        F.lit(False).alias("needs_ocr"))
    extracted = d.where("lang <> 'de'").select(
        F.col("source_file").alias("source_path"), F.replace("text", F.lit("."), F.lit("?")).alias("full_text"),
        F.lit(None).cast("string").alias("markdown_text"))
    return pc.catalogue_and_classify(files, extracted, **WORDS)["counts"].drop("skipped")


CLEANED = f"""{_LINES},
    kept AS (SELECT doc_id, pos, line, {q_sub("lower(line)", SPACE + "+", " ")} AS norm FROM stripped
        WHERE NOT {_NOISE} AND NOT {q_any("line", lx.SITE_MARKS)}),
    counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n FROM kept),
    live AS (SELECT * FROM counted WHERE NOT (n >= 3 AND length(line) <= 40)),
    cleaned AS (SELECT d.doc_id, coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM live j WHERE j.doc_id = d.doc_id), '') AS t FROM v_docs d),
    md AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, {lit(tx.HEADING_LINE)}) THEN
            CASE WHEN {q_sub("line", tx.HEADING_MARK, flags="")} <> '' THEN '## ' || {q_sub("line", tx.HEADING_MARK, flags="")} ELSE line END
        WHEN regexp_matches(line, {lit(tx.BULLET_LINE)}) THEN '- ' || {q_sub("line", tx.BULLET_MARK, flags="")} ELSE line END AS line FROM live),
    marked AS (SELECT doc_id, {q_strip("string_agg(line, chr(10) ORDER BY pos)")} AS m FROM md GROUP BY doc_id)"""


@query("p2_extract_and_clean", using("v_docs", f""", {CLEANED}, o AS (SELECT d.doc_id, c.t, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'error' WHEN c.t = '' THEN 'empty'
        WHEN d.category = 'src7' OR contains(d.source_file, 'src19') THEN 'template' ELSE 'success' END AS outcome
        FROM v_docs d JOIN cleaned c ON c.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT o.doc_id, outcome, CASE WHEN outcome = 'success' THEN o.t END AS full_text, CASE WHEN outcome = 'success' THEN coalesce(m, '') END AS markdown_text
    FROM o LEFT JOIN marked k ON k.doc_id = o.doc_id"""))
def p2(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source_file").alias("source_path"), "category", F.col("text").alias("full_text"),
        (F.col("category") == "src7").alias("is_template"),
        F.when(F.col("toxic") == 1, F.array(F.lit("broken"))).otherwise(F.expr("cast(array() as array<string>)")).alias("errors"))
    words = {"path_words": ["src19"], "section_words": ["简历"]}
    return pc.extract_and_clean(d, words).select("doc_id", "outcome", "full_text", "markdown_text")


_BANK = ["src0", "src3", "src6", "src9", "src12", "src15", "src18"]
_IS_BANK = f"category IN ({', '.join(map(lit, _BANK))})"


@query("p3_parse_and_chunk", using("v_docs", f""", {V_SPACED}, v_bank AS (SELECT doc_id, source_file, CASE WHEN {_IS_BANK} THEN {lit(pc.QUESTION_BANK)} ELSE category END AS category,
        {_IS_BANK} AS bank, doc_id % 2 = 0 AND text <> '' AS md, text FROM v_spaced WHERE {q_strip("text")} <> ''), {q_chunks("v_bank")} SELECT * FROM chunks"""))
def p3(spark, sf):
    """All documents dressed with markers; a third of the sources are question banks."""
    d = spaced(spark, sf)
    return shown_chunks(pc.parse_and_chunk(d.select(
        F.col("source_file").alias("source_path"),
        F.when(F.col("category").isin(*_BANK), pc.QUESTION_BANK).otherwise(F.col("category")).alias("category"),
        F.col("text").alias("full_text"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("markdown_text"))))


@query("p3_plain_chunks", using("v_docs", f""", src AS (SELECT doc_id AS id, {q_strip("text")} AS t FROM v_docs WHERE length({q_strip("text")}) > 1500), {q_force("src", "f")},
    sm AS (SELECT doc_id, {q_strip("text")} AS t FROM v_docs WHERE {q_strip("text")} <> '' AND length({q_strip("text")}) <= 1500)
    SELECT id AS doc_id, {q_strip("substr(t, CAST(s + 1 AS INTEGER), CAST(e - s AS INTEGER))")} AS content FROM f UNION ALL SELECT doc_id, t FROM sm"""))
def p3_plain(spark, sf):
    """Undressed documents that hold no marker: all go the plain way."""
    d = docs(spark, sf).select("doc_id", F.concat_ws("/", F.lit("x"), "doc_id").alias("source_path"), "category",
                               F.regexp_replace("text", r"(?md)^([Qq])", "q").alias("t0"), "text")
    plain = d.select("source_path", "category", F.col("text").alias("full_text"), F.lit("").alias("markdown_text"))
    marked = d.where(F.size(sg.parse_pairs(F.col("text"))) > 0).select("source_path")
    chunks = pc.parse_and_chunk(plain.join(marked, "source_path", "left_anti"))
    rest = d.join(marked, "source_path", "left_semi").select("source_path", F.explode(sg.chunk_plain(F.col("text"))).alias("c")).select(
        "source_path", F.col("c.content").alias("content"))
    both = chunks.select(F.col("source_file").alias("source_path"), "content").unionByName(rest)
    return both.select(F.split_part("source_path", F.lit("/"), F.lit(2)).cast("bigint").alias("doc_id"), "content")


_P4 = f"""s AS (SELECT doc_id AS id, CASE WHEN lang <> 'es' THEN split_part(text, '.', 1) END AS q, replace(text, chr(10), chr(10) || '- ') AS a FROM v_docs),
    kq AS ({q_keywords("s", "q", 5)}), ka AS ({q_keywords("s", "a", 10)}),
    u AS (SELECT id, w, min(o) AS o FROM (SELECT id, w, place AS o FROM kq UNION ALL SELECT id, w, 100 + place FROM ka) GROUP BY id, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM u),
    kw AS (SELECT s.id, coalesce(string_agg(w, ',' ORDER BY o), '') AS keywords FROM s LEFT JOIN r ON s.id = r.id AND rn <= 10 GROUP BY s.id),
    lab AS (SELECT doc_id AS chunk_id, '面试题' AS content_category, {q_case("lower(text)", lx.POSITION_BY_CONTENT, "'通用'")} AS position,
        '进阶' AS difficulty, CASE WHEN lang = 'es' OR split_part(text, '.', 1) = '' THEN '知识点' WHEN contains(lower(text), 'function') OR contains(lower(text), 'def ') OR contains(text, '```') THEN '代码题'
        WHEN len(string_split(text, chr(10))) - 1 > 3 THEN '对比题' ELSE '概念题' END AS question_type, keywords FROM v_docs JOIN kw ON id = doc_id)"""


def labels_of_all(spark, sf):
    return pc.label_chunks(chunk_rows(spark, sf), {"words": DEMO_WORDS})


@query("p4_label_chunks", using("v_docs", f", {_P4} SELECT * FROM lab"))
def p4(spark, sf):
    """The default word lists on all documents as chunks, with keywords of a list of its own."""
    return labels_of_all(spark, sf).select(
        "chunk_id", "content_category", "position", "difficulty", "question_type", F.array_join("keywords", ",").alias("keywords"))


@query("p4_label_statistics", using("v_docs", f", {_P4} " + " UNION ALL ".join(
    f"SELECT '{c}' AS label, {c} AS value, count(*) AS n FROM lab GROUP BY 2" for c in LABELS)))
def p4_statistics(spark, sf):
    return label_statistics(labels_of_all(spark, sf))


_NORMED = q_strip(q_sub(q_sub("lower(t)", SPACE + "+", " "), f"[^{WORD_CHARS}{SPACE_CHARS}]"))


@query("p5_quality_gate", f"""{_CHECKED}, v AS (SELECT c.id, s.t, md5({_NORMED}) AS h FROM checked c JOIN src s ON s.id = c.id WHERE is_valid),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY length(t) DESC, id) AS rn FROM v) SELECT id FROM r WHERE rn = 1""")
def p5(spark, sf):
    rows = checked(spark, sf).drop("is_valid", "issues", *op.SCORES)
    return pc.quality_gate(rows, "id", **LIMITS)["final"].select("id")


@query("p5_review_sample", f"""{_CHECKED}, v AS (SELECT c.id, s.t, md5({_NORMED}) AS h FROM checked c JOIN src s ON s.id = c.id WHERE is_valid),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY length(t) DESC, id) AS rn FROM v)
    SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat('review', id)), id) AS k, count(*) OVER () AS n FROM r WHERE rn = 1) WHERE k <= greatest(1, floor(n * 0.1e0))""")
def p5_review(spark, sf):
    """A tenth of what the gate lets through, the same every run."""
    rows = checked(spark, sf).drop("is_valid", "issues", *op.SCORES)
    return pc.quality_gate(rows, "id", **LIMITS)["review"]().select("id")


_VEC = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


@query("p6_build_index", f"""WITH e AS (SELECT doc_id AS chunk_id, source, lang, {_VEC} AS v FROM documents), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e),
    m AS (SELECT chunk_id, lang, CASE WHEN n > 0 THEN list_transform(v, lambda x: CAST(x / n AS FLOAT)) ELSE list_transform(v, lambda x: CAST(x AS FLOAT)) END AS u FROM n),
    q(query_id, q) AS (VALUES {", ".join(f"({i}, [{', '.join('1e0' if j == i else '0e0' for j in range(len(LETTERS)))}])" for i in range(len(LETTERS)))})
    SELECT query_id::BIGINT AS query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT query_id, chunk_id, list_dot_product(CAST(u AS DOUBLE[]), q) AS score FROM q, m)) WHERE rank <= 5""")
def p6(spark, sf):
    """Index built in two runs that overlap, then searched once per letter."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("source_file"))
    path = scratch_path(spark, "index")
    pc.build_index(d.where("chunk_id % 3 = 0"), path, letter_encoder, len(LETTERS))
    index = pc.build_index(d, path, letter_encoder, len(LETTERS))
    eye = [(i, [float(i == j) for j in range(len(LETTERS))]) for i in range(len(LETTERS))]
    return shown(vx.top_k(index, spark.createDataFrame(eye, "query_id bigint, embedding array<double>"), 5))


@query("p7_repair_round", using("v_docs", f""", {_FAILED}, x AS (SELECT *, {q_strip('full_text')} = '' AND file_type IN ('.pdf', '.docx') AS bad FROM f)
    SELECT doc_id, CASE WHEN bad AND length({q_strip("split_part(text, chr(10), 1)")}) >= 50 THEN split_part(text, chr(10), 1) WHEN bad AND length({q_strip("split_part(text, chr(10), 2)")}) > 0 THEN split_part(text, chr(10), 2) ELSE full_text END AS full_text FROM x"""))
def p7(spark, sf):
    d = with_failures(spark, sf)
    again = lambda rows: rows.select(
        "source_path", "file_type", F.split_part("whole", F.lit("\n"), F.lit(1)).alias("direct"),
        F.split_part("whole", F.lit("\n"), F.lit(2)).alias("fallback"))
    return pc.repair_round(d, [".pdf", ".docx"], again)["documents"].select("doc_id", "full_text")


@query("p7_new_chunks", using("v_docs", f""", {_FAILED}, v_again AS (SELECT f.doc_id, f.source_file, d.category, false AS bank, false AS md, f.text FROM f JOIN v_docs d ON d.doc_id = f.doc_id
        WHERE {q_strip('full_text')} = '' AND file_type IN ('.pdf', '.docx') AND length({q_strip('f.text')}) > 0), {q_chunks("v_again")} SELECT * FROM chunks"""))
def p7_chunks(spark, sf):
    d = with_failures(spark, sf)
    again = lambda rows: rows.select(
        "source_path", "file_type", F.col("whole").alias("direct"), F.lit(None).cast("string").alias("fallback"))
    return shown_chunks(pc.repair_round(d, [".pdf", ".docx"], again)["new_chunks"])


@query("p7_chunk_table", using("v_docs", f""", {_FAILED}, v_after AS (SELECT * FROM (SELECT f.doc_id, f.source_file, d.category, false AS bank, false AS md,
        CASE WHEN {q_strip('full_text')} = '' AND file_type IN ('.pdf', '.docx') AND length({q_strip('f.text')}) > 0 THEN f.text ELSE full_text END AS text
        FROM f JOIN v_docs d ON d.doc_id = f.doc_id) WHERE {q_strip('text')} <> ''), {q_chunks("v_after")} SELECT * FROM chunks"""))
def p7_table(spark, sf):
    """All chunks after the round: those of repaired documents take the place of their old ones."""
    d = with_failures(spark, sf)
    again = lambda rows: rows.select(
        "source_path", "file_type", F.col("whole").alias("direct"), F.lit(None).cast("string").alias("fallback"))
    return shown_chunks(pc.repair_round(d, [".pdf", ".docx"], again, pc.parse_and_chunk(d))["chunks"])


def _q_prompt() -> str:
    """The report prompt over the columns of a report row; a tenth is rounded up from its half."""
    tenth = lambda c: f"printf('%.1f', round({c}, 1))"
    fields = {
        "job_type": "'technical'", "difficulty": "'进阶'", "total_questions": "total_count",
        "correct_rate": f"concat({tenth('pass_rate * 100')}, '%')", "avg_technical": tenth("avg_technical_accuracy"),
        "avg_clarity": tenth("avg_clarity"), "avg_depth": tenth("avg_depth_breadth"), "answer_details": "digest",
    }
    out = lit(sc.REPORT_PROMPT)
    for name, column in fields.items():
        out = f"replace({out}, '{{{name}}}', CAST({column} AS VARCHAR))"
    return out


@query("p8_session_report", using("v_sessions v_latest v_answers", f""", rs AS (SELECT * FROM v_latest l WHERE EXISTS (SELECT 1 FROM v_answers a
        WHERE NOT a.is_followup AND a.session_id = l.session_id AND a.question_id = l.question_id)), st AS ({_SESSION_STATS} FROM rs GROUP BY session_id),
    m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i FROM v_answers WHERE NOT is_followup),
    dg AS (SELECT m.session_id, string_agg(concat('Question ', i, ': ', substr(user_answer, 1, 60), '...', chr(10), '  Score: ', printf('%.1f', l.total_score), '/10', chr(10), '  Weaknesses: ', chr(10)), chr(10) ORDER BY i) AS digest
        FROM m JOIN v_latest l ON m.session_id = l.session_id AND m.question_id = l.question_id GROUP BY m.session_id),
    report AS (SELECT v.session_id, v.status, (end_time - start_time) / 6e7 AS total_minutes,
        CASE WHEN s.total_count > 0 THEN (end_time - start_time) / 6e7 / s.total_count ELSE 0e0 END AS minutes_per_question, {_ZERO},
        CASE WHEN s.session_id IS NULL THEN 'No questions were completed' ELSE '' END AS note, coalesce(digest, 'No answer records') AS digest
        FROM v_sessions v LEFT JOIN st s ON s.session_id = v.session_id LEFT JOIN dg ON dg.session_id = v.session_id)
    SELECT *, {_q_prompt()} AS prompt FROM report"""))
def p8(spark, sf):
    return pi.session_report(sessions(spark, sf), answers(spark, sf), scored(spark, sf), digits=RAW)["reports"]


@query("q04_extract_questions", using("v_docs", f""", {V_DRESSED}, {CLEANED.replace("v_docs", "v_dressed")},
    v_clean AS (SELECT c.doc_id, CASE WHEN coalesce(m, '') <> '' THEN m ELSE c.t END AS text FROM cleaned c LEFT JOIN marked k ON k.doc_id = c.doc_id
        JOIN v_dressed d ON d.doc_id = c.doc_id WHERE d.category <> 'src7' AND {q_strip("d.text")} <> ''),
    {MARKED.replace("v_dressed", "v_clean")}, qs AS (SELECT doc_id, pos, CASE WHEN {q_strip("qtext")} <> '' THEN {q_strip("qtext")} ELSE {q_strip("head")} END AS question
        FROM hd WHERE mk IS NOT NULL), qn AS (SELECT doc_id AS ord, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS seq, question FROM qs WHERE question <> '')
    SELECT ord, seq, question FROM qn WHERE length(question) >= 4 QUALIFY row_number() OVER (PARTITION BY question ORDER BY ord, seq) = 1"""))
def q04(spark, sf):
    d = dressed(spark, sf).select(
        F.col("source_file").alias("source_path"), "category", F.col("doc_id").alias("ord"), F.col("text").alias("full_text"),
        (F.col("category") == "src7").alias("is_template"))
    return pb.extract_questions(d, 4).select("ord", "seq", "question")


def _asked_sql(max_chars: int) -> str:
    return f"""{V_DRESSED}, {CLEANED.replace("v_docs", "v_dressed")},
    v_asked AS (SELECT d.doc_id, CASE WHEN d.category = 'src7' THEN 'template' WHEN d.doc_id % 13 = 0 THEN 'extract_failed' WHEN {q_strip("d.text")} = '' THEN 'empty'
        WHEN coalesce(m, '') = '' THEN 'no_text' END AS reason, coalesce(m, '') AS text FROM v_dressed d LEFT JOIN marked k ON k.doc_id = d.doc_id),
    v_live AS (SELECT doc_id, text FROM v_asked WHERE reason IS NULL), {q_sections("v_live", max_chars)},
    told AS (SELECT doc_id AS ord, seq + 1 AS section_index, {q_strip(q_sub(q_strip(q_sub("split_part(section, chr(10), 1)", tx.LIST_MARK, flags="")), SPACE + "+", " "))} AS question
        FROM sections WHERE (doc_id + seq + 1) % 7 <> 0),
    accepted AS (SELECT * FROM told WHERE length(question) >= 4)"""


def asked_model(spark, sf, max_chars=2000):
    """A stand-in for the model: the first line of a section, and some requests that fail."""
    d = dressed(spark, sf).select(
        F.col("source_file").alias("source_path"), "category", F.col("doc_id").alias("ord"), F.col("text").alias("full_text"),
        (F.col("category") == "src7").alias("is_template"),
        F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("broken"))).otherwise(F.expr("cast(array() as array<string>)")).alias("errors"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.substring_index("section", "\n", 1))), F.lit("\n```"))
    model = lambda rows: rows.withColumn("output", F.when((F.col("ord") + F.col("section_index")) % 7 != 0, answer))
    return pb.extract_with_model(d, model, max_chars=max_chars, min_length=4)


_QUESTIONS = """ SELECT ord, section_index, question FROM accepted
    QUALIFY row_number() OVER (PARTITION BY question ORDER BY ord, section_index) = 1"""
_UNPROCESSED = """, f AS (SELECT doc_id, bool_or((doc_id + seq + 1) % 7 = 0) AS failed FROM sections GROUP BY doc_id)
    SELECT a.doc_id AS ord, CASE WHEN coalesce(failed, false) THEN 'failed' ELSE 'skipped' END AS status,
        coalesce(reason, CASE WHEN failed THEN 'request_failed' WHEN f.doc_id IS NULL THEN 'no_sections' ELSE 'no_questions' END) AS reason
    FROM v_asked a LEFT JOIN f ON f.doc_id = a.doc_id WHERE a.doc_id NOT IN (SELECT ord FROM accepted)"""


@query("q04_model_questions", using("v_docs", f", {_asked_sql(2000)} {_QUESTIONS}"))
def q04_model(spark, sf):
    return asked_model(spark, sf)["questions"].select("ord", "section_index", "question")


@query("q04_unprocessed", using("v_docs", f", {_asked_sql(2000)} {_UNPROCESSED}"))
def q04_unprocessed(spark, sf):
    return asked_model(spark, sf)["unprocessed"].select("ord", "status", "reason")


# the same two with more sections to a document
@query("q04_model_questions_whole", using("v_docs", f", {_asked_sql(900)} {_QUESTIONS}"))
def q04_model_whole(spark, sf):
    return asked_model(spark, sf, 900)["questions"].select("ord", "section_index", "question")


@query("q04_unprocessed_whole", using("v_docs", f", {_asked_sql(900)} {_UNPROCESSED}"))
def q04_unprocessed_whole(spark, sf):
    return asked_model(spark, sf, 900)["unprocessed"].select("ord", "status", "reason")


def _landing(df, name):
    """The rows as the files a stream would find, in several pieces."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", 200_000).parquet(path)
    return path, df.schema


@query("st1_index_stream", "SELECT doc_id AS chunk_id, length(text)::INTEGER AS n FROM documents")
def st1(spark, sf):
    """Repeats within a batch and across batches; ids seen are state of the query."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("seen_at"))
    src, schema = _landing(d.unionByName(d.where("chunk_id % 4 = 0")), "chunks")
    out = scratch_path(spark, "index")
    chunks = st.read_stream(spark, src, schema, files_per_batch=3)
    st.index_stream(chunks, out, scratch_path(spark, "state"), letter_encoder, time="seen_at", within="36500 days").awaitTermination()
    return spark.read.parquet(out).select("chunk_id", F.length("content").alias("n"))


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), (F.col("event_id") % 97).alias("question_id"),
        F.col("ts").cast("timestamp").alias("ts"))


def _ending(spark, src, rows):
    """A last row of a session of its own, long after the others: what waits on time is told then."""
    later = rows.limit(1).withColumn("session_id", F.lit(-1).cast("long")).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    later.select(*rows.columns).write.mode("append").parquet(src)


@query("st2_backlog_stream", """WITH a AS (SELECT event_id AS id, user_id AS session_id, event_id % 97 AS question_id, ts FROM events),
    open AS (SELECT * FROM a WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM a e WHERE e.id % 3 = 0 AND e.session_id = a.session_id AND e.question_id = a.question_id
        AND e.ts >= a.ts AND e.ts <= a.ts + INTERVAL 30 DAYS))
    SELECT session_id, question_id, min_by(id, (ts, id)) AS id FROM open GROUP BY session_id, question_id""")
def st2_backlog(spark, sf):
    """Answers and evaluations land in two streams, files in no order of time; the first answer without an evaluation within 30 days."""
    rows = _events(spark, sf)
    given, schema = _landing(rows.where("id % 3 <> 0"), "answers")
    told, _ = _landing(rows.where("id % 3 = 0"), "evaluations")
    for src in (given, told):
        _ending(spark, src, rows)
    answers_ = st.read_stream(spark, given, schema).withColumnRenamed("ts", "answered_at")
    evaluations_ = st.read_stream(spark, told, schema).withColumnRenamed("ts", "evaluated_at")
    out = scratch_path(spark, "backlog")
    st.backlog_stream(answers_, evaluations_, out, scratch_path(spark, "state"), "30 days", "3650 days").awaitTermination()
    return st.first_answers(spark.read.schema(answers_.schema).parquet(out)).select("session_id", "question_id", "id")


@query("st3_session_timeout", """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) // 1000 AS ms FROM events),
    g AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) > 43200000, true)::INTEGER AS cut FROM e),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS part FROM g)
    SELECT session_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS events FROM i GROUP BY session_id, part""")
def st3_timeout(spark, sf):
    """Sessions that end by twelve hours of silence."""
    rows = _events(spark, sf).select("session_id", "ts")
    src, schema = _landing(rows, "events")
    _ending(spark, src, rows)
    out = scratch_path(spark, "ended")
    st.ended_stream(st.read_stream(spark, src, schema), out, scratch_path(spark, "state"), 43_200_000, "3650 days").awaitTermination()
    return spark.read.parquet(out).select("session_id", "first_ms", "last_ms", "events")


@query("st2_evaluation_stream", using("v_answers", " SELECT session_id, question_id, length(user_answer)::DOUBLE / 100 AS total_score FROM v_answers"))
def st2(spark, sf):
    a = answers(spark, sf)
    src, schema = _landing(a, "answers")
    out = scratch_path(spark, "evaluations")
    score = lambda rows: rows.select(*iv.KEYS, (F.length("user_answer").cast("double") / 100).alias("total_score"))
    for _ in range(2):
        # The second run starts from nothing and finds every answer scored.
        st.evaluation_stream(st.read_stream(spark, src, schema), out, scratch_path(spark, "state"), score).awaitTermination()
    return spark.read.parquet(out)


@query("st3_session_progress", """SELECT user_id AS session_id, count_if(event_type <> 'error')::BIGINT AS asked, max_by(event_type, (ts, event_type)) AS last_kind,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 AS minutes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 >= 42000 OR count_if(event_type <> 'error') >= 60 AS should_end
    FROM events GROUP BY user_id""")
def st3(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    src, schema = _landing(e, "events")
    out = scratch_path(spark, "progress")
    st.progress_stream(st.read_stream(spark, src, schema), out, scratch_path(spark, "state")).awaitTermination()
    now = st.whole_sessions(spark.read.parquet(out))
    return st.with_limits(now, 42000, 60).select("session_id", "asked", "last_kind", "minutes", "should_end")


@query("st4_quality_stream", f"{_CHECKED} SELECT id, is_valid FROM checked")
def st4(spark, sf):
    rows = checked(spark, sf).drop("is_valid", "issues", *op.SCORES)
    src, schema = _landing(rows, "chunks")
    good, bad = scratch_path(spark, "valid"), scratch_path(spark, "invalid")
    st.quality_stream(st.read_stream(spark, src, schema), good, bad, scratch_path(spark, "state"), **LIMITS).awaitTermination()
    return spark.read.parquet(good).select("id", "is_valid").unionByName(spark.read.parquet(bad).select("id", "is_valid"))
