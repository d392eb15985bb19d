"""Catalogue, labels, joins and unions over all documents."""

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import lexicon as lx
from ..functions import segment as sg
from ..functions import text as tx
from ..operators import catalog as ct
from ..sources import files as fl
from ..session import materialize
from .registry import query
from .segment import HEADED, PAIRS, V_DRESSED, dressed
from .views import docs, lit, q_any, q_case, q_strip, table, using

# --- a listing made of all documents and pages -------------------------------
_FOLDERS = ["", "demo/", "notes/logs/", "Example/", "hr/"]
_SUFFIXES = [".md", ".PDF", ".png", ".xyz", ".txt", ".docx"]
_LISTING = f"""listing AS (SELECT concat('/corpus/', CASE WHEN id % 11 = 0 THEN '' ELSE concat(source, '/') END,
        [{", ".join(map(lit, _FOLDERS))}][(id % 5 + 1)::INTEGER],
        id, [{", ".join(map(lit, _SUFFIXES))}][(id % 6 + 1)::INTEGER]) AS path, length FROM (
        SELECT doc_id AS id, source, n_chars AS length FROM documents
        UNION ALL SELECT 1000000000 + page_id, 'web', length(html) FROM pages))"""
_FILES = f"""{_LISTING}, parts AS (SELECT path, length AS size, string_split(substr(path, 9), '/') AS ps FROM listing),
    named AS (SELECT *, ps[len(ps)] AS name, lower(regexp_extract(ps[len(ps)], '(?s)^.+(\\.[^.]+)$', 1)) AS suffix,
        CASE WHEN len(ps) > 1 THEN ps[1] ELSE '未分类' END AS category FROM parts),
    files AS (SELECT path, name, suffix, size, category, CASE WHEN len(ps) > 1 THEN ps[len(ps) - 1] ELSE 'corpus' END AS parent_folder,
        {q_any("lower(path)", lx.PATH_TEMPLATE_WORDS)} OR (({q_any("lower(category)", ["hr", "简历"])}) AND suffix IN ('.doc', '.docx', '.pdf', '.rtf', '.wps')) AS is_template,
        suffix IN ({", ".join(map(lit, lx.IMAGE_SUFFIXES))}) AS needs_ocr FROM named
        WHERE NOT list_has_any(ps[1:len(ps) - 1], [{", ".join(map(lit, lx.SKIP_DIRS))}]) AND NOT {q_any("lower(path)", lx.SKIP_PATH_WORDS)}
        AND suffix IN ({", ".join(map(lit, lx.DOCUMENT_SUFFIXES + lx.IMAGE_SUFFIXES))}))"""


def listing(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("length"))
    p = table(spark, sf, "pages").select(
        (F.lit(1000000000) + F.col("page_id")).alias("id"), F.lit("web").alias("source"),
        F.length("html").cast("bigint").alias("length"))
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("id") % n).cast("int"))
    return d.unionByName(p).select(
        F.concat(F.lit("/corpus/"), F.when(F.col("id") % 11 == 0, "").otherwise(F.concat("source", F.lit("/"))),
                 pick(_FOLDERS, 5), F.col("id").cast("string"), pick(_SUFFIXES, 6)).alias("path"), "length")


@query("s01_catalogue", f"WITH {_FILES} SELECT * FROM files")
def s01(spark, sf):
    return fl.describe_paths(listing(spark, sf), "/corpus")


_STATS = "count(*) AS files, sum(size)::BIGINT AS size, count_if(is_template)::BIGINT AS templates, count_if(NOT is_template)::BIGINT AS interview_files, count_if(needs_ocr)::BIGINT AS ocr_needed"


@query("a01_catalogue_statistics", f"""WITH {_FILES} SELECT 'all' AS level, '' AS key, {_STATS} FROM files
    UNION ALL SELECT 'suffix', suffix, {_STATS} FROM files GROUP BY suffix
    UNION ALL SELECT 'category', category, {_STATS} FROM files GROUP BY category""")
def a01(spark, sf):
    return ct.catalogue_statistics(fl.describe_paths(listing(spark, sf), "/corpus"))


@query("k09_folder_order", f"""WITH {_FILES} SELECT category AS folder, name, row_number() OVER (ORDER BY category, name, path) AS place FROM files""")
def k09(spark, sf):
    files = fl.describe_paths(listing(spark, sf), "/corpus").select(
        F.col("category").alias("folder"), "name", "path").orderBy("folder", "name", "path")
    return with_global_position(files)


def with_global_position(ordered):
    """Position in a globally sorted result: partition offsets plus local index."""
    from ..session import materialize
    from pyspark.sql import Window
    parts = materialize(
        ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return parts.join(offsets, "_p").select(
        "folder", "name", (F.col("_off") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


# --- documents, markdown variants, samples --------------------------------------
@query("j01_text_samples", using("v_docs", f""", s AS (SELECT source_file, substr(t, 1, 4000) AS sample FROM (
        SELECT source_file, {q_strip("CASE WHEN lang = 'en' THEN '# ' || text ELSE text END")} AS t FROM v_docs WHERE lang <> 'de') WHERE t <> '')
    SELECT d.doc_id, s.sample FROM v_docs d LEFT JOIN s ON d.source_file = s.source_file"""))
def j01(spark, sf):
    d = docs(spark, sf)
    extracted = d.where("lang <> 'de'").select(
        F.col("source_file").alias("source_path"), F.col("text").alias("full_text"),
        F.when(F.col("lang") == "en", F.concat(F.lit("# "), "text")).alias("markdown_text"))
    files = d.select("doc_id", F.col("source_file").alias("path"))
    return ct.with_samples(files, ct.text_samples(extracted)).select("doc_id", "sample")


WORDS = dict(template_words=["src1", "9.md"], question_words=["src2", "src3", "3.md"],
             experience_words=["src4", "tion", "1.md"], resume_path_words=["src11"],
             resume_section_words=["the", "tion", "eau", "und", "sch", "ing"], qa_words=("the", "and"))


def classified(spark, sf):
    d = docs(spark, sf)
    files = d.select(
        F.col("source_file").alias("path"), F.concat("doc_id", F.lit(".md")).alias("name"), "category",
        (F.col("category") == "src5").alias("is_template"))
    extracted = d.where("lang <> 'de'").select(
        F.col("source_file").alias("source_path"), F.replace("text", F.lit("."), F.lit("?")).alias("full_text"),
        F.lit(None).cast("string").alias("markdown_text"))
    return ct.classify_files(files, ct.text_samples(extracted), **WORDS)


def _hits(x, words):
    return "(" + " + ".join(f"contains({x}, {lit(w)})::INTEGER" for w in words) + ")"


_W = WORDS
_CLASSED = f"""src AS (SELECT source_file AS path, doc_id || '.md' AS name, category, category = 'src5' AS is_template,
        CASE WHEN lang <> 'de' THEN substr({q_strip("replace(text, '.', '?')")}, 1, 4000) ELSE '' END AS t FROM v_docs),
    f AS (SELECT *, lower(concat_ws(' ', path, name, category)) AS c FROM src),
    g AS (SELECT *, t <> '' AND (contains(lower(path), 'src11') OR ({_hits("t", _W["resume_section_words"])} >= 4 AND length(t) < 4000) OR {_hits("t", _W["resume_section_words"])} >= 6) AS resume,
        length(t) - length(replace(replace(t, '?', ''), '？', '')) >= 5 AS marks, contains(t, 'the') AND contains(t, 'and') AS qa,
        {q_any("t", _W["experience_words"])} AS told FROM f),
    sc AS (SELECT *, {_hits("c", _W["template_words"])} * 3 + resume::INTEGER * 5 AS ts,
        {_hits("c", _W["question_words"])} * 2 + marks::INTEGER * 2 + qa::INTEGER * 3 AS qs,
        {_hits("c", _W["experience_words"])} * 2 + told::INTEGER AS es FROM g),
    classed AS (SELECT path, CASE WHEN is_template THEN '模板' WHEN greatest(ts, qs, es) = 0 THEN '其他' WHEN ts >= qs AND ts >= es THEN '模板'
            WHEN qs >= es THEN '题库' ELSE '经验' END AS class,
        CASE WHEN is_template THEN 1e0 WHEN ts + qs + es = 0 THEN 0e0 ELSE CAST(greatest(ts, qs, es) AS DOUBLE) / (ts + qs + es) END AS confidence,
        CASE WHEN is_template THEN 'scan_template' ELSE coalesce(nullif(concat_ws(', ',
            {", ".join(f"CASE WHEN contains(c, {lit(w)}) THEN {lit('path_template:' + w)} END" for w in _W["template_words"])},
            CASE WHEN resume THEN 'text_resume_template' END,
            {", ".join(f"CASE WHEN contains(c, {lit(w)}) THEN {lit('path_question:' + w)} END" for w in _W["question_words"])},
            {", ".join(f"CASE WHEN contains(c, {lit(w)}) THEN {lit('path_experience:' + w)} END" for w in _W["experience_words"])},
            CASE WHEN marks THEN 'text_qmarks' END, CASE WHEN qa THEN 'text_qa_pair' END,
            CASE WHEN told THEN 'text_experience_kw' END), ''), 'no_match') END AS reasons FROM sc)"""


@query("t13_file_class", using("v_docs", f", {_CLASSED} SELECT * FROM classed"))
def t13(spark, sf):
    return classified(spark, sf)


@query("a04_class_counts", using("v_docs", f", {_CLASSED} SELECT class, count(*) AS files FROM classed GROUP BY class"))
def a04(spark, sf):
    return ct.class_counts(classified(spark, sf)).drop("skipped")


# --- labels ------------------------------------------------------------------------
CATEGORY = {"其他": ["src1/", "src2/"], "笔试题": ["src3", "src4"], "面试技巧": ["src5", "src1"]}
FOLDERS = {"src7": "AI", "src8": "DB", "src9": "AI", "src1": "Web", "corpus/src4": "Inner"}
CONTENT = {"EN": ["with the", "ther"], "FR": ["eau"], "DE": ["und", "sch"]}
DIFFICULTY = {"基础": ["theth", "auxaux"], "进阶": ["ingthe", "cióncion"], "高级": ["blendble"]}
TYPES = {"概念题": ["the a", "le la"], "对比题": ["der die", "ing of"]}


def chunk_rows(spark, sf):
    """Every document as a chunk with its first sentence as question."""
    d = docs(spark, sf)
    return d.select(
        F.col("doc_id").alias("chunk_id"), "source_file", F.col("text").alias("content"),
        F.when(F.col("lang") != "es", F.split_part("text", F.lit("."), F.lit(1))).alias("question"),
        F.replace("text", F.lit("\n"), F.lit("\n- ")).alias("answer"))


def labelled(spark, sf):
    c = F.col
    return chunk_rows(spark, sf).select(
        "chunk_id",
        lb.content_category(c("source_file"), CATEGORY).alias("content_category"),
        lb.position(c("source_file"), c("content"), FOLDERS, CONTENT).alias("position"),
        lb.difficulty(c("content"), c("question"), DIFFICULTY, ["sheth"], ["the "]).alias("difficulty"),
        lb.question_type(c("question"), c("answer"), TYPES).alias("question_type"))


_EXACT = "CASE " + " ".join(f"WHEN list_contains(string_split(source_file, '/'), {lit(k)}) THEN {lit(v)}" for k, v in FOLDERS.items()) + " END"
_INSIDE = "CASE " + " ".join(f"WHEN contains(source_file, {lit(k)}) THEN {lit(v)}" for k, v in FOLDERS.items()) + " END"
_BY_ANSWER = """CASE WHEN contains(a, '```') OR contains(a, 'def ') OR contains(a, 'function') THEN '代码题'
    WHEN len(string_split(a, chr(10) || '-')) - 1 > 3 OR len(string_split(a, chr(10) || '•')) - 1 > 3 THEN '对比题' ELSE '概念题' END"""
_LABELLED = f"""ch AS (SELECT doc_id AS chunk_id, source_file, text AS content, CASE WHEN lang <> 'es' THEN split_part(text, '.', 1) END AS question,
        lower(replace(text, chr(10), chr(10) || '- ')) AS a FROM v_docs),
    labelled AS (SELECT chunk_id, {q_case("source_file", CATEGORY, "'面试题'")} AS content_category,
        coalesce({_EXACT}, {_INSIDE}, {q_case("lower(content)", CONTENT, "'通用'")}) AS position,
        {q_case("lower(content)", DIFFICULTY, "CASE WHEN contains(lower(content), 'sheth') THEN '高级' WHEN coalesce(contains(lower(question), 'the '), false) THEN '基础' ELSE '进阶' END")} AS difficulty,
        CASE WHEN coalesce(question, '') = '' THEN '知识点' ELSE {q_case("lower(question)", TYPES, _BY_ANSWER)} END AS question_type FROM ch)"""
for _op, _col in [("t14_content_category", "content_category"), ("t15_position", "position"),
                  ("t16_difficulty", "difficulty"), ("t17_question_type", "question_type")]:
    query(_op, using("v_docs", f", {_LABELLED} SELECT chunk_id, {_col} FROM labelled"))(
        lambda spark, sf, _c=_col: labelled(spark, sf).select("chunk_id", _c))


@query("t18_custom_labels", using("v_docs", f""", {_LABELLED} SELECT chunk_id, position, 'own' AS difficulty, 'r1' AS round FROM labelled"""))
def t18(spark, sf):
    base = labelled(spark, sf)
    meta = F.create_map(F.lit("position"), F.col("position"), F.lit("difficulty"), F.col("difficulty"))
    m = lb.add_labels(meta, {"difficulty": "own", "round": "r1"})
    return base.select("chunk_id", m.alias("m")).select(
        "chunk_id", *[F.element_at("m", k).alias(k) for k in ("position", "difficulty", "round")])


@query("a02_label_statistics", using("v_docs", f""", {_LABELLED}, x AS (SELECT chunk_id, content_category,
        CASE WHEN position <> 'AI' THEN position END AS position, difficulty, question_type FROM labelled)
    """ + " UNION ALL ".join(
    f"SELECT '{c}' AS label, coalesce({c}, '未标注') AS value, count(*) AS n FROM x GROUP BY 2" for c in ct.LABELS)))
def a02(spark, sf):
    x = labelled(spark, sf).withColumn("position", F.when(F.col("position") != "AI", F.col("position")))
    return ct.label_statistics(x)


@query("j13_folder_positions", using("v_docs", f""", p AS (SELECT doc_id, unnest(string_split(source_file, '/')) AS folder,
        generate_subscripts(string_split(source_file, '/'), 1) AS at_ FROM v_docs),
    m(folder, position) AS (VALUES {", ".join(f"({lit(k)}, {lit(v)})" for k, v in FOLDERS.items())})
    SELECT doc_id, min_by(position, at_) AS position FROM p JOIN m USING (folder) GROUP BY doc_id"""))
def j13(spark, sf):
    mapping = spark.createDataFrame(list(FOLDERS.items()), "folder string, position string")
    return ct.folder_positions(docs(spark, sf), "source_file", mapping, "doc_id")


# --- incremental, repair, unions -----------------------------------------------------
@query("j02_new_rows", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j02(spark, sf):
    return ct.new_rows(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("j03_merge_reprocessed", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('again: ', d.text) ELSE d.text END AS text,
    CASE WHEN l.doc_id IS NOT NULL THEN NULL ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j03(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    repaired = d.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.concat(F.lit("again: "), "text").alias("text"), F.lit(None).cast("string").alias("lang"))
    return ct.merge_reprocessed(d, repaired, "doc_id", ["text", "lang"])


_J7 = f"""{V_DRESSED}, {PAIRS}, x AS (SELECT * FROM pairs WHERE answer <> ''), {HEADED},
    y AS (SELECT * FROM headed h WHERE answer <> '' AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = h.doc_id
        AND x.start_pos <= h.start_pos AND h.end_pos <= x.end_pos))"""


def _two(spark, sf):
    n = dressed(spark, sf).select("doc_id", sg.normalise_document(F.col("text")).alias("t"))
    # Both kinds are read more than once, so texts are parsed once and the pairs written.
    made = materialize(n.select("doc_id", sg.pairs_by_markers(F.col("t")).alias("e"), sg.pairs_by_headings(F.col("t")).alias("h")), "pairs")
    return made.select("doc_id", F.inline("e")), made.select("doc_id", F.inline("h"))


@query("j07_outside_pairs", using("v_docs", f", {_J7} SELECT doc_id, question, start_pos, end_pos FROM y"))
def j07(spark, sf):
    explicit, headings = _two(spark, sf)
    return ct.outside_pairs(headings, explicit, "doc_id").select("doc_id", "question", "start_pos", "end_pos")


@query("u04_explicit_and_headings", using("v_docs", f""", {_J7}, u AS (SELECT doc_id, question, start_pos FROM x UNION ALL SELECT doc_id, question, start_pos FROM y)
    SELECT doc_id, question, start_pos FROM u"""))
def u04(spark, sf):
    explicit, headings = _two(spark, sf)
    both = explicit.unionByName(ct.outside_pairs(headings, explicit, "doc_id"))
    return both.select("doc_id", "question", "start_pos").orderBy("doc_id", "start_pos")


_OUT = """SELECT d.doc_id, d.source AS folder, length(d.text) AS n, CASE WHEN l.toxic = 1 THEN 'failed'
    WHEN l.quality = 0 OR l.doc_id IS NULL THEN 'skipped' ELSE 'processed' END AS status,
    CASE WHEN l.toxic = 1 THEN 'request_failed' WHEN l.quality = 0 THEN 'no_questions' WHEN l.doc_id IS NULL THEN 'no_text' END AS reason,
    len(string_split(d.text, '.')) AS questions, CASE WHEN length(d.text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(d.text) / 1.5e0) AS INTEGER)) END AS tokens
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def outcomes(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").when(
        (F.col("quality") == 0) | F.col("seen").isNull(), "skipped").otherwise("processed")
    reason = F.when(F.col("toxic") == 1, "request_failed").when(F.col("quality") == 0, "no_questions").when(
        F.col("seen").isNull(), "no_text")
    return d.select("doc_id", F.col("source").alias("folder"), status.alias("status"), reason.alias("reason"),
                    F.size(F.split("text", r"\.", -1)).alias("questions"), tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("a09_folder_progress", f"""WITH o AS ({_OUT}) SELECT folder, count_if(status = 'processed')::BIGINT AS processed,
    count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'failed')::BIGINT AS failed,
    sum(questions)::BIGINT AS questions, sum(tokens)::BIGINT AS est_tokens FROM o GROUP BY folder""")
def a09(spark, sf):
    return ct.folder_progress(outcomes(spark, sf))


@query("u05_unprocessed", f"WITH o AS ({_OUT}) SELECT doc_id, folder, reason, status FROM o WHERE status <> 'processed'")
def u05(spark, sf):
    o = outcomes(spark, sf).select("doc_id", "folder", "reason", "status")
    return ct.unprocessed(o.where("status = 'skipped'").drop("status"), o.where("status = 'failed'").drop("status"))


@query("a16_outcome_counts", f"WITH o AS ({_OUT}) SELECT coalesce(reason, 'success') AS outcome, count(*) AS n FROM o GROUP BY 1")
def a16(spark, sf):
    return ct.outcome_counts(outcomes(spark, sf).select(F.coalesce("reason", F.lit("success")).alias("outcome")))


@query("u01_append_chunks", """SELECT doc_id, 'old' AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT doc_id, 'new' FROM labels WHERE toxic = 1""")
def u01(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1")
    old = d.join(l, "doc_id", "left_anti").select("doc_id", F.lit("old").alias("batch"))
    return old.unionByName(l.select("doc_id", F.lit("new").alias("batch")))
