"""Quality measures over whole documents and over their forced-split chunks."""

from pyspark.sql import functions as F

from ..functions import quality as ql
from ..functions import segment as sg
from ..functions.patterns import NORMAL_CHARS
from ..operators import quality as op
from .registry import query
from .views import docs, lit, q_avg, q_strip, q_sub, table, using

_GARBLED = f"(CASE WHEN length(t) > 0 THEN 1e0 - CAST(length(t) - length({q_sub('t', f'[{NORMAL_CHARS}]')}) AS DOUBLE) / length(t) ELSE 0e0 END)"
_SPECIAL = f"(CASE WHEN length(t) > 0 THEN CAST(length({q_sub('t', f'[{NORMAL_CHARS}]')}) AS DOUBLE) / length(t) ELSE 0e0 END)"

# Repetition by positions: text as rows of characters, neighbours by window.
_CHARS = """chars AS (SELECT id, unnest(string_split(t, '')) AS ch,
        generate_subscripts(string_split(t, ''), 1) AS pos FROM src WHERE length(t) >= 20)"""
_RUNS = """runs AS (SELECT id, count(*) * 4 AS len FROM (
        SELECT id, grp, ch, count(*) AS n FROM (
            SELECT id, ch, pos - row_number() OVER (PARTITION BY id, ch ORDER BY pos) AS grp FROM chars)
        WHERE ch <> chr(10) GROUP BY id, grp, ch HAVING count(*) >= 5) GROUP BY id)"""


def _grams(n: int) -> str:
    return f"""eq{n} AS (SELECT id, pos, coalesce(ch = lead(ch, {n}) OVER (PARTITION BY id ORDER BY pos), false) AS same FROM chars),
    tw{n} AS (SELECT id, pos FROM (SELECT id, pos, count_if(same) OVER (PARTITION BY id ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS k FROM eq{n}) WHERE k = {n}),
    pat{n} AS (SELECT DISTINCT s.id, s.t, substr(s.t, w.pos, {n}) AS p FROM tw{n} w JOIN src s ON s.id = w.id),
    cnt{n} AS (SELECT id, strpos(t, p) - 1 AS beg, (length(t) - length(replace(t, p, ''))) // {n} AS n, length(t) AS len FROM pat{n}),
    gram{n} AS (SELECT id, (min_by(n, beg) - 1) * {n} AS len FROM cnt{n} WHERE n > 2 AND beg < len - {2 * n} GROUP BY id)"""


_REPEAT = f"""{_CHARS}, {_RUNS}, {_grams(3)}, {_grams(5)}, {_grams(10)},
    rep AS (SELECT s.id, CASE WHEN length(s.t) < 20 THEN 0e0 ELSE least(1e0,
        CAST(coalesce(r.len, 0) + coalesce(a.len, 0) + coalesce(b.len, 0) + coalesce(c.len, 0) AS DOUBLE) / length(s.t)) END AS r
        FROM src s LEFT JOIN runs r ON s.id = r.id LEFT JOIN gram3 a ON s.id = a.id
        LEFT JOIN gram5 b ON s.id = b.id LEFT JOIN gram10 c ON s.id = c.id)"""


@query("t19_garbled_ratio", using("v_docs", f", src AS (SELECT doc_id, text AS t FROM v_docs) SELECT doc_id, {_GARBLED} AS garbled FROM src"))
def t19(spark, sf):
    return docs(spark, sf).select("doc_id", ql.garbled_ratio(F.col("text")).alias("garbled"))


@query("t20_special_ratio", using("v_docs", f", src AS (SELECT doc_id, text AS t FROM v_docs) SELECT doc_id, {_SPECIAL} AS special FROM src"))
def t20(spark, sf):
    return docs(spark, sf).select("doc_id", ql.special_ratio(F.col("text")).alias("special"))


@query("t21_repetition_ratio", f"""WITH src AS (SELECT doc_id AS id, text AS t FROM documents
        UNION ALL SELECT -1 - page_id, html FROM pages), {_REPEAT}
    SELECT id, r AS repetition FROM rep""")
def t21(spark, sf):
    both = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).unionByName(
        table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("t")))
    return both.select("id", ql.repetition_ratio(F.col("t")).alias("repetition"))


# Turns of a conversation as question/answer records, some with a side missing.
def qa_records(spark, sf):
    c = table(spark, sf, "conversations")
    q = F.when(F.col("turn") % 5 == 1, F.lit(None).cast("string")).when(
        F.col("turn") % 5 == 2, F.substr("text", F.lit(1), F.lit(3))).otherwise(F.split_part("text", F.lit("."), F.lit(1)))
    a = F.when(F.col("turn") % 7 == 1, F.lit("")).when(
        F.col("turn") % 7 == 3, F.substr("text", F.lit(1), F.lit(8))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", q.alias("question"), a.alias("answer"))


_QA = """SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN NULL WHEN turn % 5 = 2 THEN substr(text, 1, 3)
        ELSE split_part(text, '.', 1) END AS question,
        CASE WHEN turn % 7 = 1 THEN '' WHEN turn % 7 = 3 THEN substr(text, 1, 8) ELSE text END AS answer
        FROM conversations"""


@query("t22_pair_issues", f"""WITH qa AS ({_QA}) SELECT conv_id, turn, concat_ws(';',
    CASE WHEN coalesce(question, '') = '' THEN '缺少问题' WHEN length(question) < 5 THEN '问题过短' END,
    CASE WHEN coalesce(answer, '') = '' THEN '缺少答案' WHEN length(answer) < 10 THEN '答案过短' END) AS issues FROM qa""")
def t22(spark, sf):
    qa = qa_records(spark, sf)
    return qa.select("conv_id", "turn", F.array_join(
        ql.pair_issues(F.col("question"), F.col("answer")), ";").alias("issues"))


# Lower limits than the defaults, since the prose is mostly sound.
LIMITS = {"garbled_max": 0.02, "repetition_max": 0.01, "special_max": 0.05}
_CHECK_SRC = f"""src AS (SELECT doc_id AS id, text AS t, 'text' AS kind, NULL AS question, NULL AS answer FROM documents
        UNION ALL SELECT -1 - (conv_id * 4294967296 + turn), answer, 'qa', question, answer FROM qa)"""
_CHECKED = f"""WITH qa AS ({_QA}), {_CHECK_SRC}, {_REPEAT},
    m AS (SELECT s.*, {_GARBLED} AS g, {_SPECIAL} AS sp, rep.r FROM src s JOIN rep ON s.id = rep.id),
    iss AS (SELECT *, list_filter([
        CASE WHEN length(t) < 20 THEN concat('内容过短（', length(t), '字符）') END,
        CASE WHEN g > 0.02 THEN concat('疑似乱码（非正常字符占比: ', printf('%.2f', g * 100), '%）') END,
        CASE WHEN r > 0.01 THEN concat('大量重复内容（重复率: ', printf('%.2f', r * 100), '%）') END,
        CASE WHEN sp > 0.05 THEN concat('特殊字符过多（占比: ', printf('%.2f', sp * 100), '%）') END,
        CASE WHEN kind <> 'qa' THEN NULL WHEN coalesce(question, '') = '' THEN '缺少问题' WHEN length(question) < 5 THEN '问题过短' END,
        CASE WHEN kind <> 'qa' THEN NULL WHEN coalesce(answer, '') = '' THEN '缺少答案' WHEN length(answer) < 10 THEN '答案过短' END],
        lambda x: x IS NOT NULL) AS issues FROM m WHERE {q_strip("t")} <> ''),
    scored AS (SELECT *, greatest(0e0, least(1e0, 1e0 - g * 0.5e0 - r * 0.3e0 - sp * 0.2e0 - len(issues) * 0.1e0)) AS overall FROM iss),
    checked AS (SELECT id, len(issues) = 0 OR overall >= 0.6 AS is_valid, issues, overall, g AS garbled_ratio,
        r AS repetition_ratio, sp AS special_char_ratio FROM scored
        UNION ALL SELECT id, false, ['内容为空'], 0e0, NULL, NULL, NULL FROM m WHERE {q_strip("t")} = '')"""


def checked(spark, sf):
    null = F.lit(None).cast("string")
    whole = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("text").alias("chunk_type"),
        null.alias("question"), null.alias("answer"))
    turns = qa_records(spark, sf).select(
        (-1 - (F.col("conv_id") * 4294967296 + F.col("turn"))).alias("id"), F.col("answer").alias("content"),
        F.lit("qa").alias("chunk_type"), "question", "answer")
    return op.validate_chunks(whole.unionByName(turns), **LIMITS)


@query("t23_validate", f"""{_CHECKED} SELECT id, is_valid, array_to_string(issues, ';') AS issues, overall,
    garbled_ratio, repetition_ratio, special_char_ratio FROM checked""")
def t23(spark, sf):
    return checked(spark, sf).select(
        "id", "is_valid", F.array_join("issues", ";").alias("issues"), *op.SCORES)


_MMM = ", ".join(f"{q_avg(s)} AS {s}_mean, min({s}) AS {s}_min, max({s}) AS {s}_max" for s in op.SCORES)


@query("a03_score_summary", f"""{_CHECKED} SELECT count(*) AS total, count_if(is_valid)::BIGINT AS valid,
    count_if(NOT is_valid)::BIGINT AS invalid, {_MMM} FROM checked""")
def a03(spark, sf):
    return op.score_summary(checked(spark, sf))


@query("a03_issue_summary", f"""{_CHECKED}, i AS (SELECT {q_sub("unnest(issues)", "[0-9]+[.]?[0-9]*%?", "X")} AS issue FROM checked)
    SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def a03_issues(spark, sf):
    return op.issue_summary(checked(spark, sf))


@query("a03_invalid_samples", f"""{_CHECKED} SELECT id, array_to_string(issues, ';') AS issues, overall FROM checked
    WHERE NOT is_valid ORDER BY id LIMIT 20""")
def a03_invalid(spark, sf):
    return op.invalid_samples(checked(spark, sf), 20, "id").select(
        "id", F.array_join("issues", ";").alias("issues"), "overall")


@query("k05_review_sample", """SELECT doc_id, source FROM documents ORDER BY md5(concat('review', doc_id)), doc_id
    LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1e0) AS BIGINT)) FROM documents)""")
def k05(spark, sf):
    return op.review_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
