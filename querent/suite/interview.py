"""Interview analytics over all events, conversation turns and bank items."""

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import scores as sc
from ..functions import text as tx
from ..functions.patterns import CJK_CHARS
from ..operators import interview as iv
from .registry import query
from .views import answers, evaluations, lit, personas, q_avg, q_sub, questions, sessions, table, using

# Hashed queries compare unrounded values; rounding is tested on its own.
RAW = None


def scored(spark, sf):
    e = evaluations(spark, sf)
    return e.withColumn("total_score", sc.total_score(*[F.col(d) for d in iv.DIMENSIONS], digits=RAW))


def newest(spark, sf):
    return iv.latest_evaluations(scored(spark, sf))


_BIASED = """p AS (SELECT * FROM v_evaluations e JOIN v_persona p ON p.persona_id = e.session_id % 4),
    b AS (SELECT id, session_id, failed, name,
        CASE WHEN failed THEN 0e0 ELSE least(10e0, greatest(0e0, technical_accuracy + technical_weight)) END AS technical_accuracy,
        CASE WHEN failed THEN 0e0 ELSE least(10e0, greatest(0e0, clarity + clarity_weight)) END AS clarity,
        CASE WHEN failed THEN 0e0 ELSE least(10e0, greatest(0e0, depth_breadth + depth_weight)) END AS depth_breadth FROM p),
    t AS (SELECT *, technical_accuracy * 0.5e0 + clarity * 0.2e0 + depth_breadth * 0.3e0 AS total_score FROM b)"""


def evaluated(spark, sf):
    rows = evaluations(spark, sf).withColumn("persona_id", (F.col("session_id") % 4).cast("int"))
    return iv.evaluate(iv.with_persona(rows, personas(spark), "persona_id"), RAW)


@query("t37_persona_bias", using("v_evaluations v_persona", f", {_BIASED} SELECT id, technical_accuracy, clarity, depth_breadth FROM t"))
def t37(spark, sf):
    return evaluated(spark, sf).select("id", *iv.DIMENSIONS)


@query("t38_keyword_coverage", """WITH k AS (SELECT doc_id, len(string_split(text, '.')) - 1 AS h, length(text) - length(replace(text, chr(10), '')) AS m FROM documents)
    SELECT doc_id, CASE WHEN h + m = 0 THEN 1e0 ELSE CAST(h AS DOUBLE) / (h + m) END AS coverage FROM k""")
def t38(spark, sf):
    rest = lambda parts: F.slice(parts, F.lit(2), F.size(parts))
    hit = rest(F.split("text", r"\.", -1))
    missed = rest(F.split("text", "\n", -1))
    return table(spark, sf, "documents").select("doc_id", sc.keyword_coverage(hit, missed, RAW).alias("coverage"))


@query("t39_total_score", using("v_scored", " SELECT id, total_score FROM v_scored"))
def t39(spark, sf):
    return scored(spark, sf).select("id", "total_score")


@query("t40_followup_band", using("v_evaluations v_persona", f", {_BIASED} SELECT id, NOT failed AND total_score BETWEEN 6 AND 8 AS needs_followup FROM t"))
def t40(spark, sf):
    return evaluated(spark, sf).select("id", "needs_followup")


@query("t41_feedback", using("v_scored", f""" SELECT id, CASE WHEN total_score >= 8 THEN {lit(lx.FEEDBACK_DEFAULT['high_score'])}
    WHEN total_score >= 6 THEN {lit(lx.FEEDBACK_DEFAULT['medium_score'])} ELSE 'again' END AS feedback FROM v_scored"""))
def t41(spark, sf):
    own = F.create_map(F.lit("low_score"), F.lit("again"))
    return scored(spark, sf).select("id", sc.feedback(F.col("total_score"), own).alias("feedback"))


@query("t42_fallback", using("v_evaluations v_persona", f""", {_BIASED} SELECT id, total_score,
    CASE WHEN failed THEN {lit(sc.FALLBACK_WEAKNESSES[0])} ELSE '' END AS weaknesses,
    CASE WHEN failed THEN {lit(sc.FALLBACK_SUGGESTIONS[0])} ELSE '' END AS suggestions FROM t"""))
def t42(spark, sf):
    return evaluated(spark, sf).select(
        "id", "total_score", F.array_join("weaknesses", "|").alias("weaknesses"),
        F.array_join("suggestions", "|").alias("suggestions"))


def _sql_fill(template: str, **fields: str) -> str:
    import re
    out = [f"coalesce(CAST({fields[p[1:-1]]} AS VARCHAR), '')" if p.startswith("{") else lit(p).replace("\\n", "\n")
           for p in re.split(r"(\{\w+\})", template) if p]
    return "concat(" + ", ".join(out) + ")"


@query("t43_prompts", using("v_answers", f""" SELECT id,
    {_sql_fill(sc.EVALUATION_PROMPT, job_type="session_id", question_type="'概念题'", difficulty="'进阶'", question="question_id",
               reference_answer="CASE WHEN is_followup THEN '????????????' ELSE 'ref' END", user_answer="user_answer")} AS evaluation,
    {_sql_fill(sc.FOLLOWUP_PROMPT, personality_name="'strict'", question="question_id", user_answer="user_answer", total_score="question_id",
               weaknesses="CASE WHEN is_followup THEN '无明显不足' ELSE 'a、b' END", followup_style="'short'")} AS followup FROM v_answers"""))
def t43(spark, sf):
    c = F.col
    f = c("is_followup")
    weak = F.when(f, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("a"), F.lit("b")))
    return answers(spark, sf).select(
        "id",
        sc.evaluation_prompt(job_type=c("session_id"), question_type=F.lit("概念题"), difficulty=F.lit("进阶"),
                             question=c("question_id"), reference_answer=F.when(f, F.lit(" ")).otherwise("ref"),
                             user_answer=c("user_answer")).alias("evaluation"),
        sc.followup_prompt(personality_name=F.lit("strict"), question=c("question_id"), user_answer=c("user_answer"),
                           total_score=c("question_id"), weaknesses=weak, followup_style=F.lit("short")).alias("followup"))


@query("t44_elapsed", using("v_sessions", """, n AS (SELECT user_id AS session_id, count(*) AS asked FROM events GROUP BY user_id),
    m AS (SELECT v.session_id, (end_time - start_time) / 6e7 AS minutes, asked FROM v_sessions v JOIN n ON n.session_id = v.session_id)
    SELECT session_id, minutes, minutes >= 42000 AS time_exceeded, minutes >= 42000 OR asked >= 70 AS should_end FROM m"""))
def t44(spark, sf):
    asked = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("asked"))
    m = sessions(spark, sf).join(asked, "session_id").withColumn(
        "minutes", sc.elapsed_minutes(F.col("start_time"), F.col("end_time"), digits=RAW))
    return m.select("session_id", "minutes", sc.time_exceeded(F.col("minutes"), F.lit(42000)).alias("time_exceeded"),
                    sc.should_end(F.col("minutes"), F.lit(42000), F.col("asked"), F.lit(70)).alias("should_end"))


_LET = f"length({q_sub('user_answer', '[^A-Za-z]')})"
_CJ = f"length({q_sub('user_answer', f'[^{CJK_CHARS}]')})"


@query("t48_translation_routing", using("v_answers", f""" SELECT id, CASE WHEN {_LET} >= 3 AND ({_CJ} = 0 OR {_CJ} < {_LET} * 0.05)
    THEN CASE WHEN question_id % 3 = 0 THEN concat('译 ', user_answer) ELSE user_answer END ELSE user_answer END AS scored_text FROM v_answers"""))
def t48(spark, sf):
    made = F.when(F.col("question_id") % 3 == 0, F.concat(F.lit("译 "), "user_answer")).when(
        F.col("question_id") % 3 == 1, "  ")
    return answers(spark, sf).select("id", sc.route_translation(F.col("user_answer"), made).alias("scored_text"))


@query("t49_followup_questions", using("v_evaluations v_persona", f""", {_BIASED} SELECT session_id, concat(id, '_followup') AS question_id,
    concat('why ', name) AS content, '' AS reference_answer, '概念题' AS question_type, '进阶' AS difficulty, name AS job_category
    FROM t WHERE NOT failed AND total_score BETWEEN 6 AND 8 AND id % 3 <> 0"""))
def t49(spark, sf):
    e = evaluated(spark, sf).withColumn("question_id", F.col("id")).withColumn(
        "followup_text", F.when(F.col("id") % 3 != 0, F.concat(F.lit("why "), "name"))).withColumn(
        "question_type", F.lit("概念题")).withColumn("difficulty", F.lit("进阶")).withColumn("job_category", F.col("name"))
    return iv.followup_questions(e)


@query("t50_rehydrate", using("v_answers", """ SELECT id, coalesce(CASE WHEN is_followup THEN '原理题' END, '概念题') AS question_type,
    '进阶' AS difficulty, '通用' AS job_category FROM v_answers"""))
def t50(spark, sf):
    a = answers(spark, sf).select("id", F.when(F.col("is_followup"), "原理题").alias("question_type"))
    return sc.with_defaults(a, {"question_type": "概念题", "difficulty": "进阶", "job_category": "通用"})


# --- joins -----------------------------------------------------------------------------
@query("j04_report_details", using("v_latest v_answers", """ SELECT a.id, a.session_id, a.question_id, coalesce(l.total_score, 0e0) AS total_score,
    coalesce(l.clarity, 0e0) AS clarity FROM v_answers a LEFT JOIN v_latest l ON a.session_id = l.session_id AND a.question_id = l.question_id"""))
def j04(spark, sf):
    return iv.report_details(answers(spark, sf), newest(spark, sf)).select(
        "id", "session_id", "question_id", "total_score", "clarity")


@query("j05_report_set", using("v_latest v_answers", """ SELECT l.id, l.session_id, l.question_id FROM v_latest l WHERE EXISTS (
    SELECT 1 FROM v_answers a WHERE NOT a.is_followup AND a.session_id = l.session_id AND a.question_id = l.question_id)"""))
def j05(spark, sf):
    return iv.report_set(newest(spark, sf), answers(spark, sf)).select("id", "session_id", "question_id")


@query("j06_backlog", using("v_evaluations v_answers", """ SELECT a.id, a.session_id, a.question_id FROM v_answers a WHERE NOT EXISTS (
    SELECT 1 FROM v_evaluations e WHERE a.session_id = e.session_id AND a.question_id = e.question_id)"""))
def j06(spark, sf):
    return iv.backlog(answers(spark, sf), evaluations(spark, sf)).select("id", "session_id", "question_id")


@query("j08_persona", using("v_sessions v_persona", """ SELECT s.session_id, p.name, p.depth_weight FROM v_sessions s
    LEFT JOIN v_persona p ON p.persona_id = s.session_id % 5"""))
def j08(spark, sf):
    s = sessions(spark, sf).withColumn("persona_id", (F.col("session_id") % 5).cast("int"))
    return iv.with_persona(s, personas(spark), "persona_id").select("session_id", "name", "depth_weight")


@query("j12_followup_pairs", using("v_answers", """ SELECT f.id, p.id AS parent_id, p.user_answer AS parent_answer FROM v_answers f
    JOIN v_answers p ON f.session_id = p.session_id AND f.parent_question_id = p.question_id WHERE f.is_followup AND NOT p.is_followup"""))
def j12(spark, sf):
    return iv.followup_pairs(answers(spark, sf)).select("id", "parent_id", "parent_answer")


# --- statistics -------------------------------------------------------------------------
@query("a05_global_statistics", using("v_sessions v_answers v_scored", f""" SELECT (SELECT count(*) FROM v_sessions) AS total_sessions,
    (SELECT count_if(status = 'completed')::BIGINT FROM v_sessions) AS completed_sessions, (SELECT count(*) FROM v_answers) AS total_answers,
    (SELECT {q_avg('total_score')} FROM v_scored) AS avg_score,
    (SELECT CAST(count_if(total_score >= 6) AS DOUBLE) / count(*) FROM v_scored) AS pass_rate"""))
def a05(spark, sf):
    return iv.global_statistics(sessions(spark, sf), answers(spark, sf), scored(spark, sf), RAW)


_SESSION_STATS = f"""SELECT session_id, {q_avg("technical_accuracy")} AS avg_technical_accuracy, {q_avg("clarity")} AS avg_clarity,
    {q_avg("depth_breadth")} AS avg_depth_breadth, {q_avg("total_score")} AS avg_total_score, count(*) AS total_count,
    count_if(total_score >= 6)::BIGINT AS pass_count, CAST(count_if(total_score >= 6) AS DOUBLE) / count(*) AS pass_rate,
    count_if(total_score >= 8)::BIGINT AS correct_count, count_if(total_score >= 6 AND total_score < 8)::BIGINT AS partial_count,
    count_if(total_score < 6)::BIGINT AS incorrect_count"""


@query("a06_session_statistics", using("v_latest", f" {_SESSION_STATS} FROM v_latest GROUP BY session_id"))
def a06(spark, sf):
    return iv.session_statistics(newest(spark, sf), RAW)


_ZERO = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in (
    "avg_technical_accuracy avg_clarity avg_depth_breadth avg_total_score total_count pass_count pass_rate"
    " correct_count partial_count incorrect_count").split())
# Every evaluation scored above 2 counts as a kept answer, so some sessions stay empty.
_REPORTS = f"""st AS ({_SESSION_STATS} FROM v_latest WHERE question_id < 97 AND session_id % 3 <> 0 GROUP BY session_id),
    reports AS (SELECT v.session_id, v.status, (end_time - start_time) / 6e7 AS total_minutes,
        CASE WHEN s.total_count > 0 THEN (end_time - start_time) / 6e7 / s.total_count ELSE 0e0 END AS minutes_per_question, {_ZERO},
        CASE WHEN s.session_id IS NULL THEN 'No questions were completed' ELSE '' END AS note
        FROM v_sessions v LEFT JOIN st s ON v.session_id = s.session_id)"""


def reports(spark, sf):
    some = newest(spark, sf).where("session_id % 3 <> 0")
    return iv.session_reports(sessions(spark, sf), some, RAW)


@query("a07_session_reports", using("v_sessions v_latest", f", {_REPORTS} SELECT * FROM reports"))
def a07(spark, sf):
    return reports(spark, sf)


@query("a07_keyword_coverage", using("v_sessions v_latest", f""", c AS (SELECT session_id, {q_avg("clarity / 10")} AS cov FROM v_latest GROUP BY session_id)
    SELECT v.session_id, coalesce(cov, 0) AS avg_keyword_coverage FROM v_sessions v LEFT JOIN c ON c.session_id = v.session_id"""))
def a07_coverage(spark, sf):
    n = newest(spark, sf).withColumn("keyword_coverage", F.col("clarity") / 10)
    return iv.session_reports(sessions(spark, sf), n, RAW).select("session_id", "avg_keyword_coverage")


@query("a08_category_counts", using("v_questions", f""" SELECT category_key AS key, CASE category_key {" ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in lx.CATEGORY_DISPLAY.items())} ELSE category_key END AS name, count(*) AS count
    FROM v_questions GROUP BY category_key"""))
def a08(spark, sf):
    return iv.category_counts(questions(spark, sf), lx.CATEGORY_DISPLAY)


@query("a13_answered_counts", using("v_answers", " SELECT session_id, count_if(NOT is_followup)::BIGINT AS questions_answered FROM v_answers GROUP BY session_id"))
def a13(spark, sf):
    return iv.answered_counts(answers(spark, sf))


@query("a14_answer_digest", using("v_latest v_answers", """, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i
        FROM v_answers WHERE NOT is_followup)
    SELECT m.session_id, 0::BIGINT AS page, string_agg(concat('Question ', i, ': ', substr(user_answer, 1, 60), '...', chr(10),
        '  Score: ', printf('%.1f', l.technical_accuracy), '/10', chr(10), '  Weaknesses: depth, clarity', chr(10)), chr(10) ORDER BY i) AS digest
    FROM m JOIN v_latest l ON m.session_id = l.session_id AND m.question_id = l.question_id GROUP BY m.session_id"""))
def a14(spark, sf):
    n = newest(spark, sf).withColumn("total_score", F.col("technical_accuracy")).withColumn(
        "weaknesses", F.array(*map(F.lit, ["depth", "clarity", "length"])))
    return iv.answer_digest(answers(spark, sf), n, "id", "user_answer", "weaknesses")


@query("a15_history", using("v_sessions v_latest", f""", {_REPORTS} SELECT r.session_id, r.avg_total_score, r.total_count, r.pass_rate,
    r.total_minutes, v.start_time AS interview_date,
    concat('job', r.session_id % 4) AS job_type, concat('p', r.session_id % 3) AS personality_name FROM reports r JOIN v_sessions v ON r.session_id = v.session_id"""))
def a15(spark, sf):
    about = sessions(spark, sf).withColumn("job_type", F.concat(F.lit("job"), F.col("session_id") % 4)).withColumn(
        "personality_name", F.concat(F.lit("p"), F.col("session_id") % 3))
    return iv.history(reports(spark, sf), about)


# --- listing and choice -------------------------------------------------------------------
@query("k01_list_sessions", using("v_sessions", " SELECT session_id, end_time, status FROM v_sessions WHERE status = 'completed' ORDER BY end_time DESC, session_id DESC LIMIT 50"))
def k01(spark, sf):
    return iv.list_sessions(sessions(spark, sf), "completed", 50, "end_time").select("session_id", "end_time", "status")


@query("k02_ordered_fetch", using("v_evaluations", " SELECT session_id, id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS place FROM v_evaluations"))
def k02(spark, sf):
    from ..operators.ranking import with_ordinal
    e = evaluations(spark, sf).select("session_id", "id", "created_at")
    return with_ordinal(e, ["session_id"], "created_at", "id", "place")


@query("k03_keyword_search", using("v_questions", " SELECT question_id, content FROM v_questions WHERE contains(content, 'tion the') ORDER BY question_id LIMIT 10"))
def k03(spark, sf):
    return iv.search_questions(questions(spark, sf), "tion the", 10).select("question_id", "content")


def _h(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"(concat('0x', substr(md5({joined}), 1, 15)))::BIGINT"


_BANK = f"""bank AS (SELECT question_id, category_key, row_number() OVER (PARTITION BY category_key ORDER BY {_h("'bank'", "question_id")}, question_id) - 1 AS p,
        count(*) OVER (PARTITION BY category_key) AS n FROM v_questions),
    live AS (SELECT session_id, ['LLM', 'Oracle', 'Web3', 'SLAM'][session_id % 4 + 1] AS category_key FROM v_sessions)"""


def with_category(spark, sf):
    names = F.array(*map(F.lit, ["LLM", "Oracle", "Web3", "SLAM"]))
    return sessions(spark, sf).select(
        "session_id", F.get(names, (F.col("session_id") % 4).cast("int")).alias("category_key"))


@query("k06_preload", using("v_questions v_sessions", f""", {_BANK},
    s AS (SELECT DISTINCT l.session_id, l.category_key, n, {_h("'pool'", "session_id")} % n AS f FROM live l JOIN bank b ON l.category_key = b.category_key),
    w AS (SELECT *, unnest(range(0, least(6, n))) AS place FROM s)
    SELECT w.session_id, w.category_key, w.place, b.question_id FROM w JOIN bank b ON b.category_key = w.category_key AND b.p = (w.f + w.place) % w.n"""))
def k06(spark, sf):
    bank = iv.shuffled_bank(questions(spark, sf).select("question_id", "category_key"), "bank")
    return iv.draw(with_category(spark, sf), bank, F.lit(6), "pool")


_ASKED = "asked AS (SELECT DISTINCT user_id AS session_id, event_id % 40 AS question_id FROM events WHERE event_type <> 'error')"


def asked_rows(spark, sf):
    return table(spark, sf, "events").where("event_type <> 'error'").select(
        F.col("user_id").alias("session_id"), (F.col("event_id") % 40).alias("question_id")).distinct()


@query("j09_unasked", using("v_questions v_sessions", f""", {_BANK}, {_ASKED}, s AS (SELECT DISTINCT l.session_id, l.category_key, n, {_h("'pool'", "session_id")} % n AS f FROM live l JOIN bank b ON l.category_key = b.category_key),
    w AS (SELECT *, unnest(range(0, least(20, n))) AS place FROM s),
    pool AS (SELECT w.session_id, b.question_id FROM w JOIN bank b ON b.category_key = w.category_key AND b.p = (w.f + w.place) % w.n)
    SELECT session_id, question_id FROM pool p WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.session_id = p.session_id AND a.question_id = p.question_id)"""))
def j09(spark, sf):
    bank = iv.shuffled_bank(questions(spark, sf).select("question_id", "category_key"), "bank")
    pool = iv.draw(with_category(spark, sf), bank, F.lit(20), "pool")
    return iv.unasked(pool, asked_rows(spark, sf)).select("session_id", "question_id")


_WIN = f"""s AS (SELECT DISTINCT l.session_id, l.category_key, n, {_h("'next'", "l.session_id")} % n AS f, coalesce(c.k, 0) AS k
        FROM live l JOIN bank b ON l.category_key = b.category_key LEFT JOIN (SELECT session_id, count(DISTINCT question_id) AS k FROM asked GROUP BY 1) c ON c.session_id = l.session_id),
    near AS (SELECT w.session_id, b.question_id FROM (SELECT *, unnest(range(0, least(5, n))) AS place FROM s) w JOIN bank b ON b.category_key = w.category_key AND b.p = (w.f + w.place) % w.n),
    pool AS (SELECT * FROM near p WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.session_id = p.session_id AND a.question_id = p.question_id)),
    low AS (SELECT * FROM s WHERE coalesce((SELECT count(*) FROM pool p WHERE p.session_id = s.session_id), 0) < 3),
    far AS (SELECT w.session_id, b.question_id FROM (SELECT *, unnest(range(5, least(10 + k, n))) AS place FROM low) w JOIN bank b ON b.category_key = w.category_key AND b.p = (w.f + w.place) % w.n),
    more AS (SELECT * FROM far p WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.session_id = p.session_id AND a.question_id = p.question_id)),
    full_ AS (SELECT * FROM pool UNION SELECT * FROM more)"""


@query("k07_next_question", using("v_questions v_sessions", f""", {_BANK}, {_ASKED}, {_WIN}
    SELECT session_id, arg_min(question_id, ({_h("'next'", "session_id", "question_id")}, question_id)) AS question_id FROM full_ GROUP BY session_id"""))
def k07(spark, sf):
    bank = iv.shuffled_bank(questions(spark, sf).select("question_id", "category_key"), "bank")
    return iv.next_questions(with_category(spark, sf), bank, asked_rows(spark, sf), preload=5, threshold=3)


@query("k10_random_persona", using("v_sessions v_persona", f""" SELECT s.session_id, p.name FROM v_sessions s
    JOIN v_persona p ON p.persona_id = {_h("'persona'", "s.session_id")} % 4"""))
def k10(spark, sf):
    return iv.with_persona(iv.pick_persona(sessions(spark, sf), 4), personas(spark), "persona_id").select("session_id", "name")


@query("u02_pool_refill", using("v_answers", """, pool AS (SELECT session_id, question_id, 0 AS src FROM v_answers WHERE NOT is_followup),
    extra AS (SELECT session_id, question_id, 1 AS src FROM v_answers WHERE question_id % 3 = 0),
    u AS (SELECT * FROM pool UNION ALL SELECT * FROM extra)
    SELECT session_id, question_id, min(src) AS src FROM u GROUP BY session_id, question_id"""))
def u02(spark, sf):
    a = answers(spark, sf)
    shape = lambda d, n: d.select("session_id", "question_id", F.col("question_id").alias("place"), F.lit(n).alias("src"))
    full = iv.refill(shape(a.where(~F.col("is_followup")), 0), shape(a.where("question_id % 3 = 0"), 1))
    return full.select("session_id", "question_id", "src")
