"""Interview analytics: evaluations, reports, question choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from .ranking import latest, with_ordinal

KEYS = ["session_id", "question_id"]
DIMENSIONS = ["technical_accuracy", "clarity", "depth_breadth"]


# --- evaluations ------------------------------------------------------------------
def with_persona(rows: DataFrame, personas: DataFrame, key: str) -> DataFrame:
    """Persona columns by key; Spark broadcasts the personas if they are as few as usual."""
    return rows.join(personas, key, "left")


def evaluate(rows: DataFrame, digits: int | None = 2) -> DataFrame:
    """Evaluation rows from model scores, persona bias columns and ``failed``.

    A failed scoring gives the fallback row: zeros, fixed texts, no follow-up.
    """
    def dim(name: str) -> Column:
        return sc.apply_bias(F.col(name), F.col(sc.BIAS_OF[name]))

    ok = ~F.col("failed")
    zero = F.lit(0.0)
    scored = rows.select(
        *[c for c in rows.columns if c not in DIMENSIONS],
        *[F.when(ok, dim(d)).otherwise(zero).alias(d) for d in DIMENSIONS],
    )
    total = sc.total_score(*[F.col(d) for d in DIMENSIONS], digits=digits)
    none = F.expr("cast(array() as array<string>)")
    fallback = {
        "weaknesses": sc.FALLBACK_WEAKNESSES,
        "suggestions": sc.FALLBACK_SUGGESTIONS,
    }
    for name, texts in fallback.items():
        own = F.col(name) if name in scored.columns else none
        scored = scored.withColumn(
            name, F.when(F.col("failed"), F.array(*map(F.lit, texts))).otherwise(own)
        )
    return scored.withColumn("total_score", F.when(ok, total).otherwise(zero)).withColumn(
        "needs_followup", ok & sc.needs_followup(F.col("total_score"))
    )


def latest_evaluations(evaluations: DataFrame) -> DataFrame:
    return latest(evaluations, KEYS, "created_at", "id")


def report_details(answers: DataFrame, newest: DataFrame) -> DataFrame:
    """Every answer with its latest scores, 0.0 where there is none."""
    scores = ["total_score", *DIMENSIONS]
    return answers.join(newest.select(*KEYS, *scores), KEYS, "left").select(
        *answers.columns, *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in scores]
    )


def report_set(newest: DataFrame, answers: DataFrame) -> DataFrame:
    """Latest evaluations of answered main questions."""
    return newest.join(answers.where(~F.col("is_followup")).select(*KEYS), KEYS, "left_semi")


def backlog(answers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Answers not evaluated yet, follow-ups included."""
    return answers.join(evaluations.select(*KEYS), KEYS, "left_anti")


def followup_pairs(answers: DataFrame) -> DataFrame:
    """Follow-up answers beside the answer they go back to."""
    parent = answers.where(~F.col("is_followup")).select(
        "session_id", F.col("question_id").alias("parent_question_id"),
        F.col("id").alias("parent_id"), F.col("user_answer").alias("parent_answer"),
    )
    return answers.where("is_followup").join(parent, ["session_id", "parent_question_id"])


def followup_questions(evaluated: DataFrame) -> DataFrame:
    """New question rows for evaluated answers that call for a follow-up."""
    return evaluated.where(F.col("needs_followup") & F.col("followup_text").isNotNull()).select(
        "session_id",
        F.concat(F.col("question_id").cast("string"), F.lit("_followup")).alias("question_id"),
        F.col("followup_text").alias("content"),
        F.lit("").alias("reference_answer"),
        "question_type", "difficulty", "job_category",
    )


# --- statistics ---------------------------------------------------------------------
def global_statistics(sessions: DataFrame, answers: DataFrame, evaluations: DataFrame, digits: int | None = 2) -> DataFrame:
    """One row over all sessions; averages count every evaluation row.

    The three one-row aggregates are put side by side by unioning them into one
    more aggregate.
    """
    parts = [
        sessions.agg(F.count("*").alias("total_sessions"), F.count_if(F.col("status") == "completed").alias("completed_sessions")),
        answers.agg(F.count("*").alias("total_answers")),
        evaluations.agg(sc.exact_avg(F.col("total_score")).alias("avg_score"),
                        F.try_divide(F.count_if(F.col("total_score") >= 6), F.count("*")).alias("pass_rate")),
    ]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    rounded = lambda c: F.coalesce(F.max(c) if digits is None else F.round(F.max(c), digits), F.lit(0.0))
    return merged.agg(
        *[F.max(c).alias(c) for c in ("total_sessions", "completed_sessions", "total_answers")],
        rounded("avg_score").alias("avg_score"),
        rounded("pass_rate").alias("pass_rate"),
    )


def session_statistics(evaluations: DataFrame, digits: int | None = 2) -> DataFrame:
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return evaluations.groupBy("session_id").agg(
        *[r(sc.exact_avg(F.col(d))).alias(f"avg_{d}") for d in (*DIMENSIONS, "keyword_coverage") if d in evaluations.columns],
        r(sc.exact_avg(F.col("total_score"))).alias("avg_total_score"),
        F.count("*").alias("total_count"),
        F.count_if(F.col("total_score") >= 6).alias("pass_count"),
        r(F.try_divide(F.count_if(F.col("total_score") >= 6), F.count("*"))).alias("pass_rate"),
        F.count_if(F.col("total_score") >= 8).alias("correct_count"),
        F.count_if((F.col("total_score") >= 6) & (F.col("total_score") < 8)).alias("partial_count"),
        F.count_if(F.col("total_score") < 6).alias("incorrect_count"),
    )


def session_reports(sessions: DataFrame, evaluations: DataFrame, digits: int | None = 2) -> DataFrame:
    """One report row per session; sessions without evaluations get zeros."""
    stats = session_statistics(evaluations, digits)
    minutes = sc.elapsed_minutes(F.col("start_time"), F.col("end_time"), digits=digits)
    zero = [c for c in stats.columns if c != "session_id"]
    joined = sessions.join(stats, "session_id", "left").withColumn("total_minutes", minutes)
    per_question = F.try_divide(F.col("total_minutes"), F.col("total_count"))
    return joined.select(
        "session_id", "status", "total_minutes",
        F.coalesce(per_question if digits is None else F.round(per_question, digits), F.lit(0.0)).alias("minutes_per_question"),
        *[F.coalesce(F.col(c), F.lit(0).cast(stats.schema[c].dataType)).alias(c) for c in zero],
        F.when(F.col("total_count").isNull(), "No questions were completed").otherwise("").alias("note"),
    )


def answered_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("session_id").agg(
        F.count_if(~F.col("is_followup")).alias("questions_answered")
    )


def answer_digest(
    answers: DataFrame, newest: DataFrame, order: str, question: str,
    weaknesses: str | None = None, page_lines: int = 1000,
) -> DataFrame:
    """(session_id, page, digest): short lines on the scored main answers.

    A session of usual size has one page; a huge one is cut into pages, so no
    text grows without bound.
    """
    main = with_ordinal(answers.where(~F.col("is_followup")), ["session_id"], order)
    weak = F.array_join(F.slice(F.col(weaknesses), 1, 2), ", ") if weaknesses else F.lit("")
    keep = [*KEYS, "total_score", *([weaknesses] if weaknesses else [])]
    lines = main.join(newest.select(*keep), KEYS).select(
        "session_id",
        F.floor((F.col("ordinal") - 1) / page_lines).alias("page"),
        "ordinal",
        F.concat(
            F.lit("Question "), F.col("ordinal").cast("string"), F.lit(": "),
            F.substr(F.col(question), F.lit(1), F.lit(60)), F.lit("...\n  Score: "),
            F.format_string("%.1f", F.col("total_score")), F.lit("/10\n  Weaknesses: "), weak, F.lit("\n"),
        ).alias("line"),
    )
    return lines.groupBy("session_id", "page").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda s: s["line"]), "\n"
        ).alias("digest")
    )


def whole_digests(digests: DataFrame) -> DataFrame:
    """(session_id, digest): the pages of a session in order, as one report wants them."""
    pages = F.array_sort(F.collect_list(F.struct("page", "digest")))
    return digests.groupBy("session_id").agg(
        F.array_join(F.transform(pages, lambda p: p["digest"]), "\n").alias("digest")
    )


def history(reports: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session history for a list view, with job and persona where the sessions have them."""
    about = [c for c in ("job_type", "personality_name") if c in sessions.columns]
    return reports.select(
        "session_id", "avg_total_score", "total_count", "pass_rate", "total_minutes"
    ).join(sessions.select("session_id", F.col("start_time").alias("interview_date"), *about), "session_id")


def list_sessions(sessions: DataFrame, status: str | None = None, limit: int = 50, order: str = "created_at") -> DataFrame:
    chosen = sessions if status is None else sessions.where(F.col("status") == status)
    return chosen.orderBy(F.desc(order), F.desc("session_id")).limit(limit)


# --- question choice --------------------------------------------------------------------
def hash_number(*parts: Column) -> Column:
    """Number below 2**60 from the md5 of the joined parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def search_questions(questions: DataFrame, keyword: str, k: int = 10, order: str = "question_id") -> DataFrame:
    if not keyword:
        return questions.limit(0)
    return questions.where(F.contains("content", F.lit(keyword))).orderBy(order).limit(k)


def shuffled_bank(questions: DataFrame, seed: str) -> DataFrame:
    """Bank with a seeded random position 0..n-1 inside its category."""
    keyed = questions.withColumn("_h", hash_number(F.lit(seed), F.col("question_id")))
    placed = with_ordinal(keyed, ["category_key"], "_h", "question_id", "_p").drop("_h")
    sizes = questions.groupBy("category_key").agg(F.count("*").alias("_n"))
    return placed.withColumn("_p", F.col("_p") - 1).join(sizes, "category_key")


def draw(sessions: DataFrame, bank: DataFrame, count: Column, seed: str, skip: Column | None = None) -> DataFrame:
    """``count`` bank questions per session without meeting the whole bank.

    A session starts at a seeded place of its category's shuffled order and
    takes the following positions, wrapping round; the join is on the position.
    """
    sizes = bank.select("category_key", "_n").distinct()
    skip = F.lit(0) if skip is None else skip
    wanted = sessions.join(sizes, "category_key")
    first = hash_number(F.lit(seed), F.col("session_id")) % F.col("_n")
    many = F.least(count.cast("bigint") + skip, F.col("_n"))
    steps = F.when(many > skip, F.sequence(skip.cast("bigint"), many - 1)).otherwise(
        F.expr("cast(array() as array<bigint>)")
    )
    spots = wanted.withColumn("_first", first).withColumn("place", F.explode(steps)).withColumn(
        "_p", (F.col("_first") + F.col("place")) % F.col("_n")
    )
    return spots.select("session_id", "category_key", "_p", "place").join(
        bank.drop("_n"), ["category_key", "_p"]
    ).drop("_p")


def unasked(pool: DataFrame, asked: DataFrame) -> DataFrame:
    return pool.join(asked.select(*KEYS), KEYS, "left_anti")


def refill(pool: DataFrame, extra: DataFrame) -> DataFrame:
    """Pool plus new rows, one row per question, pool rows first."""
    both = pool.withColumn("_from", F.lit(0)).unionByName(extra.withColumn("_from", F.lit(1)))
    rest = [c for c in pool.columns if c not in KEYS]
    return (
        both.groupBy(*KEYS)
        .agg(F.min_by(F.struct(*rest), F.struct("_from", "place")).alias("_r"))
        .select(*KEYS, "_r.*")
        .select(*pool.columns)
    )


def next_questions(
    sessions: DataFrame, bank: DataFrame, asked: DataFrame, preload: int = 100,
    threshold: int = 20, max_questions: int | None = None, seed: str = "next",
) -> DataFrame:
    """One random unasked question for every session that may still ask.

    A session whose pool runs below ``threshold`` gets further positions of the
    shuffled order: as many as the pool size plus what it has already asked.
    """
    counts = asked.groupBy("session_id").agg(F.countDistinct("question_id").alias("_asked"))
    live = sessions.join(counts, "session_id", "left").withColumn(
        "_asked", F.coalesce("_asked", F.lit(0))
    )
    if max_questions is not None:
        live = live.where(F.col("_asked") < max_questions)
    slim = bank.select("category_key", "_p", "_n", "question_id")
    pool = unasked(draw(live, slim, F.lit(preload), seed), asked)
    left = pool.groupBy("session_id").agg(F.count("*").alias("_left"))
    low = live.join(left, "session_id", "left").where(F.coalesce("_left", F.lit(0)) < threshold)
    more = unasked(draw(low, slim, F.lit(preload) + F.col("_asked"), seed, F.lit(preload)), asked)
    full = refill(pool, more)
    pick = hash_number(F.lit(seed), F.col("session_id"), F.col("question_id"))
    return full.groupBy("session_id").agg(
        F.min_by("question_id", F.struct(pick, F.col("question_id"))).alias("question_id")
    )


def pick_persona(sessions: DataFrame, n: int, seed: str = "persona") -> DataFrame:
    return sessions.withColumn(
        "persona_id", (hash_number(F.lit(seed), F.col("session_id")) % n).cast("int")
    )


def category_counts(questions: DataFrame, display: dict[str, str]) -> DataFrame:
    """Questions per category by key; the fixed list with 0 for an empty bank."""
    from ..functions.labels import lookup

    counts = questions.where(F.coalesce("category_key", F.lit("")) != "").groupBy(
        F.col("category_key").alias("key")
    ).agg(F.count("*").alias("count"))
    if counts.isEmpty():
        fixed = questions.sparkSession.createDataFrame(list(display.items()), "key string, name string")
        return fixed.withColumn("count", F.lit(0).cast("bigint"))
    return counts.select("key", lookup(F.col("key"), display).alias("name"), "count").orderBy("key")
