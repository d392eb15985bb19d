"""Working views over the given tables, for Spark and for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.patterns import STRIP


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables.

    Text tables are worked on row by row.  One that Spark reads in fewer tasks
    than there are cores (a single row group, say) is dealt out to all of them,
    which changes no result; a large table is left as it is.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("/", F.lit("corpus"), "source", F.concat("doc_id", F.lit(".md"))).alias("source_file"),
        F.col("source").alias("category"),
        "lang",
        "text",
    )


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    cap = lambda c: F.least(F.lit(10.0), c)
    value = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 97).alias("question_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"),
        cap(value / 10).alias("technical_accuracy"),
        cap(value / 8).alias("clarity"),
        cap(value / 12).alias("depth_breadth"),
        (F.col("event_type") == "error").alias("failed"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    followup = F.col("turn") % 4 == 2
    return table(spark, sf, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("question_id"),
        F.col("text").alias("user_answer"),
        followup.alias("is_followup"),
        F.when(followup, F.col("turn") - 2).alias("parent_question_id"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("session_id"))
        .agg(
            F.min(micros).alias("start_time"),
            F.max(micros).alias("end_time"),
            F.max(F.struct(F.col("ts"), F.col("event_type")))["event_type"].alias("last_type"),
        )
        .select(
            "session_id", "start_time", "end_time",
            F.when(F.col("last_type") == "purchase", "completed")
            .otherwise("in_progress").alias("status"),
        )
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id") % 4
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.when(k == 0, "LLM").when(k == 1, "Oracle").when(k == 2, "Web3")
        .otherwise("SLAM").alias("category_key"),
        F.col("text").alias("content"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("position")
    )


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        lx.PERSONAS,
        "persona_id int, name string, technical_weight double, clarity_weight double,"
        " depth_weight double",
    )


VIEWS = {
    "v_docs": """SELECT doc_id, concat('corpus/', source, '/', doc_id, '.md') AS source_file,
        source AS category, lang, text FROM documents""",
    "v_evaluations": """SELECT event_id AS id, user_id AS session_id, event_id % 97 AS question_id,
        epoch_us(ts) AS created_at,
        least(CAST(10 AS DOUBLE), value / 10) AS technical_accuracy,
        least(CAST(10 AS DOUBLE), value / 8) AS clarity,
        least(CAST(10 AS DOUBLE), value / 12) AS depth_breadth,
        event_type = 'error' AS failed FROM events""",
    "v_answers": """SELECT conv_id * 4294967296 + turn AS id, conv_id AS session_id, turn AS question_id,
        text AS user_answer, turn % 4 = 2 AS is_followup,
        CASE WHEN turn % 4 = 2 THEN turn - 2 END AS parent_question_id
        FROM conversations WHERE role = 'user'""",
    "v_sessions": """SELECT user_id AS session_id, epoch_us(min(ts)) AS start_time,
        epoch_us(max(ts)) AS end_time,
        CASE WHEN max_by(event_type, (ts, event_type)) = 'purchase' THEN 'completed'
             ELSE 'in_progress' END AS status
        FROM events GROUP BY user_id""",
    "v_questions": """SELECT item_id AS question_id,
        CASE item_id % 4 WHEN 0 THEN 'LLM' WHEN 1 THEN 'Oracle' WHEN 2 THEN 'Web3'
             ELSE 'SLAM' END AS category_key, text AS content FROM benchmark""",
    "v_index": "SELECT vec_id AS chunk_id, embedding, label AS position FROM embeddings",
    "v_persona": "SELECT * FROM (VALUES "
    + ", ".join(f"({i},'{n}',CAST({t} AS DOUBLE),CAST({c} AS DOUBLE),CAST({d} AS DOUBLE))"
                for i, n, t, c, d in lx.PERSONAS)
    + ") AS t(persona_id,name,technical_weight,clarity_weight,depth_weight)",
    # three-dimension total, without persona
    "v_scored": """SELECT *, technical_accuracy * 0.5e0 + clarity * 0.2e0 + depth_breadth * 0.3e0
        AS total_score FROM v_evaluations""",
    "v_latest": """SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY session_id, question_id ORDER BY created_at DESC, id DESC) AS rn
        FROM v_scored) WHERE rn = 1""",
}
_NEEDS = {"v_scored": ["v_evaluations"], "v_latest": ["v_evaluations", "v_scored"]}


def using(names: str, sql: str) -> str:
    """``sql`` with the named views put in front as CTEs.

    ``sql`` may start with its own ``, name AS (...)`` list.
    """
    wanted: list[str] = []
    for name in names.split():
        for dep in [*_NEEDS.get(name, []), name]:
            if dep not in wanted:
                wanted.append(dep)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH RECURSIVE {head} {sql}"


def lit(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(STRIP)}, '', 'g')"


def q_sub(x: str, pattern: str, replacement: str = "", flags: str = "g") -> str:
    """All matches of ``pattern`` in ``x`` replaced; RE2 reads the pattern."""
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, {lit(flags)})"


def q_any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def q_case(x: str, groups, default: str) -> str:
    items = groups.items() if isinstance(groups, dict) else groups
    whens = " ".join(f"WHEN {q_any(x, needles)} THEN {lit(name)}" for name, needles in items)
    return f"CASE {whens} ELSE {default} END"


def q_avg(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(20,8))) AS DOUBLE) / count({x})"


BREAK = "chr(10)"
