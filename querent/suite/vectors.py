"""Vector index over all embeddings; queries are the mean vectors of the labels."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators import vectors as vx
from ..session import scratch_path
from .registry import query
from .views import docs, lit, q_case, q_strip, table, using, vectors
from ..functions import lexicon as lx

# Mean per label and dimension, in decimals so that both engines sum exactly.
_CENTRES = """dims AS (SELECT position, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM v_index),
    means AS (SELECT position, d, CAST(sum(CAST(x AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS m FROM dims GROUP BY position, d),
    centres AS (SELECT CAST(position AS BIGINT) AS query_id, list(m ORDER BY d) AS embedding FROM means GROUP BY position)"""


def centres(spark, sf):
    dims = vectors(spark, sf).select("position", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("position", "d").agg(
        (F.sum(F.col("x").cast("decimal(20,10)")).cast("double") / F.count("*")).alias("m"))
    return means.groupBy(F.col("position").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("embedding"))


def shown(found):
    """Scores as they are compared; ranks are made of the unrounded ones."""
    return found.withColumn("score", F.round("score", 6) + F.lit(0.0))


_DOT = "list_dot_product(CAST(i.embedding AS DOUBLE[]), c.embedding)"


def _top(k: int, score: str, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT query_id, chunk_id, score, position, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT c.query_id, i.chunk_id, i.position, {score} AS score FROM centres c, v_index i WHERE {where})) WHERE rank <= {k}"""


@query("v03_top_k", using("v_index", f", {_CENTRES} SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM ({_top(5, _DOT)})"))
def v03(spark, sf):
    return shown(vx.top_k(vectors(spark, sf), centres(spark, sf), 5))


@query("j10_top_k_tiled", using("v_index", f", {_CENTRES} SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM ({_top(7, _DOT)})"))
def j10(spark, sf):
    """The same search, the index met in small blocks."""
    return shown(vx.top_k(vectors(spark, sf), centres(spark, sf), 7, block_rows=50))


@query("j10_similarity_join", using("v_index", """ SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM (
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
            SELECT q.chunk_id AS query_id, i.chunk_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS score FROM v_index q, v_index i))
    WHERE rank <= 5"""))
def j10_join(spark, sf):
    """Every vector against all vectors: pairs of blocks of both sides."""
    v = vectors(spark, sf)
    return shown(vx.top_k(v, v.select(F.col("chunk_id").alias("query_id"), "embedding"), 5, block_rows=150))


_COS = f"{_DOT} / (sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.embedding, c.embedding)))"


@query("v04_cosine_filtered", using("v_index", f", {_CENTRES} SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM ({_top(5, _COS, 'i.position IN (1, 3)')})"))
def v04(spark, sf):
    return shown(vx.top_k_cosine(vectors(spark, sf), centres(spark, sf), 5, F.col("position").isin(1, 3)))


@query("v05_postfilter", using("v_index", f""", {_CENTRES}, w AS ({_top(10, _DOT)})
    SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, position, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
    FROM w WHERE position = 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5"""))
def v05(spark, sf):
    return shown(vx.top_k_postfilter(vectors(spark, sf), centres(spark, sf), 5, F.col("position") == 3, ["position"]))


@query("v06_metadata_filter", using("v_index", " SELECT chunk_id FROM v_index WHERE position = 2 AND len(embedding) = 64"))
def v06(spark, sf):
    v = vectors(spark, sf).withColumn("width", F.size("embedding"))
    return v.where(vx.metadata_filter(position=2, width=64, difficulty=None)).select("chunk_id")


@query("v07_get_and_count", using("v_index", " SELECT position, count(*) AS n, min(chunk_id) AS first_id FROM v_index GROUP BY position"))
def v07(spark, sf):
    return vectors(spark, sf).groupBy("position").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


@query("v07_get_by_id", using("v_index", " SELECT chunk_id, position FROM v_index WHERE chunk_id % 7 = 0"))
def v07_get(spark, sf):
    v = vectors(spark, sf)
    return vx.get_by_ids(v, v.where("chunk_id % 7 = 0").select("chunk_id")).select("chunk_id", "position")


@query("v07_clear", using("v_index", " SELECT count(*) AS before, 0::BIGINT AS after FROM v_index"))
def v07_clear(spark, sf):
    """A stored index counted, cleared and counted again."""
    path = scratch_path(spark, "index")
    vx.append_new(vectors(spark, sf), path)
    before = spark.read.parquet(path).agg(F.count("*").alias("before")).first()[0]
    vx.clear_index(spark, path)
    return spark.read.parquet(path).agg(F.lit(before).alias("before"), F.count("*").alias("after"))


@query("v08_dimension_report", using("v_index", " SELECT len(embedding)::INTEGER AS width, count(*) AS n, len(embedding) = 64 AS fits FROM v_index GROUP BY 1, 3"))
def v08(spark, sf):
    return vx.dimension_report(vectors(spark, sf), 64)


LETTERS = "etaoinsrhd"


def letter_encoder():
    """Stand-in for a model: counts of ten letters."""
    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float64)


_VEC = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


@query("v01_embed", f"""WITH e AS (SELECT doc_id, {_VEC} AS v FROM documents), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e),
    d AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim, n FROM n)
    SELECT doc_id, (dim - 1)::INTEGER AS dim, round(CAST(CAST(CASE WHEN n > 0 THEN x / n ELSE x END AS FLOAT) AS DOUBLE), 6) AS x FROM d""")
def v01(spark, sf):
    e = vx.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", letter_encoder)
    return e.select("doc_id", F.posexplode("embedding").alias("dim", "x")).select("doc_id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("v02_append_index", """SELECT doc_id AS chunk_id, source AS source_file, '' AS question, 0 AS question_num, concat('["', lang, '"]') AS keywords FROM documents""")
def v02(spark, sf):
    """Two appends, the second over everything again: no row doubles."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"),
        F.lit(None).cast("string").alias("question"), F.lit(None).cast("int").alias("question_num"),
        F.array("lang").alias("keywords"), F.create_map(F.lit("a"), F.col("lang")).alias("other"))
    path = scratch_path(spark, "index")
    vx.append_new(d.where("lang = 'en'"), path)
    vx.append_new(d, path)
    return spark.read.parquet(path)


@query("v09_hits_to_questions", using("v_docs", f""", h AS (SELECT doc_id, CASE WHEN lang = 'en' THEN split_part(text, '.', 1) WHEN lang = 'fr' THEN '  ' END AS q, text,
        CASE WHEN lang = 'de' THEN ' x ' END AS a, replace(source_file, 'src1', 'java') AS source_file FROM v_docs)
    SELECT doc_id AS question_id, coalesce(nullif({q_strip("coalesce(q, '')")}, ''), {q_strip("text")}) AS content, {q_strip("coalesce(a, '')")} AS reference_answer,
    '概念题' AS question_type, '进阶' AS difficulty, {q_case("lower(source_file)", lx.JOB_CATEGORY, lit(lx.JOB_CATEGORY_DEFAULT))} AS job_category
    FROM h WHERE coalesce(nullif({q_strip("coalesce(q, '')")}, ''), {q_strip("text")}) <> ''"""))
def v09(spark, sf):
    h = docs(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"),
        F.when(F.col("lang") == "en", F.split_part("text", F.lit("."), F.lit(1))).when(F.col("lang") == "fr", "  ").alias("question"),
        F.when(F.col("lang") == "de", " x ").alias("answer"), F.replace("source_file", F.lit("src1"), F.lit("java")).alias("source_file"))
    return vx.hits_to_questions(h)


@query("v10_cells_all_probes", using("v_index", f", {_CENTRES} SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM ({_top(5, _DOT)})"))
def v10(spark, sf):
    """Cell-pruned search with every cell probed equals the exact one; recall at
    fewer probes is tested."""
    c = centres(spark, sf)
    matrix = np.array([r["embedding"] for r in c.orderBy("query_id").collect()])
    index = vx.nearest_cells(vectors(spark, sf), matrix)
    return shown(vx.top_k_cells(index, c, matrix, 5, probes=len(matrix)))


@query("v10_trained_cells", using("v_index", f", {_CENTRES} SELECT query_id, chunk_id, round(score, 6) + 0e0 AS score, rank::INTEGER AS rank FROM ({_top(5, _DOT)})"))
def v10_trained(spark, sf):
    """Cells of trained centres, all of them probed."""
    found = vectors(spark, sf)
    matrix = vx.train_cells(found, 12)
    return shown(vx.top_k_cells(vx.nearest_cells(found, matrix), centres(spark, sf), matrix, 5, probes=len(matrix)))


@query("u03_multi_query_union", using("v_index", f", {_CENTRES} SELECT DISTINCT chunk_id FROM ({_top(30, _DOT)})"))
def u03(spark, sf):
    return vx.top_k(vectors(spark, sf), centres(spark, sf), 30).select("chunk_id").dropDuplicates(["chunk_id"])
