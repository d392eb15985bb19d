"""Question bank over banks made of all documents' sentences."""

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..plans import bank as pb
from ..sources import banks as bk
from ..sources import sinks as sk
from ..session import scratch_path
from .registry import query
from .text import q_key, q_noise, q_question
from .views import lit, q_case, q_strip, table, using

_PARTS = """s AS (SELECT doc_id, source, lang, unnest(string_split(text, '.')) AS s,
        generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM documents)"""


def bank_json(spark, sf):
    """(file, doc_id, value): every document as a bank file of one of five shapes."""
    items = F.split("text", r"\.", -1)
    asked = F.transform(items, lambda s: F.struct(s.alias("q")))
    listed = F.struct(items.alias("questions"))
    shape = F.col("doc_id") % 5
    value = (
        F.when(shape == 0, F.to_json(items))
        .when(shape == 1, F.to_json(F.struct(asked.alias("questions"))))
        .when(shape == 2, F.to_json(F.struct(F.array(F.struct(
            F.col("lang").alias("category"),
            F.array(F.struct(F.lit("part").alias("subcategory"), items.alias("questions"))).alias("subcategories"),
            items.alias("questions"))).alias("categories"))))
        .when(shape == 3, F.to_json(F.struct(F.create_map("lang", listed).alias("categories"))))
        .otherwise(F.to_json(F.create_map("lang", listed)))
    )
    return table(spark, sf, "documents").select(F.col("source").alias("file"), "doc_id", value.alias("value"))


@query("s04_flatten_banks", f"""WITH {_PARTS} SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN NULL WHEN doc_id % 5 = 2 THEN lang || '/part' ELSE lang END AS hint,
    i::INTEGER AS item_no, s AS text FROM s UNION ALL SELECT doc_id, lang, i::INTEGER, s FROM s WHERE doc_id % 5 = 2""")
def s04(spark, sf):
    return bk.flatten_banks(bank_json(spark, sf)).select(
        "doc_id", "hint", "item_no", bk.item_text(F.col("item")).alias("text"))


@query("t36_item_text", f"WITH {_PARTS} SELECT doc_id, i::INTEGER AS i, CASE WHEN i % 6 = 5 THEN NULL ELSE s END AS text FROM s")
def t36(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("i", "s"))
    obj = lambda name: F.to_json(F.create_map(F.lit(name), F.col("s"), F.lit("n"), F.lit("x")))
    k = F.col("i") % 6
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("s").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    j = F.when(k == 0, quoted).when(k == 1, obj("question")).when(k == 2, obj("text")).when(k == 3, obj("q")).when(
        k == 4, obj("content")).otherwise(obj("other"))
    return s.select("doc_id", "i", bk.item_text(F.parse_json(j)).alias("text"))


@query("t35_model_output", f"WITH {_PARTS} SELECT doc_id, i::INTEGER AS i, s AS text FROM s WHERE doc_id % 6 <> 4")
def t35(spark, sf):
    items = F.split("text", r"\.", -1)
    arr = F.to_json(items)
    named = lambda n: F.to_json(F.create_map(F.lit(n), items))
    k = F.col("doc_id") % 6
    out = (
        F.when(k == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```"))).when(k == 1, named("questions"))
        .when(k == 2, named("items")).when(k == 3, F.concat(F.lit("Here they are: "), arr, F.lit(" done")))
        .when(k == 4, F.concat(F.lit('["'), F.replace("text", F.lit('"'), F.lit("")), F.lit("")))
        .otherwise(named("qas"))
    )
    return table(spark, sf, "documents").select("doc_id", F.posexplode(bk.parse_model_items(out)).alias("i", "item")).select(
        "doc_id", "i", bk.item_text(F.col("item")).alias("text"))


@query("q01_normalise_items", f"""WITH {_PARTS}, r AS (SELECT lang AS category_key, doc_id * 4294967296 + i AS ord, {q_strip("s")} AS content,
        CASE WHEN i % 2 = 1 THEN 'a ' || i ELSE '' END AS reference_answer, CASE WHEN i % 2 = 1 AND i % 3 = 0 THEN 'c' || i ELSE concat('json_', lang, '_', format('{{:06d}}', doc_id * 4294967296 + i + 1)) END AS question_id,
        lang AS job_category FROM s),
    a AS (SELECT *, row_number() OVER (PARTITION BY category_key, content ORDER BY ord) AS x FROM r WHERE content <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY category_key, ord) AS y FROM a WHERE x = 1)
    SELECT category_key, ord, content, reference_answer, question_id, job_category FROM b WHERE y = 1""")
def q01(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", "lang", F.posexplode(F.split("text", r"\.", -1)).alias("i", "s"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("s").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    obj = F.to_json(F.struct(
        F.when(F.col("i") % 4 == 1, F.col("s")).alias("question"), F.when(F.col("i") % 4 == 3, F.col("s")).alias("content"),
        F.concat(F.lit(" a "), F.col("i").cast("string")).alias("answer"),
        F.when(F.col("i") % 3 == 0, F.concat(F.lit("c"), F.col("i").cast("string"))).alias("chunk_id")))
    items = s.select("lang", (F.col("doc_id") * 4294967296 + F.col("i")).alias("ord"),
                     F.parse_json(F.when(F.col("i") % 2 == 0, quoted).otherwise(obj)).alias("item"))
    return bk.normalise_items(items, "lang", "ord")


@query("q02_normalise_rows", f"""WITH {_PARTS}, r AS (SELECT doc_id * 4294967296 + i AS ord, CAST(doc_id AS VARCHAR) AS question_id,
        CASE i % 3 WHEN 0 THEN 'LLM' WHEN 1 THEN 'other' END AS category_key, {q_strip("s")} AS content, source FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY ord) AS x FROM r WHERE content <> '')
    SELECT ord, question_id, category_key, CASE category_key WHEN 'LLM' THEN 'LLM大模型' ELSE category_key END AS category_name, content,
    coalesce(CASE category_key WHEN 'LLM' THEN 'LLM大模型' ELSE category_key END, {q_case("lower(source)", lx.JOB_CATEGORY, lit(lx.JOB_CATEGORY_DEFAULT))}) AS job_category
    FROM f WHERE x = 1""")
def q02(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", r"\.", -1)).alias("i", "s"))
    rows = s.select(
        (F.col("doc_id") * 4294967296 + F.col("i")).alias("ord"), F.col("doc_id").alias("id"),
        F.when(F.col("i") % 3 == 0, " LLM ").when(F.col("i") % 3 == 1, "other").otherwise("  ").alias("category"),
        F.col("s").alias("question"), "source")
    return bk.normalise_rows(rows, "ord")


# --- build: bank file = source, list = language ------------------------------------------
def raw(spark, sf):
    s = table(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit(".json")).alias("file"),
        F.when(F.col("lang") == "fr", "Oracle").when(F.col("lang") == "es", "web3").otherwise(F.col("lang")).alias("hint"),
        F.posexplode(F.split("text", r"\.", -1)).alias("i", "text"))
    return s.select("file", "hint", (F.col("doc_id") * 4294967296 + F.col("i")).alias("pos"), "text").where("text <> ''")


_BUILT = f"""{_PARTS}, r0 AS (SELECT source || '.json' AS file, CASE lang WHEN 'fr' THEN 'Oracle' WHEN 'es' THEN 'web3' ELSE lang END AS hint, doc_id * 4294967296 + i AS pos, {q_question("s")} AS q FROM s WHERE s <> ''),
    c0 AS (SELECT *, {q_noise("q")} AS noise FROM r0), k0 AS (SELECT *, {q_key("q")} AS key FROM c0 WHERE NOT noise),
    g0 AS (SELECT *, min(pos) OVER (PARTITION BY file, hint) AS g FROM k0),
    u0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, g, pos) AS rn FROM g0 WHERE key <> ''),
    b0 AS (SELECT *, {q_case("lower(concat(file, ' ', hint))", lx.BANK_CATEGORY, lit(lx.BANK_CATEGORY_DEFAULT))} AS category FROM u0 WHERE rn = 1)"""


@query("q03_build_bank", f"WITH {_BUILT} SELECT key, q AS question, file, category FROM b0")
def q03(spark, sf):
    return pb.build_bank(raw(spark, sf))["unique"].select("key", "question", "file", "category")


@query("a11_category_sizes", f"WITH {_BUILT} SELECT category, count(*) AS count FROM b0 GROUP BY category")
def a11(spark, sf):
    return pb.category_sizes(pb.build_bank(raw(spark, sf))["unique"])


@query("a11_category_lists", f"""WITH {_BUILT}, o AS (SELECT category, q, row_number() OVER (PARTITION BY category ORDER BY file, g, pos) - 1 AS k FROM b0)
    SELECT category, (k // 1000)::BIGINT AS page, string_agg(q, chr(10) ORDER BY k) AS questions FROM o GROUP BY category, k // 1000""")
def a11_lists(spark, sf):
    pages = pb.category_pages(pb.build_bank(raw(spark, sf))["unique"])
    return pages.withColumn("questions", F.array_join("questions", "\n"))


@query("a10_bank_report", f"""WITH RECURSIVE {_BUILT}, o AS (SELECT file, hint, q, row_number() OVER (PARTITION BY file, hint ORDER BY pos) AS k FROM c0 WHERE NOT noise),
    w AS (SELECT file, hint, k, 1 AS batch, length(q) + 2 AS used, 1 AS n FROM o WHERE k = 1
        UNION ALL SELECT o.file, o.hint, o.k,
            CASE WHEN used + length(o.q) + 2 > 2500 OR n >= 50 THEN batch + 1 ELSE batch END,
            CASE WHEN used + length(o.q) + 2 > 2500 OR n >= 50 THEN length(o.q) ELSE used + length(o.q) + 2 END,
            CASE WHEN used + length(o.q) + 2 > 2500 OR n >= 50 THEN 1 ELSE n + 1 END
        FROM w JOIN o ON o.file = w.file AND o.hint = w.hint AND o.k = w.k + 1)
    SELECT (SELECT count(*) FROM c0) AS raw_questions, (SELECT count_if(noise)::BIGINT FROM c0) AS removed_noise,
        (SELECT count_if(NOT noise)::BIGINT FROM c0) AS cleaned, (SELECT count(*) FROM b0) AS unique_questions,
        (SELECT sum(m)::BIGINT FROM (SELECT max(batch) AS m FROM w GROUP BY file, hint)) AS total_batches""")
def a10(spark, sf):
    return pb.bank_report(pb.build_bank(raw(spark, sf)))


@query("q05_export_questions", f"WITH {_PARTS} SELECT doc_id, i::INTEGER AS i, {q_strip('s')} AS question FROM s WHERE {q_strip('s')} <> ''")
def q05(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("i", "s"))
    return s.select("doc_id", "i", tx.strip(F.col("s")).alias("question")).where("question <> ''")


@query("q06_raw_sections", f"""WITH sec AS (SELECT doc_id AS source_path, unnest(string_split(text, chr(10))) AS content,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section FROM documents),
    it AS (SELECT source_path, section, split_part(content, '.', 1) AS question, split_part(content, '.', 2) AS answer FROM sec WHERE section % 4 <> 3)
    SELECT s.source_path, s.section::INTEGER AS section, CASE WHEN i.section IS NOT NULL THEN 'filtered_out' ELSE 'no_qa' END AS reason
    FROM sec s LEFT JOIN it i ON s.source_path = i.source_path AND s.section = i.section
    WHERE NOT coalesce({q_strip("i.question")} <> '' AND length({q_strip("i.answer")}) >= 20, false)""")
def q06(spark, sf):
    sec = table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_path"), F.posexplode(F.split("text", "\n", -1)).alias("section", "content"))
    items = sec.where("section % 4 <> 3").select(
        "source_path", "section", F.split_part("content", F.lit("."), F.lit(1)).alias("question"),
        F.split_part("content", F.lit("."), F.lit(2)).alias("answer"))
    return pb.raw_sections(sec, items).select("source_path", "section", "reason")


@query("s05_flat_bank_csv", f"WITH {_PARTS} SELECT lang AS category, {q_strip('s')} AS question FROM s WHERE {q_strip('s')} <> ''")
def s05(spark, sf):
    s = table(spark, sf, "documents").select(F.col("lang").alias("category"), F.explode(F.split("text", r"\.", -1)).alias("question"))
    path = scratch_path(spark, "flat-bank")
    sk.write_flat_bank(s, path)
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


@query("s10_bank_files", using("v_questions", " SELECT concat('bank_', category_key) AS file, content AS text FROM v_questions"))
def s10(spark, sf):
    """Bank files written per category, read back as whole texts with their folder."""
    from .views import questions
    path = scratch_path(spark, "banks")
    q = questions(spark, sf).select("category_key", F.to_json(F.array("content")).alias("value"))
    q.write.partitionBy("category_key").text(path)
    found = spark.read.text(f"{path}/*/*.txt", wholetext=True, lineSep=None).select(
        F.concat(F.lit("bank_"), F.regexp_extract(F.col("_metadata.file_path"), "category_key=([^/]+)/", 1)).alias("file"),
        F.explode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("value"))
    return bk.flatten_banks(found).select("file", bk.item_text(F.col("item")).alias("text"))
