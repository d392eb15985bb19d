"""Question banks: JSON of several shapes, flattened with VARIANT.

Accepted: a list; ``{questions: [...]}``; ``{categories: [{category,
subcategories: [{subcategory, questions}], questions}]}``; ``{categories:
{name: {questions} | [...]}}``; ``{name: {questions}}``.  VARIANT keeps object
fields in name order, so lists come out by category name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import lexicon as lx
from ..functions.arrays import bind
from ..functions.text import strip
from ..operators.ranking import first_seen

ITEMS, FIELDS = "array<variant>", "map<string,variant>"
_NO_LISTS = "cast(array() as array<struct<hint:string,items:array<variant>>>)"


def _get(v: Column, path: str, to: str) -> Column:
    return F.try_variant_get(v, path, to)


def _list(hint: Column, items: Column) -> Column:
    """One list, or none where ``items`` is not a list."""
    return F.when(
        items.isNotNull(), F.array(F.struct(hint.cast("string").alias("hint"), items.alias("items")))
    ).otherwise(F.expr(_NO_LISTS))


def _filled(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def _entries(v: Column) -> Column:
    return F.coalesce(
        F.map_entries(_get(v, "$", FIELDS)),
        F.expr("cast(array() as array<struct<key:string,value:variant>>)"),
    )


def _each(arr: Column, fn) -> Column:
    return F.flatten(F.transform(F.coalesce(arr, F.expr(f"cast(array() as {ITEMS})")), fn))


def question_lists(doc: Column) -> Column:
    """array<struct<hint, items>>: every question list of one bank document."""

    def of_category(c: Column) -> Column:
        name = _get(c, "$.category", "string")

        def of_sub(s: Column) -> Column:
            names = F.filter(
                F.array(name, _get(s, "$.subcategory", "string")), lambda n: F.coalesce(n, F.lit("")) != ""
            )
            hint = F.when(F.size(names) > 0, F.array_join(names, "/"))
            return _list(hint, _filled(_get(s, "$.questions", ITEMS)))

        return F.concat(
            _each(_get(c, "$.subcategories", ITEMS), of_sub),
            _list(name, _filled(_get(c, "$.questions", ITEMS))),
        )

    def shapes(v: Column) -> Column:
        none = F.lit(None).cast("string")
        as_object = F.concat(
            _list(none, _get(v, "$.questions", ITEMS)),
            _each(_get(v, "$.categories", ITEMS), of_category),
            F.flatten(
                F.transform(
                    _entries(_get(v, "$.categories", "variant")),
                    lambda e: _list(
                        e["key"],
                        F.coalesce(_get(e["value"], "$.questions", ITEMS), _get(e["value"], "$", ITEMS)),
                    ),
                )
            ),
            F.flatten(
                F.transform(
                    _entries(v), lambda e: _list(e["key"], _get(e["value"], "$.questions", ITEMS))
                )
            ),
        )
        return F.when(_get(v, "$", ITEMS).isNotNull(), _list(none, _get(v, "$", ITEMS))).otherwise(as_object)

    return bind(doc, shapes)


def is_text(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item) == "STRING", F.lit(False))


def item_text(item: Column) -> Column:
    """The string itself, or the first string among the known fields."""
    fields = ["question", "text", "q", "content"]
    return F.coalesce(
        F.when(is_text(item), _get(item, "$", "string")),
        *[
            F.when(is_text(_get(item, f"$.{f}", "variant")), _get(item, f"$.{f}", "string"))
            for f in fields
        ],
    )


def flatten_banks(banks: DataFrame, json: str = "value") -> DataFrame:
    """(…, list_no, hint, item_no, item) for every item of every bank document."""
    rest = [c for c in banks.columns if c != json]
    lists = banks.select(*rest, F.posexplode(question_lists(F.try_parse_json(json))).alias("list_no", "l"))
    return lists.select(
        *rest, "list_no", F.col("l.hint").alias("hint"), F.posexplode("l.items").alias("item_no", "item")
    )


def read_banks(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, value): JSON files as whole texts, tagged with their name."""
    return spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), "value"
    )


# --- model output -----------------------------------------------------------
def parse_model_items(output: Column) -> Column:
    """array<variant> out of a model's answer: fences off, wrapper off, else the
    outermost bracket, else empty."""
    raw = strip(output)
    bare = F.when(
        raw.startswith("```"),
        strip(F.regexp_replace(F.regexp_replace(raw, r"^```[\p{L}\p{N}_-]*\s*", ""), r"\s*```$", "")),
    ).otherwise(raw)

    def read(t: Column) -> Column:
        v = F.try_parse_json(t)
        inner = F.try_parse_json(F.nullif(F.regexp_extract(t, r"(?s)\[.*\]", 0), F.lit("")))
        return F.coalesce(
            _get(v, "$", ITEMS),
            _get(v, "$.questions", ITEMS),
            _get(v, "$.qas", ITEMS),
            _get(v, "$.items", ITEMS),
            _get(inner, "$", ITEMS),
            F.expr(f"cast(array() as {ITEMS})"),
        )

    return bind(bare, read)


# --- normal question rows -----------------------------------------------------
def normalise_items(items: DataFrame, category: str, order: str, display=lx.CATEGORY_DISPLAY) -> DataFrame:
    """Question rows from (category, order, item): text, answer, id, source.

    Blank texts are dropped; a text counts once per category and then once over
    all, first come first kept.
    """
    it = F.col("item")
    text = F.when(is_text(it), _get(it, "$", "string")).otherwise(
        F.coalesce(
            F.nullif(_get(it, "$.question", "string"), F.lit("")), _get(it, "$.content", "string")
        )
    )
    own_id = F.coalesce(
        F.nullif(_get(it, "$.chunk_id", "string"), F.lit("")),
        F.nullif(_get(it, "$.question_id", "string"), F.lit("")),
    )
    made_id = F.concat(
        F.lit("json_"), F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("all")), F.lit("_"),
        F.format_string("%06d", F.col(order).cast("bigint") + 1),
    )
    source = F.coalesce(
        F.nullif(_get(it, "$.source_file", "string"), F.lit("")),
        _get(it, "$.metadata.source_file", "string"),
        F.lit(""),
    )
    name = lb.lookup(F.col(category), display)
    rows = items.select(
        F.col(category).alias("category_key"),
        F.col(order).alias("ord"),
        strip(text).alias("content"),
        strip(F.coalesce(_get(it, "$.answer", "string"), F.lit(""))).alias("reference_answer"),
        F.coalesce(own_id, made_id).alias("question_id"),
        F.coalesce(F.nullif(name, F.lit("")), lb.job_category(source)).alias("job_category"),
    ).where("content <> ''")
    per_category = first_seen(rows, ["category_key", "content"], "ord")
    return first_seen(per_category, ["content"], "category_key", "ord")


def normalise_rows(rows: DataFrame, order: str, display=lx.CATEGORY_DISPLAY) -> DataFrame:
    """Question rows from a table (id, category, question, source)."""
    key = F.nullif(strip(F.col("category")), F.lit(""))
    name = lb.lookup(key, display)
    clean = rows.select(
        F.col(order).alias("ord"),
        F.col("id").cast("string").alias("question_id"),
        key.alias("category_key"),
        name.alias("category_name"),
        strip(F.col("question")).alias("content"),
        F.coalesce(name, lb.job_category(F.col("source"))).alias("job_category"),
    ).where("content <> ''")
    return first_seen(clean, ["content"], "ord")
