"""Question bank jobs: build from JSON banks, extract from documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import scores as sc
from ..functions import segment as sg
from ..functions import text as tx
from ..functions.arrays import once
from ..operators import catalog as ct
from ..operators.dedup import first_per_question
from ..operators.packing import pack_batches
from ..operators.ranking import first_seen, with_ordinal
from ..session import materialize
from ..sources.banks import flatten_banks, item_text, parse_model_items


def raw_questions(banks: DataFrame) -> DataFrame:
    """(file, hint, pos, text) of every item with a text in every bank file."""
    return flatten_banks(banks).select(
        "file", "hint",
        (F.col("list_no").cast("bigint") * (1 << 32) + F.col("item_no")).alias("pos"),
        item_text(F.col("item")).alias("text"),
    ).where("text <> ''")


def candidates(raw: DataFrame) -> DataFrame:
    """Raw questions with their normal form and a noise flag."""
    clean = once(raw, question=tx.normalise_question(F.col("text"))).drop("text")
    return once(clean, noise=tx.is_question_noise(F.col("question")))


def clean_batches(
    kept: DataFrame, cleaner: Callable[[DataFrame], DataFrame], max_chars: int = 2500, max_items: int = 50
) -> DataFrame:
    """Questions after an external cleaner that answers batch by batch.

    ``cleaner`` gets (file, hint, batch, pos, items_json) and adds ``output``.
    A batch holds at most ``max_items`` questions.
    """
    keyed = kept.withColumn("hint", F.coalesce("hint", F.lit("")))
    numbered = pack_batches(keyed, ["file", "hint"], "pos", "question", max_chars, max_items)
    batches = keyed.join(numbered, ["file", "hint", "pos"]).groupBy("file", "hint", "batch").agg(
        F.min("pos").alias("pos"),
        F.to_json(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "question"))), lambda s: s["question"])
        ).alias("items_json"),
    )
    items = cleaner(batches).select(
        "file", F.nullif(F.col("hint"), F.lit("")).alias("hint"), F.col("pos").alias("_start"),
        F.posexplode(parse_model_items(F.col("output"))).alias("_at", "_item"),
    )
    texts = once(
        items.select("file", "hint", F.struct(F.col("_start").alias("start"), F.col("_at").alias("at")).alias("pos"), "_item"),
        question=tx.normalise_question(item_text(F.col("_item"))),
    ).drop("_item").where("question <> ''")
    return texts.where(~tx.is_question_noise(F.col("question")))


def ordered(rows: DataFrame) -> DataFrame:
    """``ord``: by file name, then list group in order of appearance, then item."""
    groups = rows.groupBy("file", "hint").agg(F.min("pos").alias("_g"))
    same = (F.col("r.file") == F.col("g.file")) & F.col("r.hint").eqNullSafe(F.col("g.hint"))
    return rows.alias("r").join(groups.alias("g"), same).select(
        "r.*", F.struct(F.col("r.file"), F.col("g._g"), F.col("r.pos")).alias("ord")
    )


def build_bank(raw: DataFrame, cleaner: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Bank questions by category, repeats with their files, and the report row.

    Without a ``cleaner`` the normalised candidates go on as they are.
    """
    cands = materialize(candidates(raw), "candidates")
    kept = cands.where(~F.col("noise")).drop("noise")
    cleaned = clean_batches(kept, cleaner) if cleaner else kept
    rows = ordered(cleaned).withColumn("source", F.col("file"))
    unique, repeats = first_per_question(rows, "question", "ord")
    unique = unique.withColumn("category", lb.bank_category(F.col("file"), F.col("hint")))
    return {"candidates": cands, "cleaned": cleaned, "unique": unique, "repeats": repeats}


def category_sizes(unique: DataFrame) -> DataFrame:
    return unique.groupBy("category").agg(F.count("*").alias("count")).orderBy("category")


def category_pages(unique: DataFrame, page_size: int = 1000) -> DataFrame:
    """(category, page, questions): lists in order of first sight, cut into pages of bounded size."""
    placed = with_ordinal(unique.select("category", "question", "ord"), ["category"], "ord")
    return placed.groupBy("category", F.floor((F.col("ordinal") - 1) / page_size).alias("page")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "question"))), lambda s: s["question"]
        ).alias("questions")
    )


def bank_report(bank: dict[str, DataFrame], max_chars: int = 2500, max_items: int = 50) -> DataFrame:
    """One row: raw, noise, cleaned and unique questions, request batches."""
    kept = bank["candidates"].where(~F.col("noise")).withColumn("hint", F.coalesce("hint", F.lit("")))
    batches = pack_batches(kept, ["file", "hint"], "pos", "question", max_chars, max_items)
    per_group = batches.groupBy("file", "hint").agg(F.max("batch").alias("n"))
    parts = [
        bank["candidates"].agg(F.count("*").alias("raw_questions"), F.count_if("noise").alias("removed_noise")),
        bank["cleaned"].agg(F.count("*").alias("cleaned")),
        bank["unique"].agg(F.count("*").alias("unique_questions")),
        per_group.agg(F.sum("n").alias("total_batches")),
    ]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in merged.columns])


def extract_questions(documents: DataFrame, min_length: int = 0, dedup: bool = True) -> DataFrame:
    """Questions by rule from catalogued documents, first occurrence kept.

    ``documents`` has source_path, category, ord, full_text, is_template.
    """
    cleaned = tx.clean_lines(F.col("full_text"))
    live = documents.where(~F.col("is_template") & ~tx.is_empty(F.col("full_text"))).withColumn("_c", cleaned)
    md = tx.to_markdown(F.col("_c"))
    found = live.select(
        "source_path", "category", "ord",
        F.posexplode(sg.question_only(F.when(md != "", md).otherwise(F.col("_c")))).alias("seq", "question"),
    ).where(F.length("question") >= min_length)
    return first_seen(found, ["question"], "ord", "seq") if dedup else found


def extract_with_model(
    documents: DataFrame, extractor: Callable[[DataFrame], DataFrame], max_chars: int = 6000,
    max_sections: int | None = None, min_length: int = 0, dedup: bool = True, resume_words: dict | None = None,
) -> dict[str, DataFrame]:
    """Questions that an external model finds in sections of catalogued documents.

    ``documents`` has source_path, category, ord, full_text, is_template,
    errors.  ``extractor`` gets (source_path, ord, section_index, section,
    prompt) and adds ``output``, null where the request failed; it runs once.
    Returns the questions (first occurrence kept) and the documents that gave
    none, with the reason.
    """
    cleaned = once(documents, _c=tx.clean_lines(F.coalesce("full_text", F.lit(""))))
    marked = once(cleaned, _m=tx.to_markdown(F.col("_c")))
    cut = sg.split_sections(F.col("_m"), max_chars)
    sections = once(marked, _s=cut if max_sections is None else F.slice(cut, 1, max_sections))
    reason = (
        F.when(F.col("is_template"), "template")
        .when(F.size("errors") > 0, "extract_failed")
        .when(tx.is_empty(F.col("full_text")), "empty")
        .when(tx.is_resume_text(F.col("source_path"), F.col("_c"), **(resume_words or {})), "resume_template")
        .when(F.col("_m") == "", "no_text")
        .when(F.size("_s") == 0, "no_sections")
    )
    ready = materialize(
        sections.select("source_path", "category", "ord", reason.alias("reason"), F.col("_s").alias("sections")), "sections"
    )
    asked = ready.where("reason is null").select(
        "source_path", "category", "ord", F.posexplode("sections").alias("_at", "section")
    ).withColumn("section_index", F.col("_at") + 1).drop("_at")
    answered = materialize(
        extractor(asked.withColumn("prompt", sc.fill(sc.EXTRACTION_PROMPT, section=F.col("section")))), "answers"
    )
    found = answered.where("output is not null").select(
        "source_path", "category", "ord", "section_index",
        F.posexplode(parse_model_items(F.col("output"))).alias("seq", "_item"),
    ).withColumn("question", tx.strip_list_mark(item_text(F.col("_item")))).drop("_item").where(
        (F.col("question") != "") & (F.length("question") >= min_length)
    )
    with_any = found.select("ord").distinct().withColumn("_any", F.lit(True))
    failed = answered.groupBy("ord").agg(F.bool_or(F.col("output").isNull()).alias("_failed"))
    outcome = ready.join(with_any, "ord", "left").join(failed, "ord", "left").where("_any is null").select(
        "source_path", "category", "ord", F.coalesce("_failed", F.lit(False)).alias("_failed"),
        F.coalesce("reason", F.when(F.col("_failed"), "request_failed").otherwise("no_questions")).alias("reason"),
    )
    return {
        "questions": first_seen(found, ["question"], "ord", "section_index", "seq") if dedup else found,
        "unprocessed": ct.unprocessed(
            outcome.where(~F.col("_failed")).drop("_failed"), outcome.where("_failed").drop("_failed")
        ),
    }


def raw_sections(sections: DataFrame, items: DataFrame, min_answer: int = 20) -> DataFrame:
    """Sections without an accepted pair, with the reason.

    ``items`` are the parsed pairs (source_path, section, question, answer).
    """
    keys = ["source_path", "section"]
    good = (tx.strip(F.col("question")) != "") & (F.length(tx.strip(F.col("answer"))) >= min_answer)
    per = items.groupBy(*keys).agg(F.count_if(good).alias("_good"), F.count("*").alias("_all"))
    return sections.join(per, keys, "left").where(F.coalesce("_good", F.lit(0)) == 0).select(
        *sections.columns,
        F.when(F.col("_all") > 0, "filtered_out").otherwise("no_qa").alias("reason"),
    )


