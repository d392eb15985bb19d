"""Corpus jobs as compositions of DataFrames.  What several results of a job
share is written once; everything else is lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import segment as sg
from ..functions import text as tx
from ..functions.arrays import bind, once
from ..operators import catalog as ct
from ..operators import dedup as dd
from ..operators import quality as ql
from ..operators import vectors as vx
from ..session import materialize, path_exists
from ..sources import sinks as sk

QUESTION_BANK = "题库"


def catalogue_and_classify(files: DataFrame, documents: DataFrame, **words) -> dict[str, DataFrame]:
    classified = ct.classify_files(files, ct.text_samples(documents), **words)
    return {
        "statistics": ct.catalogue_statistics(files),
        "classified": classified,
        "counts": ct.class_counts(classified),
    }


def extract_and_clean(documents: DataFrame, resume_words: dict | None = None) -> DataFrame:
    """Documents with cleaned text, Markdown and outcome; the text stays null
    where the document is dropped.

    ``documents`` has source_path, category, full_text, is_template, errors.
    """
    cleaned = documents.withColumn("_c", tx.clean_lines(F.col("full_text")))
    resume = tx.is_resume_text(F.col("source_path"), F.col("_c"), **(resume_words or {}))
    outcome = (
        F.when(F.size("errors") > 0, "error")
        .when(F.col("_c") == "", "empty")
        .when(F.col("is_template") | resume, "template")
        .otherwise("success")
    )
    ok = F.col("outcome") == "success"
    return cleaned.withColumn("outcome", outcome).select(
        *[c for c in documents.columns if c != "full_text"],
        "outcome",
        F.when(ok, F.col("_c")).alias("full_text"),
        F.when(ok, tx.to_markdown(F.col("_c"))).alias("markdown_text"),
    )


def bank_pairs(content: Column) -> Column:
    """Explicit pairs plus the headings outside them, by position."""

    def merge(v: Column) -> Column:
        free = F.filter(
            v["h"],
            lambda h: ~F.exists(
                v["p"], lambda p: (p["start_pos"] <= h["start_pos"]) & (h["end_pos"] <= p["end_pos"])
            ),
        )
        tag = lambda arr, n: F.transform(
            arr, lambda x, i: F.struct(x["start_pos"].alias("s"), F.lit(n).alias("n"), i.alias("i"), x.alias("x"))
        )
        both = F.array_sort(F.concat(tag(v["p"], 0), tag(free, 1)))
        return F.transform(both, lambda t: t["x"])

    return bind(
        F.struct(
            sg.parse_pairs(content).alias("p"),
            sg.pairs_by_headings(sg.normalise_document(content)).alias("h"),
        ),
        merge,
    )


def parse_and_chunk(documents: DataFrame, min_answer: int = 20, min_pair: int = 50) -> DataFrame:
    """Chunk rows of every document, without a shuffle.

    ``documents`` has source_path, category, full_text, markdown_text.
    """
    blank = F.lit("")
    md = F.coalesce(F.col("markdown_text"), blank)
    content = F.when(md != "", md).otherwise(F.coalesce(F.col("full_text"), blank))
    path = F.coalesce(F.col("source_path"), blank)
    is_bank = (
        (F.col("category") == QUESTION_BANK)
        | F.contains(path, F.lit(f"/{QUESTION_BANK}/"))
        | F.contains(path, F.lit(f"\\{QUESTION_BANK}\\"))
    )
    of_bank = F.filter(bank_pairs(F.col("content")), lambda p: F.length(tx.strip(p["answer"])) >= min_answer)
    # two selects: the analyzer gives up on one expression as deep as both
    parsed = once(
        documents.where(~tx.is_empty(content)).select(
            "source_path", "category", content.alias("content"), md.alias("md"), F.coalesce(is_bank, F.lit(False)).alias("bank")
        ),
        pairs=F.when(F.col("bank"), of_bank.cast(f"array<{sg.PAIR}>")).otherwise(sg.merge_short_pairs(sg.parse_pairs(F.col("content")), min_pair)),
    )
    no_pairs = F.when(F.col("md") != "", sg.chunk_markdown(F.col("md"))).otherwise(sg.chunk_plain(F.col("content")))
    pieces = once(
        parsed,
        pieces=F.when(F.col("bank") | (F.size("pairs") > 0), sg.chunk_pairs(F.col("pairs"))).otherwise(no_pairs),
    ).select("source_path", "category", F.posexplode("pieces").alias("seq", "c")).select("source_path", "category", "seq", "c.*")
    kind = F.when(F.col("chunk_type") == "qa", "qa").when(F.col("md_title").isNotNull(), "md").otherwise("text")
    extras = ["category", "md_title", "is_split", "part", "force_split"]
    entries = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")))
                for c in extras
            ]
        )
    )
    return pieces.select(
        sg.stable_id(kind, F.col("source_path"), F.col("seq"), F.col("content")).alias("chunk_id"),
        F.col("source_path").alias("source_file"),
        "seq", "content", "question", "answer", "chunk_type",
        F.lit(None).cast("int").alias("page_num"),
        "question_num",
        F.map_from_entries(entries).alias("metadata"),
    )


def long_enough(chunks: DataFrame, min_length: int = 50) -> DataFrame:
    return chunks.where(F.length("content") >= min_length)


def label_chunks(chunks: DataFrame, keyword_options: dict | None = None) -> DataFrame:
    c = F.col
    return chunks.select(
        "*",
        lb.content_category(c("source_file")).alias("content_category"),
        lb.position(c("source_file"), c("content")).alias("position"),
        lb.difficulty(c("content"), c("question")).alias("difficulty"),
        lb.question_type(c("question"), c("answer")).alias("question_type"),
        lb.chunk_keywords(c("question"), c("answer"), **(keyword_options or {})).alias("keywords"),
    )


def quality_gate(chunks: DataFrame, order: str, remove_invalid: bool = True, **limits) -> dict[str, DataFrame]:
    """Checked rows, the survivors of the check and of exact duplicate removal,
    the duplicate log (``duplicates()``), a review sample (``review()``) and the
    report tables.  The check is made once and written."""
    checked = materialize(ql.validate_chunks(chunks, **limits), "checked")
    valid = (checked.where("is_valid") if remove_invalid else checked).select(*chunks.columns)
    final = dd.keep_longest(valid, "content", order)
    return {
        "checked": checked,
        "final": final,
        "duplicates": lambda: dd.duplicate_log(valid, "content", order),
        "review": lambda ratio=0.1: ql.review_sample(final, order, ratio),
        "scores": ql.score_summary(checked),
        "issues": ql.issue_summary(checked),
    }


def build_index(chunks: DataFrame, path: str, encoder, dim: int, text: str = "content") -> DataFrame:
    """Embed the chunks the index lacks and append them; returns the index."""
    spark = chunks.sparkSession
    if path_exists(spark, path):
        vx.check_dimension(spark.read.parquet(path).select("chunk_id", "embedding"), dim)
    vx.append_new(chunks, path, prepare=lambda new: vx.index_rows(vx.embed(new, text, encoder)))
    return spark.read.parquet(path)


def repair_round(
    documents: DataFrame, types: list[str], extractor: Callable[[DataFrame], DataFrame], chunks: DataFrame | None = None
) -> dict[str, DataFrame]:
    """One round over documents without text.

    ``extractor`` gets the failed rows and adds ``direct`` and ``fallback``
    attempts.  Rows it cannot help go to the retry queue; the others replace
    their document and are chunked anew.  The extractor runs once: its answers
    are written before they are used.  With ``chunks``, the chunk table before
    the round, the one after it is made: new chunks stand for all old ones of
    their document, so a second round doubles none.
    """
    failed = sk.retry_rows(documents, "full_text", types)
    tried = materialize(
        extractor(failed).select(
            "source_path", "file_type",
            tx.best_attempt(F.lit(None).cast("string"), F.col("direct"), F.col("fallback")).alias("_best"),
        ),
        "repaired",
    )
    repaired = tried.where(F.col("_best").isNotNull()).select("source_path", F.col("_best").alias("full_text"))
    queue = tried.where(F.col("_best").isNull()).select(
        F.col("source_path").alias("original_path"), "file_type"
    )
    merged = ct.merge_reprocessed(documents, repaired, "source_path", ["full_text"])
    changed = merged.join(repaired.select("source_path"), "source_path", "left_semi")
    out = {"documents": merged, "queue": queue, "new_chunks": parse_and_chunk(changed)}
    if chunks is not None:
        kept = chunks.join(repaired.select(F.col("source_path").alias("source_file")).distinct(), "source_file", "left_anti")
        out["chunks"] = kept.unionByName(out["new_chunks"])
    return out
