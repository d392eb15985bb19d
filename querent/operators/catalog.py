"""Joins and counts over catalogue, documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.labels import file_class
from ..session import materialize
from .ranking import with_best_before

LABELS = ["content_category", "position", "difficulty", "question_type"]


def path_key(c: Column) -> Column:
    """Path with one kind of separator, for joins between listings."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+", "/")


def text_samples(documents: DataFrame, max_chars: int | None = 4000) -> DataFrame:
    """(path_key, sample): Markdown if there is any, else the full text; all of it without ``max_chars``."""
    text = tx.strip(
        F.coalesce(F.nullif(F.col("markdown_text"), F.lit("")), F.col("full_text"), F.lit(""))
    )
    sample = text if max_chars is None else F.substr(text, F.lit(1), F.lit(max_chars))
    return documents.select(
        path_key(F.col("source_path")).alias("path_key"), sample.alias("sample")
    ).where("sample <> ''")


def with_samples(files: DataFrame, samples: DataFrame) -> DataFrame:
    return (
        files.withColumn("path_key", path_key(F.col("path")))
        .join(samples, "path_key", "left")
        .drop("path_key")
    )


def classify_files(files: DataFrame, samples: DataFrame, **words) -> DataFrame:
    """Catalogue rows with class, confidence and reasons."""
    decided = file_class(
        F.col("path"), F.col("name"), F.col("category"), F.col("is_template"), F.col("sample"), **words
    )
    return with_samples(files, samples).select("path", decided.alias("c")).select(
        "path", F.col("c.category").alias("class"), "c.confidence", "c.reasons"
    )


def class_counts(classified: DataFrame, done: list[str] | None = None) -> DataFrame:
    """Files per class, most frequent first; classes already sorted in count as skipped."""
    folders = done or list(lx.CLASS_NAMES.values())
    skipped = F.col("category").isin(*folders) if "category" in classified.columns else F.lit(False)
    return (
        classified.groupBy("class")
        .agg(F.count("*").alias("files"), F.count_if(skipped).alias("skipped"))
        .orderBy(F.desc("files"), "class")
    )


def catalogue_statistics(files: DataFrame) -> DataFrame:
    """Counts and sizes in all, per suffix and per category, in one pass."""
    level = (
        F.when(F.grouping("suffix") == 0, "suffix")
        .when(F.grouping("category") == 0, "category")
        .otherwise("all")
    )
    return files.groupingSets(
        [[], [F.col("suffix")], [F.col("category")]], "suffix", "category"
    ).agg(
        level.alias("level"),
        F.coalesce("suffix", "category", F.lit("")).alias("key"),
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        F.count_if("is_template").alias("templates"),
        F.count_if(~F.col("is_template")).alias("interview_files"),
        F.count_if("needs_ocr").alias("ocr_needed"),
    ).drop("suffix", "category")


def label_statistics(chunks: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Histogram of every label; rows without one count under the default name."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c), F.lit(lx.UNLABELLED)).alias("value"))
            for c in labels
        ]
    )
    return (
        chunks.select(F.inline(pairs)).groupBy("label", "value").agg(F.count("*").alias("n"))
        .orderBy("label", F.desc("n"), "value")
    )


def new_rows(chunks: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose id the index does not hold yet.

    The index is asked which of the new ids it holds: a batch of ids that Spark
    finds small enough to send along meets the index where it is read, which
    then is not shuffled, however large.  Ids of any number are compared exactly.
    """
    ids = materialize(chunks.select(key).distinct(), "new-ids")
    held = materialize(index.select(key).join(ids, key, "left_semi").distinct(), "held-ids")
    return chunks.join(held, key, "left_anti")


def merge_reprocessed(documents: DataFrame, repaired: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Documents with the given columns replaced where a repaired row exists."""
    new = repaired.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = documents.join(new, key, "left")
    return joined.select(
        *[
            (F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
            for c in documents.columns
        ]
    )


def outside_pairs(headings: DataFrame, explicit: DataFrame, doc: str) -> DataFrame:
    """Heading pairs that lie inside no explicit pair of the same document.

    A sweep: both kinds are ordered by their start, and a heading is inside if
    the greatest end of the explicit pairs that began before it, or with it, is
    not before its own.  No pair is compared with another, and a document of any
    number of pairs is spread over tasks.
    """
    known = explicit.where(F.col(doc).isNotNull() & F.col("start_pos").isNotNull())
    starts = known.select(doc, "start_pos", F.lit(0).alias("_side"), F.col("end_pos").alias("_end"))
    swept = headings.withColumn("_side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    swept = swept.withColumn("_at", F.struct("start_pos", "_side"))
    widest = with_best_before(swept, [doc], "_at", F.col("_end"), "_widest")
    return widest.where((F.col("_side") == 1) & ~F.coalesce(F.col("_widest") >= F.col("end_pos"), F.lit(False))).select(*headings.columns)


def folder_positions(rows: DataFrame, path: str, mapping: DataFrame, key: str) -> DataFrame:
    """(key, position): mapping of the first path part that has one.

    ``mapping`` is (folder, position); Spark broadcasts it only when it is small.
    """
    parts = rows.select(key, F.posexplode(F.split(path, "/", -1)).alias("at", "folder"))
    return (
        parts.join(mapping, "folder")
        .groupBy(key)
        .agg(F.min_by("position", "at").alias("position"))
    )


def outcome_counts(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def folder_progress(files: DataFrame) -> DataFrame:
    """Per folder: files by status, questions and token estimate.

    ``files`` has folder, status, questions, tokens.
    """
    return files.groupBy("folder").agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("questions").alias("questions"),
        F.sum("tokens").alias("est_tokens"),
    )


def unprocessed(skipped: DataFrame, failed: DataFrame) -> DataFrame:
    """Skipped and failed files in one report."""
    return skipped.withColumn("status", F.lit("skipped")).unionByName(
        failed.withColumn("status", F.lit("failed"))
    )
