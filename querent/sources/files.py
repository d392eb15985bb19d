"""File catalogue and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.arrays import last


def describe_paths(
    listing: DataFrame,
    root: str,
    formats: list[str] = lx.DOCUMENT_SUFFIXES,
    image_formats: list[str] = lx.IMAGE_SUFFIXES,
    skip_dirs: list[str] = lx.SKIP_DIRS,
    skip_files: list[str] = lx.SKIP_FILES,
    skip_words: list[str] = lx.SKIP_PATH_WORDS,
) -> DataFrame:
    """Catalogue rows for a (path, length) listing under ``root``.

    Only expressions over the path: no file is opened.
    """
    root = root.rstrip("/")
    local = F.regexp_replace("path", "^file:/+", "/")
    df = listing.select(local.alias("path"), F.col("length").alias("size"))
    parts = F.split(F.substr("path", F.lit(len(root) + 2)), "/", -1)
    df = df.withColumn("_parts", parts)
    folders = F.slice("_parts", 1, F.size("_parts") - 1)
    name = last(F.col("_parts"))
    # A name that only starts with a dot has no suffix.
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    category = F.when(F.size("_parts") > 1, F.get("_parts", F.lit(0))).otherwise(lx.UNCATEGORISED)
    wanted = (
        df.where(df["path"].startswith(root + "/"))
        .where(~F.exists(folders, lambda d: d.isin(*skip_dirs)))
        .where(~name.isin(*skip_files))
        .where(~tx.contains_any(F.lower("path"), skip_words))
        .where(suffix.isin(*[f.lower() for f in formats + image_formats]))
    )
    return wanted.select(
        "path",
        name.alias("name"),
        suffix.alias("suffix"),
        "size",
        category.alias("category"),
        F.when(F.size("_parts") > 1, F.get("_parts", F.size("_parts") - 2))
        .otherwise(root.rsplit("/", 1)[-1])
        .alias("parent_folder"),
        tx.is_template_path(F.col("path"), category).alias("is_template"),
        suffix.isin(*[f.lower() for f in image_formats]).alias("needs_ocr"),
    )


def scan_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """Catalogue of every supported file under ``root``.

    Files whose name starts with ``_`` or ``.`` are hidden by Spark's listing.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    return describe_paths(listing, root, **options)


def decode_text(content: Column) -> Column:
    """UTF-8 text of a file; malformed bytes are dropped."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    )


def document_text(content: Column, suffix: Column) -> Column:
    cleaned = tx.base_clean(decode_text(content))
    return F.when(suffix.isin(".md", ".markdown"), tx.strip_comments(cleaned)).otherwise(cleaned)


def to_documents(files: DataFrame) -> DataFrame:
    """Documents from (path, suffix, category, is_template, content) rows."""
    text = document_text(F.col("content"), F.col("suffix"))
    return files.withColumn("full_text", text).select(
        F.col("path").alias("source_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("suffix").alias("file_type"),
        "full_text",
        "category",
        "is_template",
        F.array(
            F.struct(
                F.lit(1).alias("page_num"),
                F.col("full_text").alias("content"),
                tx.has_image(F.col("full_text")).alias("has_images"),
                tx.has_table(F.col("full_text")).alias("has_tables"),
            )
        ).alias("pages"),
        F.expr("cast(array() as array<string>)").alias("errors"),
    )


def read_documents(spark: SparkSession, root: str, catalogue: DataFrame) -> DataFrame:
    """Text and Markdown files of the catalogue as documents, one row each."""
    content = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{md,markdown,txt,MD,TXT}")
        .load(root)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    )
    return to_documents(
        catalogue.select("path", "suffix", "category", "is_template").join(content, "path")
    )
