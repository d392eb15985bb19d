"""Report and hand-over sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def write_flat_bank(rows: DataFrame, path: str) -> None:
    """CSV (category, question) with header; blank questions are left out."""
    question = strip(F.col("question"))
    (
        rows.select("category", question.alias("question"))
        .where("question <> ''")
        .write.mode("overwrite")
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", "false")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def review_lines(df: DataFrame) -> DataFrame:
    """Readable blocks of chunks, one per row, for a text file."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return df.select(
        F.concat(
            F.lit("=== "), show("chunk_id"), F.lit(" ===\n来源: "), show("source_file"),
            F.lit("\n类型: "), show("chunk_type"), F.lit("\n问题: "), show("question"),
            F.lit("\n答案: "), show("answer"), F.lit("\nMetadata: "),
            F.coalesce(F.to_json("metadata"), F.lit("{}")), F.lit("\n\n" + "=" * 50 + "\n"),
        ).alias("value")
    )


def write_review_sample(df: DataFrame, path: str) -> None:
    review_lines(df).write.mode("overwrite").text(path)


def retry_rows(documents: DataFrame, text: str, types: list[str]) -> DataFrame:
    """Rows of the given types whose extraction gave no text."""
    blank = F.length(strip(F.coalesce(F.col(text), F.lit("")))) == 0
    return documents.where(F.col("file_type").isin(*types) & blank)


def queue_for_retry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
