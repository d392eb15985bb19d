"""Session report for all sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import interview as iv


def session_report(
    sessions: DataFrame, answers: DataFrame, evaluations: DataFrame, order: str = "id",
    question: str = "user_answer", digits: int | None = 2,
) -> dict[str, DataFrame]:
    """Backlog, reports, details, digests and report prompts."""
    newest = iv.latest_evaluations(evaluations)
    counted = iv.report_set(newest, answers)
    reports = iv.session_reports(sessions, counted, digits)
    digests = iv.whole_digests(iv.answer_digest(answers, newest, order, question))
    with_digest = reports.join(digests, "session_id", "left").withColumn(
        "digest", F.coalesce("digest", F.lit("No answer records"))
    )
    c = F.col
    prompt = sc.fill(
        sc.REPORT_PROMPT, job_type=F.lit("technical"), difficulty=F.lit("进阶"), total_questions=c("total_count"),
        correct_rate=F.format_string("%.1f%%", c("pass_rate") * 100),
        avg_technical=F.format_string("%.1f", c("avg_technical_accuracy")),
        avg_clarity=F.format_string("%.1f", c("avg_clarity")),
        avg_depth=F.format_string("%.1f", c("avg_depth_breadth")), answer_details=c("digest"),
    )
    return {
        "backlog": iv.backlog(answers, evaluations),
        "reports": with_digest.withColumn("prompt", prompt),
        "details": iv.report_details(answers, newest),
    }
