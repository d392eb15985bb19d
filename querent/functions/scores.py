"""Scores, bands and session rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import mostly_english, strip

WEIGHTS = {"technical_accuracy": 0.5, "clarity": 0.2, "depth_breadth": 0.3}
BIAS_OF = {
    "technical_accuracy": "technical_weight",
    "clarity": "clarity_weight",
    "depth_breadth": "depth_weight",
}
# Fixed values of the row written when scoring was not possible.
FALLBACK_WEAKNESSES = ["AI evaluation unavailable"]
FALLBACK_SUGGESTIONS = ["Please try again when the AI service is available."]


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def exact_avg(c: Column) -> Column:
    """Average over decimals, so the result does not depend on the row order."""
    return F.try_divide(F.sum(c.cast("decimal(20,8)")).cast("double"), F.count(c))


def apply_bias(score: Column, bias: Column) -> Column:
    """Shift and clamp to [0, 10]; a persona without this bias changes nothing."""
    return F.when(
        bias.isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.0), score + bias))
    ).otherwise(score)


def keyword_coverage(hit: Column, missed: Column, digits: int | None = 2) -> Column:
    h = F.coalesce(F.size(hit), F.lit(0))
    m = F.coalesce(F.size(missed), F.lit(0))
    return F.coalesce(_rounded(F.try_divide(h, h + m), digits), F.lit(1.0))


def total_score(technical: Column, clarity: Column, depth: Column, digits: int | None = 2) -> Column:
    w = WEIGHTS
    return _rounded(
        technical * w["technical_accuracy"] + clarity * w["clarity"] + depth * w["depth_breadth"], digits
    )


def needs_followup(total: Column, low: float = 6.0, high: float = 8.0) -> Column:
    return total.between(low, high)


def band(total: Column) -> Column:
    return F.when(total >= 8, "high_score").when(total >= 6, "medium_score").otherwise("low_score")


def feedback(total: Column, templates: Column | None = None) -> Column:
    """Persona text of the band, or the default text."""
    default = F.create_map(*[F.lit(x) for kv in lx.FEEDBACK_DEFAULT.items() for x in kv])
    text = F.try_element_at(default, band(total))
    return text if templates is None else F.coalesce(F.try_element_at(templates, band(total)), text)


def elapsed_minutes(start: Column, end: Column, now: Column | None = None, digits: int | None = 2) -> Column:
    """Minutes between two microsecond stamps; 0 for a session not begun."""
    stop = end if now is None else F.coalesce(end, now)
    return F.coalesce(_rounded((stop - start) / F.lit(6e7), digits), F.lit(0.0))


def time_exceeded(minutes: Column, limit: Column) -> Column:
    return minutes >= limit


def should_end(minutes: Column, limit: Column, asked: Column, max_questions: Column) -> Column:
    return (minutes >= limit) | (asked >= max_questions)


def route_translation(answer: Column, translated: Column) -> Column:
    """Text to score: the translation of a mostly English answer, if there is one."""
    usable = F.when(strip(F.coalesce(translated, F.lit(""))) != "", translated)
    return F.when(mostly_english(answer), F.coalesce(usable, answer)).otherwise(answer)


def with_defaults(df, defaults: dict[str, str]):
    """Missing columns and nulls filled with the given values."""
    for name, value in defaults.items():
        present = F.col(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(present, F.lit(value)))
    return df


# --- prompts --------------------------------------------------------------------
EVALUATION_PROMPT = (
    "Role: {job_type} interviewer. Score the answer.\nType: {question_type}\nDifficulty: {difficulty}\n"
    "Question: {question}\nReference: {reference_answer}\nAnswer: {user_answer}\n"
    "Return JSON: technical_accuracy, clarity, depth_breadth (0-10), keywords_hit, keywords_missed,"
    " weaknesses, suggestions."
)
FOLLOWUP_PROMPT = (
    "Role: interviewer, {personality_name}.\nQuestion: {question}\nAnswer: {user_answer}\n"
    "Score: {total_score}/10\nWeak points: {weaknesses}\nAsk one follow-up: {followup_style}"
)
REPORT_PROMPT = (
    "Role: {job_type} interviewer. Difficulty: {difficulty}. Questions: {total_questions}."
    " Correct: {correct_rate}. Averages: {avg_technical}, {avg_clarity}, {avg_depth}.\n{answer_details}\n"
    "Return JSON: weak_areas, strong_areas, suggestions."
)
EXTRACTION_PROMPT = (
    "Extract interview questions from the text below. Return ONLY a JSON array.\n\nTEXT:\n{section}"
)
MISSING_REFERENCE = "????????????"
NO_WEAKNESS = "无明显不足"


def fill(template: str, **fields: Column) -> Column:
    """The template with each ``{name}`` replaced by its column; null reads as ''."""
    import re

    out = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            out.append(F.coalesce(fields[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def evaluation_prompt(template: str = EVALUATION_PROMPT, **fields: Column) -> Column:
    reference = strip(F.coalesce(fields["reference_answer"], F.lit("")))
    fields["reference_answer"] = F.when(reference != "", reference).otherwise(MISSING_REFERENCE)
    return fill(template, **fields)


def followup_prompt(template: str = FOLLOWUP_PROMPT, **fields: Column) -> Column:
    joined = F.array_join(fields["weaknesses"], "、")
    fields["weaknesses"] = F.when(F.size(fields["weaknesses"]) > 0, joined).otherwise(NO_WEAKNESS)
    return fill(template, **fields)
