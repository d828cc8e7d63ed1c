"""What a reviewer sees of a span: its candidates as rows, its context with the span marked, the reasons to be careful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reasons that call for care, and what is written in place of characters of markup.
SAFETY = ["high_risk_medication", "dose_adjacent", "mixed_script", "low_margin"]
MARKUP = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def candidate_rows(spans: DataFrame) -> DataFrame:
    """span_id and the columns of its candidates' table, in order of rank."""
    rows = spans.select("span_id", F.posexplode("candidates").alias("at", "c"))
    return rows.select(
        "span_id", (F.col("at") + 1).alias("rank"), "c.term", F.col("c.concept_id").alias("concept"), F.col("c.score_breakdown.phonetic").alias("phonetic"),
        F.col("c.score_breakdown.orthographic").alias("spelling"), F.col("c.score").alias("final"), F.col("c.risk_tier").alias("risk"), F.col("c.provenance").alias("source"),
    )


def escaped(col: Column) -> Column:
    for char, put in MARKUP:
        col = F.replace(col, F.lit(char), F.lit(put))
    return col


def highlighted(context: Column, span: Column) -> Column:
    """The context as markup, with the first occurrence of the span, in whatever case, marked."""
    at = F.instr(F.lower(context), F.lower(span))
    inside = F.concat(escaped(F.substring(context, F.lit(1), at - 1)), F.lit("<mark>"), escaped(F.substring(context, at, F.length(span))), F.lit("</mark>"), escaped(F.substring(context, at + F.length(span), F.length(context))))
    return F.when(at > 0, inside).otherwise(escaped(context))


def safety_reasons(reasons: Column) -> Column:
    """The reasons that call for care, in their own order."""
    return F.filter(reasons, lambda r: r.isin(SAFETY))
