"""The audit log: matches and reviews as append-only Parquet tables, the latest match of a request counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACTIONS = ["accept_candidate", "keep_original", "unresolved"]
REVIEWED = "review_id span_id reviewer_id action concept_id note review_created_at".split()
REVIEW = "review_id string, request_id string, span_id string, reviewer_id string, action string, concept_id string, note string, artifact_version string, created_at timestamp"


def save_matches(responses: DataFrame, path: str) -> None:
    """Append responses (request_id, artifact_version, created_at, ...), the whole response as JSON."""
    payload = F.to_json(F.struct(*responses.columns), {"ignoreNullFields": "false"})
    responses.select("request_id", "artifact_version", "created_at", payload.alias("payload_json")).write.mode("append").parquet(f"{path}/matches")


def latest(matches: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Of each request the row that was put last (by created_at, ties by payload)."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (order or ["created_at", "payload_json"])]
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*[c.desc() for c in columns]))
    return matches.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def get_match(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """At most one row: the stored match of a request."""
    return latest(spark.read.parquet(f"{path}/matches").where(F.col("request_id") == request_id))


def review_problem(spans: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reviews`` with a column problem, null where a review may be stored.

    ``spans`` has request_id, span_id and candidates. The span has to exist; accepting needs a concept, and a
    concept has to be one of the span's candidates.
    """
    known = spans.select("request_id", "span_id", F.transform("candidates", lambda c: c["concept_id"]).alias("_concepts"))
    met = reviews.join(known, ["request_id", "span_id"], "left")
    problem = (
        F.when(~F.coalesce(F.length("reviewer_id").between(1, 100), F.lit(False)), "reviewer_id")
        .when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "action")
        .when(F.length("note") > 2000, "note")
        .when((F.col("action") == "accept_candidate") & F.col("concept_id").isNull(), "concept_id is needed")
        .when(F.col("_concepts").isNull(), "no such span")
        .when(F.col("concept_id").isNotNull() & ~F.array_contains("_concepts", F.col("concept_id")), "concept_id is no candidate")
    )
    return met.withColumn("problem", problem).drop("_concepts")


def save_reviews(reviews: DataFrame, path: str) -> None:
    """Append reviews, each with a new id and the time."""
    stamped = reviews.withColumn("review_id", F.uuid()).withColumn("created_at", F.current_timestamp())
    stamped.select(*[c.split()[0] for c in REVIEW.split(", ")]).write.mode("append").parquet(f"{path}/reviews")


def reviews_of(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/reviews").where(F.col("request_id") == request_id).orderBy("created_at", "review_id")


def export(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """request_id, created_at, review_created_at, line: a JSON line for each match and review of it, in the order of both times.

    A line has the stored response's own fields and ``review``: the review's fields that are not null, or {}.
    """
    of = reviews.select(F.col("request_id").alias("reviewed_request"), *[F.col(c) if c in reviews.columns else F.lit(None).cast("string").alias(c) for c in REVIEWED[:-1]], F.col("created_at").alias("review_created_at"))
    joined = matches.join(of, F.col("request_id") == F.col("reviewed_request"), "left")
    body = F.regexp_replace(F.col("payload_json"), r"\s*\}\s*$", "")
    more = F.when(F.trim(body) == "{", "").otherwise(",")
    line = F.concat(body, more, F.lit('"review":'), F.to_json(F.struct(*REVIEWED)), F.lit("}"))
    return joined.select("request_id", "created_at", "review_created_at", line.alias("line")).orderBy("created_at", F.asc_nulls_first("review_created_at"), "line")


def write_export(matches: DataFrame, reviews: DataFrame, path: str) -> int:
    """The lines of ``export`` as text files, in order; returns how many."""
    lines = export(matches, reviews)
    lines.select("line").write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).count()


def orphans(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of requests that were never stored."""
    return reviews.join(matches.select("request_id").distinct(), "request_id", "left_anti")
