"""Evaluation records: JSON lines with a fixed schema, checked before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.plans.match import NBEST, TOKENS
from termweave.plans.stage import numbered

GOLD = "array<struct<char_start:int,char_end:int,span_text:string,gold_term:string,concept_id:string,language:string,script:string,code_switch:boolean,dose_adjacent:boolean,risk_tier:string,error_type:string,term_category:string>>"
RECORD = f"dataset_version string, case_id string, text string, locale string, tags array<string>, split string, source_kind string, provenance string, audio_file string, tokens {TOKENS}, n_best {NBEST}, reference_transcript string, asr_hypothesis string, gold_spans {GOLD}"
FIELDS = [c.split(" ", 1)[0] for c in RECORD.split(", ")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file of JSON lines; blank lines are skipped. A row has ``problem`` (with its line) or is sound."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    return check_records(numbered(lines, "id", "line").select("line", "value"))


def check_records(lines: DataFrame) -> DataFrame:
    """Records from (line, value), numbered by position among the lines that are not blank, with defaults and ``problem``."""
    rows = numbered(lines.where(F.trim("value") != ""), "line", "position")
    parsed = rows.select("line", "position", F.from_json("value", RECORD).alias("r"), F.json_object_keys("value").alias("keys"))
    default = {
        "dataset_version": F.lit("unversioned"), "tags": F.array().cast("array<string>"), "split": F.lit("test"), "source_kind": F.lit("synthetic"),
        "tokens": F.array().cast(TOKENS), "n_best": F.array().cast(NBEST), "gold_spans": F.array().cast(GOLD),
    }
    named = F.when(F.coalesce(F.col("r.case_id"), F.lit("")) == "", F.format_string("record-%05d", "position")).otherwise(F.col("r.case_id"))
    full = parsed.select("line", "position", "keys", *[named.alias(c) if c == "case_id" else F.coalesce(F.col(f"r.{c}"), default[c]).alias(c) if c in default else F.col(f"r.{c}").alias(c) for c in FIELDS])
    again = F.row_number().over(Window.partitionBy("case_id").orderBy("position")) > 1
    bad_gold = F.exists("gold_spans", lambda g: g["char_start"].isNull() | g["char_end"].isNull() | (g["char_start"] < 0) | (g["char_end"] <= g["char_start"]) | (g["char_end"] > F.length("text")))
    bad_text = F.exists("gold_spans", lambda g: g["span_text"].isNotNull() & (F.substring("text", g["char_start"] + 1, g["char_end"] - g["char_start"]) != g["span_text"]))
    at = lambda what: F.format_string(f"line %d: {what}", "line")
    problem = (
        F.when(F.col("keys").isNull(), at("no JSON object"))
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0, at("unknown field"))
        .when(F.coalesce(F.length("text"), F.lit(0)) < 1, at("no text"))
        .when(bad_gold, at("offsets of a gold span"))
        .when(bad_text, at("text of a gold span"))
        .when(again, at("case_id again"))
    )
    return full.withColumn("problem", problem).drop("keys")


def sound(records: DataFrame) -> DataFrame:
    """The records, if all are sound; else an error that names the first problem."""
    first = records.where("problem IS NOT NULL").orderBy("line").select("problem").first()
    if first:
        raise ValueError(f"invalid evaluation record: {first['problem']}")
    return records.drop("problem")
