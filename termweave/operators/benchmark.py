"""A synthetic benchmark: terms put into sentences after defined damage, with gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.plans.match import NBEST, TOKENS

_MARK, _GLUE = r"\p{M}\x{200C}\x{200D}", r"\x{200C}\x{200D}"
#: Conditions, each with the template that carries it.
CONDITIONS = ["deletion", "transposition", "asr_boundary", "substitution", "script_confusion", "low_confidence", "negative"]
TEMPLATES = ["Continue {} today.", "Give {} 5 mg daily.", "Start {} tonight.", "The note says {} again.", "Review {} before discharge.", "Continue {} daily.", "The patient walked to the clinic."]
WITH = {"deletion": 0, "transposition": 1, "asr_boundary": 2, "substitution": 3, "script_confusion": 4, "low_confidence": 5, "negative": 6}


def units(col: Column) -> Column:
    """Characters with the marks and joiners that belong to them."""
    return F.regexp_extract_all(col, F.lit(rf"((?s)(?:^[{_MARK}]|[^{_MARK}])(?:[{_MARK}]|(?<=[{_GLUE}]).)*)"), F.lit(1))


def damaged(term: Column, replacement: Column, foreign: Column) -> dict[str, Column]:
    """The five kinds of damage, all around the middle unit that is no space."""
    u = units(term)
    places = F.filter(F.transform(u, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    middle = F.get(places, (F.size(places) / 2).cast("int"))
    before = F.get(places, (F.size(places) / 2).cast("int") - 1)
    join = lambda *parts: F.array_join(F.concat(*parts), "")
    head, tail = F.slice(u, 1, middle), F.slice(u, middle + 2, F.size(u))
    own = F.get(u, middle)
    put = F.when(F.lower(own) == F.lower(replacement), F.concat(replacement, replacement)).otherwise(replacement)
    return {
        "deletion": join(head, tail),
        "transposition": join(F.slice(u, 1, before), F.array(F.get(u, before + 1)), F.array(F.get(u, before)), F.slice(u, before + 3, F.size(u))),
        "asr_boundary": join(head, F.array(F.lit(" ")), F.slice(u, middle + 1, F.size(u))),
        "substitution": join(head, F.array(put), tail),
        "script_confusion": join(head, F.array(foreign), tail),
    }


def benchmark(terms: DataFrame, version: str = "benchmark-v1") -> DataFrame:
    """A record for each term and condition; terms have key, term, language, replacement, foreign (a letter of another script).

    Records have the columns that ``evaluate`` reads. Low-confidence rows carry the term as a token of confidence
    0.35, boundary rows both hypotheses (0.58 the reference, 0.42 what was heard); elsewhere these are empty.
    Damage that leaves the term as it was, or equals another kind's, shows in ``distinct_damage`` = false.
    """
    made = damaged(F.col("term"), F.col("replacement"), F.col("foreign"))
    made |= {"low_confidence": F.col("term"), "negative": F.lit(None).cast("string")}
    kinds = F.array(*[F.struct(F.lit(c).alias("condition"), made[c].alias("observed"), F.lit(TEMPLATES[WITH[c]]).alias("template")) for c in CONDITIONS])
    rows = terms.withColumn("distinct_damage", F.size(F.array_distinct(F.array(F.col("term"), *[made[c] for c in CONDITIONS[:5]]))) == 6)
    rows = rows.select("*", F.explode(kinds).alias("k")).select("*", "k.*").drop("k")
    start = F.instr("template", "{}") - 1
    sentence = F.replace("template", F.lit("{}"), F.coalesce("observed", F.lit("")))
    gold = F.when(F.col("observed").isNotNull(), F.array(F.struct(start.alias("char_start"), (start + F.length("observed")).alias("char_end"), F.col("observed").alias("span_text"), F.col("term").alias("gold_term"), F.concat_ws(":", F.lit("SYNTH"), "language", "key").alias("concept_id"))))
    start, end = start.cast("int"), (start + F.length("observed")).cast("int")
    reference = F.when(F.col("observed").isNotNull(), F.replace("template", F.lit("{}"), F.col("term")))
    none, quiet = F.lit(None).cast("double"), F.lit(0.35)
    token = F.struct(F.col("observed").alias("text"), start.alias("char_start"), end.alias("char_end"), quiet.alias("confidence"), none.alias("start_time"), none.alias("end_time"))
    both = F.array(F.struct(reference.alias("text"), F.lit(0.58).alias("confidence")), F.struct(sentence.alias("text"), F.lit(0.42).alias("confidence")))
    only = lambda condition, value, kind: F.when(F.col("condition") == condition, value.cast(kind)).otherwise(F.array().cast(kind))
    return rows.select(
        F.lit(version).alias("dataset_version"), F.concat_ws("-", "language", "key", "condition").alias("case_id"), sentence.alias("text"), F.col("language").alias("locale"),
        F.array(F.when(F.col("condition") == "negative", "negative").otherwise("positive"), F.concat(F.lit("language:"), "language"), F.col("condition")).alias("tags"), "condition", "distinct_damage",
        F.coalesce(gold, F.array().cast("array<struct<char_start:int,char_end:int,span_text:string,gold_term:string,concept_id:string>>")).alias("gold_spans"),
        only("low_confidence", F.array(token), TOKENS).alias("tokens"), only("asr_boundary", both, NBEST).alias("n_best"), reference.alias("reference_transcript"), F.when(F.col("observed").isNotNull(), sentence).alias("asr_hypothesis"),
    )


def manifest(records: DataFrame) -> DataFrame:
    """Counts by language and condition."""
    return records.groupBy("locale", "condition").agg(F.count(F.lit(1)).alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two generated sets are equal as bags of rows (the staleness check)."""
    return not (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count())
