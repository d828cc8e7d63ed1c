"""Evaluation of detection and ranking against gold spans."""

from __future__ import annotations

import bisect
import collections

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from termweave.functions import text
from termweave.plans.match import match, requests_of
from termweave.plans.stage import stage
from termweave.sources.terms import Dictionary


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(0.0)


def pair_spans(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, p, g, exact: spans of a case matched one to one, equal bounds first, then as many overlaps as possible.

    The spans of a case meet as two arrays. After the equal ones, the pairs of the largest share of both spans are taken
    first; then each gold span left over looks, breadth first, for a chain of exchanges that frees a prediction.
    """
    listed = lambda df, place: df.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "char_end", F.col(place).alias("at")))).alias(place))
    met = listed(predicted, "p").join(listed(gold, "g"), "case_id")
    return met.select("case_id", F.explode(_paired("p", "g")).alias("x")).select("case_id", "x.*")


@F.arrow_udf(ArrayType(StructType([StructField("p", IntegerType()), StructField("g", IntegerType()), StructField("exact", BooleanType())])))
def _paired(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    out = []
    for spans, marks in zip(predicted.to_pylist(), gold.to_pylist(), strict=True):
        spans, marks = ([(x["char_start"], x["char_end"], x["at"]) for x in side] for side in (spans, marks))
        waiting: dict[tuple[int, int], list[int]] = {}
        for a, b, p in reversed(spans):
            waiting.setdefault((a, b), []).append(p)
        pairs, rest, used = [], [], set()
        for a, b, g in marks:
            if waiting.get((a, b)):
                used.add(p := waiting[a, b].pop())
                pairs.append({"p": p, "g": g, "exact": True})
            else:
                rest.append((a, b, g))
        found = _most_overlaps([s for s in spans if s[2] not in used], rest)
        out.append(pairs + [{"p": p, "g": g, "exact": False} for g, p in found.items()])
    return pa.array(out, pa.list_(pa.struct([("p", pa.int32()), ("g", pa.int32()), ("exact", pa.bool_())])))


def _most_overlaps(spans: list[tuple[int, int, int]], marks: list[tuple[int, int, int]]) -> dict[int, int]:
    """Gold place -> prediction place, for as many as can overlap one to one; both lists ascend by start."""
    touching: dict[int, list[int]] = {}
    edges = []
    longest = max((b - a for a, b, _ in spans), default=0)
    for a, b, g in marks:
        at = bisect.bisect_left(spans, (a - longest, -1, -1))
        while at < len(spans) and spans[at][0] < b:
            c, d, p = spans[at]
            if d > a:
                touching.setdefault(g, []).append(p)
                edges.append((-(min(b, d) - max(a, c)) / (max(b, d) - min(a, c)), g, p))
            at += 1
    of_gold: dict[int, int] = {}
    of_span: dict[int, int] = {}
    for _, g, p in sorted(edges):
        if g not in of_gold and p not in of_span:
            of_gold[g], of_span[p] = p, g
    for g in (g for *_, g in marks if g in touching and g not in of_gold):
        came: dict[int, int] = {}  # prediction -> the gold span that reached it
        queue, free = collections.deque([g]), None
        while queue and free is None:
            x = queue.popleft()
            for p in touching[x]:
                if p not in came:
                    came[p] = x
                    if p not in of_span:
                        free = p
                        break
                    queue.append(of_span[p])
        while free is not None:  # each gold span of the chain takes the prediction that it reached
            x = came[free]
            before = of_gold.get(x)
            of_gold[x], of_span[free] = free, x
            free = before if x != g else None
    return of_gold


def outcomes(records: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold rows with what was found for each, predicted rows with whether each was right)."""
    predicted = spans.select(F.col("request_id").alias("case_id"), F.struct("char_start", "char_end", "candidates", "decision").alias("s"))
    predicted = predicted.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("s.char_start", "s.char_end", "s.decision", F.transform("s.candidates", lambda c: F.struct(c["concept_id"].alias("concept_id"), c["term"].alias("term"))).alias("c")))).alias("all"))
    predicted = predicted.select("case_id", F.posexplode("all").alias("p", "x")).select("case_id", "p", "x.*")
    gold = records.select("case_id", F.posexplode("gold_spans").alias("g", "x")).select("case_id", "g", "x.char_start", "x.char_end", "x.gold_term", "x.concept_id")
    pairs = stage(pair_spans(predicted, gold), "pairs")
    met = gold.join(pairs, ["case_id", "g"], "left").join(predicted.select("case_id", "p", "decision", "c"), ["case_id", "p"], "left")
    terms = F.transform("c", lambda c: F.lower(c["term"]))
    rank_term = F.array_position(terms, text.normalize_term(F.coalesce("gold_term", F.lit(""))))
    rank_concept = F.array_position(F.transform("c", lambda c: c["concept_id"]), F.coalesce("concept_id", F.lit("")))
    met = met.withColumn("rank_term", F.coalesce(rank_term, F.lit(0))).withColumn("rank_concept", F.coalesce(rank_concept, F.lit(0)))
    judged = predicted.join(pairs.select("case_id", "p", F.lit(True).alias("hit"), "exact"), ["case_id", "p"], "left")
    return met, judged


def metrics(records: DataFrame, gold: DataFrame, predicted: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Counts and rates, one row in all, or one a tag with ``by`` (case_id, tag)."""
    tagged = (lambda d: d.join(by, "case_id")) if by is not None else (lambda d: d.withColumn("tag", F.lit("all")))
    counts = tagged(gold).groupBy("tag").agg(
        F.count(F.lit(1)).alias("gold"),
        F.count(F.when(F.col("exact"), 1)).alias("exact_true_positives"),
        F.count("p").alias("overlap_true_positives"),
        F.count(F.when(F.col("rank_term") == 1, 1)).alias("term_hits_1"),
        F.count(F.when(F.col("rank_term").between(1, 5), 1)).alias("term_hits_5"),
        F.count(F.when(F.col("rank_concept") == 1, 1)).alias("concept_hits_1"),
        F.count(F.when(F.col("rank_concept").between(1, 5), 1)).alias("concept_hits_5"),
        F.sum(F.when(F.col("rank_term") > 0, 1.0 / F.col("rank_term")).otherwise(0.0)).alias("reciprocal_ranks"),
    )
    made = tagged(predicted).groupBy("tag").agg(F.count(F.lit(1)).alias("predicted"), F.count(F.when(F.col("decision") == "review", 1)).alias("reviews"), F.count(F.when(F.col("decision") == "abstain", 1)).alias("abstentions"), F.count(F.when(F.col("decision") == "commit", 1)).alias("commits"), F.count(F.when(F.col("hit").isNull(), 1)).alias("false_positives"))
    cases = tagged(records.select("case_id", F.size("gold_spans").alias("n")).join(predicted.groupBy("case_id").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("hit").isNull(), 1)).alias("f")), "case_id", "left")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("n") == 0, 1)).alias("negative_records"), F.count(F.when((F.col("n") == 0) & (F.col("m") > 0), 1)).alias("negative_records_with_predictions"), F.count(F.when(F.col("f") > 0, 1)).alias("records_with_false_positives")
    )
    out = cases.join(counts, "tag", "left").join(made, "tag", "left").na.fill(0)
    return out.select(
        "*",
        ratio(F.col("overlap_true_positives"), F.col("predicted")).alias("overlap_precision"),
        ratio(F.col("overlap_true_positives"), F.col("gold")).alias("overlap_recall"),
        ratio(2 * F.col("overlap_true_positives"), F.col("predicted") + F.col("gold")).alias("overlap_f1"),
        ratio(F.col("exact_true_positives"), F.col("predicted")).alias("exact_precision"),
        ratio(F.col("exact_true_positives"), F.col("gold")).alias("exact_recall"),
        ratio(2 * F.col("exact_true_positives"), F.col("predicted") + F.col("gold")).alias("exact_f1"),
        ratio(F.col("term_hits_1"), F.col("gold")).alias("recall_at_1"),
        ratio(F.col("term_hits_5"), F.col("gold")).alias("recall_at_5"),
        ratio(F.col("concept_hits_1"), F.col("gold")).alias("accuracy_at_1"),
        ratio(F.col("reciprocal_ranks"), F.col("gold")).alias("mrr"),
        ratio(F.col("reviews"), F.col("predicted")).alias("review_rate"),
    )


def word_errors(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """(edits, reference words): each distinct word of a pair becomes one code point from U+E000 on, then the edit distance counts words.

    A pair of more distinct words than there are such code points (1,056,768) is an error.
    """
    split = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    a, b = split(reference), split(hypothesis)
    both = F.array_distinct(F.concat(a, b))
    letter = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.lit(0xDFFF) + p), 8, "0")), "UTF-32")
    # the array of one binds the distinct words, which else are found anew for every word
    coded = lambda words: F.get(F.transform(F.array(both), lambda known: F.array_join(F.transform(words, lambda w: letter(F.array_position(known, w))), "")), F.lit(0))
    edits = F.when(F.size(both) > 0x110000 - 0xE000, F.raise_error(F.lit("too many distinct words in a pair"))).otherwise(F.levenshtein(coded(a), coded(b)))
    return edits.cast("int"), F.size(a)


def transcript_errors(records: DataFrame) -> DataFrame:
    """wer and cer over all records that have both transcripts: edits over reference units."""
    both = records.where("reference_transcript IS NOT NULL AND asr_hypothesis IS NOT NULL")
    edits, words = word_errors(F.col("reference_transcript"), F.col("asr_hypothesis"))
    sums = both.agg(F.sum(edits).alias("we"), F.sum(words).alias("wn"), F.sum(F.levenshtein("reference_transcript", "asr_hypothesis")).alias("ce"), F.sum(F.length("reference_transcript")).alias("cn"))
    return sums.select(ratio(F.col("we"), F.col("wn")).alias("wer"), ratio(F.col("ce"), F.col("cn")).alias("cer"))


def evaluate(records: DataFrame, dictionary: Dictionary) -> dict[str, DataFrame]:
    """overall, slices (by tag), errors (missed gold and wrong predictions by case), transcripts, versions."""
    records = stage(records, "records")
    spans = stage(match(requests_of(records.select(F.col("case_id").alias("request_id"), "text", "locale", "tokens", "n_best")), dictionary), "predictions")
    gold, predicted = outcomes(records, spans)
    gold, predicted = stage(gold, "gold"), stage(predicted, "predicted")
    tags = records.select("case_id", F.explode(F.array_distinct("tags")).alias("tag"))
    missed = gold.where("p IS NULL").groupBy("case_id").agg(F.collect_list(F.struct("char_start", "char_end", "gold_term")).alias("false_negatives"))
    wrong = predicted.where("hit IS NULL").groupBy("case_id").agg(F.collect_list(F.struct("char_start", "char_end")).alias("false_positives"))
    shifted = gold.where("p IS NOT NULL AND NOT exact").groupBy("case_id").agg(F.collect_list(F.struct("char_start", "char_end", "gold_term")).alias("boundary_mismatches"))
    return {
        "overall": metrics(records, gold, predicted),
        "slices": metrics(records, gold, predicted, tags).orderBy("tag"),
        "errors": missed.join(wrong, "case_id", "full").join(shifted, "case_id", "full"),
        "transcripts": transcript_errors(records),
        "versions": records.agg(F.sort_array(F.collect_set("dataset_version")).alias("dataset_versions")),
    }
