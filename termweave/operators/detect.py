"""Windows of a transcript, the evidence against each, and the choice of suspicious spans."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from termweave.functions import text
from termweave.plans.stage import join_counted, stage

#: The thresholds and weights of detection.
HINT, SUSPECT, MAX_TOKENS = 0.52, 0.30, 5
WEIGHTS = {"oov": 0.25, "low_confidence": 0.20, "nbest_disagreement": 0.15, "boundary_risk": 0.15, "mixed_script": 0.15, "neighbor_hint": 0.10}


def token_confidences(words: Column, heard: Column) -> Column:
    """A confidence for each word: the mean over heard tokens that overlap it, if all have offsets; else by position. No tokens: none."""
    placed = F.forall(heard, lambda h: h["char_start"].isNotNull() & h["char_end"].isNotNull())

    def over(w: Column) -> Column:
        own = F.transform(F.filter(heard, lambda h: h["confidence"].isNotNull() & (h["char_start"] < w["end"]) & (h["char_end"] > w["start"])), lambda h: h["confidence"])
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)).otherwise(1.0)

    by_place = F.transform(words, lambda w, i: F.coalesce(F.get(heard, i)["confidence"], F.lit(1.0)))
    return F.when(F.coalesce(F.size(heard), F.lit(0)) <= 0, F.array().cast("array<double>")).when(placed, F.transform(words, over)).otherwise(by_place)


def _low_confidence(own: Column) -> Column:
    """1 less the mean of a window's confidences, 0 at least and without any."""
    return F.when(F.size(own) > 0, F.greatest(F.lit(0.0), 1.0 - F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own))).otherwise(0.0)


def windows(requests: DataFrame, most: int = MAX_TOKENS, heard: bool = False, hopeful=None) -> DataFrame:
    """A row for each run of 1 to ``most`` words of a request, with the evidence that the request itself holds; ``heard``: and whether it has other hypotheses.

    Requests: request_id, text, locale, top_k, tokens, n_best. ``hopeful`` (a function of text and locale) says of all
    runs, shorter ones first, which may be near a name; others without evidence by confidence or hypotheses are
    never made. No Python function stands above the rows of windows: while one works, Spark holds its input rows,
    which have their request's words, and beyond memory on disk.
    """
    other = F.coalesce(F.size("n_best"), F.lit(0)) > 0
    more = [other.alias("heard")] if heard else []
    judged = [other.alias("_other"), hopeful(F.col("text"), F.coalesce("locale", F.lit(""))).alias("_near")] if hopeful is not None else []
    read = requests.select("request_id", "text", "locale", "tokens", text.tokens(F.col("text")).alias("words"), *more, *judged)
    read = read.withColumn("confidences", token_confidences(F.col("words"), F.col("tokens")))
    # no filter by size: Spark would test it below the Python functions, which then run twice
    sizes = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.least(F.lit(most), F.size("words")))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("first"), n.alias("width")))))
    if hopeful is not None:
        own = lambda w: F.slice("confidences", w["first"] + 1, w["width"])
        runs = F.filter(runs, lambda w, i: F.col("_other") | F.get("_near", i) | (_low_confidence(own(w)) >= 0.25))
    rows = read.select("*", F.explode(runs).alias("w")).drop("tokens")
    begin, end = F.get("words", F.col("w.first"))["start"], F.get("words", F.col("w.first") + F.col("w.width") - 1)["end"]
    rows = rows.select("request_id", "text", "locale", "w.first", "w.width", begin.alias("char_start"), end.alias("char_end"), F.slice("confidences", F.col("w.first") + 1, F.col("w.width")).alias("confidences"), *["heard"] * heard)
    span = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return rows.withColumn("span_text", span).withColumn("low_confidence", _low_confidence(F.col("confidences"))).drop("text", "confidences")


def described(rows: DataFrame, hopeful=None) -> DataFrame:
    """Adds scripts, spoken (language), mixed_script, exact_key and normalized; each distinct span is worked on once, and a frequent one is no hot key.

    ``hopeful`` (a function of span text and locale) names spans that may be near a name; others without evidence
    by confidence or hypotheses (rows then have ``heard``, whether there are any) are left out, before any work on them.
    It is for windows that were made without such a function.
    """
    rows = rows.withColumn("_l", F.coalesce("locale", F.lit(""))).drop("locale")
    if hopeful is not None:
        rows = rows.where(F.col("heard") | (F.col("low_confidence") >= 0.25) | hopeful(F.col("span_text"), F.col("_l"))).drop("heard")
    rows = stage(rows, "rows")
    spans = rows.groupBy("span_text", "_l").agg(F.count(F.lit(1)).alias("_n"))
    spans = spans.withColumn("scripts", text.scripts(F.col("span_text"))).withColumn("spoken", text.language(F.col("scripts"), F.col("_l")))
    spans = spans.withColumn("exact_key", text.normalize_term(F.col("span_text"))).withColumn("stripped", text.strip_structured(F.col("span_text")))
    spans = spans.withColumn("normalized", F.when(F.col("stripped") != "", F.col("stripped")).otherwise(text.normalize_term(F.col("span_text"), F.col("spoken.language"))))
    spans = stage(spans.withColumn("mixed_script", (F.size("scripts") > 1).cast("double")).drop("stripped"), "spans")
    return join_counted(rows, spans, ["span_text", "_l"], "_n").drop("_l")


def disagreement(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds nbest_disagreement: the share of other hypotheses without the span."""
    other = requests.where(F.size("n_best") > 0).select("request_id", F.explode("n_best").alias("h")).select("request_id", text.normalize_term(F.col("h.text")).alias("h"))
    other = other.groupBy("request_id").agg(F.collect_list("h").alias("others"))
    met = rows.join(other, "request_id", "left")
    hits = F.size(F.filter("others", lambda h: F.contains(h, F.col("exact_key"))))
    return met.withColumn("nbest_disagreement", F.when(F.col("others").isNull(), 0.0).otherwise(1.0 - hits / F.size("others"))).drop("others")


def risk_score() -> Column:
    """The weighted sum of the kinds of evidence."""
    return sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))


def suspicious(rows: DataFrame, threshold: float = SUSPECT) -> DataFrame:
    """Windows whose evidence suffices; rows have exact and neighbor besides."""
    hint = (F.col("neighbor") >= HINT).cast("double")
    out = rows.withColumn("neighbor_hint", hint).withColumn("oov", (~F.col("exact")).cast("double"))
    out = out.withColumn("boundary_risk", F.when(F.col("width") > 1, hint).otherwise(0.0))
    out = out.withColumn("risk", risk_score())
    trigger = (F.col("neighbor_hint") > 0) | (F.col("low_confidence") >= 0.25) | (F.col("nbest_disagreement") >= 0.5) | (F.col("mixed_script") > 0)
    fine = F.col("exact") & (F.col("low_confidence") == 0) & (F.col("mixed_script") == 0)
    return out.where((F.col("risk") >= threshold) & trigger & ~fine)


@F.arrow_udf(ArrayType(IntegerType()))
def _chosen(spans: pa.Array) -> pa.Array:
    """Of each list of (s, e), best first, the places of those that overlap none chosen before."""
    out = []
    for row in spans.to_pylist():
        held: list[tuple[int, int]] = []
        places = []
        for i, span in enumerate(row or []):
            at = bisect.bisect_left(held, (span["e"], -1))  # chosen ones do not overlap, so only the last that begins before the end may
            if not at or held[at - 1][1] <= span["s"]:
                held.insert(at, (span["s"], span["e"]))
                places.append(i)
        out.append(places)
    return pa.array(out, pa.list_(pa.int32()))


def non_overlapping(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Greedily the strongest windows of each request that overlap none chosen before; ``keep`` travels along."""
    order = F.struct(-F.col("neighbor"), -F.bround("risk", 4), -F.col("width"), F.col("width").alias("size"), F.col("first").alias("at"), F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.struct(*keep).alias("row"))
    listed = rows.groupBy("request_id").agg(F.sort_array(F.collect_list(order)).alias("all"))
    listed = listed.withColumn("places", _chosen(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    chosen = F.transform("places", lambda i: F.get(F.col("all"), i)["row"])
    return listed.select("request_id", F.explode(chosen).alias("c")).select("request_id", "c.*")
