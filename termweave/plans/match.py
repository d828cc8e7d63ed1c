"""The match plan: requests to suspicious spans with ranked candidates and a decision."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from termweave.functions import bounds, phonetics, text
from termweave.functions.ids import span_id
from termweave.functions.similarity import ratio_udf, similarity_cap, weighted_ratio_udf
from termweave.operators import detect, retrieve
from termweave.plans.stage import stage
from termweave.sources.terms import Dictionary, pronounce

TOKENS = "array<struct<text:string,char_start:int,char_end:int,confidence:double,start_time:double,end_time:double>>"
NBEST = "array<struct<text:string,confidence:double>>"
REQUEST = f"request_id string, text string, locale string, speaker_id string, top_k int, tokens {TOKENS}, n_best {NBEST}"

#: Thresholds and weights of ranking and decision, limits of a request.
REVIEW, MARGIN, CONTEXT, NEAR, FAR = 0.55, 0.12, 80, 5, 20
SCORE = {"phonetic": 0.40, "orthographic": 0.20, "alias": 0.10, "language_score": 0.10, "asr": 0.10, "prior": 0.10}
HIGH_RISK = ["high", "lasa", "critical"]


def requests_of(rows: DataFrame) -> DataFrame:
    """Rows with some of a request's columns as full requests; missing ones are empty, top_k is 5."""
    default = {"locale": F.lit(None).cast("string"), "speaker_id": F.lit(None).cast("string"), "top_k": F.lit(5), "tokens": F.array().cast(TOKENS), "n_best": F.array().cast(NBEST)}
    columns = [F.coalesce(F.col(c), default[c]).alias(c) if c in rows.columns and c in default else F.col(c) if c in rows.columns else default[c].alias(c) for c in ("request_id", "text", "locale", "speaker_id", "top_k", "tokens", "n_best")]
    return rows.select(*columns)


def valid_request() -> Column:
    """Whether a request keeps to the limits: 1 to 100,000 characters, top_k 1 to 20, confidences 0 to 1, times from 0 on, tokens and hypotheses with a text."""
    unit = lambda x: x["text"].isNotNull() & (x["confidence"].isNull() | x["confidence"].between(0, 1))
    timed = lambda x: unit(x) & (x["start_time"].isNull() | (x["start_time"] >= 0)) & (x["end_time"].isNull() | (x["end_time"] >= 0))
    return F.coalesce(F.length("text").between(1, 100_000) & F.col("top_k").between(1, 20) & F.forall("tokens", timed) & F.forall("n_best", unit), F.lit(False))


def rejected(requests: DataFrame) -> DataFrame:
    """The requests that ``match`` leaves out, as they break a limit."""
    return requests.where(~valid_request())


def neighbor_score(feature: Column, orthographic: Column) -> Column:
    """How near an entry is: 0.65 by sound, 0.35 by spelling; what is missing counts as 0."""
    return 0.65 * F.coalesce(feature, F.lit(0.0)) + 0.35 * F.coalesce(orthographic, F.lit(0.0))


def language_score(entry: Column, languages: Column) -> Column:
    """1 for the first language, 0.7 for another, 0.4 if the first is undetermined."""
    first = F.get(languages, F.lit(0))
    return F.when(entry == first, 1.0).when(F.array_contains(languages, entry), 0.7).otherwise(F.when(first == "und", 0.4).otherwise(0.0))


def final_score(**parts: Column) -> Column:
    """The weighted sum of SCORE's parts, to four decimals."""
    return F.bround(sum((F.lit(w) * parts[c] for c, w in SCORE.items()), F.lit(0.0)), 4)


def decision_reason(top: Column, next_score: Column, pronunciations: Column, scripts: Column, spoken: Column, strengths: Column, review: float = REVIEW, margin: float = MARGIN) -> Column:
    """Why a span is abstained from (one reason) or reviewed (the first reason says so); ``top`` has score and risk_tier."""
    reasons = F.array_compact(F.array(
        F.lit("candidate_above_review_threshold"),
        F.when(top["score"] - F.coalesce(next_score, F.lit(0.0)) < margin, "low_margin"),
        F.when(F.lower(top["risk_tier"]).isin(HIGH_RISK), "high_risk_medication"),
        F.when(F.size(scripts) > 1, "mixed_script"),
        F.when(spoken["confidence"] < 0.5, "language_uncertain"),
        F.when(F.size(strengths) > 0, "dose_adjacent"),
    ))
    return (
        F.when(F.size(pronunciations) == 0, F.array(F.lit("pronunciation_failed")))
        .when((spoken["language"] == "und") | (F.array_join(scripts, "+") == "Zyyy"), F.array(F.lit("language_or_script_unresolved")))
        .when(top.isNull() | (top["score"] < review), F.array(F.lit("below_review_threshold")))
        .otherwise(reasons)
    )


def decision(reasons: Column) -> Column:
    return F.when(F.get(reasons, F.lit(0)) == "candidate_above_review_threshold", "review").otherwise("abstain")


def context(text_: Column, start: Column, end: Column) -> Column:
    """A span with CONTEXT characters on either side."""
    begin = F.greatest(F.lit(0), start - CONTEXT)
    return F.substring(text_, begin + 1, F.least(F.length(text_), end + CONTEXT) - begin)


def audio_range(tokens: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The first start and the last end of the tokens that overlap a span; null without any."""
    heard = F.filter(tokens, lambda t: (t["char_start"] < end) & (t["char_end"] > start))
    return F.array_min(F.transform(heard, lambda t: t["start_time"])), F.array_max(F.transform(heard, lambda t: t["end_time"]))


def neighbor_scores(keys: DataFrame, dictionary: Dictionary) -> DataFrame:
    """normalized, language, neighbor: how near the nearest retrieved entry is, 0.65 by sound and 0.35 by spelling."""
    spoken = pronounce(keys, dictionary.curated(), dictionary.lexicon).withColumn("sounds", F.transform("pronunciations", lambda p: p["value"]))
    spoken = stage(spoken, "said")
    found = spoken.select("normalized", "language", "sounds").join(retrieve.retrieve(spoken, dictionary, NEAR), "normalized")
    pairs = found.select("normalized", "language", "entry_id", F.explode("sounds").alias("sound")).join(dictionary.forms(), "entry_id")
    sound = retrieve.best_sound(pairs, ["normalized", "language", "entry_id"])
    near = found.join(sound, ["normalized", "language", "entry_id"], "left")
    return near.groupBy("normalized", "language").agg(F.max(neighbor_score(F.col("feature"), F.col("orthographic"))).alias("neighbor"))


def worth_scoring(keys: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Keys that can reach the hint: some entry is near enough by its sound and the most similar of all its names.

    Lossless (what is retrieved is never more similar than that), and most keys leave by the native tests:
    spelling gives at most 0.35, so the sound has to give the rest; and letters bound the likeness of spellings.
    """
    least = (detect.HINT - 0.35) / 0.65 - 1e-9
    forms, small = dictionary.forms(), retrieve.small(dictionary.forms())
    spoken = pronounce(keys, dictionary.curated(), dictionary.lexicon).select("normalized", "language", F.explode("pronunciations").alias("p")).select("normalized", "language", F.col("p.value").alias("sound"))
    # the edit distance is at least the difference of lengths
    a, b = F.length("sound"), F.length("form")
    near = spoken.join(F.broadcast(forms) if small else forms, F.least(a, b) >= least * F.greatest(a, b))
    near = near.withColumn("feature", phonetics.feature_similarity(F.col("sound"), F.col("form"))).where(F.col("feature") >= least)
    near = near.groupBy("normalized", "language", "entry_id").agg(F.max("feature").alias("feature"))
    names = dictionary.aliases().select("entry_id", "alias")
    pairs = near.join(F.broadcast(names) if retrieve.small(names) else names, "entry_id")
    pairs = pairs.where(0.65 * F.col("feature") + 0.35 * similarity_cap(F.col("normalized"), F.col("alias")) >= detect.HINT - 1e-9)
    pairs = pairs.withColumn("similarity", weighted_ratio_udf("normalized", "alias") / 100)
    return pairs.where(0.65 * F.col("feature") + 0.35 * F.col("similarity") >= detect.HINT - 1e-9).select("normalized", "language").distinct()


#: Entries of a dictionary whose names' letters are compared with all windows; with more entries no window leaves by them.
COMPARED = 1000


def _near_some_name(dictionary: Dictionary):
    """A function of spans and whether their languages are case-folded: which may be near some name, or have characters or a language of which nothing is known.

    Lossless; None (every span may be) for a large dictionary, and for one with a pronouncing lexicon.
    """
    if dictionary.lexicon is not None or len(rows := dictionary.entries.select("pronunciation_forms", "normalized_aliases").limit(COMPARED + 1).collect()) > COMPARED:
        return None
    judge = bounds.hopeful([(list(r[0] or []), list(r[1] or [])) for r in rows], detect.HINT)

    def near(spans: list[str], folded: list[bool]) -> np.ndarray:
        out = np.ones(len(spans), bool)
        plain = [i for i, (x, own) in enumerate(zip(spans, folded, strict=True)) if own and bounds.PLAIN.fullmatch(x)]
        if plain:
            out[plain] = judge([spans[i] for i in plain])
        return out

    return near


def _folded(locales: pa.Array) -> list[bool]:
    own = {x: re.match("[^-_]*", x).group().lower() in text.CASEFOLDED for x in locales.unique().to_pylist()}
    return [own[x] for x in locales.to_pylist()]


def hopeful_spans(dictionary: Dictionary):
    """``_near_some_name`` as a function of the columns span text and locale."""
    if (near := _near_some_name(dictionary)) is None:
        return None

    @F.arrow_udf(BooleanType())
    def hopeful(spans: pa.Array, locales: pa.Array) -> pa.Array:
        return pa.array(near(spans.to_pylist(), _folded(locales)))

    return hopeful


#: Spans judged at once, about; a request's own are not parted.
AT_ONCE = 20_000


def hopeful_runs(dictionary: Dictionary, most: int):
    """``_near_some_name`` as a function of the columns text and locale, for all runs of 1 to ``most`` words, shorter ones first."""
    if (near := _near_some_name(dictionary)) is None:
        return None

    @F.arrow_udf(ArrayType(BooleanType()))
    def hopeful(texts: pa.Array, locales: pa.Array) -> pa.Array:
        flags, ends, spans, own = [], [0], [], []
        for x, folded in zip(texts.to_pylist(), _folded(locales), strict=True):
            words = [m.span() for m in text.WORD.finditer(x or "")]
            before = len(spans)
            for width in range(1, min(most, len(words)) + 1):
                spans += [x[a[0] : b[1]] for a, b in zip(words, words[width - 1 :], strict=False)]
            own += [folded] * (len(spans) - before)
            ends.append(ends[-1] + len(spans) - before)
            if len(spans) >= AT_ONCE:
                flags.append(near(spans, own))
                spans, own = [], []
        flags.append(near(spans, own))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flags)))

    return hopeful


def detected_spans(requests: DataFrame, dictionary: Dictionary, threshold: float = detect.SUSPECT, max_tokens: int = detect.MAX_TOKENS) -> DataFrame:
    """The suspicious, non-overlapping spans of each request with their evidence."""
    rows = detect.disagreement(detect.described(detect.windows(requests, max_tokens, hopeful=hopeful_runs(dictionary, max_tokens))), requests)
    names = dictionary.aliases().select(F.col("alias").alias("exact_key")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(F.broadcast(names) if retrieve.small(names) else names, "exact_key", "left").withColumn("exact", F.coalesce("known", F.lit(False))).drop("known")
    rows = stage(rows.withColumn("language", F.col("spoken.language")), "windows")
    evidence = (F.col("low_confidence") >= 0.25) | (F.col("nbest_disagreement") >= 0.5) | (F.col("mixed_script") > 0)
    needed = rows.where(evidence).select("normalized", "language").distinct()
    keys = rows.where(~evidence & ~(F.col("exact") & (F.col("low_confidence") == 0))).select("normalized", "language").distinct()
    keys = worth_scoring(keys, dictionary).union(needed).distinct()
    near = neighbor_scores(stage(keys, "keys"), dictionary)
    scored = rows.join(near, ["normalized", "language"], "left").withColumn("neighbor", F.coalesce("neighbor", F.lit(0.0)))
    found = detect.suspicious(scored, threshold)
    keep = "char_start char_end span_text scripts spoken normalized low_confidence nbest_disagreement boundary_risk mixed_script neighbor_hint oov risk neighbor".split()
    return detect.non_overlapping(found, keep)


def ranked_candidates(spans: DataFrame, dictionary: Dictionary) -> DataFrame:
    """A row for each candidate of each span, scored; spans have span_id, normalized, pronunciations, languages, asr."""
    keys = spans.select("normalized", "sounds").groupBy("normalized", "sounds").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    # the same text may be pronounced in two ways by language; retrieval is by both
    keyed = keys.withColumn("text_key", F.concat_ws("\u0001", "normalized", F.concat_ws("\u0002", "sounds")))
    keyed = stage(keyed, "sounds")
    found = stage(_retrieve_by_sound(keyed, dictionary), "candidates")
    entries = dictionary.entries.select("entry_id", "concept_id", "term", F.col("language").alias("entry_language"), "risk_tier", "prior", "provenance", "normalized_term", "normalized_aliases")
    rows = spans.withColumn("text_key", F.concat_ws("\u0001", "normalized", F.concat_ws("\u0002", "sounds"))).join(found, "text_key").join(entries, "entry_id")
    pairs = found.join(keyed.select("text_key", "sounds"), "text_key").select("text_key", "entry_id", F.explode("sounds").alias("sound")).join(dictionary.forms(), "entry_id")
    rows = rows.join(retrieve.best_sound(pairs, ["text_key", "entry_id"]), ["text_key", "entry_id"], "left")
    whole = found.join(keyed.select("text_key", "normalized"), "text_key").join(dictionary.aliases(), "entry_id").groupBy("text_key", "entry_id").agg(F.max(ratio_udf("normalized", "alias") / 100).alias("whole"))
    rows = rows.join(whole, ["text_key", "entry_id"])
    rows = rows.select(
        "*",
        F.greatest(F.coalesce("orthographic", F.lit(0.0)), "whole").alias("ortho"),
        (0.70 * F.coalesce("feature", F.lit(0.0)) + 0.30 * F.coalesce("trigram", F.lit(0.0))).alias("phonetic"),
        F.array_contains("normalized_aliases", F.col("normalized")).cast("double").alias("alias_hit"),
        language_score(F.col("entry_language"), F.col("languages")).alias("language_score"),
    )
    score = final_score(phonetic=F.col("phonetic"), orthographic=F.col("ortho"), alias=F.col("alias_hit"), language_score=F.col("language_score"), asr=F.col("asr"), prior=F.col("prior"))
    return rows.withColumn("score", score)


def _retrieve_by_sound(keyed: DataFrame, dictionary: Dictionary) -> DataFrame:
    names = retrieve.retrieve(keyed.select("normalized", F.array().cast("array<string>").alias("sounds")), dictionary, FAR)
    spelled = keyed.select("text_key", "normalized").join(names, "normalized").select("text_key", "entry_id", "orthographic", "matched_alias")
    sounding = retrieve.retrieve(keyed.select(F.col("text_key").alias("normalized"), "sounds"), _sounds_only(dictionary), FAR).select(F.col("normalized").alias("text_key"), "entry_id", "orthographic", "matched_alias")
    return spelled.unionByName(sounding).groupBy("text_key", "entry_id").agg(F.max("orthographic").alias("orthographic"), F.max("matched_alias").alias("matched_alias"))


def _sounds_only(dictionary: Dictionary) -> Dictionary:
    return Dictionary(dictionary.entries.withColumn("normalized_aliases", F.array().cast("array<string>")), dictionary.version)


def match(requests: DataFrame, dictionary: Dictionary, review: float = REVIEW, margin: float = MARGIN, threshold: float = detect.SUSPECT, max_tokens: int = detect.MAX_TOKENS) -> DataFrame:
    """One row a suspicious span: offsets, context, language, evidence, ranked candidates, decision and reasons.

    A decision is abstain or review; nothing is ever committed. Requests that break a limit (``rejected``) take no part.
    """
    requests = requests.where(valid_request())
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    requests = stage(requests.repartition(parts, "request_id"), "requests")  # a few large files are no bound on parallelism
    spans = stage(detected_spans(requests, dictionary, threshold, max_tokens), "spans")
    spans = spans.withColumn("span_id", span_id(F.col("request_id"), F.col("char_start"), F.col("char_end")))
    second = F.when(F.col("spoken.confidence") < 0.5, F.slice("spoken.alternatives", 1, 1)).otherwise(F.array().cast("array<string>"))
    spans = spans.withColumn("languages", F.concat(F.array("spoken.language"), second)).withColumn("asr", 1.0 - F.bround("low_confidence", 4))
    said = pronounce(spans.select("normalized", F.explode("languages").alias("language")).distinct(), dictionary.curated(), dictionary.lexicon)
    spelled = spans.select("span_id", "normalized", F.posexplode("languages").alias("at", "language")).join(said, ["normalized", "language"])
    spelled = spelled.groupBy("span_id").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "pronunciations"))), lambda x: x["pronunciations"]))).alias("pronunciations"))
    spans = spans.join(spelled, "span_id").withColumn("sounds", F.transform("pronunciations", lambda p: p["value"]))
    spans = stage(spans.join(requests.select("request_id", "text", "top_k", "tokens"), "request_id"), "spoken")
    ranked = ranked_candidates(spans.select("span_id", "normalized", "sounds", "languages", "asr", "top_k"), dictionary)
    order = Window.partitionBy("span_id").orderBy(F.desc("score"), F.desc(F.coalesce("orthographic", F.lit(0.0))), "entry_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))
    breakdown = F.struct(
        F.bround("phonetic", 4).alias("phonetic"), F.bround("ortho", 4).alias("orthographic"), F.col("alias_hit").alias("alias"), F.col("language_score").alias("language"),
        F.bround("asr", 4).alias("asr"), "prior", F.bround(F.coalesce("feature", F.lit(0.0)), 4).alias("phonetic_feature"), F.bround(F.coalesce("trigram", F.lit(0.0)), 4).alias("ipa_ngram"),
    )
    candidate = F.struct("rank", "concept_id", "term", F.coalesce("matched_alias", "normalized_term").alias("matched_alias"), F.col("entry_language").alias("language"), "risk_tier", "score", breakdown.alias("score_breakdown"), "provenance")
    listed = ranked.groupBy("span_id").agg(F.sort_array(F.collect_list(candidate)).alias("candidates"))
    rows = stage(spans.join(listed, "span_id", "left"), "ranked")
    rows = rows.withColumn("structured", text.medication_fields(F.col("span_text")))
    top, next_ = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    why = decision_reason(top, next_["score"], F.col("pronunciations"), F.col("scripts"), F.col("spoken"), F.col("structured.strengths"), review, margin)
    audio_start, audio_end = audio_range(F.col("tokens"), F.col("char_start"), F.col("char_end"))
    evidence = F.struct("oov", F.bround("low_confidence", 4).alias("low_confidence"), F.bround("nbest_disagreement", 4).alias("nbest_disagreement"), "boundary_risk", "mixed_script", "neighbor_hint", F.bround("risk", 4).alias("risk_score"))
    none = F.array().cast("array<string>")
    return rows.withColumn("decision_reason", why).select(
        "request_id", "span_id", "span_text", "char_start", "char_end",
        context(F.col("text"), F.col("char_start"), F.col("char_end")).alias("context"),
        F.col("spoken.language").alias("language"), F.bround("spoken.confidence", 4).alias("language_confidence"), F.coalesce("spoken.alternatives", none).alias("language_alternatives"),
        F.array_join("scripts", "+").alias("script"), F.col("normalized").alias("normalized_span"), "structured", "pronunciations", evidence.alias("evidence"), "candidates",
        decision(F.col("decision_reason")).alias("decision"), "decision_reason",
        F.lit(dictionary.version).alias("artifact_version"), audio_start.alias("audio_start"), audio_end.alias("audio_end"),
    )


def responses(requests: DataFrame, spans: DataFrame, version: str) -> DataFrame:
    """One row a request: its normalised text and its spans in order; a request without spans has an empty list."""
    listed = spans.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("char_start", F.struct(*[c for c in spans.columns if c != "request_id"]).alias("span")))).alias("s"))
    out = requests.join(listed, "request_id", "left")
    return out.select("request_id", text.normalize_text(F.col("text")).alias("normalized_text"), F.lit(version).alias("artifact_version"), F.lit(False).alias("auto_commit_enabled"), F.transform(F.coalesce("s", F.array()), lambda x: x["span"]).alias("spans"), F.current_timestamp().alias("created_at"))
