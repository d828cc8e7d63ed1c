"""Queries of the review engine and the DuckDB SQL whose rows they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.functions import ids, phonetics, text
from termweave.operators import benchmark, detect, retrieve, review
from termweave.plans import evaluate, match
from termweave.sources import audit, evaluation, terms

TOK = text.TOKEN.replace("'", "''")


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").withColumn("t", text.normalize_text(F.col("text")))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").withColumn("w", text.tokens(F.col("text")))
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x[field])
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), total("start").alias("starts"), total("end").alias("ends"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "text")
    rows = detect.windows(match.requests_of(turns))
    return rows.groupBy(F.col("width").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("char_start").cast("long")).alias("starts"), F.sum(F.length("span_text").cast("long")).alias("chars"))


def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(text.scripts(F.col("text")), "+").alias("script"))


def _orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return parts.select("p_partkey", F.concat(F.lit("Take "), "p_size", F.lit(" MG of "), "p_name", F.lit(" PO tablet or "), "p_size", F.lit(".5ml iv, then "), "p_size", F.lit(" mg.")).alias("text"))


def medication_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_text(spark, sf_dir).withColumn("m", text.medication_fields(F.col("text")))
    return rows.select("p_partkey", F.array_join("m.strengths", "|").alias("strengths"), F.array_join("m.routes", "|").alias("routes"), F.array_join("m.dosage_forms", "|").alias("forms"), text.strip_structured(F.col("text")).alias("stripped"))


def spelled_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", phonetics.spelled(text.normalize_term(F.col("p_name"))).alias("sound"))


def name_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.lower("p_name"), F.lower("p_type")
    x, y = phonetics.ngrams(a), phonetics.ngrams(b)
    parts = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return parts.select("p_partkey", F.size(F.array_intersect(x, y)).cast("long").alias("shared"), F.size(F.array_union(x, y)).cast("long").alias("all_grams"), F.levenshtein(a, b).cast("long").alias("edits"), phonetics.edit_similarity(a, b).alias("similarity"))


def _part_dictionary(spark: SparkSession, sf_dir: str) -> terms.Dictionary:
    """The part names as a dictionary, in the order of the names."""
    names = _table(spark, sf_dir, "part", "p_name").distinct()
    none = F.array().cast("array<string>")
    rows = names.select(F.concat(F.lit("P:"), "p_name").alias("concept_id"), F.col("p_name").alias("term"), none.alias("aliases"), F.lit("en").alias("language"), F.lit("standard").alias("risk_tier"), F.lit(0.5).alias("prior"), F.lit("local").alias("provenance"), none.alias("pronunciations"), F.col("p_name").alias("line"))
    return terms.build_dictionary(rows, "parts")


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 1, F.lit("x")).otherwise(F.lit("")))
    keys = _table(spark, sf_dir, "part", "p_partkey", "p_name").select(text.normalize_term(asked).alias("normalized"))
    dictionary = _part_dictionary(spark, sf_dir)
    return retrieve.exact_entries(keys, dictionary).join(dictionary.entries, "entry_id").select("normalized", "term", "entry_id")


def gram_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "part", "p_type").distinct().select(F.col("p_type").alias("normalized"), F.array(phonetics.spelled(text.normalize_term(F.col("p_type")))).alias("sounds"))
    return retrieve.sounding_entries(keys, _part_dictionary(spark, sf_dir), 5).select("normalized", "entry_id", "hits", F.col("rank").cast("long").alias("rank"))


def best_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "part", "p_name", "p_type").select("p_name", F.lower("p_name").alias("sound"), F.lower("p_type").alias("form"))
    best = retrieve.best_sound(pairs, ["p_name"])
    return best.select("p_name", F.round((0.7 * F.col("feature") + 0.3 * F.col("trigram")) * 1000000).cast("long").alias("best"))


def channel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    key = [F.col("user_id").cast("string").alias("normalized"), (F.col("event_id") % 9).alias("entry_id")]
    none = [F.lit(None).cast("double").alias("orthographic"), F.lit(None).cast("string").alias("matched_alias")]
    scored = e.where("event_type = 'click'").groupBy(*key).agg(((F.max("event_id") % 100) / 100).alias("orthographic"), F.max(F.col("event_id").cast("string")).alias("matched_alias"))
    return retrieve.merged([scored, e.where("event_type <> 'click'").select(*key, *none).distinct(), e.select(*key, *none).distinct()])


def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("w", text.tokens(F.col("text")))
    heard = F.filter(F.transform("w", lambda w, i: F.when(i % 2 == 0, F.struct(w["text"].alias("text"), w["start"].alias("char_start"), w["end"].alias("char_end"), (w["start"] % 10 / 10.0).cast("double").alias("confidence")))), lambda h: h.isNotNull())
    rows = turns.withColumn("heard", heard)
    values = F.transform(detect.token_confidences(F.col("w"), F.col("heard")), lambda c: F.round(c * 1000).cast("long"))
    return rows.select("conv_id", "turn", F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x).alias("confidence"))


def nbest_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    next_ = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    other = F.array_compact(F.array(F.when(next_.isNotNull(), F.struct(next_.alias("text"), F.lit(0.4).alias("confidence"))))).cast(match.NBEST)
    requests = match.requests_of(turns.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "text", other.alias("n_best")))
    rows = detect.windows(requests, 1).withColumn("exact_key", text.normalize_term(F.col("span_text")))
    return detect.disagreement(rows, requests).groupBy("request_id").agg(F.count(F.lit(1)).alias("words"), F.sum("nbest_disagreement").cast("long").alias("missing"))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests whose every other word was heard as a token, with a confidence and times made of its offsets."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "text").withColumn("w", text.tokens(F.col("text")))
    token = lambda w: F.struct(w["text"].alias("text"), w["start"].alias("char_start"), w["end"].alias("char_end"), (w["start"] % 10 / 10.0).cast("double").alias("confidence"), (w["start"] / 10.0).cast("double").alias("start_time"), (w["end"] / 10.0).cast("double").alias("end_time"))
    heard = F.filter(F.transform("w", lambda w, i: F.when(i % 2 == 0, token(w))), lambda t: t.isNotNull())
    return match.requests_of(turns.withColumn("tokens", heard.cast(match.TOKENS)))


def window_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.windows(_heard(spark, sf_dir), 3)
    return rows.groupBy("request_id", F.col("width").cast("long").alias("width")).agg(F.sum(F.round(F.col("low_confidence") * 1000000).cast("long")).alias("low"))


def audio_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _heard(spark, sf_dir)
    rows = detect.windows(requests, 2).join(requests.select("request_id", "tokens"), "request_id")
    start, end = match.audio_range(F.col("tokens"), F.col("char_start"), F.col("char_end"))
    rows = rows.select("request_id", start.alias("s"), end.alias("e"))
    return rows.groupBy("request_id").agg(F.count("s").alias("heard"), F.sum(F.round(F.col("s") * 10).cast("long")).alias("starts"), F.sum(F.round(F.col("e") * 10).cast("long")).alias("ends"))


def suspicious_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = _table(spark, sf_dir, "events", "event_id").select("event_id", (i % 100 / 100.0).alias("neighbor"), (i % 7 / 10.0).alias("low_confidence"), (i % 5 / 4.0).alias("nbest_disagreement"), F.when(i % 11 == 0, 1.0).otherwise(0.0).alias("mixed_script"), (i % 3 == 0).alias("exact"), (i % 5 + 1).alias("width"))
    found = detect.suspicious(rows)
    return found.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("oov", "boundary_risk", "neighbor_hint")], F.round(F.col("risk") * 10000).cast("long").alias("risk"))


def span_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = _table(spark, sf_dir, "events", "event_id", "user_id").select(F.col("user_id").alias("request_id"), (i % 7 / 10.0).alias("neighbor"), (i % 3 / 10.0).alias("risk"), (i % 4 + 1).cast("int").alias("width"), (i % 50).cast("int").alias("first")).distinct()
    rows = rows.select("*", F.col("first").alias("char_start"), (F.col("first") + F.col("width")).alias("char_end"))
    return detect.non_overlapping(rows, ["char_start", "char_end"]).select("request_id", F.col("char_start").cast("long").alias("s"), F.col("char_end").cast("long").alias("e"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, pick = F.col("event_id"), lambda n, *values: F.element_at(F.array(*values), (n % len(values) + 1).cast("int"))
    lists = pick(F.floor(i / 3), *[F.array(*map(F.lit, x)) for x in (["en"], ["und"], ["de", "en"], ["und", "fr"])])
    rows = _table(spark, sf_dir, "events", "event_id").select("event_id", (i % 101 / 100.0).alias("p"), F.when(i % 6 != 0, i % 97 / 100.0).alias("o"), pick(i, F.lit("en"), F.lit("de"), F.lit("fr")).alias("l"), lists.alias("ls"))
    score = match.final_score(phonetic=F.col("p"), orthographic=F.coalesce("o", F.lit(0.0)), alias=(i % 2).cast("double"), language_score=match.language_score(F.col("l"), F.col("ls")), asr=F.col("p"), prior=F.lit(0.5))
    as_long = lambda c: F.round(c * 10000).cast("long")
    return rows.select("event_id", as_long(match.language_score(F.col("l"), F.col("ls"))).alias("language"), as_long(match.neighbor_score(F.col("p"), F.col("o"))).alias("neighbor"), as_long(score).alias("score"))


def span_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, pick = F.col("event_id"), lambda n, *values: F.element_at(F.array(*values), (n % len(values) + 1).cast("int"))
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    top = F.when(i % 19 != 0, F.struct((i % 101 / 100.0).alias("score"), pick(i, *map(F.lit, ("standard", "High", "lasa", "critical"))).alias("risk_tier")))
    spoken = F.struct(F.when(i % 17 == 0, "und").otherwise("en").alias("language"), (i % 10 / 10.0).alias("confidence"))
    rows = _table(spark, sf_dir, "events", "event_id").select("event_id", top.alias("top"), F.when(i % 5 != 0, i % 53 / 100.0).alias("next"), F.when(i % 13 == 0, words()).otherwise(words("x")).alias("said"), pick(i, words("Latn"), words("Cyrl", "Latn"), words("Zyyy")).alias("scripts"), spoken.alias("spoken"), F.when(i % 2 == 0, words("5mg")).otherwise(words()).alias("strengths"))
    rows = rows.withColumn("why", match.decision_reason(F.col("top"), F.col("next"), F.col("said"), F.col("scripts"), F.col("spoken"), F.col("strengths")))
    return rows.select("event_id", match.decision(F.col("why")).alias("decision"), F.array_join("why", ",").alias("reasons"), F.array_join(review.safety_reasons(F.col("why")), ",").alias("safety"))


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.array(F.struct(F.lit("x").alias("text"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end"), (F.col("conv_id") % 15 / 10.0).alias("confidence"), (F.col("conv_id") % 5 - 1.0).alias("start_time"), F.lit(None).cast("double").alias("end_time"))).cast(match.TOKENS)
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.when(F.col("turn") % 4 == 3, F.repeat("text", 100)).otherwise(F.col("text")).alias("text"), (F.col("turn") * 7 % 25).cast("int").alias("top_k"), heard.alias("tokens"))
    requests = match.requests_of(turns)
    return requests.where(match.valid_request()).select("request_id", F.lit(True).alias("taken")).union(match.rejected(requests).select("request_id", F.lit(False)))


def review_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    events = _table(spark, sf_dir, "events", "event_id", "user_id")
    spans = events.select(F.col("user_id").cast("string").alias("request_id"), (i % 5).alias("n")).distinct()
    spans = spans.select("request_id", F.col("n").cast("string").alias("span_id"), F.transform(F.array(F.col("n"), F.col("n") + 1), lambda c: F.struct(F.concat(F.lit("c"), c).alias("concept_id"))).alias("candidates"))
    action = F.element_at(F.array(*map(F.lit, [*audit.ACTIONS, "odd"])), (i % 4 + 1).cast("int"))
    reviews = events.select("event_id", F.col("user_id").cast("string").alias("request_id"), (i % 7).cast("string").alias("span_id"), F.when(i % 23 == 0, "").otherwise("me").alias("reviewer_id"), action.alias("action"), F.when(i % 9 != 0, F.concat(F.lit("c"), i % 8)).alias("concept_id"), F.when(i % 29 == 0, F.repeat(F.lit("n"), 2001)).alias("note"))
    return audit.review_problem(spans, reviews).select("event_id", "problem")


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, case = F.col("event_id"), F.col("user_id").cast("string").alias("case_id")
    events = _table(spark, sf_dir, "events", "event_id", "user_id")
    predicted = events.select(case, (i % 40).cast("int").alias("p")).distinct().select("*", (F.col("p") * 10).alias("char_start"), (F.col("p") * 10 + 4).alias("char_end"))
    gold = events.select(case, (i % 37 * 2 + F.floor(i / 37) % 2).cast("int").alias("g")).distinct()
    start = (F.floor(F.col("g") / 2) * 10 + F.col("g") % 2 * 2).cast("int")
    return evaluate.pair_spans(predicted, gold.select("*", start.alias("char_start"), (start + 4).alias("char_end")))


def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag").withColumn("case_id", (F.col("l_orderkey") % 500).cast("string"))
    p = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber"))
    gold = line.select("case_id", p.alias("p"), (p.isNotNull() & (F.col("l_quantity").cast("long") % 2 == 0)).alias("exact"), (F.col("l_partkey") % 7).alias("rank_term"), (F.col("l_suppkey") % 4).alias("rank_concept"))
    predicted = line.select("case_id", F.when(F.col("l_returnflag") == "A", "review").otherwise("abstain").alias("decision"), F.when(F.col("l_linenumber") % 4 != 0, F.lit(True)).alias("hit"))
    records = line.select("case_id").distinct().select("case_id", F.when(F.col("case_id").cast("int") % 10 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("gold_spans"))
    tags = records.select("case_id", (F.col("case_id").cast("int") % 3).cast("string").alias("tag"))
    return evaluate.metrics(records, gold, predicted, tags).select("tag", "records", "negative_records", "negative_records_with_predictions", "records_with_false_positives", "gold", "predicted", "exact_true_positives", "overlap_true_positives", "reviews", "abstentions", "commits", "false_positives", "overlap_precision", "overlap_recall", "overlap_f1", "exact_f1", "recall_at_1", "recall_at_5", "accuracy_at_1", "mrr", "review_rate")


def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    events = _table(spark, sf_dir, "events", "event_id")
    listed = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.concat(F.lit("c"), (i + k) % 6).alias("concept_id"), F.concat(F.lit("Term "), (i + k) % 7).alias("term")))
    spans = events.select(F.concat(F.lit("e"), "event_id").alias("request_id"), F.lit(2).alias("char_start"), F.lit(6).alias("char_end"), listed.alias("candidates"), F.lit("review").alias("decision"))
    gold = F.struct((i % 4 * 2).cast("int").alias("char_start"), (i % 4 * 2 + 4).cast("int").alias("char_end"), F.concat(F.lit("TERM  "), i % 5).alias("gold_term"), F.concat(F.lit("c"), i % 3).alias("concept_id"))
    records = events.select(F.concat(F.lit("e"), "event_id").alias("case_id"), F.array(gold).alias("gold_spans"))
    met, _ = evaluate.outcomes(records, spans)
    return met.select("case_id", "exact", F.col("rank_term").cast("long").alias("rank_term"), F.col("rank_concept").cast("long").alias("rank_concept"))


def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    gold = F.array(F.struct((i % 3).cast("int").alias("char_start"), (i % 3 + i % 5).cast("int").alias("char_end"), F.substring("text", 1, 2).alias("span_text")))
    value = F.to_json(F.struct(F.when(i % 4 != 0, F.concat(F.lit("case-"), F.floor(i / 2))).alias("case_id"), F.when(i % 11 != 0, F.col("text")).alias("text"), F.when(i % 2 == 0, gold).alias("gold_spans"), F.when(i % 13 == 0, 1).alias("odd")))
    lines = _table(spark, sf_dir, "benchmark", "item_id", "text").select((i + 1).alias("line"), F.when(i % 17 == 0, "{").when(i % 19 == 0, " ").otherwise(value).alias("value"))
    return evaluation.check_records(lines).select("line", F.col("position").cast("long").alias("position"), "case_id", "problem")


def reviewer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda n: F.struct(F.concat("p_name", F.lit(f" {n}")).alias("term"), F.concat(F.lit("C"), k + n).alias("concept_id"), F.struct((k % 10 / 10.0).alias("phonetic"), (k % 7 / 10.0).alias("orthographic")).alias("score_breakdown"), (k % 100 / 100.0).alias("score"), F.lit("high").alias("risk_tier"), F.lit("local").alias("provenance"))
    spans = _table(spark, sf_dir, "part", "p_partkey", "p_name").select(k.alias("span_id"), F.array(one(1), one(2)).alias("candidates"))
    return review.candidate_rows(spans).withColumn("rank", F.col("rank").cast("long"))


def marked_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("context", F.concat(F.lit("<a href=\"x\"> & it's "), "text"))
    span = F.lower(F.regexp_extract("text", f"({text.TOKEN})", 1))
    return turns.select("conv_id", "turn", F.md5(review.highlighted(F.col("context"), span)).alias("marked"))


def release_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    fields = [F.col("p_partkey") % 97, F.when(F.col("p_size") == 7, "SPA").otherwise("ENG"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.when(F.col("p_size") % 5 == 0, "Y").otherwise("N"), *[F.lit("")] * 4, F.lit("RXNORM"), F.when(F.col("p_size") == 9, "XX").otherwise("IN"), F.lit(""), F.col("p_name"), F.lit(""), F.when(F.col("p_size") == 11, "O").otherwise("N"), F.lit(""), F.lit("")]
    lines = p.select(F.col("p_partkey").alias("line"), F.concat_ws("|", *[f.cast("string") for f in fields]).alias("value"))
    return terms.release_terms(lines).select("concept_id", "term", F.array_join("aliases", "|").alias("aliases"), F.col("line").alias("first_line"))


def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")
    hit, truth = F.col("n_chars") >= 1000, F.col("quality") == 1
    counts = docs.groupBy("lang").agg(F.count(F.when(hit & truth, 1)).alias("tp"), F.count(F.when(hit, 1)).alias("predicted"), F.count(F.when(truth, 1)).alias("gold"))
    return counts.select("*", evaluate.ratio(2 * F.col("tp"), F.col("predicted") + F.col("gold")).alias("f1"))


def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark", "item_id", "text").withColumn("ref", F.trim(F.regexp_replace("text", r"\s+", " ")))
    heard = F.array_join(F.filter(F.split("ref", " "), lambda w, i: i % 5 != 4), " ")
    edits, words = evaluate.word_errors(F.col("ref"), heard)
    return rows.select("item_id", edits.cast("long").alias("word_edits"), words.cast("long").alias("words"), F.levenshtein(F.col("ref"), heard).cast("long").alias("char_edits"))


def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    stored = events.select(F.col("user_id").cast("string").alias("request_id"), F.col("ts").alias("created_at"), "event_id", "event_type")
    return audit.latest(stored, ["created_at", "event_id"]).select("request_id", "event_id", "event_type")


def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("created_at", F.unix_seconds(F.col("ts").cast("timestamp")))
    request = F.concat(F.lit("u"), "user_id").alias("request_id")
    stored = F.to_json(F.struct("event_id", "user_id")).alias("payload_json")
    matches = audit.latest(events.where("event_type = 'click'").select(request, "created_at", "event_id", stored), ["created_at", "event_id"])
    reviews = events.where("event_type <> 'click'").select(request, F.col("event_id").alias("review_id"), F.col("event_type").alias("action"), F.when(F.col("event_id") % 2 == 0, "a note").alias("note"), "created_at")
    return audit.export(matches, reviews).select("request_id", "line")


def span_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("w", text.tokens(F.col("text")))
    each = F.transform("w", lambda w: match.context(F.col("text"), w["start"], w["end"]))
    return turns.select("conv_id", "turn", F.md5(F.array_join(each, "|")).alias("contexts"))


def span_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", ids.uuid5(F.lit(ids.URL_NAMESPACE), F.concat_ws(":", F.col("turn").cast("string"), F.length("text").cast("string"))).alias("id"))


def damaged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part", "p_name").distinct()
    made = benchmark.damaged(F.col("p_name"), F.lit("x"), F.lit("ж"))
    return names.select("p_name", *[c.alias(k) for k, c in made.items()])


def dictionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("Coumadin",), ("metforman",), ("blood count",), ("",)], "query string")
    return retrieve.search(asked, terms.bundled_dictionary(spark), 5).select("query", "rank", "concept_id", "term", "similarity")


REQUESTS = [
    ("dose", "At noon she swallowed met for men 850 mg again.", "en-US"),
    ("right", "He keeps using metformin.", "en-US"),
    ("spelling", "Her list shows amoxycillin twice a week.", "en-US"),
    ("scripts", "Please look up метформин first.", None),
]


def match_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("request_id"), "text", F.lit("en").alias("locale"))
    requests = match.requests_of(turns.unionByName(spark.createDataFrame(REQUESTS, "request_id string, text string, locale string")))
    found = match.match(requests, terms.bundled_dictionary(spark))
    best = F.get("candidates", F.lit(0))
    return found.select("request_id", "span_id", "span_text", "char_start", "char_end", "normalized_span", "decision", F.array_join("decision_reason", ",").alias("reasons"), best["concept_id"].alias("concept_id"), best["score"].alias("score"), F.col("evidence.risk_score").alias("risk_score"))


FLAGSHIP = "match_flagship"
QUERIES = {
    f.__name__: f
    for f in (
        match_flagship, dictionary_search, normalize_documents, token_offsets, window_counts, document_scripts, medication_fields, spelled_sounds, name_likeness, exact_lookup, gram_retrieval,
        token_confidence, nbest_disagreement, release_import, detection_metrics, word_error_rate, audit_latest, audit_export, span_context, span_ids, damaged_names,
        best_sounds, channel_merge, window_confidence, audio_ranges, suspicious_windows, span_choice, candidate_scores, span_decisions, request_limits, review_problems, gold_pairs, gold_ranks,
        evaluation_metrics, evaluation_records, reviewer_views, marked_contexts,
    )
}

_NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    folded = f"replace(lower(nfc_normalize(replace(replace(replace({x}, '’', ''''), '–', '-'), '—', '-'))), 'ß', 'ss')"
    return _NORM.format(folded)


def _term(x: str) -> str:
    return _NORM.format(f"regexp_replace({_norm(x)}, '[^\\p{{L}}\\p{{N}}_\\s''\\-]', ' ', 'g')")


_TOKENS = f"""p AS (SELECT *, regexp_extract_all(text, '(?s)(.*?)({TOK})', 1) AS g, regexp_extract_all(text, '(?s)(.*?)({TOK})', 2) AS t FROM src),
u AS (SELECT * EXCLUDE (g, t), unnest(g) AS g, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS i FROM p),
o AS (SELECT *, (sum(length(g) + length(t)) OVER w - length(t))::BIGINT AS s, (sum(length(g) + length(t)) OVER w)::BIGINT AS e FROM u WINDOW w AS (PARTITION BY id ORDER BY i))"""


def _sound(x: str) -> str:
    for pattern, put in phonetics.SPELLING:
        if "(?=" in pattern:
            x = f"regexp_replace({x}, '{pattern[0]}([eiy])', '{put}\\1', 'g')"
        else:
            x = f"replace({x}, '{pattern}', '{put}')"
    return f"regexp_replace({x}, '[^a-zɑ-ʒθðŋɹ]+', '', 'g')"


def _grams(x: str) -> str:
    return f"(CASE WHEN length({x}) < 2 THEN ['^' || {x} || '$'] ELSE list_distinct(list_transform(range(1, length({x}) + 1), lambda i: substring('^' || {x} || '$', i, 3))) END)"


def _markup(x: str) -> str:
    for char, put in review.MARKUP:
        x = f"replace({x}, '{char.replace("'", "''")}', '{put}')"
    return x


def _scripts_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(text, '{cls}') THEN '{s}' END" for s, cls in sorted(text.script_ranges().items()))
    return f"SELECT doc_id, coalesce(nullif(concat_ws('+', {cases}), ''), 'Zyyy') AS script FROM documents"


_DAMAGE = """WITH n AS (SELECT DISTINCT p_name FROM part), u AS (SELECT p_name, string_split(p_name, '') AS u FROM n),
m AS (SELECT p_name, u, list_filter(range(1, len(u) + 1), lambda i: u[i] <> ' ') AS pl FROM u),
k AS (SELECT p_name, pl[len(pl) // 2 + 1] AS m, pl[len(pl) // 2] AS b FROM m)
SELECT p_name, substring(p_name, 1, m - 1) || substring(p_name, m + 1) AS deletion,
 substring(p_name, 1, b - 1) || substring(p_name, b + 1, 1) || substring(p_name, b, 1) || substring(p_name, b + 2) AS transposition,
 substring(p_name, 1, m - 1) || ' ' || substring(p_name, m) AS asr_boundary,
 substring(p_name, 1, m - 1) || CASE WHEN lower(substring(p_name, m, 1)) = 'x' THEN 'xx' ELSE 'x' END || substring(p_name, m + 1) AS substitution,
 substring(p_name, 1, m - 1) || 'ж' || substring(p_name, m + 1) AS script_confusion FROM k"""

ORACLE_SQL = {
    "normalize_documents": f"SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT doc_id, {_norm('text')} AS t FROM documents)",
    "token_offsets": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_TOKENS} SELECT d.doc_id, count(o.i)::BIGINT AS n_tokens, coalesce(sum(s), 0)::BIGINT AS starts, coalesce(sum(e), 0)::BIGINT AS ends FROM documents d LEFT JOIN o ON o.id = d.doc_id GROUP BY 1",
    "window_counts": f"WITH src AS (SELECT conv_id || ':' || turn AS id, text FROM conversations), {_TOKENS}, w AS (SELECT a.id, a.s, b.e, b.i - a.i + 1 AS width FROM o a JOIN o b ON a.id = b.id AND b.i BETWEEN a.i AND a.i + 4) SELECT width::BIGINT AS width, count(*) AS n, sum(s)::BIGINT AS starts, sum(e - s)::BIGINT AS chars FROM w GROUP BY 1",
    "medication_fields": r"""WITH t AS (SELECT p_partkey, 'Take ' || p_size || ' MG of ' || p_name || ' PO tablet or ' || p_size || '.5ml iv, then ' || p_size || ' mg.' AS text, p_size, p_name FROM part)
SELECT p_partkey, p_size || 'mg|' || p_size || '.5ml' AS strengths, 'iv|po' AS routes, 'tablet' AS forms, 'take of ' || lower(p_name) || ' or then' AS stripped FROM t""",
    "spelled_sounds": f"SELECT p_partkey, {_sound(f'''replace({_term('p_name')}, ' ', '')''')} AS sound FROM part",
    "name_likeness": f"WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), g AS (SELECT *, {_grams('a')} AS x, {_grams('b')} AS y FROM p) SELECT p_partkey, len(list_intersect(x, y))::BIGINT AS shared, (len(x) + len(y) - len(list_intersect(x, y)))::BIGINT AS all_grams, levenshtein(a, b)::BIGINT AS edits, CASE WHEN a = b THEN 1.0 ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS similarity FROM g",
    "exact_lookup": f"""WITH n AS (SELECT p_name, {_term('p_name')} AS a, row_number() OVER (ORDER BY p_name) - 1 AS entry_id FROM (SELECT DISTINCT p_name FROM part)),
k AS (SELECT DISTINCT {_term("upper(p_name) || CASE WHEN p_partkey % 2 = 1 THEN 'x' ELSE '' END")} AS normalized FROM part) SELECT normalized, p_name AS term, entry_id FROM k JOIN n ON n.a = normalized""",
    "gram_retrieval": f"""WITH n AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS entry_id, {_sound(f"replace({_term('p_name')}, ' ', '')")} AS f FROM (SELECT DISTINCT p_name FROM part)),
t AS (SELECT p_type AS normalized, {_sound(f"replace({_term('p_type')}, ' ', '')")} AS f FROM (SELECT DISTINCT p_type FROM part)),
g AS (SELECT DISTINCT entry_id, unnest({_grams('f')}) AS gram FROM n), k AS (SELECT normalized, unnest({_grams('f')}) AS gram FROM t),
h AS (SELECT normalized, entry_id, count(*) AS hits FROM k JOIN g USING (gram) GROUP BY 1, 2)
SELECT normalized, entry_id, hits, row_number() OVER (PARTITION BY normalized ORDER BY hits DESC, entry_id) AS rank FROM h QUALIFY rank <= 5""",
    "token_confidence": f"WITH src AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text FROM conversations), {_TOKENS} SELECT c.conv_id, c.turn, coalesce(sum(CASE WHEN i % 2 = 1 THEN s % 10 * 100 ELSE 1000 END), 0)::BIGINT AS confidence FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id AND o.turn = c.turn GROUP BY 1, 2",
    "nbest_disagreement": f"""WITH src AS (SELECT conv_id || ':' || turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations), {_TOKENS}
SELECT id AS request_id, count(*) AS words, sum(CASE WHEN nx IS NULL OR contains({_term('nx')}, {_term('t')}) THEN 0 ELSE 1 END)::BIGINT AS missing FROM o GROUP BY 1""",
    "release_import": """WITH r AS (SELECT p_partkey % 97 AS c, p_partkey AS line, p_name, p_size % 5 = 0 AS pref FROM part WHERE p_size NOT IN (7, 9, 11) AND trim(p_name) <> ''),
t AS (SELECT c, min(line) AS first_line, arg_min(p_name, (CASE WHEN pref THEN 0 ELSE 1 END) * 1000000000 + line) AS term FROM r GROUP BY c),
a AS (SELECT r.c, p_name, min(line) AS l FROM r JOIN t ON r.c = t.c AND p_name <> term GROUP BY 1, 2), s AS (SELECT c, string_agg(p_name, '|' ORDER BY l) AS aliases FROM a GROUP BY 1)
SELECT 'RxCUI:' || t.c AS concept_id, term, coalesce(aliases, '') AS aliases, first_line FROM t LEFT JOIN s USING (c)""",
    "detection_metrics": "SELECT *, round_even(2 * tp / (predicted + gold)::DOUBLE, 4) AS f1 FROM (SELECT lang, count(*) FILTER (n_chars >= 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 1000) AS predicted, count(*) FILTER (quality = 1) AS gold FROM documents JOIN labels USING (doc_id) GROUP BY lang)",
    "word_error_rate": r"""WITH r AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark), g AS (SELECT item_id, w, list_filter(range(1, len(w) + 1), lambda i: i % 5 = 0) AS gone FROM r)
SELECT item_id, len(gone)::BIGINT AS word_edits, len(w)::BIGINT AS words, coalesce(list_sum(list_transform(gone, lambda i: length(w[i]) + 1)), 0)::BIGINT AS char_edits FROM g""",
    "audit_latest": "SELECT user_id::VARCHAR AS request_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "audit_export": """WITH m AS (SELECT * FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT DESC, event_id DESC) = 1), r AS (SELECT * FROM events WHERE event_type <> 'click')
SELECT 'u' || m.user_id AS request_id, '{"event_id":' || m.event_id || ',"user_id":' || m.user_id || ',"review":{' || CASE WHEN r.event_id IS NULL THEN '' ELSE '"review_id":' || r.event_id || ',"action":"' || r.event_type || CASE WHEN r.event_id % 2 = 0 THEN '","note":"a note' ELSE '' END || '","review_created_at":' || floor(epoch(r.ts))::BIGINT END || '}}' AS line FROM m LEFT JOIN r USING (user_id)""",
    "span_context": f"WITH src AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text FROM conversations), {_TOKENS}, x AS (SELECT id, string_agg(substring(text, greatest(0, s - 80) + 1, least(length(text), e + 80) - greatest(0, s - 80)), '|' ORDER BY i) AS j FROM o GROUP BY 1) SELECT c.conv_id, c.turn, md5(coalesce(j, '')) AS contexts FROM conversations c LEFT JOIN x ON x.id = c.conv_id || ':' || c.turn",
    "span_ids": f"WITH h AS (SELECT conv_id, turn, sha1(unhex('{ids.URL_NAMESPACE.replace('-', '')}') || encode(turn || ':' || length(text))) AS h FROM conversations) SELECT conv_id, turn, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM h",
    "damaged_names": _DAMAGE,
    "document_scripts": _scripts_sql(),
    "best_sounds": f"""WITH p AS (SELECT p_name, lower(p_name) AS a, lower(p_type) AS b FROM part), g AS (SELECT *, {_grams('a')} AS x, {_grams('b')} AS y FROM p),
l AS (SELECT p_name, CASE WHEN a = b THEN 1.0 ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS f, len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) AS t FROM g)
SELECT p_name, max(round((0.7 * f + 0.3 * t) * 1000000))::BIGINT AS best FROM l GROUP BY 1""",
    "channel_merge": """WITH e AS (SELECT user_id::VARCHAR AS normalized, event_id % 9 AS entry_id, event_id, event_type FROM events)
SELECT normalized, entry_id, max(event_id) FILTER (event_type = 'click') % 100 / 100.0::DOUBLE AS orthographic, max(event_id::VARCHAR) FILTER (event_type = 'click') AS matched_alias FROM e GROUP BY 1, 2""",
    "window_confidence": f"""WITH src AS (SELECT conv_id || ':' || turn AS id, text FROM conversations), {_TOKENS}, c AS (SELECT id, i, CASE WHEN i % 2 = 1 THEN s % 10 / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS c FROM o),
w AS (SELECT a.id, a.i, k.k AS width, avg(b.c) AS m, count(*) AS n FROM c a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k JOIN c b ON b.id = a.id AND b.i BETWEEN a.i AND a.i + k.k - 1 GROUP BY ALL HAVING count(*) = k.k)
SELECT id AS request_id, width::BIGINT AS width, sum(round(greatest(0, 1 - m) * 1000000)::BIGINT)::BIGINT AS low FROM w GROUP BY 1, 2""",
    "audio_ranges": f"""WITH src AS (SELECT conv_id || ':' || turn AS id, text FROM conversations), {_TOKENS},
w AS (SELECT a.id, a.s, b.e FROM o a JOIN o b ON a.id = b.id AND b.i BETWEEN a.i AND a.i + 1), r AS (SELECT w.id, w.s, w.e, min(h.s) AS b, max(h.e) AS f FROM w LEFT JOIN o h ON h.id = w.id AND h.i % 2 = 1 AND h.s < w.e AND h.e > w.s GROUP BY ALL)
SELECT id AS request_id, count(b) AS heard, sum(b)::BIGINT AS starts, sum(f)::BIGINT AS ends FROM r GROUP BY 1""",
    "suspicious_windows": """WITH e AS (SELECT event_id, event_id % 100 / 100.0::DOUBLE AS nb, event_id % 7 / 10.0::DOUBLE AS lc, event_id % 5 / 4.0::DOUBLE AS nd, CASE WHEN event_id % 11 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ms, event_id % 3 = 0 AS ex, event_id % 5 + 1 AS wd FROM events),
h AS (SELECT *, CASE WHEN nb >= 0.52 THEN 1 ELSE 0 END AS hint, CASE WHEN ex THEN 0 ELSE 1 END AS oov FROM e), b AS (SELECT *, CASE WHEN wd > 1 THEN hint ELSE 0 END AS br FROM h),
r AS (SELECT *, 0.25::DOUBLE * oov + 0.20::DOUBLE * lc + 0.15::DOUBLE * nd + 0.15::DOUBLE * br + 0.15::DOUBLE * ms + 0.10::DOUBLE * hint AS risk FROM b)
SELECT event_id, oov::BIGINT AS oov, br::BIGINT AS boundary_risk, hint::BIGINT AS neighbor_hint, round(risk * 10000)::BIGINT AS risk FROM r
WHERE risk >= 0.30::DOUBLE AND (hint > 0 OR lc >= 0.25 OR nd >= 0.5 OR ms > 0) AND NOT (ex AND lc = 0 AND ms = 0)""",
    "span_choice": """WITH RECURSIVE w AS (SELECT DISTINCT user_id AS r, event_id % 50 AS s, event_id % 50 + event_id % 4 + 1 AS e, event_id % 4 + 1 AS width, event_id % 7 AS nb, event_id % 3 AS rk FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY nb DESC, rk DESC, width DESC, s) AS n FROM w),
g AS (SELECT r, 0::BIGINT AS n, []::STRUCT(s BIGINT, e BIGINT)[] AS c FROM (SELECT DISTINCT r FROM w) UNION ALL
 SELECT g.r, o.n, CASE WHEN len(list_filter(g.c, lambda x: x.s < o.e AND x.e > o.s)) = 0 THEN list_append(g.c, {'s': o.s, 'e': o.e}) ELSE g.c END FROM g JOIN o ON o.r = g.r AND o.n = g.n + 1),
f AS (SELECT r, unnest(arg_max(c, n)) AS x FROM g GROUP BY r) SELECT r AS request_id, x.s AS s, x.e AS e FROM f""",
    "candidate_scores": """WITH e AS (SELECT event_id, event_id % 101 / 100.0::DOUBLE AS p, CASE WHEN event_id % 6 <> 0 THEN event_id % 97 / 100.0::DOUBLE END AS o, (['en', 'de', 'fr'])[event_id % 3 + 1] AS l, ([['en'], ['und'], ['de', 'en'], ['und', 'fr']])[(event_id // 3) % 4 + 1] AS ls FROM events),
s AS (SELECT *, CASE WHEN l = ls[1] THEN 1.0 WHEN list_contains(ls, l) THEN 0.7 WHEN ls[1] = 'und' THEN 0.4 ELSE 0.0 END::DOUBLE AS lang FROM e)
SELECT event_id, round(lang * 10000)::BIGINT AS language, round((0.65 * p + 0.35 * coalesce(o, 0)) * 10000)::BIGINT AS neighbor, round((0.4 * p + 0.2 * coalesce(o, 0) + 0.1 * (event_id % 2) + 0.1 * lang + 0.1 * p + 0.05) * 10000)::BIGINT AS score FROM s""",
    "span_decisions": """WITH e AS (SELECT event_id, event_id % 19 <> 0 AS has, event_id % 101 / 100.0::DOUBLE AS sc, (['standard', 'high', 'lasa', 'critical'])[event_id % 4 + 1] AS rt, CASE WHEN event_id % 5 <> 0 THEN event_id % 53 / 100.0::DOUBLE END AS nx, event_id % 3 AS k, event_id % 17 = 0 AS und, event_id % 10 / 10.0::DOUBLE AS cf FROM events),
w AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN ['pronunciation_failed'] WHEN und OR k = 2 THEN ['language_or_script_unresolved'] WHEN NOT has OR sc < 0.55 THEN ['below_review_threshold']
 ELSE list_filter(['candidate_above_review_threshold', CASE WHEN sc - coalesce(nx, 0) < 0.12::DOUBLE THEN 'low_margin' END, CASE WHEN rt <> 'standard' THEN 'high_risk_medication' END, CASE WHEN k = 1 THEN 'mixed_script' END, CASE WHEN cf < 0.5 THEN 'language_uncertain' END, CASE WHEN event_id % 2 = 0 THEN 'dose_adjacent' END], lambda x: x IS NOT NULL) END AS why FROM e)
SELECT event_id, CASE WHEN why[1] = 'candidate_above_review_threshold' THEN 'review' ELSE 'abstain' END AS decision, array_to_string(why, ',') AS reasons, array_to_string(list_filter(why, lambda x: x IN ('high_risk_medication', 'dose_adjacent', 'mixed_script', 'low_margin')), ',') AS safety FROM w""",
    "request_limits": """SELECT conv_id || ':' || turn AS request_id, length(text) >= 1 AND length(text) * CASE WHEN turn % 4 = 3 THEN 100 ELSE 1 END <= 100000 AND turn * 7 % 25 BETWEEN 1 AND 20 AND conv_id % 15 <= 10 AND conv_id % 5 >= 1 AS taken FROM conversations""",
    "review_problems": """WITH r AS (SELECT event_id, user_id, event_id % 7 AS sp, event_id % 4 AS a, CASE WHEN event_id % 9 <> 0 THEN event_id % 8 END AS c FROM events), s AS (SELECT DISTINCT user_id, event_id % 5 AS n FROM events)
SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'reviewer_id' WHEN a = 3 THEN 'action' WHEN event_id % 29 = 0 THEN 'note' WHEN a = 0 AND c IS NULL THEN 'concept_id is needed' WHEN s.n IS NULL THEN 'no such span'
 WHEN c IS NOT NULL AND c NOT IN (s.n, s.n + 1) THEN 'concept_id is no candidate' END AS problem FROM r LEFT JOIN s ON s.user_id = r.user_id AND s.n = r.sp""",
    "gold_pairs": """WITH p AS (SELECT DISTINCT user_id AS c, event_id % 40 AS p FROM events), g AS (SELECT DISTINCT user_id AS c, event_id % 37 * 2 + (event_id // 37) % 2 AS g FROM events)
SELECT p.c::VARCHAR AS case_id, p::INTEGER AS p, min(g)::INTEGER AS g, min(g) % 2 = 0 AS exact FROM p JOIN g ON g.c = p.c AND g // 2 = p.p GROUP BY 1, 2""",
    "gold_ranks": """WITH e AS (SELECT event_id AS i, event_id % 4 AS o FROM events), h AS (SELECT *, o < 3 AS hit FROM e)
SELECT 'e' || i AS case_id, CASE WHEN hit THEN o = 1 END AS exact, CASE WHEN hit THEN coalesce(list_position([(i + 0) % 7, (i + 1) % 7, (i + 2) % 7, (i + 3) % 7], i % 5), 0) ELSE 0 END::BIGINT AS rank_term,
 CASE WHEN hit THEN coalesce(list_position([(i + 0) % 6, (i + 1) % 6, (i + 2) % 6, (i + 3) % 6], i % 3), 0) ELSE 0 END::BIGINT AS rank_concept FROM h""",
    "evaluation_metrics": """WITH l AS (SELECT l_orderkey % 500 AS c, (l_orderkey % 500) % 3 AS tag, l_linenumber % 3 <> 0 AS p, l_linenumber % 3 <> 0 AND l_quantity::BIGINT % 2 = 0 AS ex, l_partkey % 7 AS rt, l_suppkey % 4 AS rc, l_returnflag = 'A' AS rv, l_linenumber % 4 <> 0 AS hit FROM lineitem),
g AS (SELECT tag, count(*) AS n, count(*) FILTER (ex) AS ex, count(*) FILTER (p) AS ov, count(*) FILTER (rt = 1) AS t1, count(*) FILTER (rt BETWEEN 1 AND 5) AS t5, count(*) FILTER (rc = 1) AS c1, sum(CASE WHEN rt > 0 THEN 1.0::DOUBLE / rt ELSE 0 END) AS rr, count(*) FILTER (rv) AS rv, count(*) FILTER (NOT hit) AS fp FROM l GROUP BY 1),
c AS (SELECT tag, c, count(*) FILTER (NOT hit) AS f FROM l GROUP BY 1, 2), r AS (SELECT tag, count(*) AS records, count(*) FILTER (c % 10 = 0) AS neg, count(*) FILTER (f > 0) AS wf FROM c GROUP BY 1)
SELECT tag::VARCHAR AS tag, records, neg AS negative_records, neg AS negative_records_with_predictions, wf AS records_with_false_positives, n AS gold, n AS predicted, ex AS exact_true_positives, ov AS overlap_true_positives, rv AS reviews, n - rv AS abstentions, 0::BIGINT AS commits, fp AS false_positives,
 round_even(ov / n, 4) AS overlap_precision, round_even(ov / n, 4) AS overlap_recall, round_even(2 * ov / (n + n), 4) AS overlap_f1, round_even(2 * ex / (n + n), 4) AS exact_f1, round_even(t1 / n, 4) AS recall_at_1, round_even(t5 / n, 4) AS recall_at_5, round_even(c1 / n, 4) AS accuracy_at_1, round_even(rr / n, 4) AS mrr, round_even(rv / n, 4) AS review_rate
FROM g JOIN r USING (tag)""",
    "evaluation_records": """WITH l AS (SELECT item_id AS i, item_id + 1 AS line, text FROM benchmark WHERE item_id % 17 = 0 OR item_id % 19 <> 0), p AS (SELECT *, row_number() OVER (ORDER BY line) AS position FROM l),
n AS (SELECT *, CASE WHEN i % 17 = 0 OR i % 4 = 0 THEN printf('record-%05d', position) ELSE 'case-' || (i // 2) END AS case_id FROM p), a AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY position) > 1 AS again FROM n)
SELECT line, position, case_id, CASE WHEN i % 17 = 0 THEN 'line ' || line || ': no JSON object' WHEN i % 13 = 0 THEN 'line ' || line || ': unknown field' WHEN i % 11 = 0 OR text = '' THEN 'line ' || line || ': no text'
 WHEN i % 2 = 0 AND (i % 5 = 0 OR i % 3 + i % 5 > length(text)) THEN 'line ' || line || ': offsets of a gold span' WHEN i % 2 = 0 AND substring(text, i % 3 + 1, i % 5) <> substring(text, 1, 2) THEN 'line ' || line || ': text of a gold span' WHEN again THEN 'line ' || line || ': case_id again' END AS problem FROM a""",
    "reviewer_views": """SELECT p_partkey AS span_id, n::BIGINT AS rank, p_name || ' ' || n AS term, 'C' || (p_partkey + n) AS concept, p_partkey % 10 / 10.0::DOUBLE AS phonetic, p_partkey % 7 / 10.0::DOUBLE AS spelling, p_partkey % 100 / 100.0::DOUBLE AS final, 'high' AS risk, 'local' AS source FROM part, (SELECT unnest([1, 2]) AS n)""",
    "marked_contexts": f"""WITH c AS (SELECT conv_id, turn, '<a href="x"> & it''s ' || text AS x, lower(regexp_extract(text, '({TOK})', 1)) AS w FROM conversations), l AS (SELECT *, strpos(lower(x), lower(w)) AS q FROM c)
SELECT conv_id, turn, md5(CASE WHEN q > 0 THEN {_markup('substring(x, 1, q - 1)')} || '<mark>' || {_markup('substring(x, q, length(w))')} || '</mark>' || {_markup('substring(x, q + length(w))')} ELSE {_markup('x')} END) AS marked FROM l""",
}
