import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from termweave.functions import bounds, phonetics
from termweave.operators import benchmark, detect, retrieve
from termweave.plans import evaluate, match
from termweave.sources import audit, evaluation, terms


@pytest.fixture(scope="module")
def dictionary(spark):
    return terms.bundled_dictionary(spark, "test_v1")


def test_dictionary(spark, dictionary, tmp_path):
    assert dictionary.entries.count() == 30
    names = {r["alias"] for r in dictionary.aliases().collect()}
    assert {"metformin", "glucophage"} <= names and "met for men" not in names
    path = str(tmp_path / "terms.csv")
    (tmp_path / "terms.csv").write_text("﻿concept_id,term,aliases\nX:1,Foo,Bar | Baz||\n", encoding="utf-8")
    row = terms.read_terms(spark, path).first()
    assert (row["concept_id"], row["aliases"], row["language"], row["prior"]) == ("X:1", ["Bar", "Baz"], "en", 0.5)
    built = terms.build_from_file(spark, path, str(tmp_path / "out"), "v9")
    assert built.version == "v9" and built.entries.first()["normalized_aliases"] == ["foo", "bar", "baz"]


def test_search(spark, dictionary):
    asked = spark.createDataFrame([("Coumadin",), ("",)], "query string")
    found = retrieve.search(asked, dictionary, 3).orderBy("rank").collect()
    assert found[0]["concept_id"] == "RxCUI:11289" and {r["query"] for r in found} == {"Coumadin"}


def test_names_beyond_a_broadcast_are_all_scored(spark, dictionary, monkeypatch):
    keys = spark.createDataFrame([("zerilta",), ("amlodepen",), ("kosarna",), ("blood count",), ("zz",)], "normalized string")
    small = sorted(retrieve.similar_names(keys, dictionary, 25.0, 20).collect())
    monkeypatch.setattr(retrieve, "BROADCAST_NAMES", 10)
    assert sorted(retrieve.similar_names(keys, dictionary, 25.0, 20).select("normalized", "entry_id", "place", "alias", "similarity", "rank").collect()) == small
    grams = lambda x: {f"^{x}$"[i : i + 3] for i in range(len(x))}
    assert any(not grams(r["normalized"]) & grams(r["alias"]) for r in small)


def test_release(spark):
    def line(cui, name, pref="N", lat="ENG", suppress="N", sab="RXNORM", tty="IN"):
        f = dict.fromkeys(terms.RRF, "") | {"RXCUI": cui, "LAT": lat, "ISPREF": pref, "SAB": sab, "TTY": tty, "STR": name, "SUPPRESS": suppress}
        return "|".join(f.values())

    rows = [line("1", "b"), line("1", "a", "Y"), line("1", "b"), line("2", "x"), line("3", "n", lat="SPA"), line("4", "n", suppress="O"), line("5", "n", sab="Q"), line("6", "n", tty="ZZ"), "short|line"]
    lines = spark.createDataFrame(list(enumerate(rows)), "line long, value string")
    assert [(r["concept_id"], r["term"], r["aliases"]) for r in terms.release_terms(lines).orderBy("line").collect()] == [("RxCUI:1", "a", ["b"]), ("RxCUI:2", "x", [])]


def test_match_and_evaluation(spark, dictionary):
    cases = [
        {"case_id": "dose", "text": "At noon she swallowed met for men 850 mg again.", "locale": "en-US", "tags": ["dose"], "gold_spans": [{"char_start": 22, "char_end": 33, "span_text": "met for men", "gold_term": "metformin", "concept_id": "RxCUI:6809"}], "reference_transcript": "he had metformin", "asr_hypothesis": "he had met for men"},
        {"text": "He keeps using metformin.", "locale": "en-US", "tags": ["negative"]},
        {"case_id": "nbest", "text": "Give clone azepam at bedtime.", "locale": "en-US", "n_best": [{"text": "Give clonazepam at bedtime."}], "gold_spans": [{"char_start": 5, "char_end": 17, "gold_term": "clonazepam", "concept_id": "RxCUI:2598"}]},
    ]
    lines = spark.createDataFrame([(i + 1, json.dumps(c)) for i, c in enumerate(cases)], "line long, value string")
    records = evaluation.sound(evaluation.check_records(lines))
    report = evaluate.evaluate(records, dictionary)
    overall = report["overall"].first()
    assert (overall["records"], overall["gold"], overall["overlap_recall"], overall["recall_at_1"], overall["mrr"], overall["accuracy_at_1"], overall["commits"]) == (3, 2, 1.0, 1.0, 1.0, 1.0, 0)
    assert overall["negative_records_with_predictions"] == 0
    assert report["transcripts"].first()["wer"] == 1.0 and {r["tag"] for r in report["slices"].collect()} == {"dose", "negative"}
    heard = [{"text": t, "char_start": a, "char_end": b, "confidence": c, "start_time": s, "end_time": e} for t, a, b, c, s, e in (("met", 0, 3, 0.7, 1.0, 1.2), ("for", 4, 7, 0.6, 1.2, 1.4), ("men", 8, 11, 0.7, 1.4, 1.8))]
    one = spark.createDataFrame([("r", "met for men", "en-US", heard)], f"request_id string, text string, locale string, tokens {match.TOKENS}")
    span = match.match(match.requests_of(one), dictionary).first()
    assert (span["audio_start"], span["audio_end"], span["candidates"][0]["term"], span["decision"]) == (1.0, 1.8, "metformin", "review")


def test_word_errors_of_many_distinct_words(spark):
    words = [f"w{i}" for i in range(8300)]
    other = words[:8250] + words[8251:8253] + words[8250:8251] + words[8253:]
    rows = [(0, " ".join(words), " ".join(other)), (1, " ".join(words), " ".join(words)), (2, "a b", ""), (3, "a b c", "a x c d")]
    edits, n = evaluate.word_errors(F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", edits, n).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 8300), (0, 8300), (2, 2), (2, 3)]


def test_bad_records(spark):
    bad = ["{", '{"text": "ab", "odd": 1}', '{"text": ""}', '{"text": "ab", "gold_spans": [{"char_start": 0, "char_end": 3}]}', '{"text": "ab", "gold_spans": [{"char_start": 0, "char_end": 1, "span_text": "b"}]}', '{"case_id": "x", "text": "a"}', '{"case_id": "x", "text": "a"}']
    rows = evaluation.check_records(spark.createDataFrame([(i + 1, b) for i, b in enumerate(bad)], "line long, value string"))
    problems = [r["problem"] for r in rows.orderBy("line").collect()]
    assert [p is None for p in problems] == [False] * 5 + [True, False] and problems[0].startswith("line 1")
    with pytest.raises(ValueError, match="line 1"):
        evaluation.sound(rows)


def test_pairs_are_one_to_one(spark):
    predicted = spark.createDataFrame([("a", 0, 0, 7)], "case_id string, p int, char_start int, char_end int")
    gold = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 4, 7)], "case_id string, g int, char_start int, char_end int")
    assert evaluate.pair_spans(predicted, gold).count() == 1


def test_suppression_equals_a_plain_greedy_choice(spark):
    r = random.Random(4)
    rows = [("q", r.randint(0, 9) / 10, r.randint(0, 5) / 10, w, a, a, a + w) for w, a in itertools.product(range(1, 5), range(20))]
    df = spark.createDataFrame(rows, "request_id string, neighbor double, risk double, width int, first int, char_start int, char_end int")
    got = {(x["char_start"], x["char_end"]) for x in detect.non_overlapping(df, ["char_start", "char_end"]).collect()}
    want = []
    for x in sorted(rows, key=lambda x: (x[1], x[2], x[3]), reverse=True):
        if not any(x[5] < b and x[6] > a for a, b in want):
            want.append((x[5], x[6]))
    assert got == set(want)


def test_audit(spark, tmp_path):
    path = str(tmp_path)
    for version in ("v1", "v2"):
        row = spark.createDataFrame([("r", version)], "request_id string, artifact_version string").withColumn("created_at", F.current_timestamp())
        audit.save_matches(row, path)
    assert audit.get_match(spark, path, "r").first()["artifact_version"] == "v2" and audit.get_match(spark, path, "none").count() == 0
    spans = spark.createDataFrame([("r", "s", [{"concept_id": "c"}])], "request_id string, span_id string, candidates array<struct<concept_id:string>>")
    given = [("r", "s", "me", "accept_candidate", "c"), ("r", "s", "me", "accept_candidate", None), ("r", "t", "me", "unresolved", None), ("r", "s", "me", "unresolved", "d")]
    reviews = spark.createDataFrame(given, "request_id string, span_id string, reviewer_id string, action string, concept_id string")
    reviews = reviews.withColumn("note", F.lit(None).cast("string")).withColumn("artifact_version", F.lit("v2"))
    judged = audit.review_problem(spans, reviews)
    assert judged.where("problem IS NULL").count() == 1
    audit.save_reviews(judged.where("problem IS NULL"), path)
    assert audit.reviews_of(spark, path, "r").first()["action"] == "accept_candidate"
    stored, given = audit.latest(spark.read.parquet(f"{path}/matches")), spark.read.parquet(f"{path}/reviews")
    line = json.loads(audit.export(stored, given).first()["line"])
    assert line["artifact_version"] == "v2" and line["review"]["concept_id"] == "c" and "note" not in line["review"] and "review_created_at" in line["review"]
    assert json.loads(audit.export(stored, given.where("false")).first()["line"])["review"] == {}
    assert audit.write_export(stored, given, f"{path}/export") == 1


def test_benchmark(spark):
    named = spark.createDataFrame([("a", "metformin", "en", "x", "ж"), ("b", "blood count", "en", "q", "д")], "key string, term string, language string, replacement string, foreign string")
    rows = benchmark.benchmark(named)
    assert rows.count() == 14 and rows.where("NOT distinct_damage").count() == 0 and benchmark.same_rows(rows, rows)
    for r in rows.collect():
        for g in r["gold_spans"]:
            assert r["text"][g["char_start"] : g["char_end"]] == g["span_text"]


def test_benchmark_is_evaluated(spark, dictionary):
    named = spark.createDataFrame([("a", "metformin", "en", "x", "ж")], "key string, term string, language string, replacement string, foreign string")
    rows = {r["condition"]: r for r in benchmark.benchmark(named).collect()}
    heard, observed = rows["asr_boundary"], rows["asr_boundary"]["gold_spans"][0]["span_text"]
    assert [tuple(h) for h in heard["n_best"]] == [("Start metformin tonight.", 0.58), (f"Start {observed} tonight.", 0.42)]
    low = rows["low_confidence"]
    assert [(t["text"], t["char_start"], t["char_end"], t["confidence"]) for t in low["tokens"]] == [("metformin", 9, 18, 0.35)]
    assert all(not r["n_best"] or c == "asr_boundary" for c, r in rows.items()) and all(not r["tokens"] or c == "low_confidence" for c, r in rows.items())
    assert rows["negative"]["reference_transcript"] is None and heard["asr_hypothesis"] == heard["text"]
    overall = evaluate.evaluate(benchmark.benchmark(named), dictionary)["overall"].first()
    assert (overall["records"], overall["gold"], overall["negative_records"], overall["commits"]) == (7, 6, 1, 0)


def test_stream(spark, dictionary, tmp_path):
    from termweave.streaming.matches import match_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request_id": "r1", "text": "Start metforman tonight.", "locale": "en"}\n')
    match_stream(spark, str(tmp_path / "in"), dictionary, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert "metformin" in audit.get_match(spark, str(tmp_path / "log"), "r1").first()["payload_json"]


def _windows(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(150).select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "text", F.lit("en").alias("locale"))
    odd = [("o1", "take met for men oral tablet, coumaden; glucofage - it's METFORMAN iv iv", "en-US"), ("o2", "метформин met formin 5 mg", "en"), ("o3", "xylo-met Straße ferr ous sul fate comp lete blud count", "de")]
    return match.requests_of(turns.unionByName(spark.createDataFrame(odd, "request_id string, text string, locale string")))


def test_windows_that_no_name_is_near_leave_first(spark, dictionary):
    requests = _windows(spark)
    hopeful = match.hopeful_spans(dictionary)
    every = detect.described(detect.windows(requests))
    left = detect.described(detect.windows(requests, heard=True), hopeful)
    assert left.count() < every.count() / 10
    keys = every.select("normalized", F.col("spoken.language").alias("language")).distinct()
    near = match.worth_scoring(keys, dictionary)  # the former test, over all windows
    needed = every.withColumn("language", F.col("spoken.language")).join(near, ["normalized", "language"]).select("request_id", "char_start", "char_end").distinct()
    assert needed.count() > 5
    assert needed.subtract(left.select("request_id", "char_start", "char_end")).count() == 0
    mixed = every.where("mixed_script > 0").select("request_id", "char_start", "char_end")
    assert mixed.count() and mixed.subtract(left.select("request_id", "char_start", "char_end")).count() == 0


def test_plain_spans_read_as_columns_read_them(spark):
    rows = detect.described(detect.windows(_windows(spark))).where(F.col("normalized") != "").select("span_text", "normalized", phonetics.spelled(F.col("normalized")).alias("sound")).distinct().collect()
    plain = [r for r in rows if bounds.PLAIN.fullmatch(r["span_text"]) and bounds.plain_normalized(r["span_text"])]
    assert len(plain) > 1000
    assert all((bounds.plain_normalized(r["span_text"]), bounds.spelled(r["normalized"])) == (r["normalized"], r["sound"]) for r in plain)


def test_evidence_keeps_windows(spark, dictionary):
    requests = match.requests_of(spark.createDataFrame([("r1", "zzzzzz qqqqqq wwwwww", "en", [("zzzzzz", 0.2)])], "request_id string, text string, locale string, n_best array<struct<text string, confidence double>>"))
    assert detect.described(detect.windows(requests, heard=True), match.hopeful_spans(dictionary)).count() == 6


def _odd_requests(spark):
    plain = _windows(spark).select("request_id", "text", "locale").collect()
    none = None
    rows = [(*r, none, none) for r in plain] + [
        ("e1", "", "en", none, none), ("e2", " ... ", "en", none, none), ("e3", "metforman", none, none, none), ("e4", "metforman-\n'glucofage'  (iv)\tfoo--bar ’", "en", none, none),
        ("n1", "zzzzzz qqqqqq metforman", "en", [("zzzzzz", 0.2)], none), ("c1", "zzzzzz qqqqqq wwwwww kkkkkk", "en", none, [("zzzzzz", 0.2), ("qqqqqq", 1.0), ("wwwwww", none), ("kkkkkk", 0.9)]),
    ]
    heard = "array<struct<text string, confidence double>>"
    given = spark.createDataFrame(rows, f"request_id string, text string, locale string, n_best {heard}, heard {heard}")
    tokens = F.transform("heard", lambda t: F.struct(t["text"], F.lit(None).cast("int"), F.lit(None).cast("int"), t["confidence"], F.lit(None).cast("double"), F.lit(None).cast("double"))).cast(match.TOKENS)
    return match.requests_of(given.withColumn("tokens", tokens))


def test_windows_judged_by_request_are_those_judged_one_by_one(spark, dictionary):
    requests = _odd_requests(spark)
    for most in (1, 5):
        one_by_one = detect.described(detect.windows(requests, most, True), match.hopeful_spans(dictionary))
        judged = detect.described(detect.windows(requests, most, hopeful=match.hopeful_runs(dictionary, most)))
        assert judged.columns == one_by_one.columns and judged.count() > 10
        assert judged.exceptAll(one_by_one).count() == 0 and one_by_one.exceptAll(judged).count() == 0


def test_no_python_above_the_rows_of_windows(spark, dictionary, monkeypatch):
    """A Python function holds its input rows, on disk beyond memory; those of windows have all words of their request."""
    plans = []
    monkeypatch.setattr(detect, "stage", lambda df, name, f=detect.stage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, name))
    match.detected_spans(match.stage(_windows(spark), "requests"), dictionary)
    lines = next(p for p in plans if "Generate" in p).splitlines()
    python = [i for i, x in enumerate(lines) if "EvalPython" in x]
    assert len(python) == 1 and python[0] > next(i for i, x in enumerate(lines) if "Generate" in x)
