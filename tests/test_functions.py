import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from termweave.functions import ids, phonetics, similarity, text

SAMPLES = ["  Metformin—500 mg  PO Tablet  ", "met for men's co-trimoxazole", "metформин", "मेटफॉर्मिन लें", "メトホルミン錠", "Straße ﬁne Ⅷ", "", " ", "120/80", "μg", "x_y z-1"]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens_have_the_offsets_of_the_original(spark):
    got = column(spark, SAMPLES, text.tokens)
    for s, words in zip(SAMPLES, got, strict=True):
        assert all(s[w["start"] : w["end"]] == w["text"] for w in words)
        assert [w["text"] for w in words] == [m.group() for m in re.finditer(r"\b[\w][\w'’-]*\b", s)]


def test_normalisation(spark):
    def plain(s):
        s = unicodedata.normalize("NFKC", s).replace("’", "'").replace("–", "-").replace("—", "-")
        return re.sub(r"\s+", " ", s).strip().casefold()

    assert column(spark, SAMPLES, text.normalize_text) == [plain(s) for s in SAMPLES]
    fields = column(spark, SAMPLES[:1], text.medication_fields)[0]
    assert (fields["strengths"], fields["routes"], fields["dosage_forms"]) == (["500mg"], ["po"], ["tablet"])
    assert column(spark, SAMPLES[:1], text.strip_structured) == ["metformin"]


def test_scripts(spark):
    assert column(spark, ["metformin", "metформин", "120", "メトホルミン錠", "μg", "é"], text.scripts) == [["Latn"], ["Cyrl", "Latn"], ["Zyyy"], ["Hani", "Kana"], ["Latn", "Zyyy"], ["Latn"]]


def test_sounds(spark):
    assert column(spark, ["M EH1 T F AO0 R"], phonetics.arpabet_to_ipa) == ["mɛtfɔɹ"]
    assert column(spark, ["phone cell", "метформин"], phonetics.spelled) == ["fonesell", ""]
    assert set(column(spark, ["abc"], phonetics.ngrams)[0]) == {"^ab", "abc", "bc$"}
    assert column(spark, ["a"], lambda c: phonetics.edit_similarity(c, F.lit("ab"))) == [0.5]


def test_string_similarity():
    assert similarity.ratio("metformin", "metformin") == 100.0
    assert similarity.ratio("ab", "ba") == similarity.ratio("ba", "ab") == 50.0
    assert similarity.weighted_ratio("", "x") == 0.0
    assert similarity.weighted_ratio("count blood", "blood count") == 95.0
    assert similarity.partial_ratio("form", "metformin") == 100.0


def test_span_ids_are_version_five(spark):
    request = str(uuid.uuid4())
    df = spark.createDataFrame([(request, 3, 9)], "r string, a int, b int")
    assert df.select(ids.span_id(F.col("r"), F.col("a"), F.col("b")).alias("v")).first()["v"] == str(uuid.uuid5(uuid.UUID(request), "3:9"))
