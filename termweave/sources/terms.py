"""Terminology sources and the dictionary that is built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import phonetics, text
from termweave.plans.stage import numbered, stage

TERM_SCHEMA = "concept_id string, term string, aliases array<string>, language string, risk_tier string, prior double, provenance string, pronunciations array<string>"
RRF = "RXCUI LAT TS LUI STT SUI ISPREF RXAUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF EMPTY".split()

# Which rows of a terminology release are taken, and the bundled development dictionary.
RELEASE = {"LAT": ["ENG"], "SUPPRESS": ["N"], "SAB": ["RXNORM"], "TTY": ["IN", "PIN", "MIN", "SCD", "SBD", "BN", "PSN", "SY"]}
BUNDLED = """\
RxCUI:6809,metformin,Glucophage|metformin hydrochloride,en,standard,0.95,RxNorm|RxTerms,mɛtˈfɔɹmɪn
RxCUI:5640,ibuprofen,Advil|Motrin,en,standard,0.92,RxNorm|RxTerms,ˌaɪbjuˈproʊfən
RxCUI:161,acetaminophen,Tylenol|paracetamol,en,standard,0.94,RxNorm|RxTerms,əˌsitəˈmɪnəfən
RxCUI:36567,simvastatin,Zocor,en,standard,0.80,RxNorm|RxTerms,ˌsɪmvəˈstætɪn
RxCUI:83367,atorvastatin,Lipitor,en,standard,0.91,RxNorm|RxTerms,əˌtɔɹvəˈstætɪn
RxCUI:29046,lisinopril,Zestril|Prinivil,en,standard,0.90,RxNorm|RxTerms,laɪˈsɪnəprɪl
RxCUI:32968,omeprazole,Prilosec,en,standard,0.89,RxNorm|RxTerms,oʊˈmɛprəzoʊl
RxCUI:723,amoxicillin,Amoxil,en,standard,0.91,RxNorm|RxTerms,əˌmɑksɪˈsɪlɪn
RxCUI:7980,penicillin,penicillin V|penicillin G,en,high,0.82,RxNorm|RxTerms,ˌpɛnɪˈsɪlɪn
RxCUI:2551,ciprofloxacin,Cipro,en,high,0.72,RxNorm|RxTerms,ˌsɪproʊˈflɑksəsɪn
RxCUI:11289,warfarin,Coumadin|Jantoven,en,critical,0.88,RxNorm|RxTerms,ˈwɔɹfərɪn
RxCUI:5224,heparin,unfractionated heparin,en,critical,0.84,RxNorm|RxTerms,ˈhɛpərɪn
RxCUI:67108,enoxaparin,Lovenox,en,critical,0.79,RxNorm|RxTerms,ɪˌnɑksəˈpærɪn
RxCUI:1191,aspirin,ASA,en,high,0.94,RxNorm|RxTerms,ˈæspərɪn
RxCUI:7052,morphine,MS Contin,en,critical,0.70,RxNorm|RxTerms,ˈmɔɹfin
RxCUI:7804,oxycodone,OxyContin,en,critical,0.77,RxNorm|RxTerms,ˌɑksiˈkoʊdoʊn
RxCUI:4337,fentanyl,Sublimaze,en,critical,0.74,RxNorm|RxTerms,ˈfɛntənɪl
RxCUI:8640,prednisone,Deltasone,en,standard,0.78,RxNorm|RxTerms,ˈprɛdnɪsoʊn
RxCUI:72625,albuterol,salbutamol|Ventolin,en,standard,0.87,RxNorm|RxTerms,ælˈbjutərɔl
RxCUI:6470,lorazepam,Ativan,en,critical,0.65,RxNorm|RxTerms,lɔˈræzəpæm
RxCUI:3322,diazepam,Valium,en,critical,0.61,RxNorm|RxTerms,daɪˈæzəpæm
RxCUI:596,amlodipine,Norvasc,en,standard,0.88,RxNorm|RxTerms,æmˈloʊdəpin
RxCUI:6918,metoprolol,Lopressor|Toprol XL,en,standard,0.86,RxNorm|RxTerms,mɛˈtoʊprəlɔl
RxCUI:2599,clonidine,Catapres,en,high,0.58,RxNorm|RxTerms,ˈklɑnɪdin
RxCUI:2598,clonazepam,Klonopin,en,critical,0.56,RxNorm|RxTerms,kloʊˈnæzəpæm
LOCAL:cbc,complete blood count,CBC|full blood count,en,standard,0.90,local,C B C
LOCAL:myocardial-infarction,myocardial infarction,MI|heart attack,en,high,0.83,local,ˌmaɪoʊˈkɑɹdiəl ɪnˈfɑɹkʃən
LOCAL:hypertension,hypertension,high blood pressure|HTN,en,standard,0.92,local,ˌhaɪpərˈtɛnʃən
LOCAL:diabetes-mellitus,diabetes mellitus,diabetes|DM,en,standard,0.95,local,ˌdaɪəˈbitiz məˈlaɪtəs
LOCAL:appendectomy,appendectomy,appendix removal,en,standard,0.60,local,ˌæpənˈdɛktəmi"""


def parts(col: Column) -> Column:
    """A list written with bars: trimmed items, empty ones dropped; null: none."""
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def _typed(rows: DataFrame) -> DataFrame:
    given = lambda c, default: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(default))
    return rows.select(
        "concept_id", "term", parts(F.col("aliases")).alias("aliases"), given("language", "en").alias("language"), given("risk_tier", "standard").alias("risk_tier"),
        given("prior", "0.5").cast("double").alias("prior"), given("provenance", "local").alias("provenance"), parts(F.col("pronunciations")).alias("pronunciations"), "line",
    )


COLUMNS = "concept_id term aliases language risk_tier prior provenance pronunciations".split()


def read_csv_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a CSV file with a header (a byte order mark is taken off), in file order (line)."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    for c in COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return _typed(raw.withColumn("line", F.monotonically_increasing_id()))


def read_json_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON list."""
    raw = spark.read.schema(TERM_SCHEMA).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    fill = {"language": F.lit("en"), "risk_tier": F.lit("standard"), "prior": F.lit(0.5), "provenance": F.lit("local"), "aliases": none, "pronunciations": none}
    return raw.select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in COLUMNS], F.monotonically_increasing_id().alias("line"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return read_json_terms(spark, path) if path.lower().endswith(".json") else read_csv_terms(spark, path)


def bundled_terms(spark: SparkSession) -> DataFrame:
    rows = [(*line.split(","), i) for i, line in enumerate(BUNDLED.split("\n"))]
    return _typed(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS) + ", line long"))


def release_terms(lines: DataFrame, max_concepts: int | None = None) -> DataFrame:
    """Concepts of a terminology release from its lines (value, line), one row a concept in the order of their first line.

    Lines of fewer than 19 fields are skipped. The preferred name is the first marked so, else the first; the
    other names, in order and each once, are aliases. ``max_concepts`` keeps whole concepts.
    """
    fields = F.split("value", r"\|", -1)
    rows = lines.select("line", fields.alias("f")).where(F.size("f") >= len(RRF)).select("line", *[F.get("f", i).alias(c) for i, c in enumerate(RRF)])
    for c, values in RELEASE.items():
        rows = rows.where(F.col(c).isin(values))
    rows = rows.where(F.trim("STR") != "")
    found = rows.groupBy("RXCUI").agg(
        F.min("line").alias("line"),
        F.min_by("STR", F.struct((F.col("ISPREF") != "Y").alias("other"), "line")).alias("term"),
        F.transform(F.sort_array(F.collect_list(F.struct("line", "STR"))), lambda x: x["STR"]).alias("names"),
    )
    out = found.select(
        F.concat(F.lit("RxCUI:"), "RXCUI").alias("concept_id"), "term", F.array_remove(F.array_distinct("names"), F.col("term")).alias("aliases"), F.lit("en").alias("language"),
        F.lit("standard").alias("risk_tier"), F.lit(0.5).alias("prior"), F.lit("RxNorm").alias("provenance"), F.array().cast("array<string>").alias("pronunciations"), "line",
    )
    return out.orderBy("line").limit(max_concepts) if max_concepts else out


def read_release(spark: SparkSession, path: str, max_concepts: int | None = None) -> DataFrame:
    return release_terms(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()), max_concepts)


def write_csv_terms(terms: DataFrame, path: str) -> None:
    flat = terms.orderBy("line").select(*[F.array_join(c, "|").alias(c) if c in ("aliases", "pronunciations") else F.col(c) for c in COLUMNS])
    flat.write.mode("overwrite").csv(path, header=True)


@dataclass(frozen=True)
class Dictionary:
    """A dictionary version: its entries, the name -> curated pronunciations table, and where it came from."""

    entries: DataFrame
    version: str
    source_sha256: str | None = None
    lexicon: DataFrame | None = None  # word, arpabet, place: pronunciations of English words, of which the first two by place (else by arpabet) count

    def aliases(self) -> DataFrame:
        return self.entries.select("entry_id", F.posexplode("normalized_aliases").alias("place", "alias"))

    def forms(self) -> DataFrame:
        return self.entries.select("entry_id", F.explode("pronunciation_forms").alias("form"))

    def grams(self) -> DataFrame:
        return self.forms().select("entry_id", F.explode(phonetics.ngrams(F.col("form"))).alias("gram")).distinct()

    def curated(self) -> DataFrame:
        """alias, curated pronunciations; of entries that share a name the last counts."""
        named = self.entries.where(F.size("pronunciations") > 0).select("entry_id", "pronunciations", F.explode("normalized_aliases").alias("alias"))
        return named.groupBy("alias").agg(F.max_by("pronunciations", "entry_id").alias("curated"))


def build_dictionary(terms: DataFrame, version: str, source_sha256: str | None = None, lexicon: DataFrame | None = None) -> Dictionary:
    """Entries numbered in source order, with normalised names and pronunciation forms of all names."""
    placed = numbered(terms, "line", "entry_id").withColumn("entry_id", F.col("entry_id") - 1).drop("line")
    names = F.concat(F.array("term"), "aliases")
    entries = placed.withColumn("normalized_term", text.normalize_term(F.col("term"), F.col("language")))
    place = entries.select("entry_id", "language", F.posexplode(names).alias("at", "name"))
    named = place.select("entry_id", "language", "at", text.normalize_term(F.col("name"), F.col("language")).alias("alias"))
    grouped = named.groupBy("entry_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"])).alias("normalized_aliases"))
    entries = stage(entries.join(grouped, "entry_id"), "names")
    curated = Dictionary(entries.withColumn("pronunciation_forms", F.array().cast("array<string>")), version).curated()
    spoken = pronounce(named.where("alias <> ''").withColumnRenamed("alias", "normalized"), curated, lexicon)
    forms = spoken.groupBy("entry_id").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", F.transform("pronunciations", lambda p: p["value"]).alias("v")))), lambda x: x["v"]))).alias("pronunciation_forms"))
    entries = entries.join(forms, "entry_id", "left").withColumn("pronunciation_forms", F.coalesce("pronunciation_forms", F.array().cast("array<string>")))
    return Dictionary(stage(entries, "dictionary"), version, source_sha256, lexicon)


def pronounce(rows: DataFrame, curated: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds pronunciations, array<struct<value,alphabet,source>>, to rows with normalized and language.

    Tiers: curated by the whole text; for English the lexicon, if every word is in it (two variants a word at
    most, three phrases at most); else what the spelling suggests, if anything.
    """
    one = lambda value, alphabet, source: F.struct(value.alias("value"), F.lit(alphabet).alias("alphabet"), F.lit(source).alias("source"))
    out = rows.join(curated.withColumnRenamed("alias", "_alias"), F.col("normalized") == F.col("_alias"), "left").drop("_alias")
    fallback = phonetics.spelled(F.col("normalized"))
    tiers = [F.when(F.size("curated") > 0, F.transform("curated", lambda v: one(v, "ipa", "curated")))]
    if lexicon is not None:
        place = F.col("place") if "place" in lexicon.columns else F.lit(0)
        words = lexicon.groupBy("word").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), "arpabet"))), lambda x: x["arpabet"]), 1, 2).alias("said")).select("word", F.transform("said", phonetics.arpabet_to_ipa).alias("said"))
        texts = rows.where("language = 'en' AND normalized <> ''").select("normalized").distinct()
        split = texts.select("normalized", F.posexplode(F.split("normalized", " ")).alias("at", "word")).join(words, "word", "left")
        phrases = split.groupBy("normalized").agg(F.count(F.when(F.col("said").isNull(), 1)).alias("missing"), F.sort_array(F.collect_list(F.struct("at", "said"))).alias("w")).where("missing = 0")
        joined = F.aggregate("w", F.array(F.lit("")), lambda acc, x: F.flatten(F.transform(acc, lambda p: F.transform(x["said"], lambda v: F.concat(p, v)))))
        phrases = phrases.select(F.col("normalized").alias("_phrase"), F.slice(F.array_distinct(joined), 1, 3).alias("spoken"))
        out = out.join(phrases, (F.col("normalized") == F.col("_phrase")) & (F.col("language") == "en"), "left").drop("_phrase")
        tiers.append(F.when(F.col("spoken").isNotNull(), F.transform("spoken", lambda v: one(v, "ipa", "cmudict"))))
    tiers.append(F.when(fallback != "", F.array(one(fallback, "fallback", "fallback"))))
    none = F.array().cast("array<struct<value:string,alphabet:string,source:string>>")
    made = F.coalesce(*tiers, none)
    return out.withColumn("pronunciations", F.when(F.col("normalized") == "", none).otherwise(made)).drop("curated", "spoken")


_bundled: dict[str, tuple[object, Dictionary]] = {}


def bundled_dictionary(spark: SparkSession, version: str = "bundled") -> Dictionary:
    """The bundled dictionary, built once a session and version."""
    held = _bundled.get(version)
    if held is None or held[0] is not spark:
        held = _bundled[version] = spark, build_dictionary(bundled_terms(spark), version)
    return held[1]


def source_sha256(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]


def write_dictionary(dictionary: Dictionary, path: str) -> None:
    """Entries and a one-row description, as Parquet."""
    spark = dictionary.entries.sparkSession
    dictionary.entries.write.mode("overwrite").parquet(f"{path}/entries")
    about = spark.createDataFrame([(dictionary.version, dictionary.source_sha256)], "artifact_version string, source_sha256 string")
    about.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/about")


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    about = spark.read.parquet(f"{path}/about").first()
    return Dictionary(spark.read.parquet(f"{path}/entries"), about["artifact_version"], about["source_sha256"])


def build_from_file(spark: SparkSession, source: str, output: str, version: str | None = None) -> Dictionary:
    """Read terms, build, write, and read back; without a name the version is made of the date and the source's hash."""
    from datetime import UTC, datetime

    digest = source_sha256(spark, source)
    version = version or f"dict_{datetime.now(UTC).date().isoformat()}_{digest[:8]}"
    write_dictionary(build_dictionary(read_terms(spark, source), version, digest), output)
    return read_dictionary(spark, output)
