"""Candidate retrieval: exact names, similar names, shared sounds; and dictionary search."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import phonetics, text
from termweave.functions.similarity import weighted_ratio, weighted_ratio_udf
from termweave.sources.terms import Dictionary

#: Names of a dictionary that are broadcast, at most (some 100 bytes each); beyond, names are met in blocks of as many.
BROADCAST_NAMES = 100_000
CUTOFF, SEARCH_CUTOFF = 35.0, 25.0


def small(names: DataFrame) -> bool:
    """Whether a table of names or forms may be broadcast."""
    return names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES


def _scored_blocks(keys: DataFrame, names: DataFrame, cutoff: float, most: int) -> DataFrame:
    """Every key scored against every name, the names in blocks of BROADCAST_NAMES; of each Arrow batch the best ``most`` a key, so little is sorted or shuffled."""

    def work(batches):
        for b in batches:
            b["similarity"] = [weighted_ratio(x, y) for x, y in zip(b["normalized"], b["alias"], strict=True)]
            b = b[b["similarity"] >= cutoff].sort_values(["similarity", "entry_id", "place"], ascending=[False, True, True])
            yield b.groupby("normalized", sort=False).head(most)

    blocks = -(-names.count() // BROADCAST_NAMES)
    pairs = keys.select("normalized").crossJoin(names.repartition(blocks).hint("shuffle_replicate_nl"))
    return pairs.mapInPandas(work, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pairs.schema)}, similarity double")


def similar_names(keys: DataFrame, dictionary: Dictionary, cutoff: float, most: int) -> DataFrame:
    """The ``most`` names most like each ``normalized`` (at least ``cutoff``), ties in dictionary order.

    Every name is scored. A small dictionary is broadcast; a larger one is met block by block, without a
    broadcast and with the same result.
    """
    names = dictionary.aliases().select("entry_id", "place", "alias")
    if small(names):
        pairs = keys.crossJoin(F.broadcast(names))
        scored = pairs.withColumn("similarity", weighted_ratio_udf("normalized", "alias")).where(F.col("similarity") >= cutoff)
    else:
        scored = _scored_blocks(keys, names, cutoff, most)
    order = Window.partitionBy("normalized").orderBy(F.desc("similarity"), "entry_id", "place")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def retrieve(keys: DataFrame, dictionary: Dictionary, most: int = 20) -> DataFrame:
    """normalized, entry_id, orthographic (0 to 1), matched_alias for keys with normalized, sounds (array<string>).

    Three channels are joined: the exact name, the ``most`` most similar names, the ``most`` entries that share
    most sound trigrams. Only the second gives scores.
    """
    texts = keys.select("normalized", "sounds").dropDuplicates(["normalized"])
    alike = similar_names(texts.select("normalized"), dictionary, CUTOFF, most)
    best = alike.groupBy("normalized", "entry_id").agg((F.max("similarity") / 100).alias("orthographic"), F.max_by("alias", F.struct("similarity", -F.col("rank"))).alias("matched_alias"))
    nothing = (F.lit(None).cast("double").alias("orthographic"), F.lit(None).cast("string").alias("matched_alias"))
    exact = exact_entries(texts, dictionary).select("normalized", "entry_id", *nothing)
    sounding = sounding_entries(texts, dictionary, most).select("normalized", "entry_id", *nothing)
    return merged([best, exact, sounding])


def exact_entries(keys: DataFrame, dictionary: Dictionary) -> DataFrame:
    """normalized, entry_id for the entries that have the name itself."""
    names = dictionary.aliases().select(F.col("alias").alias("normalized"), "entry_id").distinct()
    return keys.select("normalized").distinct().join(names, "normalized")


def sounding_entries(keys: DataFrame, dictionary: Dictionary, most: int) -> DataFrame:
    """normalized, entry_id, hits, rank of the ``most`` entries that share most sound trigrams with each key's sounds; ties to earlier entries."""
    grams = keys.select("normalized", F.explode("sounds").alias("sound")).select("normalized", F.explode(phonetics.ngrams(F.col("sound"))).alias("gram"))
    shared = grams.join(dictionary.grams(), "gram").groupBy("normalized", "entry_id").agg(F.count(F.lit(1)).alias("hits"))
    order = Window.partitionBy("normalized").orderBy(F.desc("hits"), "entry_id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def merged(channels: list[DataFrame]) -> DataFrame:
    """An entry once a key, with the score of the channel that gave one."""
    every = functools.reduce(DataFrame.unionByName, channels)
    return every.groupBy("normalized", "entry_id").agg(F.max("orthographic").alias("orthographic"), F.max("matched_alias").alias("matched_alias"))


def best_sound(pairs: DataFrame, by: list[str]) -> DataFrame:
    """For rows ``by`` with sound and form: feature and trigram of the pair that is best at 0.7 and 0.3 of them."""
    likeness = pairs.withColumn("feature", phonetics.feature_similarity(F.col("sound"), F.col("form"))).withColumn("trigram", phonetics.ngram_similarity(F.col("sound"), F.col("form")))
    top = likeness.groupBy(*by).agg(F.max_by(F.struct("feature", "trigram"), 0.7 * F.col("feature") + 0.3 * F.col("trigram")).alias("b"))
    return top.select(*by, "b.feature", "b.trigram")


def search(queries: DataFrame, dictionary: Dictionary, limit: int = 10) -> DataFrame:
    """query, rank and the concepts whose names are most like ``query``; an empty query finds nothing."""
    keys = queries.select("query", text.normalize_term(F.col("query"), "en").alias("normalized")).where("normalized <> ''")
    alike = similar_names(keys.select("normalized").distinct(), dictionary, SEARCH_CUTOFF, max(3 * limit, 20))
    best = alike.groupBy("normalized", "entry_id").agg(F.max("similarity").alias("s"), F.min("rank").alias("first"))
    order = Window.partitionBy("normalized").orderBy(F.desc("s"), "first")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    found = top.join(dictionary.entries, "entry_id").join(keys, "normalized")
    return found.select("query", "rank", "concept_id", "term", "aliases", "language", "risk_tier", "provenance", F.bround(F.col("s") / 100, 4).alias("similarity"))
