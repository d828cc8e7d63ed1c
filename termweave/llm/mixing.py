"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import carry, cut, drop_cut, restore, small_enough

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: At most so many sources are broadcast (a source's row takes some 100 bytes); beyond, a shuffled join.
BROADCAST_SOURCES = 20_000
SEEDS = 16


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank: 0 for the first source by code point, null last; offsets of range partitions, so no single task sorts all."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    placed = cut(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranks")
    offsets, total = [], 0
    for row in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        offsets += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    return placed.select("source", "source_size", (F.col("at") + offset).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target for a table (source, source_size), one row a source.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes by weight. A
    target stops at ``most`` times its source's size; what exceeds it is shared again by weight among the
    others until none is above. Only sums reach the driver, one round for each set of capped sources.
    """
    ranked = cut(_ranked(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    cap = F.lit(float(most)) * F.col("source_size")
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["all"] or not row["open"]:
            break
        capped, level = row["capped"], (row["all"] - row["fixed"]) / row["open"]
    return ranked.select("source", "source_size", F.least(cap, F.lit(level or 0.0) * F.col("weight")).alias("target"))


def _copies(rate: Column, unit: Column) -> Column:
    return (F.floor(rate) + (unit < rate - F.floor(rate)).cast("long")).cast("long")


def _unit(seed: int, id_: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text only."""
    return F.pmod(F.xxhash64(F.lit(f"mix{seed}"), id_, text), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=3.0, seeds: int = SEEDS) -> DataFrame:
    """Each row of ``docs`` with size, source_size, target and copies (added or replacing columns of these names).

    The rate of a source is target / source_size, at most ``most``. A document is taken floor(rate) times,
    and once more if its hash, taken as a number in [0, 1), lies under the fraction of the rate. Each source
    uses, of ``seeds`` hash seeds, the one whose copies come nearest to its target (the smallest such seed),
    so a rerun takes the same. Null texts have size 0 and are taken like others, adding no words; a null
    source is a source of its own, the last; rows that repeat id and text share their hash. A source without
    words gets rate 0.

    Scale: the documents are aggregated to one row a source (combined before the shuffle), so a hot source
    is no hot task; the rates come back by a broadcast if there are at most BROADCAST_SOURCES sources, else
    by a join.
    """
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    sizes = cut(docs.select(id_.alias("d"), F.xxhash64(text).alias("t"), source.alias("source"), word_count(text).alias("size")), "sizes")
    targets = cut(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    few = small_enough(targets, BROADCAST_SOURCES)

    def meet(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        right = right.withColumnRenamed("source", "source_of")
        return left.join(F.broadcast(right) if few else right, F.col(name).eqNullSafe(F.col("source_of")), "left").drop("source_of")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    words = [F.sum(F.col("size") * _copies(F.col("rate"), _unit(s, F.col("d"), F.col("t")))).alias(f"w{s}") for s in range(seeds)]
    trial = meet(sizes, targets.select("source", "target", rate.alias("rate")), "source").groupBy("source").agg(F.first("target").alias("target"), F.first("rate").alias("rate"), *words)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))["seed"]
    chosen = cut(trial.select("source", best.alias("seed"), "rate", "target"), "seeds")
    rates = chosen.join(targets.select(F.col("source").alias("own"), "source_size"), F.col("own").eqNullSafe(F.col("source"))).drop("own")
    base = carry(docs, d=id_, t=F.xxhash64(text), from_source=source, size=word_count(text))
    units = F.element_at(F.array(*[_unit(s, F.col("d"), F.col("t")) for s in range(seeds)]), F.col("seed") + 1)
    out = restore(
        meet(base, rates, "from_source"),
        docs.columns,
        size=F.col("size"),
        source_size=F.col("source_size").cast("long"),
        target=F.col("target").cast("double"),
        copies=_copies(F.col("rate"), units),
    )
    drop_cut(sizes)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix_counts`` takes it, with the columns of ``docs``."""
    counted = mix_counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{options.get(k, v)}`").alias(v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]), **{k: v for k, v in options.items() if not k.endswith("_col")})
    return counted.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
