"""Stage tables: results that later steps read more than once, written to the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and the session runs on one machine, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="termweave-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: short plans, and nothing to recompute when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/termweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of ``by``. Range partitions and their sizes, so no single task takes all rows."""
    parts = stage(df.orderBy(by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordered")
    offsets, total = [], 1
    for row in sorted(parts.groupBy("_part").count().collect()):  # a row a partition
        offsets += [F.lit(row["_part"]), F.lit(total)]
        total += row["count"]
    place = F.create_map(*offsets)[F.col("_part")] + F.col("_at") if offsets else F.lit(1).cast("long")
    return parts.withColumn(name, place).drop("_part", "_at")


#: A key of more than this share of all rows is met by a broadcast, so at most as many keys as this.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """``left`` joined with the one row of ``right`` for each of its ``keys``, which may be hot (keys are not null).

    ``copies`` of ``right`` says how many rows of ``left`` have the key. The few keys that make up much of all
    rows come by a broadcast, the others by a shuffle, so no task takes the rows of one hot key. Both sides are
    read twice and should be stage tables.
    """
    total = right.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) > max(100, -(-total // HOT_SHARE))
    known = right.select("*", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).drop(*keys)
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    first = left.join(F.broadcast(known.where(hot)), same, "left")
    rest = first.where("_k0 IS NULL").select(*left.columns).join(known.where(~hot), same)
    return first.where("_k0 IS NOT NULL").unionByName(rest).drop(copies, *names)
