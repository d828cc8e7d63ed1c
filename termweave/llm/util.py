"""Helpers shared by the corpus operators: lineage cuts, safe column carrying, packed exchanges."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARRIED = "_tw_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the session runs on one machine (as in tests) a temporary folder takes its place.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="termweave-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/termweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tw_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``; only for tables that no returned plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.tw_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of plans that nothing refers to any more, now that a cut has replaced them.

    Spark's listener queues hold the end event of the last query, and with it that query's plan, until another event
    comes; the query of one row here takes its place.
    """
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def carry(df: DataFrame, kept: list[str] | None = None, **columns: Column) -> DataFrame:
    """The whole row (or its columns ``kept``) as one struct beside computed columns, so that no column name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if kept is None else kept)]).alias(CARRIED), *[c.alias(n) for n, c in columns.items()])


def texts_of(batch: pa.RecordBatch, column: str | None) -> pa.Array:
    """The text column of a batch of carried rows, read from the rows themselves; without a name, the computed column ``own``."""
    if column is None:
        return batch.column(batch.schema.get_field_index("own"))
    rows = batch.column(batch.schema.get_field_index(CARRIED))
    return rows.field(rows.type.get_field_index(column))


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = 256, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of at most ``most`` rows, fewer if the texts are long."""
    at = 0
    while at < batch.num_rows:
        own = texts.slice(at, most).to_pylist()
        held = 0
        for n, t in enumerate(own, 1):
            held += len(t or "")
            if held >= chars:
                break
        yield batch.slice(at, n), own[:n]
        at += n


def restore(df: DataFrame, columns: list[str], **put: Column) -> DataFrame:
    """The carried columns again; those in ``put`` replace columns of the same name or follow at the end."""
    kept = [put.get(c, F.col(f"{CARRIED}.`{c}`")).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in put.items() if k not in columns])


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, found without counting beyond that."""
    return df.limit(most + 1).count() <= most


def packed_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows of equal ``key`` as one table each; the input is sorted by ``key`` within the partition."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != at:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield at, pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, work: Callable, schema: str, groups: int = 0) -> DataFrame:
    """Bring rows of equal ``key`` together and run ``work(key, table) -> iterator of record batches`` on each group, one at a time.

    ``groups`` is how many keys to expect: beyond the session's shuffle partitions there are half as many partitions as keys, so that tasks do not grow with the input.
    """

    def run(batches):
        for k, table in packed_groups(batches, key):
            yield from work(k, table)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(-(-groups // 2), F.col(key)) if groups > 2 * parts else df.repartition(F.col(key))
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)
