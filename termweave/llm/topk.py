"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of per-query lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import by_key, cut

TILE_QUERIES, TILE_ROWS, FAN_IN = 512, 4096, 8
#: Partitions of either side of the grid of blocks, at most.
MOST_PARTS = 1000
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as a double (whole numbers; beyond 2^53 they are still exact multiples)."""
    return F.transform(vector, lambda x: _floor(x.cast("double") * scale))


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) >= 2.0**52, x).otherwise(F.floor(x).cast("double"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole-number doubles. Where sums might pass 2^53, exact integers are used; longs saturate."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return np.rint(q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T
    return np.clip(exact, *LONG).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; partial selection first."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
        if len(at) > 4 * k:  # many ties at the edge: of these the smallest ids
            above, level = at[scores[at] > kth], at[scores[at] == kth]
            need = k - len(above)
            level = level[np.argpartition(ids[level], need - 1)[:need]] if need < len(level) else level
            at = np.concatenate([above, level])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]


BLOCKS = pa.schema([("part", pa.int32()), ("made", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors of one length packed into matrices of at most ``rows`` rows: part and made (which of the part) name one; size, ids, data."""
    schema = "part int, made int, size int, ids binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part, made = pyspark.TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, list[float]]]] = {}

        def out(size: int) -> pa.RecordBatch:
            nonlocal made
            own = held.pop(size)
            ids = np.array([i for i, _ in own], "<i8").tobytes()
            data = np.array([v for _, v in own], "<f8").tobytes()
            made += 1
            return pa.RecordBatch.from_pylist([{"part": part, "made": made - 1, "size": size, "ids": ids, "data": data}], schema=BLOCKS)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= rows:
                    yield out(len(v))
        for size in list(held):
            yield out(size)

    return vectors.mapInArrow(run, schema)


def _numbered(blocks: DataFrame) -> tuple[Column, int]:
    """A number from 0 on for each block, without gaps, and how many there are; a row a partition reaches the driver."""
    offsets, total = [], 0
    for row in sorted(blocks.groupBy("part").count().collect()):
        offsets += [F.lit(row["part"]), F.lit(total).cast("long")]
        total += row["count"]
    return (F.create_map(*offsets)[F.col("part")] + F.col("made") if offsets else F.lit(0).cast("long")), total


def _pack(ids: np.ndarray, scores: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes() + scores.astype("<i8").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)


LISTS = pa.schema([("tile", pa.string()), ("branch", pa.int64()), ("query", pa.binary()), ("lists", pa.list_(pa.binary()))])
LISTS_SQL = "tile string, branch long, query binary, lists array<binary>"


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those of the query's
    own id; ties go to smaller ids. Rows with a null id or vector, or with null or non-finite components, take
    no part; vectors meet vectors of their own length only (empty ones score 0 with each other). A candidate
    that stands in several rows is listed as often; rows that repeat a query's id and vector are one query.
    Scores that pass a long saturate. Fewer than k candidates: all.

    Scale: queries and rows are packed into matrices; each pair of a query tile and a row shard is one matrix
    product with a partial selection, so what leaves a pair is k rows a query. Lists of a tile are merged
    FAN_IN shards at a time, so no task takes the lists of more than FAN_IN shards of one tile.
    """
    id_, v = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    usable = id_.isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(id_.cast("long").alias("id"), quantised(v, scale).alias("v"))
    rows = cut(rows, "vectors")
    shards = cut(_blocks(rows, TILE_ROWS), "shards")
    tiles = cut(_blocks(rows.where(F.col("id") % every == 0).distinct(), TILE_QUERIES), "tiles")
    branch, many = _numbered(shards)
    spread = lambda df, n: df.repartition(max(1, min(n, MOST_PARTS)))
    pairs = spread(tiles.select(F.concat_ws("-", "part", "made").alias("tile"), "size", F.col("ids").alias("q_ids"), F.col("data").alias("q")), tiles.count()).crossJoin(
        spread(shards.select(branch.alias("branch"), F.col("size").alias("c_size"), F.col("ids").alias("c_ids"), F.col("data").alias("c")), many)
    )  # blocks of the stated query set with blocks of rows; joined on the length, all would be one key

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["size"] != row["c_size"]:
                    continue
                q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
                q = np.frombuffer(row["q"], "<f8").reshape(len(q_ids), row["size"])
                c = np.frombuffer(row["c"], "<f8").reshape(len(c_ids), row["size"])
                scores, lists = products(q, c), []
                for i, own in enumerate(q_ids):
                    other = c_ids != own
                    ids, s = (c_ids, scores[i]) if other.all() else (c_ids[other], scores[i][other])
                    at = best(ids, s, k)
                    lists.append(_pack(ids[at], s[at]))
                yield pa.RecordBatch.from_pylist([{"tile": row["tile"], "branch": row["branch"], "query": row["q_ids"], "lists": lists}], schema=LISTS)

    def merge(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = table.to_pylist()
        lists = []
        for i in range(len(rows[0]["lists"])):
            got = [_unpack(r["lists"][i]) for r in rows]
            ids, s = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            at = best(ids, s, k)
            lists.append(_pack(ids[at], s[at]))
        yield pa.RecordBatch.from_pylist([{"tile": rows[0]["tile"], "branch": rows[0]["branch"], "query": rows[0]["query"], "lists": lists}], schema=LISTS)

    merged, left = pairs.mapInArrow(multiply, LISTS_SQL), many
    while left > 1:
        left = -(-left // FAN_IN)
        merged = merged.withColumn("branch", F.floor(F.col("branch") / FAN_IN).cast("long"))
        merged = by_key(merged.withColumn("key", F.concat_ws(":", "tile", "branch")), "key", merge, LISTS_SQL)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for query, raw in zip(np.frombuffer(row["query"], "<i8"), row["lists"], strict=True):
                    ids, s = _unpack(raw)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, query)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ids), pa.array(s)], names=["query_id", "rank", "vec_id", "score"])

    return merged.mapInArrow(lay_out, "query_id long, rank int, vec_id long, score long")
