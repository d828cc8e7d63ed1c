"""Line dedup by overlapping windows of consecutive lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import CARRIED, carry, cut, drop_cut, restore

BLANKS = " \t\r"
#: Windows of more than one in so many occurrences are met by a broadcast.
HOT_SHARE = 1000


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """d, t, and for each window of ``size`` lines its position and a hash of 128 bits (a, b); windows of blank lines only are left out.

    Each step is a projection of its own: an array that a lambda reads has to be a column, or it is made anew for every element.
    """
    lined = docs.select("d", "t", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= size)
    marked = lined.select("d", "t", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x, F.lit(BLANKS)) == "").alias("blank"))).alias("e"))

    def one(i: Column) -> Column:
        own = [F.get(F.col("e"), i + k) for k in range(size)]
        empty = own[0]["blank"]
        for e in own[1:]:
            empty = empty & e["blank"]
        hashes = [e["h"] for e in own]
        return F.when(~empty, F.struct(F.xxhash64(*hashes).alias("a"), F.xxhash64(F.lit("second"), *hashes[::-1]).alias("b"), i.alias("pos")))

    out = marked.select("d", "t", F.explode(F.transform(F.sequence(F.lit(0), F.size("e") - size), one)).alias("w"))
    return out.where("w IS NOT NULL").select("d", "t", "w.a", "w.b", "w.pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Remove lines covered by a window of ``window`` consecutive lines that occurred earlier.

    Lines are what stands between line feeds. Windows overlap (one starts at every line) and match by
    content. The order of occurrences is (id, text hash, position), null ids first; every occurrence but the
    first is removed, with the positions of overlapping removals merged into runs. Occurrences are judged on
    the input, not on what is left. Texts of fewer lines than ``window`` have no window and stay; windows of
    blank lines only do not count. Null texts stay null with 0 lines, an empty text has one line. Rows that
    repeat an id and a text are one document and get the same result. All input columns return; ``text_col``
    holds what is left (an empty string if nothing is), and n_lines, n_removed follow (or replace columns of
    these names).

    Scale: only hashes and positions are shuffled for the search, once written as a table. The first
    occurrence is a combinable minimum. Windows that make up over one in HOT_SHARE of all occurrences (at
    most HOT_SHARE of them, so) are met by a broadcast of their first occurrences, the others by a shuffle:
    no task takes the occurrences of one hot window. The texts move once, to meet their removals (at every size
    by a shuffle, as no bound keeps the removals small).
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = cut(_windows(docs.select(id_.alias("d"), F.xxhash64(text).alias("t"), text.alias("text")), window), "windows")
    first = found.groupBy("a", "b").agg(F.min(F.struct("d", "t", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(first.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first", "n"), "first")
    hot = F.col("n") > -(-found.count() // HOT_SHARE)
    same = (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))
    known = found.join(F.broadcast(first.where(hot)), same, "left")
    rest = known.where("fa IS NULL").select(*found.columns).join(first.where(~hot), same)
    later = known.where("fa IS NOT NULL").unionByName(rest).where(~F.struct("d", "t", "pos").eqNullSafe(F.col("first")))
    runs = later.groupBy("d", "t").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    runs = cut(runs.select(
        F.col("d").alias("rd"),
        F.col("t").alias("rt"),
        F.filter("p", lambda x, i: (i == 0) | (x > F.get(F.col("p"), i - 1) + window)).alias("begins"),
        F.transform(F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get(F.col("p"), i + 1) > x + window)), lambda x: x + window).alias("ends"),
    ), "runs")
    drop_cut(found)
    drop_cut(first)
    own = F.col(f"{CARRIED}.`{text_col}`")
    base = carry(docs, d=id_, t=F.xxhash64(text))
    joined = base.join(runs.hint("merge"), F.col("d").eqNullSafe(F.col("rd")) & (F.col("t") == F.col("rt")), "left")
    parts = joined.withColumn("lines", F.split(own, "\n", -1))
    bounds = F.sequence(F.lit(0), F.size("begins"))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("ends"), k - 1))
    stop = lambda k: F.when(k == F.size("begins"), F.size("lines")).otherwise(F.get(F.col("begins"), k))
    left = F.flatten(F.transform(bounds, lambda k: F.slice(F.col("lines"), start(k) + 1, stop(k) - start(k))))
    gone = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0), lambda s, x: s + x)
    none = F.col("begins").isNull()
    return restore(
        parts,
        docs.columns,
        **{
            text_col: F.when(none, own).otherwise(F.array_join(left, "\n")),
            "n_lines": F.when(own.isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long"),
            "n_removed": F.when(none, F.lit(0)).otherwise(gone).cast("long"),
        },
    )
