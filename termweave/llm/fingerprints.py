"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing labels each symbol by where and how its bits first differ from its left
neighbour's; a few rounds leave few labels, and their local maxima cut the text into phrases. A phrase is
named by what it holds, the names are the symbols of the next level, and so on up to one name. Where to cut
depends on a few neighbours only, so equal substrings get the same phrases inside, at whatever offset.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names kept of a text (the smallest), and the level below which names are too common to tell texts apart.
KEPT, FIRST_LEVEL = 64, 2
_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _toss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit's place, plus that bit of ``x``."""
    differ = x ^ before
    low = differ & (~differ + np.uint64(1))
    place = (low.astype(np.float64).view(np.int64) >> 52) - 1023  # exact for powers of two
    return 2 * place + ((x & low) != 0)


_SMALL = _toss(*(a.astype(np.uint64) for a in np.broadcast_arrays(np.arange(128)[:, None], np.arange(128)[None, :] + 128 * (np.arange(128)[:, None] == np.arange(128)[None, :])))).astype(np.uint8).ravel()


def _level(x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of sequences laid end to end (beginning at ``start``), and where the sequences begin among them."""
    first = np.zeros(len(x), bool)
    first[start] = True
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)  # runs of one symbol become one symbol
    run = np.diff(at, append=len(x))
    x, first = x[at], first[at]
    long = run > 1
    x[long] = _mix(x[long] + _GOLD * run[long].astype(np.uint64))
    before = np.empty_like(x)
    before[1:] = x[:-1]
    edge = np.flatnonzero(first)
    before[edge] = x[edge] ^ np.uint64(1)
    label = _toss(x, before).astype(np.uint8)
    for _ in range(2):
        other = np.empty_like(label)
        other[1:] = label[:-1]
        other[edge] = label[edge] ^ 1
        label = _SMALL[label.astype(np.uint16) * 128 + other]
    up = np.empty(len(x), bool)
    up[1:] = label[1:] > label[:-1]
    up[edge] = True
    down = np.empty(len(x), bool)
    down[:-1] = label[:-1] > label[1:]
    down[np.r_[edge[1:] - 1, len(x) - 1]] = True
    cut = up & down
    cut[edge] = True
    cuts = np.flatnonzero(cut)
    size = np.diff(cuts, append=len(x))
    inside = np.arange(len(x)) - np.repeat(cuts, size)
    names = np.add.reduceat(_mix(x + _GOLD * (inside + 1).astype(np.uint64)), cuts)
    return _mix(names ^ (size.astype(np.uint64) << np.uint64(48))), np.searchsorted(cuts, edge)


def _names(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct 32-bit names of its phrases from FIRST_LEVEL up, and of the last, which is the whole text."""
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    live = [i for i, t in enumerate(texts) if t]
    if not live:
        return [np.zeros(0, np.uint32) for _ in texts]
    parts = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in live]
    start = np.cumsum([0, *map(len, parts[:-1])])
    x, depth, owner = _mix(np.concatenate(parts).astype(np.uint64) + np.uint64(1)), 0, np.array(live)
    while len(owner):
        x, start = _level(x, start)
        depth += 1
        stop = np.r_[start[1:], len(x)]
        short = (_mix(x + np.uint64(depth)) >> np.uint64(32)).astype(np.uint32)
        for i, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True):
            out[i].append((depth, short[a:b]))
        more = stop - start > 1
        x = x[np.repeat(more, stop - start)]
        start, owner = np.cumsum(np.r_[0, (stop - start)[more]])[:-1], owner[more]
    done = []
    for levels in out:
        high = [n for d, n in levels if d >= FIRST_LEVEL or len(n) == 1]
        done.append(np.unique(np.concatenate(high)) if high else np.zeros(0, np.uint32))
    return done


def fingerprints(texts: list[str]) -> list[str]:
    """The KEPT smallest names of each text in hexadecimal, eight digits each; an empty text has none."""
    return [n[:KEPT].astype(">u4").tobytes().hex() for n in _names(texts)]


def likeness(a: str, b: str) -> float:
    """The share of names that both texts have, estimated from fingerprints: exact (Jaccard) while all names are kept."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[: KEPT if max(len(x), len(y)) == KEPT else None]
    return float(np.isin(both, x).astype(int) @ np.isin(both, y).astype(int)) / len(both)


def edited(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


ROWS = pa.schema([("slot", pa.int32()), ("halo", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("z", pa.binary())])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the one before in ascending id (after the smallest: the largest), so a document is
    compared with an edited copy of itself and with a stranger. Ties of ids go by a hash of the text, null
    ids come after the smallest, a null text counts as empty (no names; like an empty text only). Equal texts
    have equal fingerprints.

    Scale: ids are cut at quantiles into slots (a few for each partition), and the first text of a slot is
    also sent to the slot whose last text it follows; so neighbours meet in one shuffle of compressed texts,
    without a global sort or a window over all rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{text_col}`").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = min(8 * parts, 20_000)
    at = own.agg(F.percentile_approx("doc_id", [i / slots for i in range(1, slots)] + [1.0], 10 * slots).alias("q"), F.max("doc_id").alias("m")).first()
    tops = sorted({*(at["q"] or []), *([] if at["m"] is None else [at["m"]])})  # ids that exist; each the largest of its slot

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        last = set(tops)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for i, tie, text in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    z = press((text or "").encode())
                    slot = 0 if i is None else bisect.bisect_left(tops, i)
                    rows.append({"slot": slot, "halo": 0, "doc_id": i, "tie": tie, "z": z})
                    if i in last:
                        rows.append({"slot": (slot + 1) % len(tops), "halo": 1, "doc_id": i, "tie": tie, "z": z})
                yield pa.RecordBatch.from_pylist(rows, schema=ROWS)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        changed = [edited(t, n) for _, t, n in pairs]
        texts = [p[1] for p in pairs] + changed + [pairs[-1][2]]
        prints = fingerprints(texts)
        k = len(pairs)
        known = {t: f for t, f in zip(texts, prints, strict=True)}
        if missing := [n for *_, n in pairs if n not in known]:
            known |= zip(missing, fingerprints(missing), strict=True)
        rows = [
            (i, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), prints[j], prints[k + j], likeness(prints[j], prints[k + j]), likeness(prints[j], known[n]))
            for j, ((i, t, n), c) in enumerate(zip(pairs, changed, strict=True))
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        pairs: list[tuple[int | None, str, str]] = []
        held, before, top = 0, None, None  # before: the row whose next is awaited; top: the slot's first text
        for row in (dict(zip(batch.schema.names, r, strict=True)) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            text = open_(row["z"]).decode()
            if before is not None:
                same = before[0] == row["slot"]
                pairs.append((before[1], before[2], text if same else top))
                held += len(before[2])
                before = None
                if held > 400_000 or len(pairs) >= 256:
                    yield work(pairs)
                    pairs, held = [], 0
            if row["halo"] == 0:
                if top is None or slot != row["slot"]:
                    top, slot = text, row["slot"]
                before = row["slot"], row["doc_id"], text
        if before is not None:
            pairs.append((before[1], before[2], top))
        if pairs:
            yield work(pairs)

    dealt = own.mapInArrow(deal, "slot int, halo int, doc_id long, tie long, z binary")
    ordered = dealt.repartition(F.col("slot")).sortWithinPartitions("slot", "halo", F.col("doc_id").desc_nulls_last(), "tie")
    return ordered.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
