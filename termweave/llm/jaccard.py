"""N-gram Jaccard join: exact links between documents whose word-shingle sets are alike, and their components.

Copies with equal sets are one class. Classes whose low-hashed tokens recur in too few other classes can
have no partner and leave early. The rest are cut into parts by hash, more than two linked sets can differ in,
so that some part is equal in both; sets with an equal part are grouped, and
within a group a T-occurrence search finds the links: short inverted lists are merged on a heap, long ones
are only probed by binary search (DivideSkip), and documents that reach the required overlap are retained.
A group too large for a task is dealt into blocks, and each pair of blocks is searched by a task of its own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.components import connected
from termweave.llm.util import by_key, carry, cut, drop_cut, restore, slices, small_enough, tidy

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
KEPT_WORDS = 150_000
#: The count sketch has so many counters, whatever the input.
SKETCH = 1 << 20
BUCKET_BYTES = 8 << 20
BROADCAST_IDS = 500_000
#: Bytes of sets that a task takes of one group; a larger group is dealt into blocks of half as many.
GROUP_BYTES = 32 << 20
#: Sets of a block where a group of fewer bytes is spread over tasks, and how many blocks it then has at most (each set goes to one pair fewer).
BLOCK_SETS, MOST_SPREAD = 256, 8
#: A class of more than this share of all rows is met by a broadcast (so at most as many classes as this), others by a shuffle.
HOT_SHARE = 1000
#: Bytes that travel at once for pairs of blocks, as a multiple of all grouped sets; more go in several rounds, each freed before the next.
ROUND_BYTES = 2
#: Turns in which few sets search, and sets of a group that has none of these; the links are the same.
TURNS, FEW = 6, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Word -> 64-bit id, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = out
        return out


_words = _Words()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run; none: empty."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and just space and tab to carriage return split
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(ids) - size + 1)
    h = np.full(runs, min(len(ids), size), np.uint64) * _B
    for k in range(min(size, len(ids))):
        h = (h ^ (h >> np.uint64(31))) * _A + ids[k : k + runs]
    h = (h ^ (h >> np.uint64(32))) * _B
    return np.unique(h ^ (h >> np.uint64(29)))


def _need(n: int) -> int:
    """The overlap below which a set of n tokens has no partner."""
    return -(-NUM * n // DEN)


def _spare(n: int) -> int:
    return n // 5


def linked(overlap: int, n: int, m: int) -> bool:
    return DEN * overlap >= NUM * (n + m - overlap)


def _class_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two longs that name a set."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("k2", pa.int64()), ("low", pa.binary()), ("h", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: set size, class, and its lowest-hashed tokens (the allowed misses, one, and a fifth more), 48 bits each."""
    for batch in batches:
        for part, texts in slices(batch, batch.column(1)):
            rows = []
            for i, text, h in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                s = shingles(text)
                n = len(s)
                if not n:
                    rows.append((i, 0, None, None, None, h))
                    continue
                most = n - _need(n) + 1 + _spare(n)
                low = (s[:most] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((i, n, *_class_of(s), low.tobytes(), h))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST.types, strict=True)], schema=DIGEST)


PACKED = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("which", pa.binary()), ("owner", pa.binary())])
PACKED_SQL = "bucket int, token binary, which binary, owner binary"


def _bytes(tokens: np.ndarray, wide: int) -> bytes:
    """The lowest ``wide`` bytes of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _tokens(raw: bytes, wide: int) -> np.ndarray:
    out = np.zeros((len(raw) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(raw, np.uint8).reshape(-1, wide)
    return out.view("<u8").ravel()


def _by_bucket(tokens: np.ndarray, owners: np.ndarray, buckets: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Distinct (token, owner) pairs of a map task as one row for each bucket."""
    if not len(tokens):
        return
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]
    tokens, owners = tokens[new], owners[new]
    place = (tokens % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    place, tokens, owners = place[order], tokens[order], owners[order]
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        names, which = np.unique(owners[a:b], return_inverse=True)
        size = 2 if len(names) <= 1 << 16 else 4  # a place in the row's own list of owners takes less than an owner
        yield pa.RecordBatch.from_pylist([{"bucket": int(place[a]), "token": _bytes(tokens[a:b], wide), "which": which.astype(f"<u{size}").tobytes(), "owner": names.tobytes()}], schema=PACKED)


def _low_postings(buckets: int, most: int = 800_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, held = [], [], 0
        for batch in batches:
            for k, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _tokens(low, 6)
                tokens.append(own)
                owners.append(np.full(len(own), k, np.int64))
                held += len(own)
                if held >= most:
                    yield from _by_bucket(np.concatenate(tokens), np.concatenate(owners), buckets, 6)
                    tokens, owners, held = [], [], 0
        if held:
            yield from _by_bucket(np.concatenate(tokens), np.concatenate(owners), buckets, 6)

    return run


def _gathered(table: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, owner) pairs of a bucket, in order, and the bounds of each token's run."""
    parts = [_tokens(x, wide) for x in table.column("token").to_pylist()]
    which = [np.frombuffer(x, f"<u{len(x) // len(t)}") for x, t in zip(table.column("which").to_pylist(), parts, strict=True)]
    owners = np.concatenate([np.frombuffer(x, "<i8")[w] for x, w in zip(table.column("owner").to_pylist(), which, strict=True)])
    tokens = np.concatenate(parts)
    del parts, which
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]
    tokens, owners = tokens[new], owners[new]
    return tokens, owners, np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True])


def _recurring(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each class, how many of its tokens in this bucket stand in another class as well."""
    _, owners, cuts = _gathered(table, 6)
    sizes = np.diff(cuts)
    k, c = np.unique(owners[np.repeat(sizes > 1, sizes)], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["k", "c"])


SETS = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("tokens", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, batch.column(1)):
            rows = []
            for i, text, k in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                s = shingles(text)
                if len(s) and _class_of(s)[0] == k:
                    rows.append({"doc_id": i, "k": k, "tokens": s.tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SETS)


def _slot(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(20)) % np.uint64(SKETCH)).astype(np.int64)


def _sketch_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        held = [np.frombuffer(x, "<u8") for x in batch.column(0).to_pylist()]
        if held:
            counts += np.bincount(_slot(np.concatenate(held)), minlength=SKETCH)
    step = SKETCH // 16
    for i in range(16):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts[i * step : (i + 1) * step].astype("<i8").tobytes()], pa.binary())], names=["slice", "counts"])


def _sketch_sum(key, table: pa.Table) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["slice", "counts"])


def prefix(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The tokens of which a partner shares at least one: the first n - need + 1 by sketched frequency, then hash; those that stand nowhere else are left out."""
    n = len(tokens)
    seen = sketch[_slot(tokens)]
    first = np.lexsort((tokens, seen))[: n - _need(n) + 1]
    return tokens[first][seen[first] > 1]


def _bands() -> np.ndarray:
    """Least sizes of the bands; sets of bands that are not neighbours differ too much in size to be linked."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * DEN // NUM + 1)
    return np.array(out)


BANDS = _bands()


def _frequency(counts: np.ndarray) -> np.ndarray:
    """Eight times the binary logarithm, about; whole numbers, the same on every machine."""
    part, power = np.frexp(counts.astype(np.float64))
    return 8 * power.astype(np.int64) + (16 * part - 8).astype(np.int64)


def signatures(tokens: np.ndarray, sketch: np.ndarray, total: int) -> np.ndarray:
    """Hashes of parts of a set, of which every set linked with it has one as well.

    The sets of two neighbouring bands are cut into equally many parts by the hash of their tokens. Linked sets
    of n and m tokens differ in at most d = (n + m) / 9 of them, hence in at most d parts, so among the first d + 1
    parts of a set one is equal in the other. The order is the same for all sets, by what a part holds: many
    and rare tokens first. As a part mostly holds three or four, a shingle or two that recur by chance group
    nothing, however many texts there are. A set with too few parts that are not empty has the tokens of its
    ``prefix`` besides, for others of that kind.
    """
    n = len(tokens)
    rarity = _frequency(np.array([total])) - _frequency(sketch[_slot(tokens)]) + 1
    mixed, place = (tokens ^ (tokens >> np.uint64(31))) * _B, (tokens * _A) >> np.uint64(32)
    band = int(np.searchsorted(BANDS, n, "right")) - 1
    out, weak = [np.zeros(0, np.uint64)], False
    for low in range(max(0, band - 1), band + 1):
        most = int(BANDS[low + 2]) - 1
        differ = (DEN - NUM) * (n + min(most, n * DEN // NUM)) // (DEN + NUM)
        if not differ:
            continue  # only an equal set could be linked
        part = place % np.uint64(3 * most // 10 + 2)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        own = np.add.reduceat(mixed[order], cuts)
        own = (own ^ (own >> np.uint64(31))) * _A + np.uint64(low)
        if len(own) > differ:
            own = own[np.lexsort((own, -np.add.reduceat(rarity[order], cuts)))[: differ + 1]]
        else:
            weak = True
        out.append(own)
    return np.concatenate([*out, prefix(tokens, sketch)] if weak else out)


def _signature_postings(sketch: bytes, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch, "<i8")
        total = int(counts.sum())
        tokens, owners = [], []
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = signatures(np.frombuffer(raw, "<u8"), counts, total)
                tokens.append(own)
                owners.append(np.full(len(own), k, np.int64))
            if sum(map(len, tokens)) > 800_000:
                yield from _by_bucket(np.concatenate(tokens), np.concatenate(owners), buckets, 8)
                tokens, owners = [], []
        if tokens:
            yield from _by_bucket(np.concatenate(tokens), np.concatenate(owners), buckets, 8)

    return run


def _stars(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each token's classes tied to the first of them: as many ties as postings, never all pairs."""
    _, owners, cuts = _gathered(table, 8)
    sizes = np.diff(cuts)
    hub = np.repeat(owners[cuts[:-1]], sizes)
    tie = np.unique(np.stack([hub, owners])[:, hub != owners], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(tie[0]), pa.array(tie[1])], names=["a", "b"])


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that stand in at least ``least`` of the ascending ``lists`` (each entry once a list), and in how many.

    The longest lists, fewer than ``least`` of them, are set aside; the others are merged on a heap. An entry
    met often enough there is looked up in the long lists by binary search, as long as it can still reach
    ``least``.
    """
    lists = sorted(lists, key=len)
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    aside = min(least - 1, int(least / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    enough = least - aside
    found = [(entry, times) for entry, same in itertools.groupby(heapq.merge(*[x.tolist() for x in short])) if (times := sum(1 for _ in same)) >= enough]
    entries, times = np.array([e for e, _ in found], np.int64), np.array([t for _, t in found], np.int64)
    for left in range(len(long), 0, -1):
        fine = times + left >= least
        entries, times = entries[fine], times[fine]
        if not len(entries):
            break
        own = long[len(long) - left]
        times = times + (own[np.minimum(np.searchsorted(own, entries), len(own) - 1)] == entries)
    fine = times >= least
    return entries[fine], times[fine]


def link_group(sets: list[np.ndarray]) -> list[int]:
    """For each set of a group the first set of its component, by exact links, all found by the T-occurrence search.

    A search finds all partners of its set, which then leaves the lists. A token whose sets are all joined
    already can add nothing to the overlap of sets that are not, so it closes; a set without enough open
    tokens has no partner left outside its component and leaves as well. Sets of the largest component need
    not search, as the other set of any link to it does. In the first TURNS turns one set of each cluster
    searches (those of the highest rank by hash for most of their tokens, and one of the largest component),
    which joins a family of copies by few searches; then all others that are left search.
    """
    n = len(sets)
    union, sizes = _Union(n), np.array([len(s) for s in sets])
    need = np.array([_need(int(k)) for k in sizes])
    _, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[place] > 1  # tokens of one set only take no part
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[shared]
    token = place[shared].astype(np.int32)
    del place, df, shared
    rank = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _A
    rank = np.argsort(np.argsort(rank ^ (rank >> np.uint64(32)), kind="stable"), kind="stable")
    searched, roots = np.zeros(n, bool), np.arange(n, dtype=np.int32)
    for turn in itertools.count(0 if n > FEW else TURNS):
        count = np.bincount(owner, minlength=n)
        keep = ((count >= need) & ~searched)[owner]
        owner, token = owner[keep], token[keep]
        live = np.flatnonzero((count >= need) & ~searched & (count > 0))
        if len(live) < 2:
            break
        kinds, many = np.unique(roots[live], return_counts=True)
        largest = roots[live] == kinds[np.argmax(many)]
        asking = live[~largest] if len(kinds) > 1 else live[:0]
        if turn < TURNS:
            best = np.full(int(token.max()) + 1, -1, np.int64)
            np.maximum.at(best, token, rank[owner])
            leads, count = np.bincount(owner[rank[owner] == best[token]], minlength=n), np.bincount(owner, minlength=n)
            seeds = np.union1d(asking[2 * leads[asking] >= count[asking]], live[largest][np.argmax(rank[live[largest]])])
        else:
            seeds = asking if len(kinds) > 1 and many.max() > 1 else live[:-1]
        if not len(asking) and turn and len(kinds) == 1:
            break
        cuts = np.searchsorted(owner, np.arange(n + 1))  # owners are in ascending order throughout
        by_token = np.argsort(token, kind="stable")
        lists, first = owner[by_token], np.searchsorted(token[by_token], np.arange(int(token.max()) + 2))
        for x in seeds.tolist():
            own = [lists[first[t] : first[t + 1]] for t in token[cuts[x] : cuts[x + 1]].tolist()]
            for y, times in zip(*divide_skip(own, int(need[x])), strict=True):
                if y != x and linked(int(times), int(sizes[x]), int(sizes[y])):
                    union.join(x, int(y))
        searched[seeds] = True
        if turn >= TURNS:
            break
        roots = np.array([union.find(x) for x in range(n)], np.int32)
        low, high = np.full(int(token.max()) + 1, n, np.int32), np.full(int(token.max()) + 1, -1, np.int32)
        np.minimum.at(low, token, roots[owner])
        np.maximum.at(high, token, roots[owner])
        keep = (low < high)[token]
        owner, token = owner[keep], token[keep]
    return [union.find(x) for x in range(n)]


RESOLVED_SQL = "k long, doc_id long, leader long, component long, split boolean"


def _resolve(key: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of each class of a group (or of a pair of its blocks) the first class of its component there, and the smallest id of that component."""
    k = table.column("k").to_numpy()
    _, first = np.unique(k, return_index=True)
    ids = table.column("doc_id").to_pylist()
    ids = [ids[i] for i in first]
    raw, k = table.column("tokens"), k[first]
    roots = link_group([np.frombuffer(raw[int(i)].as_py(), "<u8") for i in first])
    least: dict[int, int | None] = {}
    for r, i in zip(roots, ids, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    columns = [pa.array(k), pa.array(ids, pa.int64()), pa.array(k[np.array(roots)]), pa.array([least[r] for r in roots], pa.int64()), pa.array([":" in key] * len(k))]
    yield pa.RecordBatch.from_arrays(columns, names=["k", "doc_id", "leader", "component", "split"])


def _components(sets: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """k, component (smallest id) for the classes in ``groups`` (node, root).

    Small groups go to a task each. One of more than ``most`` bytes is dealt into blocks of half as many by
    hash, and one of more than BLOCK_SETS sets into up to MOST_SPREAD blocks; each pair of blocks is searched
    by a task of its own, and what the pairs find is joined. Fewer groups than one in BLOCK_SETS sets are so
    large; their list is broadcast if it has at most BROADCAST_IDS rows. A set of a large group travels to
    every other block, which grows with the square of the group: beyond ROUND_BYTES times all grouped sets
    the pairs take turns, so that the disk they need follows the sets.
    """
    groups = groups.hint("merge")  # by a shuffle at every size, as no bound keeps them small
    met = sets.join(groups, sets["k"] == groups["node"]).select("root", "doc_id", "k", "tokens")
    sizes = sets.select("k", F.length("tokens").alias("b")).join(groups, F.col("k") == F.col("node"))  # sizes travel, the sets do not
    sizes = cut(sizes.groupBy("root").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")), "sizes")
    spread = F.least(F.ceil(F.col("n") / BLOCK_SETS), F.lit(MOST_SPREAD))
    blocks = F.greatest(F.when(F.col("b") > most, F.ceil(2 * F.col("b") / most)).otherwise(0), spread, F.lit(2)).cast("int")
    blocks = cut(sizes.where((F.col("b") > most) | (F.col("n") > BLOCK_SETS)).select(F.col("root").alias("big"), "b", blocks.alias("blocks")), "blocks")
    held, sent = sizes.agg(F.sum("b")).first()[0] or 0, blocks.agg(F.sum(F.col("b") * (F.col("blocks") - 1))).first()[0] or 0
    rounds = -(-sent // max(1, ROUND_BYTES * held))
    blocks = blocks.drop("b")
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: c != F.col("own"))
    pairs = F.transform(others, lambda c: F.concat_ws(":", "root", F.least(c, F.col("own")), F.greatest(c, F.col("own"))))
    placed = met.join(F.broadcast(blocks) if small_enough(blocks, BROADCAST_IDS) else blocks, F.col("root") == F.col("big"), "left").withColumn("own", own)
    if rounds > 1:
        placed = cut(placed, "placed")
    keys = F.when(F.col("big").isNull(), F.array(F.col("root").cast("string"))).otherwise(pairs)
    parts = []
    for turn in range(max(1, rounds)):
        now = keys if rounds <= 1 else F.filter(keys, lambda key: F.pmod(F.xxhash64(key), F.lit(rounds)) == turn)
        dealt = placed.select(F.explode(now).alias("key"), "doc_id", "k", "tokens")
        parts.append(cut(by_key(dealt, "key", _resolve, RESOLVED_SQL), "found"))
        del dealt
        tidy(sets.sparkSession)
    if rounds > 1:
        drop_cut(placed)
    found = functools.reduce(DataFrame.union, parts)
    whole = found.where("NOT split").select("k", "component")
    if not blocks.limit(1).count():
        return whole
    split = found.where("split")
    joined = cut(connected(split.select(F.col("leader").alias("a"), F.col("k").alias("b"))), "joined")
    named = split.select("k", "doc_id").distinct().join(joined, F.col("k") == F.col("node"), "left").select("k", "doc_id", F.coalesce("root", "k").alias("r"))
    least = named.groupBy("r").agg(F.min("doc_id").alias("component"))
    return whole.union(named.join(least, "r").select("k", "component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) for every row of ``docs``.

    Words are runs of characters other than space and tab to carriage return, with A-Z lower-cased; a
    document's set has its distinct runs of five words, the whole sequence if there are fewer, nothing for
    no words or a null text. Two documents link when 100 * intersection >= 80 * union; component_id is the
    smallest id reachable by links (for rows without words: the own id). Rows that repeat an id or a text
    are linked like other copies; a null id is never the smallest unless all are null.

    Scale: whatever is shuffled is packed by token bucket (their number follows the input), deduplicated in
    each map task first, so copies cost one entry a task. Classes are matched by star ties, not pairs. Sets
    travel once, to their group; those of a group of more than ``group_bytes`` to each pair of its blocks that has theirs.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hashed = own.select("doc_id", "text", F.xxhash64("text").alias("h"))
    digest = cut(hashed.mapInArrow(_digest, "doc_id long, n long, k long, k2 long, low binary, h long"), "digest")
    total = digest.agg(F.sum(F.length("low")).alias("b")).first()["b"] or 0
    buckets = max(16, -(-2 * total // BUCKET_BYTES))
    rows = cut(digest.drop("low"), "rows")  # what is needed to the end; the wide table goes before
    full = digest.where("n > 0")
    classes = full.groupBy("k", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    counts = by_key(full.select("k", "low").mapInArrow(_low_postings(buckets), PACKED_SQL), "bucket", _recurring, "k long, c long", buckets)
    enough = 1 + F.floor(F.ceil(F.col("n") * NUM / DEN) / 5)
    likely = counts.groupBy("k").agg(F.sum("c").alias("c")).join(classes, "k").where(F.col("c") >= enough)
    likely = cut(likely.select("k", F.col("rep").alias("rep")), "likely")
    classes = rows.where("n > 0").groupBy("k", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    drop_cut(digest)
    del digest, full, counts
    tidy(spark)
    few = small_enough(likely, BROADCAST_IDS)
    met = own.join(F.broadcast(likely) if few else likely, own["doc_id"].eqNullSafe(likely["rep"]))
    sets = cut(met.select("doc_id", "text", "k").mapInArrow(_sets, "doc_id long, k long, tokens binary"), "sets")
    parts = by_key(sets.select("tokens").mapInArrow(_sketch_parts, "slice int, counts binary"), "slice", _sketch_sum, "slice int, counts binary")
    sketch = b"".join(bytes(r["counts"]) for r in sorted(parts.collect()))  # SKETCH counters, a fixed size
    if not sketch:
        sketch = np.zeros(SKETCH, "<i8").tobytes()
    seen = spark.sparkContext.broadcast(sketch)
    ties = by_key(sets.select("k", "tokens").mapInArrow(_signatures_with(seen, buckets), PACKED_SQL), "bucket", _stars, "a long, b long", buckets)
    groups = cut(connected(ties), "groups")
    del ties, parts
    tidy(spark)
    found = cut(_components(sets, groups, group_bytes), "components")
    drop_cut(sets)
    named = classes.join(found, "k", "left").select(F.col("k").alias("ck"), F.col("k2").alias("ck2"), "copies", F.coalesce("component", "rep").alias("component_id"))
    named = cut(named, "named")
    return _spread(rows, named)


def _spread(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each row with the component of its class; classes that hold many of the rows come by a broadcast, of at most HOT_SHARE rows."""
    hot = F.col("copies") > F.greatest(F.lit(HOT_SHARE // 20), F.lit(-(-rows.count() // HOT_SHARE)))
    same = (F.col("k") == F.col("ck")) & (F.col("k2") == F.col("ck2"))
    first = rows.select("doc_id", "n", "k", "k2", "h").join(F.broadcast(named.where(hot)), same, "left")
    met = first.where("ck IS NOT NULL OR n = 0").select("doc_id", "n", "component_id", "h")
    rest = first.where("ck IS NULL AND n > 0").select("doc_id", "n", "k", "k2", "h").join(named.where(~hot), same, "left").select("doc_id", "n", "component_id", "h")
    return met.union(rest).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("h").alias("text_hash"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less those linked with a document of a smaller id: one document of each component stays.

    Rows without words and rows with a null id stay; rows that repeat id and text are one document.
    """
    gone = cut(jaccard_components(docs, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_h")).distinct(), "gone")
    few = small_enough(gone, BROADCAST_IDS)
    base = carry(docs, d=F.col(f"`{id_col}`"), h=F.xxhash64(F.col(f"`{text_col}`")))
    left = base.join(F.broadcast(gone) if few else gone, (F.col("d") == F.col("gone")) & (F.col("h") == F.col("gone_h")), "left_anti")
    return restore(left, docs.columns)


def _signatures_with(seen, buckets: int):
    def run(batches):
        yield from _signature_postings(seen.value, buckets)(batches)

    return run
