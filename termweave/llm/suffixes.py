"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document of a smaller id.

Every 50-byte string holds an anchor, the 24-byte string of least hash within it; equal strings have theirs
at equal offsets. Anchors that recur give their surroundings (all 50-byte strings that hold the anchor) to a
bucket, where suffixes are sorted: multikey quicksort to a shallow depth, then blind tries for groups that
agree that far. Ranks at each depth tell which strings are equal and which document has each first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import by_key, cut, tidy

MATCH, ANCHOR = 50, 24
SIDE = MATCH - ANCHOR
WIDE = SIDE + MATCH  # an anchor with what may stand on either side of it
SHALLOW = 24
BLOB_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
LAST = (1 << 63) - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW47 = np.uint64((1 << 48) - 2)

BLOBS = pa.schema([("blob", pa.string()), ("kind", pa.int32()), ("data", pa.binary()), ("ids", pa.binary()), ("more", pa.binary())])
BLOBS_SQL = "blob string, kind int, data binary, ids binary, more binary"


def _blob(name: str, kind: int, data: bytes, ids: bytes = b"", more: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"blob": name, "kind": kind, "data": data, "ids": ids, "more": more}], schema=BLOBS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as compressed blobs of about BLOB_BYTES: texts, ids, lengths."""
    import pyspark
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    part, made, ids, texts, held = pyspark.TaskContext.get().partitionId(), 0, [], [], 0

    def out() -> pa.RecordBatch:
        return _blob(f"{part}-{made}", 0, press(b"".join(texts)), np.array([LAST if i is None else i for i in ids], "<i8").tobytes(), np.array([*map(len, texts)] + [i is None for i in ids], "<i8").tobytes())

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (t or "").encode()
            if held and held + len(raw) > BLOB_BYTES:
                yield out()
                made, ids, texts, held = made + 1, [], [], 0
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield out()


class _Blob:
    """A blob's bytes, documents and anchors."""

    def __init__(self, data: bytes, ids: bytes, more: bytes):
        import zstandard

        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", np.uint8)
        self.ids = np.frombuffer(ids, "<i8")
        sizes, null = np.frombuffer(more, "<i8").reshape(2, -1)
        self.null = null.astype(bool)
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.at, self.hash = self._anchors()
        self.doc = np.searchsorted(self.stop, self.at, side="right")

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors start, and their hashes (47 bits, the lowest free): each window's least, ties all."""
        n = len(self.text) - MATCH + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        raw = np.concatenate([self.text, np.zeros(8, np.uint8)])
        word = np.ndarray(len(self.text), "<u8", raw.data, 0, (1,))
        m = n + SIDE
        h = word[:m] * _C[0]
        h ^= h >> np.uint64(29)
        h = (h + word[8 : m + 8]) * _C[1]
        h ^= h >> np.uint64(32)
        h = (h + word[16 : m + 16]) * _C[2]
        h ^= h >> np.uint64(30)
        least = _sliding(h, SIDE + 1, np.minimum)
        whole = np.zeros(n + 1, np.int64)  # windows within one document
        fits = self.stop - self.start >= MATCH
        np.add.at(whole, self.start[fits], 1)
        np.add.at(whole, self.stop[fits] - MATCH + 1, -1)
        least[np.cumsum(whole[:-1]) == 0] = 0
        most = _sliding(np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)]), SIDE + 1, np.maximum)
        at = np.flatnonzero((most == h) & (h > 0))
        return at, (h[at] >> np.uint64(15)) & _LOW47

    def surroundings(self, recurring: np.ndarray):
        """Of the anchors in ``recurring``: their places, documents, and which distinct surroundings each has; then these and the smallest id that has each."""
        keep = np.isin(self.hash, recurring)
        at, doc, h = self.at[keep], self.doc[keep], self.hash[keep]
        left, right = np.minimum(at - self.start[doc], SIDE), np.minimum(self.stop[doc] - at - ANCHOR, SIDE)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), self.text, np.zeros(WIDE, np.uint8)])
        wide = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[at]
        place = np.arange(WIDE)
        wide = np.where((place >= (SIDE - left)[:, None]) & (place < (SIDE + ANCHOR + right)[:, None]), wide, 0)
        rows = np.concatenate([wide, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
        rows = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))))
        order = np.lexsort(rows.view(">u8").T[::-1]) if len(rows) else np.zeros(0, np.int64)
        new = np.r_[True, (rows[order][1:] != rows[order][:-1]).any(1)] if len(rows) else np.zeros(0, bool)
        which = np.zeros(len(rows), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        smallest = np.full(len(first), LAST, np.int64)
        np.minimum.at(smallest, which, self.ids[doc])
        return at, doc, which, rows[first], h[first], smallest


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of ``size``."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


BUCKETS = pa.schema([("bucket", pa.int32()), ("blob", pa.string()), ("data", pa.binary()), ("ids", pa.binary()), ("more", pa.binary())])
BUCKETS_SQL = "bucket int, blob string, data binary, ids binary, more binary"


def _narrow(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widen(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _split(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    place = ((h >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _anchor_hashes(buckets: int):
    """Each blob's distinct anchors by bucket; the lowest bit tells whether documents of different ids in the blob share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                blob = _Blob(row["data"], row["ids"], row["more"])
                order = np.lexsort((blob.ids[blob.doc], blob.hash))
                h, ids = blob.hash[order], blob.ids[blob.doc][order]
                if not len(h):
                    continue
                cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                several = ids[np.r_[cuts[1:], len(h)] - 1] != ids[cuts]
                h = h[cuts] | several
                for b, own in _split(h, buckets):
                    yield pa.RecordBatch.from_pylist([{"bucket": b, "blob": row["blob"], "data": _narrow(h[own]), "ids": b"", "more": b""}], schema=BUCKETS)

    return run


def _recurring(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each blob, which of its anchors other documents have as well."""
    names, parts = table.column("blob").to_pylist(), [_widen(x) for x in table.column("data").to_pylist()]
    marked = np.concatenate(parts)
    h = marked & _LOW47
    values, place, many = np.unique(h, return_inverse=True, return_counts=True)
    again = (many > 1) | (np.bincount(place, (marked & np.uint64(1)).astype(float)) > 0)
    hit, at = again[place], 0
    for name, part in zip(names, parts, strict=True):
        own = hit[at : at + len(part)]
        if own.any():
            yield _blob(name, 1, _narrow(h[at : at + len(part)][own]))
        at += len(part)


def _of_blob(table: pa.Table) -> tuple[str, _Blob, np.ndarray, list[dict]]:
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 0)
    hashes = [_widen(r["data"]) for r in rows if r["kind"] == 1]
    return own["blob"], _Blob(own["data"], own["ids"], own["more"]), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), [r for r in rows if r["kind"] == 2]


def _give(buckets: int):
    """A blob's distinct surroundings of recurring anchors, by bucket."""

    def work(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        name, blob, recurring, _ = _of_blob(table)
        if not len(recurring):
            return
        *_, rows, h, smallest = blob.surroundings(recurring)
        for b, own in _split(h, buckets):
            yield pa.RecordBatch.from_pylist([{"bucket": b, "blob": name, "data": press(rows[own].tobytes()), "ids": smallest[own].tobytes(), "more": own.astype("<i4").tobytes()}], schema=BUCKETS)

    return work


class BlindTrie:
    """Distinct strings of equal length in order: inner nodes keep a depth and branch on the byte there, leaves keep strings."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    def add(self, s: bytes) -> None:
        node = self.root
        while not isinstance(node, bytes):  # blindly down to some leaf below
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node == s:
            return
        differ = int.from_bytes(node) ^ int.from_bytes(s)
        depth, leaf = len(s) - (differ.bit_length() + 7) // 8, node
        above, node = None, self.root
        while not isinstance(node, bytes) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, bytes) and node[0] == depth:
            node[1][s[depth]] = s
            return
        inner = [depth, {leaf[depth]: node, s[depth]: s}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def ordered(self) -> Iterator[bytes]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                yield node
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of strings of equal length (rows of bytes).

    Multikey quicksort with letters of eight bytes, each letter only within groups that agree so far, to the
    depth ``shallow``; blind tries order the groups that still agree there.
    """
    n, width = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    letters = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8")
    for j in range(min(shallow, width) // 8):
        key = letters[order, j].astype(np.uint64)
        open_ = np.flatnonzero(np.bincount(group)[group] > 1) if n else np.zeros(0, np.int64)
        sub = np.lexsort((key[open_], group[open_]))
        order[open_] = order[open_][sub]
        key = letters[order, j].astype(np.uint64)
        group = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if n else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        own = order[a:b]
        if (rows[own] == rows[own[0]]).all():
            continue
        same: dict[bytes, list[int]] = {}
        for i in own.tolist():
            same.setdefault(rows[i].tobytes(), []).append(i)
        trie = None
        for s in same:
            if trie is None:
                trie = BlindTrie(s)
            else:
                trie.add(s)
        order[a:b] = [i for s in trie.ordered() for i in same[s]]
    return order


def _shared(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each string, in order, shares with the one before; the first: 0."""
    differ = rows[order[1:]] != rows[order[:-1]]
    return np.r_[0, np.where(differ.any(1), differ.argmax(1), rows.shape[1])]


def _judge(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each surroundings of a blob a mask: bit o is set if the string that starts o bytes before the anchor also starts in a document of a smaller id than any in the blob that has it."""
    import zstandard

    names = table.column("blob").to_pylist()
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(-1, -(-(WIDE + 2) // 8) * 8) for x in table.column("data").to_pylist()]
    rows = np.concatenate(parts)
    smallest = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("ids").to_pylist()])
    left, right = rows[:, WIDE].astype(np.int64), rows[:, WIDE + 1].astype(np.int64)
    ahead, back = np.ascontiguousarray(rows[:, SIDE:WIDE]), np.ascontiguousarray(rows[:, :SIDE][:, ::-1])
    n = len(rows)
    mask = np.zeros(n, np.int64)
    order_a, order_b = deep_shallow(ahead), deep_shallow(back)
    shared_a, shared_b = _shared(ahead, order_a), _shared(back, order_b)
    rank_a, rank_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SIDE + 1):
        fine = np.flatnonzero((left >= o) & (right >= SIDE - o))
        if len(fine) < 2:
            continue
        rank_a[order_a] = np.cumsum(shared_a < MATCH - o)
        rank_b[order_b] = np.cumsum(shared_b < o)
        key = (rank_a * (n + 1) + rank_b)[fine]
        by = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        first = np.minimum.reduceat(smallest[fine][by], cuts)
        first = np.repeat(first, np.diff(np.r_[cuts, len(by)]))
        hit = fine[by][first < smallest[fine][by]]
        mask[hit] |= 1 << o
    at = 0
    for name, part, local in zip(names, parts, table.column("more").to_pylist(), strict=True):
        own = mask[at : at + len(part)]
        at += len(part)
        if own.any():
            yield _blob(name, 2, np.frombuffer(local, "<i4")[own > 0].tobytes(), own[own > 0].astype("<i8").tobytes())


def _remove(with_text: bool):
    def work(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, blob, recurring, answers = _of_blob(table)
        gone = np.zeros(len(blob.text), bool)
        if len(recurring):
            at, doc, which, rows, _, smallest = blob.surroundings(recurring)
            mask = np.zeros(len(rows), np.int64)
            for r in answers:
                mask[np.frombuffer(r["data"], "<i4")] = np.frombuffer(r["ids"], "<i8")
            left, right = rows[which, WIDE].astype(np.int64), rows[which, WIDE + 1].astype(np.int64)
            later = blob.ids[doc] > smallest[which]  # the blob itself has the whole in a document of a smaller id
            starts = np.zeros(len(blob.text) + 1, np.int64)
            for o in range(SIDE + 1):
                hit = np.where(later, (left >= o) & (right >= SIDE - o), mask[which] >> o & 1 > 0)
                starts[at[hit] - o] = 1
            opened = np.cumsum(starts)
            gone = opened[: len(blob.text)] > np.r_[np.zeros(min(MATCH, len(blob.text)), np.int64), opened[: max(0, len(blob.text) - MATCH)]]
        out = []
        for i, null, a, b in zip(blob.ids.tolist(), blob.null.tolist(), blob.start.tolist(), blob.stop.tolist(), strict=True):
            own = gone[a:b]
            kept = blob.text[a:b][~own].tobytes()
            edges = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
            row = {"doc_id": None if null else i, "n_bytes": b - a, "n_removed": int(own.sum()), "n_spans": len(edges) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | ({"kept": kept, "spans": edges.tolist()} if with_text else {}))
        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.int64()))] if with_text else []
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, kept (bytes) and spans for every row.

    A byte is removed if a 50-byte string of its document that covers it also starts in a document of a
    smaller id; strings are judged on the input and never cross documents. ``spans`` lists begin and end of
    each maximal removed run; ``kept`` may be no valid UTF-8, as cuts fall between bytes. A null text counts
    as empty. Rows of equal id never remove each other's bytes; null ids come after all others (and not after
    each other). Texts under 50 bytes stay whole.

    Scale: texts are packed once into compressed blobs. Anchors (about one in 14 bytes) go out as 6-byte
    hashes, each once a blob, however often copies repeat it; only the surroundings of recurring ones follow,
    each once a blob. A passage that a third of all documents share thus brings a bucket one entry a blob.
    The numbers of blobs and buckets follow the input.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blobs = cut(own.mapInArrow(_pack, BLOBS_SQL), "blobs")
    sums = blobs.agg(F.sum(F.length("data")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, many = sums["b"] or 0, sums["n"]
    buckets = max(16, -(-3 * total // BUCKET_BYTES))
    hashes = blobs.select("blob", "data", "ids", "more").mapInArrow(_anchor_hashes(buckets), BUCKETS_SQL)
    again = cut(by_key(hashes, "bucket", _recurring, BLOBS_SQL, buckets), "again")
    del hashes
    tidy(docs.sparkSession)  # shuffles that the written tables have replaced may go
    given = by_key(blobs.union(again), "blob", _give(buckets), BUCKETS_SQL, many)
    masks = cut(by_key(given, "bucket", _judge, BLOBS_SQL, buckets), "masks")
    del given
    tidy(docs.sparkSession)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<long>" if with_text else "")
    return by_key(blobs.union(again).union(masks), "blob", _remove(with_text), out, many)
