"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece of text exactly one vocabulary token can be the last one of the prefix's
encoding. It is found among the tokens that end there (an automaton with suffix links over the vocabulary lists them): the
token fits if it and the last token of the prefix before it could stand side by side in an encoding. The
last tokens of all prefixes are kept, and the encoding of the whole is read off backwards.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from termweave.llm.util import CARRIED, carry, restore, slices, texts_of

#: Fixed value: the splitting pattern of byte-level BPE files of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern over U+0000 to U+00FF alone, where its classes are short lists; fixed values.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
SPLIT_LATIN = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pieces (of at most so many characters) and pairs whose results a worker keeps; when full, the store is emptied.
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 200_000, 64, 200_000
DEFAULT = "byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The letters by which such files write bytes: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder for one vocabulary file (byte-level BPE, no normaliser, one split pattern)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], _byte_letters()
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.bytes_of = {i: raw[t] for t, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not read")
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self._added = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {i: -1 for i in ids.values()}  # the rank at which a token comes into being; bytes: before all
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = ids[left], ids[right]
            self.rank[pair] = r
            whole = ids[left + right]
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, r
        self.fits = _Fits(self)
        automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if len(raw[token]) == 1 or i in self.parts and self.side_by_side(*self.parts[i], before=self.born[i]):
                automaton.add_word(raw[token].decode("latin-1"), (len(raw[token]), i))
        automaton.make_automaton()
        self._ends = automaton.iter
        self._any, self._latin = regex.compile(SPLIT).findall, re.compile(SPLIT_LATIN).findall
        self.pieces = _Pieces(self)

    def side_by_side(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether the encodings of two tokens, set side by side, stay two tokens (at least up to the rank ``before``).

        The tokens that touch the border while merging goes on are the right edge of ``left`` and the left edge
        of ``right``; walking back from the whole tokens, the younger of the two is taken apart each time. A pair
        that touches merges across the border if its rank is below that at which either is taken up inwards. At
        equal ranks the leftmost pair goes first: the left side's inward merge wins, the right side's does not.
        """
        parts, born = self.parts, self.born
        x, y = left, right
        x_ends = y_ends = len(self.rank) + 1 if before is None else before
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < x_ends and r <= y_ends and not (r == y_ends and (before is not None and y == right)):
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                x_ends, x = born[x], parts[x][1]
            elif born[x] < born[y]:
                y_ends, y = born[y], parts[y][0]
            else:  # the same rank: the left one merges first, so it is the older state that ends last
                y_ends, y = born[y], parts[y][0]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, read back from the last tokens of its prefixes."""
        last, n, out = self._last_tokens(piece), len(piece), []
        while n:
            token, n = last[n]
            out.append(token)
        out.reverse()
        return out

    def _last_tokens(self, piece: bytes) -> list[tuple[int, int] | None]:
        """For each prefix (by its length) its last token and where that starts."""
        last: list[tuple[int, int] | None] = [None] * (len(piece) + 1)
        fits = self.fits
        for end, (size, own) in self._ends(piece.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - size
                if start == 0 or fits[last[start][0], own]:
                    last[end] = own, start
        return last

    def _ordinary(self, text: str) -> list[str]:
        return list(map(self.pieces.__getitem__, self.split(text)))

    def encode_joined(self, text: str) -> str:
        """The decimal ids of a text, joined by commas."""
        if self._added is None or not self._added.search(text):
            return ",".join(self._ordinary(text))
        out, at = [], 0
        for m in self._added.finditer(text):
            out += self._ordinary(text[at : m.start()])
            out.append(str(self.added[m.group()]))
            at = m.end()
        return ",".join(out + self._ordinary(text[at:]))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Fits(dict):
    def __init__(self, owner: PrefixEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= KEPT_PAIRS:
            self.clear()
        out = self[pair] = self.owner.side_by_side(*pair)
        return out


class _Pieces(dict):
    """Piece of text -> its decimal ids joined by commas."""

    def __init__(self, owner: PrefixEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> str:
        if len(self) >= KEPT_PIECES:
            self.clear()
        out = ",".join(map(str, self.owner.encode_piece(piece.encode())))
        if len(piece) <= KEPT_LENGTH:
            self[piece] = out
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker process and file."""
    return PrefixEncoder(path)


def vocabulary_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Encode every whole text and decode it again.

    Adds (or replaces) n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded text) and, with ``with_ids``, ids and decoded; every other column (or those in ``columns``) returns as it is. A null text
    counts as empty: no ids. Strings of added tokens in a text become those tokens, as the file says. The
    file at ``path`` must be there on every executor, as an installed package's data is; by default it is
    looked up there by its name. Each row is worked on by itself, in one pass without a shuffle; a worker
    holds the tables of one vocabulary and a bounded store of pieces.
    """
    columns = docs.columns if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or vocabulary_path())
        for batch in batches:
            for part, texts in slices(batch, texts_of(batch, text_col if text_col in columns else None)):
                rows = []
                for text in texts:
                    joined = own.encode_joined(text or "")
                    ids = list(map(int, joined.split(","))) if joined else []
                    decoded = own.decode(ids)
                    row = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, ids, decoded) if with_ids else row)
                arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[CARRIED, *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    types = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if with_ids else [])]
    base = carry(docs, columns, **({} if text_col in columns else {"own": F.col(f"`{text_col}`")}))
    schema = base.select(CARRIED).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return restore(base.mapInArrow(run, schema), columns, **{n: F.col(n) for n in names})
