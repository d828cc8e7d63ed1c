"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Two aspects are judged, form (junk) and tone (abuse); each has its own labellers, its own label model over
all documents, and its own scorer trained on the model's posterior labels. A document that either scorer
calls bad is rejected.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import CARRIED, carry, cut, drop_cut, restore, slices, texts_of

#: Insults that the built-in labellers know; the mined list adds what labelled rows show.
INSULTS = frozenset("trash pathetic idiot worthless disgusting stupid clown scum loser moron imbecile dumb jerk garbage vermin filth bastard".split())
BITS = 16
#: Defaults of the bounds on what fits the model: labelled rows read to mine words, documents a class that train the scorers.
LABELLED, SAMPLE = 40_000, 4_000
FORM, TONE, THIRDS, STEM = 8, 4, 3, 5
GOOD, NONE, BAD = 0, 1, 2
NUMBERS = 3
#: Weight of the squared weights in fitting.
RIDGE = 3e-4

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_PLAIN = re.compile(r"[\"'(]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"').,;:!?]*")
_RUNS = re.compile(r"(.)\1+", re.S)
_BREAK = re.compile(r"\s")
_HALF = 1 << (BITS - 1)
#: What a worker keeps between batches: tokens, and their characters in all.
_KEPT, _KEPT_CHARS = 200_000, 8_000_000
#: Facts of a token: letters, capitals, odd characters, whether plain, whether a sentence ends; then the thirds of the list, and unlisted words of a mined beginning.
_LISTED = 5


class Describer(dict):
    """Token -> row of a table of what is known of it; turns texts into votes and features by sums over rows.

    Nothing depends on a text's length: a text's tokens are all in the table at once, and the table is emptied
    between batches only.
    """

    def __init__(self, listed: frozenset[str]):
        super().__init__()
        self.words, self.stems = INSULTS | {w for w in listed if not w.endswith("*")}, {w[:-1] for w in listed if w.endswith("*")}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars = 0
        self._words, self._kinds = array("H"), array("I")  # of each row: the slot of its word, and its kind
        self._shapes, self._facts = array("H"), array("f")  # of each kind, as most tokens are alike but for the word
        self._kind_of: dict[tuple, int] = {}

    def __missing__(self, token: str) -> int:
        core = token.rstrip(".,")
        plain_word = core.isalpha() and (core.islower() or core[1:].islower())  # nearly all tokens
        word = core.lower() if plain_word else _EDGES.sub("", token.lower())
        crc = zlib.crc32(word.encode())
        tone = (crc >> 16) % THIRDS if word in self.words else THIRDS if word[:STEM] in self.stems and len(word) > STEM else None
        key = (tone, len(core), word != core, token[len(core) :]) if plain_word else (tone, token)
        kind = self._kind_of.get(key)
        if kind is None:
            kind = self._kind_of[key] = self._new_kind(token, tone)
        self._words.append(crc % _HALF)
        self._kinds.append(kind)
        row = self[token] = len(self)
        self.chars += len(token)
        return row

    def _new_kind(self, token: str, tone: int | None) -> int:
        letters, capitals = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
        odd = sum(not c.isalnum() and c not in "_.,'\"-" for c in token)
        self._facts.extend((letters, capitals, odd, bool(_PLAIN.fullmatch(token)), token.endswith((".", "!", "?")), *(float(k == tone) for k in range(TONE))))
        self._shapes.append(self._shape("".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in token)))
        return len(self._shapes) - 1

    @classmethod
    def _shape(cls, form: str) -> int:
        return (cls._slot if len(form) <= 40 else cls._slot.__wrapped__)(form)  # long ones are not kept

    @staticmethod
    @functools.lru_cache(maxsize=20_000)
    def _slot(form: str) -> int:
        return zlib.crc32(_RUNS.sub(r"\1", form).encode()) % _HALF

    def _rows(self, text: str) -> np.ndarray:
        """The rows of a text's tokens; read a megabyte at a time, cut where a token ends."""
        out, at = [], 0
        while at < len(text):
            stop = len(text)
            if stop - at > 1 << 20 and (m := _BREAK.search(text, at + (1 << 20))):
                stop = m.start()
            tokens = (text if stop - at == len(text) else text[at:stop]).split()
            out.append(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))
            at = stop
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int32)

    def __call__(self, texts: list[str | None]) -> Described:
        if len(self) > _KEPT or self.chars > _KEPT_CHARS:
            self.forget()
        parts = [self._rows(t or "") for t in texts]
        size = np.array([len(p) for p in parts])
        votes = np.full((len(texts), FORM + TONE), NONE, np.uint8)
        votes[size == 0, :FORM] = BAD
        live = np.flatnonzero(size)
        numbers = np.zeros((len(texts), NUMBERS), np.float32)
        if not len(live):
            nothing = np.zeros(0, np.uint16)
            return Described(votes, nothing, size, nothing, size, np.zeros(0, np.float32), numbers)
        n, rows = size[live], np.concatenate([parts[i] for i in live])
        begin, doc = np.cumsum(n) - n, np.repeat(np.arange(len(live)), n)
        # runs of one token
        edge = np.ones(len(rows), bool)
        edge[1:] = rows[1:] != rows[:-1]
        edge[begin] = True
        at = np.flatnonzero(edge)
        runs, first = np.diff(at, append=len(rows)), np.searchsorted(at, begin)
        longest, same = np.maximum.reduceat(runs, first), (n - np.diff(first, append=len(at))) / n
        in_runs = np.add.reduceat(np.where(runs >= 3, runs, 0), first) / n
        # distinct tokens of each text
        key = np.sort(doc << 32 | rows)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many, own, of = np.diff(at, append=len(key)), (key[at] & 0xFFFFFFFF).astype(np.int32), key[at] >> 32
        first = np.searchsorted(of, np.arange(len(live)))
        kind, slot = np.array(self._kinds)[own], np.array(self._words)[own].astype(np.int64)
        facts, form = np.array(self._facts).reshape(-1, _LISTED + TONE)[kind].astype(np.float64), np.array(self._shapes)[kind].astype(np.int64)
        letters, capitals, odd, plain, stops = np.add.reduceat(facts[:, :_LISTED] * many[:, None], first).T
        most = np.maximum.reduceat(many, first) / n
        odd, upper = odd / np.array([len(texts[i]) for i in live]), capitals / np.maximum(1, letters)
        long, stops = n >= 30, 100 * stops / n
        hits = facts[:, _LISTED:] > 0
        tone = np.zeros((len(live), TONE), bool)
        for k in range(TONE):
            tone[of[hits[:, k]], k] = True
        votes[live] = np.stack([
            _votes(odd, 0.012, 0.04),
            np.where(letters >= 40, _votes(upper, 0.1, 0.35), NONE),
            np.where(long, _votes(same, 0.04, 0.15), NONE),
            np.where(long, _votes(longest, 2, 6), NONE),
            np.where(long, _votes(in_runs, 0.01, 0.1), NONE),
            np.where(long, _votes(most, 0.12, 0.3), NONE),
            _votes(1 - plain / n, 0.15, 0.4),
            np.where(long, np.where((stops >= 2) & (stops <= 40), GOOD, np.where((stops == 0) & (n >= 60), BAD, NONE)), NONE),
            *np.where(tone, BAD, GOOD).T,
        ], axis=1)
        numbers[live] = np.minimum(1.0, np.stack([4 * same, 4 * odd, 2 * upper], axis=1))
        words = np.sort(of << BITS | slot)
        words = words[np.r_[True, words[1:] != words[:-1]]]
        shapes = of << BITS | form
        order = np.argsort(shapes)
        shapes, weight = shapes[order], many[order]
        at = np.flatnonzero(np.r_[True, shapes[1:] != shapes[:-1]])
        shapes, share = shapes[at], np.add.reduceat(weight, at)
        count = lambda keys: np.bincount(live[keys >> BITS], minlength=len(texts))
        low = lambda keys: (keys & (_HALF - 1)).astype(np.uint16)
        return Described(votes, low(words), count(words), low(shapes), count(shapes), (4.0 * share / n[shapes >> BITS]).astype(np.float32), numbers)


def _votes(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """GOOD up to ``good``, BAD from ``bad``, else no vote."""
    return np.where(x <= good, GOOD, np.where(x >= bad, BAD, NONE))


class Described:
    """Votes and features of some texts: slots of words, slots of shapes with the shares of tokens that have them, and numbers."""

    def __init__(self, votes, words, n_words, shapes, n_shapes, shares, numbers):
        self.votes, self.words, self.n_words, self.shapes, self.n_shapes, self.shares, self.numbers = votes, words, n_words, shapes, n_shapes, shares, numbers

    def arrays(self) -> list[pa.Array]:
        """FEATURES as Arrow columns."""
        letters = (self.votes + 48).astype(np.uint8)
        shapes = np.zeros(len(self.shapes), np.dtype([("s", "<u2"), ("v", "<f4")]))
        shapes["s"], shapes["v"] = self.shapes, self.shares
        n = len(self.votes)
        votes = _binary(letters, np.full(n, letters.shape[1])).cast(pa.string())
        return [votes, _binary(self.words.astype("<u2"), 2 * self.n_words), _binary(shapes, 6 * self.n_shapes), _binary(self.numbers.astype("<f4"), np.full(n, 4 * NUMBERS))]

    @classmethod
    def of(cls, words: pa.Array, shapes: pa.Array, numbers: pa.Array) -> Described:
        w, n_words = _plain(words, "<u2")
        s, n_shapes = _plain(shapes, np.dtype([("s", "<u2"), ("v", "<f4")]))
        return cls(None, w, n_words, s["s"], n_shapes, s["v"], _plain(numbers, "<f4")[0].reshape(-1, NUMBERS))

    def form(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, slot and value of each feature of form."""
        n = len(self.n_words)
        at = np.concatenate([self.shapes.astype(np.int64), np.tile(_HALF + np.arange(NUMBERS), n)])
        return np.concatenate([np.repeat(np.arange(n), self.n_shapes), np.repeat(np.arange(n), NUMBERS)]), at, np.concatenate([self.shares, self.numbers.ravel()]).astype(float)

    def tone(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, slot and value of each word; values of long texts are smaller, so that many common words do not add up to a verdict."""
        return np.repeat(np.arange(len(self.n_words)), self.n_words), self.words.astype(np.int64), np.repeat(6 / np.sqrt(np.maximum(1, self.n_words)), self.n_words)


FEATURES = {"votes": "string", "words": "binary", "shapes": "binary", "numbers": "binary"}


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _plain(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // size


@functools.lru_cache(maxsize=1)
def describer(listed: frozenset[str]) -> Describer:
    """One a worker process."""
    return Describer(listed)


def mine_words(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> frozenset[str]:
    """Words, and beginnings of STEM letters (written with a star), that mark abusive documents.

    Reads the texts of at most ``most`` labelled rows, those of the lowest hash. Nine tenths of the documents
    that have the word are abusive, and so many that chance would give less than one such word in all.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled"), F.col("toxic"))
    rows = rows.orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("labelled"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{2,}"), F.lit(0)))
    stems = F.array_distinct(F.transform(F.filter("found", lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))
    words = texts.select("toxic", found.alias("found")).select("toxic", F.explode(F.concat("found", stems)).alias("word"))
    words = cut(words.groupBy("word").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).where("n >= 3"), "words")
    share = rows.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return frozenset()
    least = max(3, math.ceil(math.log(max(2, words.count())) / -math.log(min(share, 0.5))))
    return frozenset(r["word"] for r in words.where((F.col("bad") >= least) & (F.col("bad") >= 0.9 * F.col("n"))).select("word").collect())


def label_model(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of bad for each row of votes, by expectation-maximisation.

    Each labeller has, for good and for bad documents, a probability of voting bad when it votes; no vote is no
    evidence. ``weight`` tells how many documents have the row's votes.
    """
    yes, no = votes == BAD, votes == GOOD
    q = (yes.sum(1) + 0.05) / (yes.sum(1) + 0.5 * no.sum(1) + 0.6)
    total = weight.sum()
    for _ in range(rounds):
        share = np.clip((weight * q).sum() / total, 1e-4, 0.5)
        logit = np.full(len(q), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            hit = (weight * q * yes[:, j]).sum() + 1.0, (weight * q * no[:, j]).sum() + 0.3
            miss = (weight * (1 - q) * yes[:, j]).sum() + 0.3, (weight * (1 - q) * no[:, j]).sum() + 1.0
            sure, loose = hit[0] / sum(hit), miss[0] / sum(miss)
            logit += yes[:, j] * np.log(sure / loose) + no[:, j] * np.log((1 - sure) / (1 - loose))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return new


def fit_scorer(features: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray, prior: float, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer on posterior labels. AdaGrad over whole passes.

    The classes of a sample weigh as they do in the corpus, where ``prior`` is the share of bad documents.
    """
    row, at, value = features
    size = _HALF + NUMBERS + 1
    share = prior * target / max(target.sum(), 1e-9) + (1 - prior) * (1 - target) / max((1 - target).sum(), 1e-9)
    share /= share.sum()
    w, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(rounds):
        err = (_scores(features, w, len(target)) - target) * share
        grad = np.bincount(at, value * err[row], size) + RIDGE * w
        grad[-1] = err.sum()
        seen += grad**2
        w -= 0.25 * grad / np.sqrt(seen)
    return w


def _scores(features: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, n: int) -> np.ndarray:
    row, at, value = features
    z = np.bincount(row, value * weights[at], n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, labelled: int = LABELLED, sample: int = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """Adds (or replaces) votes, p_junk, p_abuse, score and keep; all other columns return, or those in ``columns``.

    ``votes`` has a digit a labeller: 0 good, 1 none, 2 bad. The label models see the votes of all documents,
    as counts of vote patterns (at most 3^12, whatever the input). The scorers are fitted to about ``sample``
    documents a class of either aspect, drawn by hash; p_junk and p_abuse are the scorers' probabilities, score
    is one less the larger, and keep is whether both are under ``threshold``. Null, empty and blank
    texts are rejected (score 0). ``labels`` (doc_id, toxic) serves only to mine words for the labellers of
    tone, from at most ``labelled`` rows; without it they know the built-in words. Each of three has a third of the words,
    the fourth looks at other words of a mined beginning, so no occurrence counts with two of them.
    Rows that repeat get equal results.

    Scale: two passes over the texts (and those of labelled rows once more). The first writes votes and
    features, about a quarter of the texts' size, to fit the models, and that table is deleted before the
    second judges. No shuffle but of pattern counts, the samples and word counts.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    columns = docs.columns if columns is None else columns
    listed = mine_words(docs.select(id_.alias("doc_id"), text.alias("text")), labels, labelled) if labels is not None else frozenset()

    own = lambda batch: texts_of(batch, text_col if text_col in columns else None)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = describer(listed)
        for batch in batches:
            for part, texts in slices(batch, batch.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0), *known(texts).arrays()], names=["h", *FEATURES])

    kinds = ", ".join(f"{n} {kind}" for n, kind in FEATURES.items())
    described = cut(docs.select(F.xxhash64(id_, text).alias("h"), text.alias("text")).mapInArrow(describe, f"h long, {kinds}"), "described")
    weights = _fit(described, sample)
    drop_cut(described)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = describer(listed)
        for batch in batches:
            for part, texts in slices(batch, own(batch)):
                found = known(texts)
                junk, abuse = (_scores(f, w, len(texts)) for f, w in zip((found.form(), found.tone()), weights, strict=True))
                none = found.n_words == 0
                junk[none], abuse[none] = 1.0, 0.0
                worst = np.maximum(junk, abuse)
                yield pa.RecordBatch.from_arrays([part.column(0), found.arrays()[0], pa.array(junk), pa.array(abuse), pa.array(1 - worst), pa.array(worst < threshold)], names=[CARRIED, *names])

    names = ["votes", "p_junk", "p_abuse", "score", "keep"]
    base = carry(docs, columns, **({} if text_col in columns else {"own": text}))
    schema = base.select(CARRIED).schema
    for n, kind in zip(names, ["string", "double", "double", "double", "boolean"], strict=True):
        schema = schema.add(n, kind)
    return restore(base.mapInArrow(judge, schema), columns, **{n: F.col(n) for n in names})


def _fit(described: DataFrame, sample: int) -> list[np.ndarray]:
    """The two scorers' weights, from the vote patterns of all rows and a sample of their features drawn by hash."""
    spark = described.sparkSession
    patterns = sorted((r["votes"], r["count"]) for r in described.groupBy("votes").count().collect())  # at most 3^12
    nothing = [np.zeros(_HALF + NUMBERS + 1)] * 2
    if not patterns:
        return nothing
    votes, many = np.array([[int(c) for c in p] for p, _ in patterns]), np.array([n for _, n in patterns], float)
    q = np.stack([label_model(votes[:, :FORM], many), label_model(votes[:, FORM:], many)], axis=1)
    place = (q[:, 0] >= 0.5) + 2 * (q[:, 1] >= 0.5)
    rate = np.minimum(1.0, sample / np.maximum(1, np.bincount(place, many, 4)))[place]
    table = pa.table({"pattern": [p for p, _ in patterns], "rate": rate, "junk": q[:, 0], "abuse": q[:, 1]})
    unit = F.pmod(F.xxhash64(F.lit("drawn"), F.col("h")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = described.select("h", "votes", "words", "shapes", "numbers").join(F.broadcast(spark.createDataFrame(table)), F.col("votes") == F.col("pattern"))
    drawn = drawn.where((unit < F.col("rate")) & (F.length("words") > 0)).groupBy("h").agg(F.min(F.struct("junk", "abuse", "words", "shapes", "numbers")).alias("f"))
    drawn = drawn.select("h", "f.*").orderBy("h").limit(6 * sample).toArrow().combine_chunks()
    if not drawn.num_rows:
        return nothing
    known = Described.of(*(drawn.column(n).chunk(0) for n in ("words", "shapes", "numbers")))
    prior = np.clip((q * many[:, None]).sum(0) / many.sum(), 1e-3, 1 - 1e-3)
    return [fit_scorer(f, drawn.column(n).to_numpy(), float(p)) for f, n, p in zip((known.form(), known.tone()), ("junk", "abuse"), prior, strict=True)]
