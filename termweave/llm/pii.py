"""Personal data: exact base patterns, and boosted trees over overlapping candidate spans of looser generators."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.util import CARRIED, carry, restore, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, in linear time; by kind, then start."""
    out: list[Span] = []
    floor = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            floor = m.end()
            out.append(("email", begin, floor))
        at = text.find("@", at + 1)
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


# Candidates ---------------------------------------------------------------------------------------------

_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s", re.I)
_AFTER_AT = re.compile(r"\s?[A-Za-z0-9-]++(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)[A-Za-z0-9-]++)+", re.I)
_RUN = re.compile(r"[0-9]+(?:[\x20().-]{1,2}[0-9]+)*")
#: Digits of a candidate, at most; the groups they come in may be any.
_MOST_DIGITS = 19


def candidates(text: str) -> Iterator[Span]:
    """High-recall spans, overlapping each other: whatever looks like an address, and every row of digit groups of a fitting length."""
    for m in _AT.finditer(text):
        end = m.start() - text[max(0, m.start() - 1) : m.start()].isspace()
        begin = end
        while begin and text[begin - 1] in _LOCAL:  # of any length; stops at the "at" before, so all in all linear
            begin -= 1
        while begin < end and text[begin] in "._%+-":
            begin += 1
        right = _AFTER_AT.match(text, m.end()) if begin < end else None
        if right:
            yield "email", begin, right.end()
    if not _DIGITS.search(text):
        return
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, *run.span())]
        for i, (begin, _) in enumerate(groups):
            total = 0
            for j in range(i, len(groups)):
                total += groups[j][1] - groups[j][0]
                if total > _MOST_DIGITS:
                    break
                end = groups[j][1]
                if j - i == 3 and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, j)):
                    yield "ip", begin, end
                if total >= 13:
                    yield "card", begin, end
                if 7 <= total <= 15:
                    start = begin
                    if start and text[start - 1] == "(" and ")" in text[start:end]:
                        start -= 1
                    if start and text[start - 1] == "+":
                        start -= 1
                    yield "phone", start, end


_CUES = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial", "whatsapp", "sms", "number"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "pan"),
    "ip": ("ip", "host", "server", "address", "gateway", "dns", "ping"),
    "email": ("mail", "contact", "write", "reach", "send", "address", "reply"),
}
_AGAINST = ("version", "order", "invoice", "isbn", "section", "page", "chapter", "id", "ref", "v", "no", "release", "build", "date", "sku", "total")
_WORD = re.compile(r"[A-Za-z]+")


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, a, b = span
    s = text[a:b]
    groups = _DIGITS.findall(s)
    sizes = [len(g) for g in groups]
    digits = "".join(groups)
    n = len(digits)
    seps = set(re.sub(r"[0-9+]", "", s))
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    near = [w.lower() for w in _WORD.findall(text[max(0, a - 28) : a])[-4:]]
    octets = len(sizes) == 4 and all(map(_small, groups))
    return [
        float(KINDS.index(kind)),
        float(n),
        float(len(sizes)),
        float(max(sizes, default=0)),
        float(min(sizes, default=0)),
        float(len(seps)),
        float("+" in s),
        float("(" in s and ")" in s),
        float("." in seps),
        float(13 <= n <= 19 and luhn(digits)),
        float(digits[:1] in ("3", "4", "5", "6") if digits else 0),
        float(sizes in ([n], [4, 4, 4, 4], [4, 6, 5], [4, 6, 4])),
        float(sizes[-3:] == [3, 3, 4] and len(sizes) <= 4 or sizes[-2:] == [3, 4] and len(sizes) <= 4),
        float(octets),
        float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        float(any(w in _CUES[kind] for w in near)),
        float(any(w in _AGAINST for w in near)),
        float(before.isalnum() or before in ("-", "/", "_", "#", "$", "=", ".") and bool(before)),
        float(after.isalnum() or after in ("-", "/", "_", "%", "@") and bool(after)),
        float(bool(re.search(r"[(\[{]\s?(?:at|dot)\s?[)\]}]", s, re.I))),
        float("@" in s),
        float(bool(re.search(r"\sdot\s", s, re.I))),
        float(bool(re.search(r"(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu)$", s, re.I))),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[.-][01][0-9][.-][0-3][0-9].*", s))),
        float(bool(re.match(r"[\x20().-]{0,2}[0-9]", text[b : b + 3])) or bool(re.search(r"[0-9][\x20().-]{0,2}$", text[max(0, a - 3) : a]))),
    ]


# Boosted trees ------------------------------------------------------------------------------------------


class BoostedTrees:
    """Logistic boosting of small trees, exact splits over the values seen in training."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._walk(tree, x)
        return self

    def _grow(self, x, grad, hess, rows, depth):
        value = self.rate * grad[rows].sum() / (hess[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 2 * self.least:
            return value
        g_all, h_all, found = grad[rows].sum(), hess[rows].sum(), None
        for j in range(x.shape[1]):
            v, place = np.unique(x[rows, j], return_inverse=True)
            if len(v) < 2:
                continue
            g, h, n = (np.bincount(place, w)[:-1].cumsum() for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1)
            gain[(n < self.least) | (len(rows) - n < self.least)] = -np.inf
            k = int(np.argmax(gain))
            if found is None or gain[k] > found[0] + 1e-12:
                found = gain[k], j, (v[k] + v[k + 1]) / 2
        if found is None or found[0] <= g_all**2 / (h_all + 1) + 1e-9:
            return value
        _, j, edge = found
        low = x[rows, j] <= edge
        return j, edge, self._grow(x, grad, hess, rows[low], depth - 1), self._grow(x, grad, hess, rows[~low], depth - 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, edge, low, high = tree
        return np.where(x[:, j] <= edge, self._walk(low, x), self._walk(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self._walk(tree, x)
        return 1 / (1 + np.exp(-f))


def training_spans(seed: int, rows: int = 3000) -> list[tuple[str, Span, int]]:
    """Made-up sentences with marked spans: (text, candidate, 1 if it is personal data)."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8)))
    words = lambda: " ".join(w() for _ in range(r.randint(1, 5)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(x: str) -> str:
        sep = r.choice(" -")
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def cue(kind: str) -> str:
        return r.choice(_CUES[kind]) + r.choice(("", ":", " is")) + " "

    def area() -> str:
        return f"({d(3)}) {d(3)}-{d(4)}"

    def dealt(x: str) -> str:
        """Digit by digit or in pairs."""
        step, sep = r.choice((1, 1, 2)), r.choice("  -.")
        return sep.join(x[i : i + step] for i in range(0, len(x), step))

    octet = lambda: str(r.randint(0, 255))
    made = [
        (lambda: (r.choice(("", cue("email"))), f"{w()}{r.choice(('@', ' (at) ', ' [at] ', ' at '))}{w()}{r.choice((' dot ', ' [dot] ', '(dot)'))}{r.choice(('com', 'org', 'net', 'de'))}"), "email", 1),
        (lambda: ("", f"{w()} at {w()}.{r.choice((w(), 'com', 'org'))}"), "email", 0),
        (lambda: (cue("phone"), r.choice((area(), f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(3)} {d(4)}", f"{d(5)} {d(6)}"))), "phone", 1),
        (lambda: ("", r.choice((area(), f"+{d(1)} {area()}", f"{d(3)}-{d(3)}-{d(4)}"))), "phone", 1),
        (lambda: (r.choice(_AGAINST) + " ", r.choice((d(8), d(10), f"{d(3)}-{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}"))), "phone", 0),
        (lambda: ("", r.choice((d(7), d(9), d(10), f"{d(4)} {d(4)}", f"19{d(2)}-20{d(2)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"{d(2)} {d(3)} {d(2)}", f"{d(3)}.{d(4)}", f"{d(3)}-{d(4)}"))), "phone", 0),
        (lambda: (r.choice(("", "", cue("card"))) + r.choice(("", d(2) + " ", d(3) + " ")), r.choice((card(), grouped(card())))), "card", 1),
        (lambda: (r.choice(("", r.choice(_AGAINST) + " ")), r.choice((d(13), d(16), d(14), d(19), grouped(d(16))))), "card", None),
        (lambda: (cue("phone"), dealt(d(10))), "phone", 1),
        (lambda: (r.choice(("", r.choice(_AGAINST) + " ")), dealt(d(r.randint(7, 15)))), "phone", 0),
        (lambda: (r.choice(("", cue("card"))) + r.choice(("", d(2) + " ")), dealt(card())), "card", 1),
        (lambda: (r.choice(("", r.choice(_AGAINST) + " ")), dealt(d(r.randint(13, 19)))), "card", None),
        (lambda: (r.choice(("", cue("email"))), f"{w()} at {w()}{''.join(f' dot {w()}' for _ in range(r.randint(2, 6)))} dot {r.choice(('com', 'org', 'net', 'de'))}"), "email", 1),
        (lambda: (cue("ip"), f"{octet()}.{octet()}.{octet()}.{octet()}"), "ip", 1),
        (lambda: (r.choice(("version ", "section ", "release ", "")), f"{d(1)}.{r.randint(256, 999)}.{d(1)}.{d(4)}"), "ip", 0),
    ]
    out = []
    for i in range(rows):
        make, kind, label = made[i % len(made)]
        lead, body = make()
        head = f"{words()} {lead}"
        text = f"{head}{body} {r.choice(('', d(2) + ' '))}{words()}"
        own = (kind, len(head), len(head) + len(body))
        if label is None:  # random digits: never a card that fails its check digit; lucky ones are left out
            digits = "".join(_DIGITS.findall(body))
            if luhn(digits) and digits[0] in "3456" and len(digits) == 16:
                continue
            label = 0
        out.append((text, own, label))
        # parts of a span, or a span with a neighbour, are wrong cuts
        out += [(text, c, 0) for c in candidates(text) if c != own and (c[0] != kind or label == 0 or c[1] != own[1] or c[2] != own[2])][:4]
    return out


@functools.lru_cache(maxsize=1)
def model(precision: float = 0.98) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and for each kind the lowest threshold whose held-out precision (on other made-up sentences) is enough."""
    train, hold = training_spans(1), training_spans(2, 1500)
    table = lambda rows: np.array([features(t, s) for t, s, _ in rows])
    trees = BoostedTrees().fit(table(train), np.array([y for *_, y in train], float))
    p, y, kind = trees.predict(table(hold)), np.array([y for *_, y in hold]), np.array([s[0] for _, s, _ in hold])
    at = {}
    for k in KINDS:
        order = np.argsort(-p[kind == k], kind="stable")
        right = y[kind == k][order].cumsum() / np.arange(1, len(order) + 1)
        ps = p[kind == k][order]
        fine = np.flatnonzero((right >= precision) & np.r_[ps[:-1] > ps[1:], True])
        at[k] = max(0.5, float(ps[fine[-1]])) if len(fine) else 1.1
    return trees, at


def added_spans(text: str, base: list[Span], trees: BoostedTrees, at: dict[str, float]) -> list[Span]:
    """Candidates that the trees accept, the likeliest first; none overlaps a base span or one chosen before."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    tops = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(span: Span) -> bool:
        i = bisect.bisect_left(starts, span[2])
        return not i or tops[i - 1] <= span[1]

    left, likely = filter(free, candidates(text)), {}
    while part := list(itertools.islice(left, 4096)):
        p = trees.predict(np.array([features(text, s) for s in part]))
        likely |= {s: x for s, x in zip(part, p.tolist(), strict=True) if x >= at[s[0]]}
    out: list[tuple[int, int, str]] = []
    for kind, a, b in sorted(likely, key=lambda s: (-likely[s], s[1] - s[2], s)):
        k = bisect.bisect_left(out, (b, -1, ""))
        if k and out[k - 1][1] > a:
            continue
        bisect.insort(out, (a, b, kind))
    return [(k, a, b) for a, b, k in out]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find_pii(docs: DataFrame, text_col: str = "text", precision: float = 0.98, columns: list[str] | None = None) -> DataFrame:
    """Adds to ``columns`` (all by default), or replaces there, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans and redacted.

    The counts n_<kind> and base_sha256 are of the base patterns, all of which stay. ``spans`` holds these and
    what the boosted trees add (n_added; for example a number that a base pattern lost because another number
    touches it, or an address written with "at" and "dot"), as kind:start:end in code points, end exclusive,
    by kind, then start. ``redacted`` is the text with each span, overlaps merged, replaced by [kind]. A null text counts as
    empty and keeps a null redaction. The trees are fitted on the driver to made-up sentences; rows are
    worked on one by one, in linear time, without a shuffle.
    """
    trees, at = model(precision)
    columns = docs.columns if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, texts_of(batch, text_col if text_col in columns else None)):
                rows = []
                for text in texts:
                    own = text or ""
                    base = base_spans(own)
                    more = added_spans(own, base, trees, at)
                    counts = [sum(k == kind for k, *_ in base) for kind in KINDS]
                    rows.append((*counts, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), None if text is None else redact(own, base + more)))
                found = zip(*rows, strict=True)
                types = [pa.int64()] * 5 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], names=[CARRIED, *names])

    names = [f"n_{k}" for k in KINDS] + ["n_added", "base_sha256", "spans", "redacted"]
    base = carry(docs, columns, **({} if text_col in columns else {"own": F.col(f"`{text_col}`")}))
    schema = base.select(CARRIED).schema
    for n in names:
        schema = schema.add(n, "long" if n.startswith("n_") else "string")
    return restore(base.mapInArrow(run, schema), columns, **{n: F.col(n) for n in names})


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at:a], f"[{kind}]"] if a >= at else []
        at = b
    return "".join(out) + text[at:]
