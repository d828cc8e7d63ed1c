"""A cheap upper bound of how near a span can be to any name of a small dictionary, from its letters alone."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from termweave.functions import phonetics, text

#: Spans of these characters only, without digits, are judged; of all others nothing is said. They are Latin, and NFKC leaves them alone.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ \n\t.,;:!?()'-]*")
_OTHER = re.compile(r"[^a-zà-öø-ÿ\s'-]")
_SILENT = re.compile("[^a-zɑ-ʒθðŋɹ]+")
_DROPPED = frozenset(text.ROUTES + text.DOSAGE_FORMS)
_RULES = [(re.compile(a) if "(" in a else a, b) for a, b in phonetics.SPELLING]


def plain_normalized(span: str) -> str:
    """``normalized`` of a plain span in a case-folded language; empty if only routes and dosage forms are left."""
    words = (w.strip("-'") for w in _OTHER.sub(" ", span.casefold()).split())
    return " ".join(w for w in words if w and w not in _DROPPED)


def spelled(normalized: str) -> str:
    """``phonetics.spelled`` of a plain text."""
    value = normalized.replace(" ", "")
    for rule, sound in _RULES:
        value = value.replace(rule, sound) if isinstance(rule, str) else rule.sub(sound, value)
    return _SILENT.sub("", value)


#: Between texts that are read as one; it stands in no plain span and is left alone by all rules.
_END = "\0"
_OTHER_OR_END, _SILENT_OR_END = (re.compile(x.pattern.replace("[^", "[^\\0")) for x in (_OTHER, _SILENT))


def all_plain_normalized(spans: list[str]) -> list[str]:
    """``plain_normalized`` of each span, read as one text."""
    read = _OTHER_OR_END.sub(" ", _END.join(spans).casefold()).split(_END)
    out = []
    for x in read:
        words = x.split()
        if "'" in x or "-" in x or not _DROPPED.isdisjoint(words):
            words = [w for w in (w.strip("-'") for w in words) if w and w not in _DROPPED]
        out.append(" ".join(words))
    return out


def all_spelled(normalized: list[str]) -> list[str]:
    """``spelled`` of each text, read as one text."""
    value = _END.join(normalized).replace(" ", "")
    for rule, sound in _RULES:
        value = value.replace(rule, sound) if isinstance(rule, str) else rule.sub(sound, value)
    return _SILENT_OR_END.sub("", value).split(_END)


def _codes(texts: list[str], codes: dict[str, int]) -> np.ndarray:
    """The code of each letter of the joined texts; of others the number of codes."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    table = np.full(max([*map(ord, codes), int(joined.max(initial=0))]) + 1, len(codes), np.int64)
    for c, i in codes.items():
        table[ord(c)] = i
    return table[joined]


def _steps(texts: list[str], codes: dict[str, int]) -> np.ndarray:
    """Row i: the code of each text's letter at place i."""
    sizes = np.array([len(x) for x in texts], np.int64)
    out = np.full((int(sizes.max(initial=0)), len(texts)), len(codes), np.uint8 if len(codes) < 255 else np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, np.repeat(np.arange(len(texts)), sizes)] = _codes(texts, codes)
    return out


def _letters(texts: list[str], codes: dict[str, int]) -> np.ndarray:
    """A row for each letter of ``codes``: how often each text has it."""
    places = _codes(texts, codes) * len(texts) + np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    counts = np.bincount(places, minlength=(len(codes) + 1) * len(texts)).reshape(-1, len(texts))
    return np.minimum(counts[:-1], 30_000).astype(np.int16)


def _common(have: np.ndarray, own: list[tuple[int, int]]) -> np.ndarray:
    """How many letters each text has in common with one that has the letters ``own`` (place, how often)."""
    out = np.zeros(have.shape[1], np.int32)
    for place, times in own:
        out += np.minimum(have[place], times)
    return out


#: Longer sounds are judged by their letters only; forms have at most as many letters as a machine integer has bits.
LONGEST, BITS = 256, 64


def _in_order(form: str, steps: np.ndarray, sounds: dict[str, int]) -> np.ndarray:
    """Length of the longest common subsequence of ``form`` with each text; row i of ``steps`` has their letters at place i, bit-parallel."""
    where = np.zeros(len(sounds) + 1, np.uint64)
    for i, c in enumerate(form):
        where[sounds[c]] |= np.uint64(1 << i)
    row = np.full(steps.shape[1], ~np.uint64(0))
    for letters in steps:
        hit = row & where[letters]
        row = row + hit | row ^ hit
    return len(form) - np.bitwise_count(row & np.uint64((1 << len(form)) - 1)).astype(np.int64)


def hopeful(entries: list[tuple[list[str], list[str]]], least: float) -> Callable[[list[str]], np.ndarray]:
    """A function: which plain spans may reach ``least`` at 0.65 by sound and 0.35 by spelling for some entry (forms, names).

    Two texts have no more in common, in whatever order or stretch, than the letters that stand in both. So the
    sound is at most these letters over the longer length (then at most the longest common subsequence over it,
    as an edit is needed for every other letter of the longer), and spellings without a word in common are at most
    as similar as these letters allow. Spans that hold a word of a name are always kept.
    """
    forms, names = sorted({f for fs, _ in entries for f in fs if f}), sorted({a for _, ns in entries for a in ns if a})
    sounds, letters = ({c: i for i, c in enumerate(sorted(set("".join(x))))} for x in (forms, names))
    counted = lambda texts, codes: [[(codes[c], min(x.count(c), 30_000)) for c in sorted(set(x))] for x in texts]
    form_letters, name_letters = counted(forms, sounds), counted(names, letters)
    known = {w for a in names for w in a.split()}
    distinct = [len(" ".join(set(a.split()))) for a in names]
    place_f, place_n = {f: i for i, f in enumerate(forms)}, {a: i for i, a in enumerate(names)}
    own = [([place_f[f] for f in fs if f], [place_n[a] for a in ns if a]) for fs, ns in entries]

    def judge(spans: list[str]) -> np.ndarray:
        normal = all_plain_normalized(spans)
        words = [x.split(" ") for x in normal]
        keep = np.array([not x or not known.isdisjoint(w) for x, w in zip(normal, words, strict=True)], bool)
        said = all_spelled(normal)
        size, long = np.array([len(x) for x in said]), np.array([len(x) for x in normal])
        once = np.array([len(x) if len(set(w)) == len(w) else len(" ".join(set(w))) for x, w in zip(normal, words, strict=True)])
        have = _letters(said, sounds)
        sound = np.stack([_common(have, f) / np.maximum(size, len(x)) for f, x in zip(form_letters, forms, strict=True)])
        have, like, parts = _letters(normal, letters), [], {}
        for f, x, short in zip(name_letters, names, distinct, strict=True):
            if len(x) not in parts:
                ratio = np.maximum(long, len(x)) / np.maximum(1, np.minimum(long, len(x)))
                parts[len(x)] = np.where(ratio < 1.5, 0.0, np.where(ratio <= 8.0, 0.9, 0.6))
            both = _common(have, f)
            like.append(np.maximum(2 * both / (once + short), parts[len(x)] * 2 * both / np.maximum(1, np.minimum(once, short) + both)))
        like = np.stack(like)
        spellings = [0.35 * like[ns].max(0) if ns else np.zeros(len(spans)) for _, ns in own]
        could = np.zeros(len(spans), bool)
        for (fs, _), spelling in zip(own, spellings, strict=True):
            for f in fs:
                could |= 0.65 * sound[f] + spelling >= least - 1e-6
        read = np.flatnonzero(could & ~keep & (size <= LONGEST))  # only of these the order matters
        steps, place = _steps([said[i] for i in read], sounds), np.zeros(len(spans), np.int64)
        place[read] = np.arange(len(read))
        for (fs, _), spelling in zip(own, spellings, strict=True):
            for f in fs:
                maybe = np.flatnonzero(~keep & (0.65 * sound[f] + spelling >= least - 1e-6))
                exact = maybe[size[maybe] <= LONGEST] if len(forms[f]) <= BITS else maybe[:0]
                keep[np.setdiff1d(maybe, exact)] = True
                if len(exact):
                    order = _in_order(forms[f], steps[: size[exact].max(), place[exact]], sounds) / np.maximum(size[exact], len(forms[f]))
                    keep[exact[0.65 * order + spelling[exact] >= least - 1e-6]] = True
        return keep

    return judge
