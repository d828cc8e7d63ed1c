"""Pronunciation and its similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phones and spelling rules that decide results.
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "B": "b", "CH": "tʃ", "D": "d", "DH": "ð",
    "EH": "ɛ", "ER": "ɝ", "EY": "eɪ", "F": "f", "G": "ɡ", "HH": "h", "IH": "ɪ", "IY": "i", "JH": "dʒ", "K": "k",
    "L": "l", "M": "m", "N": "n", "NG": "ŋ", "OW": "oʊ", "OY": "ɔɪ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ",
    "T": "t", "TH": "θ", "UH": "ʊ", "UW": "u", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
SPELLING = [("ph", "f"), ("tion", "ʃən"), ("ch", "tʃ"), ("sh", "ʃ"), ("th", "θ"), ("qu", "kw"), ("c(?=[eiy])", "s"), ("c", "k"), ("g(?=[eiy])", "dʒ"), ("x", "ks"), ("y", "i")]


def arpabet_to_ipa(col: Column) -> Column:
    """Phones of a line of ARPAbet, stress dropped; unknown ones lower-cased."""
    table = F.create_map(*[F.lit(x) for pair in ARPABET.items() for x in pair])
    phones = F.filter(F.split(F.trim(col), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(phones, lambda p: F.coalesce(table[F.regexp_replace(p, "[0-9]", "")], F.lower(F.regexp_replace(p, "[0-9]", "")))), "")


def spelled(col: Column) -> Column:
    """The pronunciation that a spelling suggests; empty for scripts without Latin letters."""
    value = F.replace(col, F.lit(" "), F.lit(""))
    for pattern, sound in SPELLING:
        value = F.regexp_replace(value, pattern, sound)
    return F.regexp_replace(value, "[^a-zɑ-ʒθðŋɹ]+", "")


def ngrams(col: Column, size: int = 3) -> Column:
    """Distinct n-grams of the text between ^ and $; the whole if it is no longer than one."""
    padded = F.concat(F.lit("^"), col, F.lit("$"))
    several = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(size))))
    return F.when(F.length(padded) <= size, F.array(padded)).otherwise(several)


def ngram_similarity(left: Column, right: Column, size: int = 3) -> Column:
    a, b = ngrams(left, size), ngrams(right, size)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def edit_similarity(left: Column, right: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(left == right, 1.0).when((left == "") | (right == ""), 0.0).otherwise(1.0 - F.levenshtein(left, right) / longer)


def feature_similarity(left: Column, right: Column) -> Column:
    """``edit_similarity``, but 0 as soon as either is empty."""
    return F.when((left == "") | (right == ""), 0.0).otherwise(edit_similarity(left, right))
