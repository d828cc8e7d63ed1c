"""Text functions as Column expressions; word offsets and compatibility normalisation of non-ASCII text leave the JVM, as Arrow batches."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Vocabularies, units and languages that decide results.
ROUTES = ["oral", "po", "iv", "intravenous", "im", "intramuscular", "subcutaneous", "sc", "topical", "inhaled"]
DOSAGE_FORMS = ["tablet", "tablets", "capsule", "capsules", "solution", "suspension", "injection", "cream", "ointment", "patch", "inhaler"]
UNITS = ["mcg", "μg", "ug", "mg", "g", "kg", "ml", "l", "%", "units?"]
CASEFOLDED = ["en", "es", "fr", "de", "it", "pt"]
SCRIPT_NAMES = [("Latn", ["LATIN"]), ("Cyrl", ["CYRILLIC"]), ("Arab", ["ARABIC"]), ("Hani", ["CJK", "IDEOGRAPH"]), ("Hira", ["HIRAGANA"]), ("Kana", ["KATAKANA"]), ("Hang", ["HANGUL"]), ("Hebr", ["HEBREW"]), ("Deva", ["DEVANAGARI"])]
SCRIPT_LANGUAGE = {"Cyrl": "ru", "Arab": "ar", "Deva": "hi", "Hani": "zh", "Hira": "ja", "Kana": "ja", "Hang": "ko", "Hebr": "he", "Latn": "en"}

_W = r"\p{L}\p{N}_"
TOKEN = rf"[{_W}](?:[{_W}'’-]*[{_W}])?"
_SPACE = r"(?U)[\s\x1c-\x1f]+"
STRENGTH = rf"(?iu)(?<![{_W}])\p{{Nd}}+(?:\.\p{{Nd}}+)?(?U:[\s\x1c-\x1f]*)(?:{'|'.join(UNITS)})" + rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"


@F.pandas_udf(StringType())
def _compatibility(text: pd.Series) -> pd.Series:
    """NFKC; nulls (texts that need none) pass."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def _where_not_ascii(col: Column, udf, plain: Column) -> Column:
    odd = col.rlike(r"[^\x00-\x7F]")
    return F.when(odd, udf(F.when(odd, col))).otherwise(plain)


def _spaced(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _SPACE, " "))


def normalize_text(col: Column, language: Column | str = "en") -> Column:
    """NFKC, one kind of apostrophe and hyphen, single spaces, and case folding for some languages."""
    language = F.lit(language) if isinstance(language, str) else language
    value = _where_not_ascii(col, _compatibility, col)
    value = _spaced(F.translate(value, "’–—", "'--"))
    return F.when(language.isin(CASEFOLDED), _where_not_ascii(value, _folded, F.lower(value))).otherwise(value)


def normalize_term(col: Column, language: Column | str = "en") -> Column:
    """``normalize_text``, then everything but letters, digits, _, space, ' and - becomes a space."""
    return _spaced(F.regexp_replace(normalize_text(col, language), rf"[^{_W}\s'\-]", " "))


#: A word as ``tokens`` finds it.
WORD = re.compile(r"\w(?:[\w'’-]*\w)?")
_TOKEN_TYPE = ArrayType(StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.arrow_udf(_TOKEN_TYPE)
def _tokens(col: pa.Array) -> pa.Array:
    sizes, words, starts, ends = [], [], [], []
    for text in col.to_pylist():
        before = len(words)
        for m in WORD.finditer(text or ""):
            words.append(m.group())
            starts.append(m.start())
            ends.append(m.end())
        sizes.append(len(words) - before if text is not None else None)
    offsets, at = [], 0
    for n in sizes:
        offsets.append(None if n is None else at)
        at += n or 0
    fields = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), fields)


def tokens(col: Column) -> Column:
    """array<struct<text,start,end>>: words with half-open code-point offsets, in one Arrow pass, linear in the text; null for null.

    A running sum has no linear form among the array functions, as each step of ``aggregate`` copies its array.
    """
    return _tokens(col)


def strengths(col: Column) -> Column:
    """Doses as written, without spaces, lower-cased, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(f"({STRENGTH})"), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, _SPACE, ""))))


def _vocabulary(col: Column, words: list[str]) -> Column:
    found = F.regexp_extract_all(normalize_text(col), F.lit(rf"([{_W}]+)"), F.lit(1))
    return F.sort_array(F.array_intersect(F.array_distinct(found), F.array(*map(F.lit, words))))


def routes(col: Column) -> Column:
    return _vocabulary(col, ROUTES)


def dosage_forms(col: Column) -> Column:
    return _vocabulary(col, DOSAGE_FORMS)


def medication_fields(col: Column) -> Column:
    return F.struct(strengths(col).alias("strengths"), routes(col).alias("routes"), dosage_forms(col).alias("dosage_forms"))


def strip_structured(col: Column) -> Column:
    """The words of a span without doses, routes and dosage forms."""
    words = F.transform(F.split(normalize_term(F.regexp_replace(col, STRENGTH, " ")), " "), lambda w: F.trim(w, F.lit("-'")))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(ROUTES + DOSAGE_FORMS)), " ")


@functools.cache
def script_ranges() -> dict[str, str]:
    """For each script a character class, made from the names of all letters; letters of no listed name are Zyyy."""
    spans: dict[str, list[list[int]]] = {}
    for code in range(0x110000):
        char = chr(code)
        if not char.isalpha():
            continue
        name = unicodedata.name(char, "")
        script = next((s for s, parts in SCRIPT_NAMES if any(p in name for p in parts)), "Zyyy")
        own = spans.setdefault(script, [])
        if own and own[-1][1] == code - 1:
            own[-1][1] = code
        else:
            own.append([code, code])
    return {s: "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in r) + "]" for s, r in spans.items()}


def scripts(col: Column) -> Column:
    """Scripts of the letters, by code; [Zyyy] if there are none.

    The long character classes see only the distinct characters beyond ASCII.
    """
    odd = F.array_join(F.array_distinct(F.regexp_extract_all(col, F.lit(r"([^\x00-\x7F])"), F.lit(1))), "")
    plain = col.rlike("[A-Za-z]")
    tests = [F.when((plain | odd.rlike(cls)) if s == "Latn" else odd.rlike(cls), F.lit(s)) for s, cls in sorted(script_ranges().items())]
    ascii_only = F.array(F.when(plain, "Latn").otherwise("Zyyy"))
    found = F.array_compact(F.array(*tests))
    return F.when(~col.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(F.when(F.size(found) == 0, F.array(F.lit("Zyyy"))).otherwise(found))


def language(script_list: Column, locale: Column) -> Column:
    """struct<language,confidence,alternatives>: of the locale if there is one, else of the scripts."""
    by_script = F.create_map(*[F.lit(x) for pair in SCRIPT_LANGUAGE.items() for x in pair])
    languages = F.array_distinct(F.transform(script_list, lambda s: F.coalesce(by_script[s], F.lit("und"))))
    guess = F.struct(F.get(languages, 0).alias("language"), F.when(F.size(languages) == 1, 0.55).otherwise(0.35).alias("confidence"), F.slice(languages, 2, 100).alias("alternatives"))
    given = F.struct(F.lower(F.regexp_extract(locale, r"^([^-_]*)", 1)).alias("language"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("alternatives"))
    return F.when(F.coalesce(locale, F.lit("")) != "", given).otherwise(guess)
