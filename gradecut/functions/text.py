"""Romanian text cleanup and search."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradecut.functions.marks import ANY_SPACE
from gradecut.params import TRACKS

# Characters that are dropped.
INVISIBLE = r"[\xAD\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
# Runs of white space other than one plain space, which is left where it is.
_UNEVEN_SPACE = f" {ANY_SPACE}+|(?! ){ANY_SPACE}{ANY_SPACE}*"


@cache
def _may_compose() -> str:
    """Class of the characters that composition can change or move: marks, the vowel and final
    letters of Hangul, and what is not composed on its own."""
    def touched(code: int) -> bool:
        c = chr(code)
        return 0x1161 <= code <= 0x11FF or unicodedata.category(c)[0] == "M" or not unicodedata.is_normalized("NFC", c)

    codes = [c for c in range(0x300, 0x110000) if not 0xD800 <= c < 0xE000 and touched(c)]
    starts = [c for c, before in zip(codes, [-1, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -1], strict=True) if c != after - 1]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def compose_nfc(text: Column) -> Column:
    """Canonical composition. Spark has no built-in for it, so this is the one Arrow UDF.

    Only text with a character that composition could change is sent to Python.
    """
    # Most text has nothing above U+0300, which is quickly told; only the rest is looked at closely.
    needed = F.when(text.rlike(r"[\x{300}-\x{10FFFF}]") & text.rlike(_may_compose()), text)
    return F.coalesce(_nfc(needed), text)


def fix_diacritics(text: Column) -> Column:
    """Comma-below letters throughout, composed. Idempotent; other letters are untouched."""
    composed = compose_nfc(text)
    commas = F.translate(composed, "ŞşŢţ", "ȘșȚț")
    for letter, comma in (("s", "ș"), ("S", "Ș"), ("t", "ț"), ("T", "Ț")):
        commas = F.regexp_replace(commas, letter + r"[\x{326}\x{327}]", comma)
    return F.when(composed.rlike(r"[ŞşŢţ\x{326}\x{327}]"), commas).otherwise(composed)


def clean_spaces(text: Column) -> Column:
    visible = F.regexp_replace(text, INVISIBLE, "")
    return F.trim(F.regexp_replace(visible, _UNEVEN_SPACE, " "))


def normalize_text(text: Column) -> Column:
    """Fix diacritics, drop invisible characters, fold and collapse spaces, trim."""
    return clean_spaces(fix_diacritics(text))


def search_key(text: Column) -> Column:
    """A collated column: equality and ``contains`` on it ignore accents and case."""
    return F.collate(clean_spaces(text), "UNICODE_CI_AI")


def matches_search(haystack: Column, needle: str) -> Column:
    """Whether ``haystack`` contains ``needle``, ignoring accents and case; blank matches all."""
    if not needle.strip():
        return F.lit(True)
    return F.contains(F.collate(haystack, "UNICODE_CI_AI"), F.collate(F.lit(needle.strip()), "UNICODE_CI_AI"))


def track_of(label: Column) -> Column:
    """Track of a published label, ignoring case, accents and punctuation; null if unknown."""
    letters = F.collate(F.regexp_replace(label, "[^\\p{L}]", ""), "UNICODE_CI_AI")
    first, *rest = TRACKS
    track = F.when(letters == F.collate(F.lit(first), "UNICODE_CI_AI"), first)
    for name in rest:
        track = track.when(letters == F.collate(F.lit(name), "UNICODE_CI_AI"), name)
    return track


def ro_order(text: Column) -> Column:
    """Sort key in Romanian alphabetical order."""
    return F.collate(text, "ro")
