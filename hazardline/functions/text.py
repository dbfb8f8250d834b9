"""Free-text findings turned into counts and marker flags, all as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal markers looked for in the cleaned text.
MARKERS = [
    "+8", "-7", "-5", "del(5q)", "del(7q)", "inv(3)", "t(3;3)", "t(6;9)",
    "complex", "monosomy 7", "trisomy 8", "t(8;21)", "inv(16)", "t(15;17)",
]
EXTRA_MARKERS = ["del(17)", "t(16;16)"]
# What counts as one anomaly, one translocation, and "complex".
ANOMALY = r"del|inv|t\(|\+|\-"
TRANSLOCATION = r"t\([\d;]+\)"
COMPLEX_FROM = 3

# Word characters are named by Unicode class: Java's \w is ASCII-only and would blank out accented letters.
# White space is noise too, so replacing each run of noise by one blank also squeezes the blanks.
_NOISE = r"[^\p{L}\p{N}_+\-();]+"


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def clean_text(col: Column | str) -> Column:
    """Lower case, blanks for everything but word characters and ``+-();``, squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(_text(col)), _NOISE, " "))


def contains_flag(cleaned: Column, marker: str) -> Column:
    return F.contains(cleaned, F.lit(marker.lower())).cast("int")


def marker_name(marker: str, prefix: str = "cyto_") -> str:
    """Column name of a marker: signs spelled out, brackets dropped, blanks and ``;`` as ``_``."""
    spelled = {"+": "plus", "-": "minus", ";": "_", " ": "_", "(": "", ")": ""}
    return prefix + "".join(spelled.get(ch, ch) for ch in marker)


def text_contains_flags(cleaned: Column, markers: Iterable[str] = MARKERS, prefix: str = "cyto_") -> list[Column]:
    return [contains_flag(cleaned, m).alias(marker_name(m, prefix)) for m in markers]


def regex_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_anomalies(col: Column | str) -> Column:
    """Anomaly signs in the raw text, case ignored."""
    return regex_count(F.lower(_text(col)), ANOMALY)


def count_translocations(col: Column | str) -> Column:
    return regex_count(F.lower(_text(col)), TRANSLOCATION)


def complex_flag(cleaned: Column, at_least: int = COMPLEX_FROM) -> Column:
    return (regex_count(cleaned, ANOMALY) >= at_least).cast("int")
