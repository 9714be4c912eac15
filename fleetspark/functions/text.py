"""Text normalisation and parsing as column expressions."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.params import ReaderParams

# Patterns and words of the header notation.
BRACKETS = r"[\[\](){}（）［］｛｝]"
SEPARATORS = r"[\s　_\-・/\\.]+"
UNIT_AT_END = r"[\[\(（［]\s*([^\]\)）］]{1,12})\s*[\]\)）］]\s*$"
UTC_OFFSET = r"^[+-]?\d{1,2}:\d{2}$"
UNIT_WORDS = (
    "kw", "kwh", "kvar", "kva", "mw", "mwh", "w", "wh", "v", "a", "ma", "hz",
    "%", "℃", "°c", "c", "k", "pa", "kpa", "mpa", "m/s", "m2", "w/m2", "w/m²",
    "kw/m2", "min", "s", "h", "sec", "hour", "count", "回", "件", "時間", "分",
    "秒", "度", "kvarh", "var", "pf", "ohm", "Ω", "kΩ",
)
UNIT_SYMBOL = r"^[A-Za-zΩ°℃%/·\^0-9\-]{1,10}$"
CODE = r"^[A-Za-z0-9_().\-]+$"
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
WHOLE_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?\z"
TIME_LIKE = r"^(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}|\d{1,2}[:：]\d{2})"
CLOCK = r"^\d{1,2}[:：]\d{2}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _single_char_folds() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms."""
    pairs = []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        form = unicodedata.normalize("NFKC", ch)
        if len(form) == 1 and form != ch:
            pairs.append((ch, form))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_width(c: str | Column) -> Column:
    """Full-width and other one-to-one compatibility characters made plain, inside the JVM.

    Enough for numbers and times; :func:`nfkc` does the whole of NFKC.
    """
    c = _col(c)
    plain, forms = _single_char_folds()
    # text with as many bytes as characters is plain already
    return F.when(F.octet_length(c) != F.length(c), F.translate(c, plain, forms)).otherwise(c)


@cache
def _unit_signs() -> list[tuple[str, str]]:
    """Signs that stand for a whole unit, and the units."""
    return [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x3371, 0x33E0)]


def fold_units(c: str | Column) -> Column:
    """:func:`fold_width`, and signs that stand for a whole unit written out."""
    c = out = _col(c)
    for sign, unit in _unit_signs():
        out = F.replace(out, F.lit(sign), F.lit(unit))
    return fold_width(F.when(c.rlike("[\u3371-\u33df]"), out).otherwise(c))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Full NFKC. For headers and dictionaries, which are small; readings use :func:`fold_width`."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def normalize(c: str | Column) -> Column:
    """Form under which headers are compared: NFKC, no brackets or separators, lower case; null is ''."""
    plain = F.trim(nfkc(F.coalesce(_col(c), F.lit(""))))
    plain = F.regexp_replace(plain, BRACKETS, " ")
    return F.lower(F.regexp_replace(plain, SEPARATORS, ""))


def normalize_text(text: str) -> str:
    """:func:`normalize` for a parameter."""
    s = unicodedata.normalize("NFKC", text or "").strip()
    return re.sub(SEPARATORS, "", re.sub(BRACKETS, " ", s)).lower()


def split_unit(c: str | Column) -> Column:
    """Struct ``name``, ``unit`` from ``"直流電圧(V)"``; a UTC offset in brackets is no unit."""
    s = F.trim(F.coalesce(_col(c), F.lit("")))
    unit = F.trim(F.regexp_extract(s, UNIT_AT_END, 1))
    real = (unit != "") & ~unit.rlike(UTC_OFFSET) & ~F.regexp_replace(unit, SEPARATORS, "").isin("", "-")
    name = F.trim(F.regexp_replace(s, UNIT_AT_END, ""))
    return F.struct(F.when(real, name).otherwise(s).alias("name"), F.when(real, unit).otherwise("").alias("unit"))


def looks_like_unit(c: str | Column) -> Column:
    s = F.trim(F.coalesce(_col(c), F.lit("")))
    written = fold_units(s)
    word = F.lower(written).isin(*UNIT_WORDS)
    return (s != "") & ~s.isin("-", "--") & (F.length(s) <= 12) & (word | written.rlike(UNIT_SYMBOL))


def strip_entity(name: str | Column, entity: str | Column) -> Column:
    """The name without its unit's prefix, whatever the case; never empty."""
    n, e = _col(name), _col(entity)
    quoted = F.concat(F.lit(r"(?i)^\s*\Q"), e, F.lit(r"\E\s*[\s_　:：\-]*"))
    rest = F.trim(F.regexp_replace(n, quoted, F.lit("")))
    bare = F.when((F.coalesce(e, F.lit("")) == "") | (rest == ""), n).otherwise(rest)
    return bare


def hint_score(c: str | Column, hints: tuple[str, ...]) -> Column:
    """How many of the hints the normalised text contains."""
    h = _col(c)
    return sum((h.contains(normalize_text(x)).cast("int") for x in hints if normalize_text(x)), F.lit(0))


def cell_is_number(c: str | Column) -> Column:
    s = F.replace(F.trim(fold_width(c)), F.lit(","), F.lit(""))
    return F.coalesce(s.rlike(NUMBER), F.lit(False))


def looks_like_time(c: str | Column) -> Column:
    return F.coalesce(F.trim(fold_width(c)).rlike(TIME_LIKE), F.lit(False))


def to_number(c: str | Column, reader: ReaderParams = ReaderParams()) -> Column:
    """A cell as a double: full width, thousands separators and no-value tokens understood."""
    s = fold_width(c)
    if reader.thousands:
        s = F.replace(s, F.lit(reader.thousands), F.lit(""))
    s = F.trim(s)
    # most no-value tokens are no numbers anyway
    for token in reader.na_values:
        if re.match(NUMBER, token):
            s = F.nullif(s, F.lit(token))
    # '' is no number; to have that told by the cast costs more than all the rest
    return F.nullif(F.regexp_extract(s, NUMBER, 0), F.lit("")).try_cast("double")


def parse_timestamp(c: str | Column) -> Column:
    """A cell as a naive timestamp: Japanese, ISO and slash forms, AM and PM; null if it is none.

    Times are local as they are written: an offset from UTC, or Z, is left out.
    """
    # the last character has no counterpart and goes; done first, few cells are left that need the long table
    signs = ("年月日時分/T秒", "-- ::- ")
    s = fold_width(F.translate(_col(c), *signs))
    s = F.when(s.rlike("[^-0-9 :.]"), F.translate(s, *signs)).otherwise(s)
    s = F.rtrim(F.ltrim(F.replace(s, F.lit("  "), F.lit(" "))), F.lit(": "))
    # most are whole by now
    return F.when(s.rlike(WHOLE_TIME), s.try_cast("timestamp_ntz")).otherwise(_other_timestamp(s))


def _other_timestamp(s: Column) -> Column:
    """:func:`parse_timestamp` of a cell in plain signs, whatever its form."""
    s = F.when(F.length(s) == 8, F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(s)
    s = F.regexp_replace(s, r"(:\d{2}(?:\.\d+)?)\s*(?:[Zz]|[+-]\d{2}:?\d{2})$", "$1")
    s = F.when(F.length(s) > 26, F.regexp_replace(s, r"(\.\d{6})\d+", "$1")).otherwise(s)
    # anything of another shape becomes '', which is no timestamp
    half = F.upper(F.regexp_extract(s, r"(?i)\d\s*([AP])\.?M\.?$", 1))
    s = F.regexp_extract(s, r"(?i)^(\d{4}-\d{1,2}-\d{1,2}( \d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?)?)(\s*[AP]\.?M\.?)?$", 1)
    ts = F.try_to_timestamp(s, F.lit("y-M-d[ H[:m[:s[.SSSSSS]]]]")).cast("timestamp_ntz")
    # twelve o'clock is the first hour of either half
    hours = F.when(half == "P", F.when(F.hour(ts) < 12, 12).otherwise(0)).otherwise(F.when(F.hour(ts) == 12, -12).otherwise(0))
    return F.when(half == "", ts).otherwise(ts + F.make_dt_interval(hours=hours))


def time_of_day_us(c: str | Column) -> Column:
    """``H:MM[:SS]`` in microseconds."""
    s = F.trim(fold_width(c))
    parts = F.split(s, ":")
    seconds = (F.get(parts, F.lit(0)).cast("long") * 3600 + F.get(parts, F.lit(1)).cast("long") * 60
               + F.coalesce(F.get(parts, F.lit(2)), F.lit("0")).cast("long"))
    return F.when(is_clock(c), seconds * 1_000_000)


def is_clock(c: str | Column) -> Column:
    """Whether a cell is a time of day. Long cells are ruled out before the pattern is tried."""
    c = _col(c)
    return F.when(F.length(c) <= 10, F.trim(fold_width(c)).rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")).otherwise(False)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters, 2·M / (len(a) + len(b)), over matching blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
