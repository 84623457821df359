"""Text expressions. Everything stays on the JVM except case folding and compatibility forms, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trustscore import constants as C

# White space as the contract means it: Unicode white space plus the four separator controls. Listed as
# plain ranges, because property classes are looked up per character.
_ODD_SPACES = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[ {_ODD_SPACES}]"
# Matches only where collapsing changes something: single blanks, by far the most, are passed over.
_COLLAPSIBLE = f"[{_ODD_SPACES}]{_SPACE}*| {_SPACE}+"
_SPACE_CHARACTERS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Characters for which case folding (also after NFKC) is exactly lower-casing plus sharp s -> ss:
# ASCII, Latin-1 letters, Hangul syllables, unified ideographs and a little punctuation.
PLAIN_CHARACTERS = (
    r"\x00-\x7fÀ-ÖØ-öø-ÿ가-힣一-鿿"
    r"–—‘’“”•"
)


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Folding is one call of a C function per text; looking for the characters that Spark folds otherwise cost far more.
@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _compatible_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda value: unicodedata.normalize("NFKC", value).casefold(), na_action="ignore")


def casefold(text: Column | str) -> Column:
    return _casefold(_as_column(text))


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(_as_column(text), F.lit(_SPACE_CHARACTERS))


def collapse_spaces(text: Column | str) -> Column:
    """Null becomes empty, inner white space becomes one blank, the ends are stripped; case is kept."""
    filled = F.coalesce(_as_column(text), F.lit(""))
    return F.trim(F.regexp_replace(filled, _COLLAPSIBLE, " "))


def normalize_text(text: Column | str) -> Column:
    """Key for duplicate detection: white space collapsed, ends stripped, case folded."""
    return casefold(collapse_spaces(text))


def canonical_text(text: Column | str) -> Column:
    """Comparison form: compatibility-normalised, case folded, letters and digits only."""
    filled = F.coalesce(_as_column(text), F.lit(""))
    return F.regexp_replace(_compatible_casefold(filled), r"[^\p{L}\p{N}]", "")


def is_blank(text: Column | str) -> Column:
    """Null, empty or only white space; looks no further than the first other character."""
    return ~F.coalesce(_as_column(text).rlike(f"[^ {_ODD_SPACES}]"), F.lit(False))


def is_informative(canonical: Column | str) -> Column:
    return F.length(_as_column(canonical)) >= C.MIN_INFORMATIVE_CHARS


def characters(text: Column | str) -> Column:
    return F.split(_as_column(text), "")


def ngrams(chars: Column | str, sizes: Iterable[int] = C.NGRAM_SIZES) -> Column:
    """All character n-grams of a text given as a character array, repeats kept.

    One pass of a pattern per size: at every character it looks ahead for the whole gram, and moves on by one.
    """
    whole = F.array_join(_as_column(chars), "")
    return F.concat(
        *[F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)) for size in sizes]
    )


def occurrences(text: Column | str, word: str) -> Column:
    """Number of non-overlapping occurrences of a literal word."""
    text = _as_column(text)
    without = F.replace(text, F.lit(word), F.lit(""))
    return ((F.length(text) - F.length(without)) / F.lit(len(word))).cast("int")


def keyword_counts(text: Column | str, keywords: Iterable[str] = C.REPETITIVE_KEYWORDS) -> Column:
    """Map of keyword to count, keeping the keywords that occur at least twice."""
    entries = []
    for word in keywords:
        entries += [F.lit(word), occurrences(text, word)]
    return F.map_filter(F.create_map(*entries), lambda _, count: count >= C.KEYWORD_MIN_COUNT)


def master_id(value: Column | str) -> Column:
    """Identifier without surrounding blanks and without the ``.0`` that spreadsheets add to whole numbers."""
    return F.regexp_replace(strip(F.coalesce(_as_column(value), F.lit(""))), r"(?U)^(\d+)\.0\z", "$1")


def abbreviate(text: Column | str, limit: int = C.ABBREVIATE_CHARS, collapse: bool = False) -> Column:
    """Display form of at most ``limit`` characters, ending in an ellipsis when shortened."""
    text = collapse_spaces(text) if collapse else _as_column(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def java_pattern(pattern: str) -> str:
    """The same pattern for Spark's regex engine: Unicode classes, any case, dot stops only at newline."""
    return "(?iuUd)" + pattern.replace(r"\s", _SPACE)


def matches_any(text: Column | str, patterns: Iterable[str]) -> Column:
    text = _as_column(text)
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(java_pattern(pattern))
    return found


def matching_count(text: Column | str, patterns: Iterable[str]) -> Column:
    text = _as_column(text)
    total = F.lit(0)
    for pattern in patterns:
        total = total + text.rlike(java_pattern(pattern)).cast("int")
    return total
