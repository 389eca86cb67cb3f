"""Cleaning, stems, token sets and the pattern of dates in texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.entities import unescape
from almanac.settings import DAY_WORDS, MONTH_WORDS, STOP_WORDS

#: Letters and digits of a word, as Java's and RE2's classes both have them.
LETTER = r"[\p{L}\p{N}_]"
#: Signs that comparison turns into blanks.
SIGNS = "–—:,\"`«»„“'()[]-\n\r/|"
SIGN_CLASS = "[" + re.sub(r"([\[\]\-])", r"\\\1", SIGNS) + "]"


def date_pattern() -> str:
    """Java pattern of dates in running text: numeric, with a month's name, ISO, and after a day's name."""
    months, days = "|".join(MONTH_WORDS), "|".join(DAY_WORDS)
    kinds = [
        r"\b[0-9]{1,2}\.\s*[0-9]{1,2}\.\s*[0-9]{2,4}\b",
        r"\b[0-9]{1,2}\.\s*[0-9]{1,2}\.(?![0-9])",
        rf"\b[0-9]{{1,2}}\.?\s*(?:{months})[a-zäöü]*\.?",
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
        rf"\b(?:{days})\.?,\s*[0-9]{{1,2}}\.",
    ]
    return "(?iuU)" + "|".join(kinds)


DATES = date_pattern()


def decode_entities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with entities in columns decoded."""
    return df.withColumns({c: unescape(F.col(c)) for c in columns})


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def clean(s: Column) -> Column:
    """The form in which texts are compared: entities decoded, lower case, signs and runs of white space as one
    blank. Null becomes empty."""
    low = F.regexp_replace(F.lower(unescape(F.coalesce(s, F.lit("")))), SIGN_CLASS, " ")
    return strip(F.regexp_replace(low, r"(?U)\s+", " "))


def cleaned(s: Column) -> Column:
    """Of a text in that form: as it is, null as empty."""
    return F.coalesce(s, F.lit(""))


def with_clean(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with new columns {new: old}: the form for comparison of old."""
    return df.withColumns({new: clean(F.col(old)) for new, old in columns.items()})


def stem(word: Column) -> Column:
    """A word of six letters or more without its last en, er, es, n, s or e."""
    short = F.length(word) < 6
    two, one = F.rlike(word, F.lit("(en|er|es)$")), F.rlike(word, F.lit("[nse]$"))
    return F.when(short, word).when(two, F.left(word, F.length(word) - 2)).when(one, F.left(word, F.length(word) - 1)).otherwise(word)


def words(cleaned: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(cleaned, F.lit(f"{LETTER}{{{least},}}"), F.lit(0))


def tokens(s: Column, stop: Sequence[str] = STOP_WORDS, form=clean) -> Column:
    """Distinct stems of the words of three letters or more that are not stop words. form: cleaned, if s is clean already."""
    found = F.array_except(words(form(s)), F.array(*[F.lit(w) for w in stop]))
    return F.array_distinct(F.transform(found, stem))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).otherwise(0.0)


def capitalize_label(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key, else the key with its first letter in upper case."""
    known = F.lit(None).cast("string")
    if labels:
        known = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), key)
    return F.coalesce(known, F.concat(F.upper(F.left(key, F.lit(1))), F.lower(F.substring(key, F.lit(2), F.length(key)))))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def strip_fence(s: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(s), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
