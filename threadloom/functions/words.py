"""Column expressions for words, names and excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"[\p{L}\p{Nl}\p{No}]"
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
#: Function words left out of titles, and the stoplist of the raw-count cosine.
TITLE_FUNCTION_WORDS = ("and", "of", "the", "for", "in")
STOPWORDS = tuple(
    "a an the and or but if as at by for from in into of on out over to up with is are was were be been being has have had "
    "do does did not no it its this that these those he she they them their his her we us our who whom which what when where "
    "while than then also can could would should may might will one two all some such each other more most".split()
)


def word_pattern(unit: str = LETTER) -> str:
    """Words of ``unit`` characters with single apostrophes inside."""
    return f"{unit}+(?:['’]{unit}+)*"


def tokens(text: Column, unit: str = LETTER) -> Column:
    """Lower-cased words of a text, with typographic apostrophes made plain."""
    found = F.regexp_extract_all(text, F.lit(word_pattern(unit)), F.lit(0))
    return F.transform(found, lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def without_possessive(word: Column) -> Column:
    return F.regexp_replace(word, "'s$", "")


def label(name: Column) -> Column:
    """The name without one trailing parenthetical."""
    return F.regexp_replace(name, r"\s+\([^()]*\)$", "")


def short_name(name: Column) -> Column:
    """The name without any parenthetical."""
    return F.trim(F.regexp_replace(name, r"\s*\([^()]*\)", ""))


def normalised(value: Column) -> Column:
    """Trimmed, lower-cased, with runs of white space made one space."""
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def url_decoded(value: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def title_words(node_id: Column) -> Column:
    """Words of an identifier's title: decoded, underscores as spaces, parentheticals and function words out, two letters or more."""
    title = F.regexp_replace(F.replace(url_decoded(node_id), F.lit("_"), F.lit(" ")), r"\([^)]*\)", "")
    words = F.transform(tokens(title), without_possessive)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*TITLE_FUNCTION_WORDS)))
