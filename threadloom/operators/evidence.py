"""Passages with character offsets.

Offsets of a few words are the lengths of the pieces before them, in column expressions. Spans of all words of a text
would take time quadratic in its length that way, so those run in Arrow batches.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.words import LETTER, without_possessive, word_pattern
from threadloom.operators.texts import BLANK_LINE

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
GAP = re.compile(r"\n\s*\n")

#: Rows of spans that a worker hands on at once.
SPANS = 20_000


def word_spans(docs: DataFrame, gap: str = GAP.pattern) -> DataFrame:
    """``docs(id, text)`` -> ``(id, para, pos, word, start, end)``: half-open character offsets into the text.

    Paragraphs end at ``gap`` (blank lines) and are numbered from 0 among those that hold a word. A worker holds no more than
    ``SPANS`` rows besides a batch of texts, however long a text is.
    """

    def spans(text: str) -> Iterator[tuple[int, int, str, int, int]]:
        para, offset = 0, 0
        for end in itertools.chain((m.span() for m in re.finditer(gap, text)), [(len(text),) * 2]):
            k = -1
            for k, m in enumerate(WORD.finditer(text, offset, end[0])):
                yield para, k, m.group().lower().replace("’", "'"), *m.span()
            para, offset = para + (k >= 0), end[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((doc, *span) for doc, text in zip(batch["id"], batch["text"], strict=True) for span in spans(text or ""))
            while held := list(itertools.islice(rows, SPANS)):
                yield pd.DataFrame(held, columns=["id", "para", "pos", "word", "start", "end"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInPandas(run, f"id {kind}, para int, pos int, word string, start int, end int")


def _split(text: Column) -> tuple[Column, Column]:
    """The words of a text and what lies around them, one piece more than words."""
    return F.regexp_extract_all(text, F.lit(word_pattern(LETTER)), F.lit(0)), F.split(text, word_pattern(LETTER))


def _ahead(words: Column, gaps: Column, n: Column) -> Column:
    """Characters before the word that ``n`` words precede."""
    length = lambda pieces, k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda acc, x: acc + F.length(x))
    return length(gaps, n + 1) + length(words, n)


def passages(docs: DataFrame, runs: DataFrame, gap: str = BLANK_LINE, context: int = 110) -> DataFrame:
    """The wording of shared runs ``(a, b, length, para_a, pos_a)`` in their first document, with offsets and context.

    Only texts with a run are split into words; a run's offsets are the lengths of what precedes its words.
    """
    found = docs.select(F.col("id").alias("a"), "text").join(runs.select("a").distinct(), "a", "left_semi")
    words, gaps = _split(F.col("text"))
    counts = F.filter(F.transform(F.split("text", gap), lambda p: F.size(F.regexp_extract_all(p, F.lit(word_pattern(LETTER)), F.lit(0)))), lambda n: n > 0)
    met = found.select("a", "text", words.alias("words"), gaps.alias("gaps"), counts.alias("counts")).join(runs.select("a", "b", "length", "para_a", "pos_a"), "a")
    first = F.aggregate(F.slice("counts", F.lit(1), F.col("para_a").cast("int")), F.lit(0), lambda acc, n: acc + n) + F.col("pos_a").cast("int")
    last = F.col("first") + F.col("length").cast("int") - 1
    cut = met.withColumn("first", first).select(
        "a", "b", "text", _ahead(F.col("words"), F.col("gaps"), F.col("first")).alias("start"),
        (_ahead(F.col("words"), F.col("gaps"), last) + F.length(F.element_at("words", last + 1))).alias("end"),
    )
    return _shown(cut, ("a", "b"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("passage"), context)


def _shown(cut: DataFrame, keys: tuple[str, ...], wording: Column, context: int) -> DataFrame:
    """``cut(<keys>, text, start, end)`` with the wording and the ``context`` characters on either side."""
    low = F.greatest(F.lit(0), F.col("start") - context)
    before, after = F.substring("text", low + 1, F.col("start") - low), F.substring("text", F.col("end") + 1, F.lit(context))
    return cut.select(*keys, "start", "end", wording, before.alias("before"), after.alias("after"))


def term_excerpts(docs: DataFrame, limit: int = 360, context: int = 80) -> DataFrame:
    """``docs(id, text, term)`` -> ``(id, term, start, end, excerpt, before, after)``.

    The term's first occurrence as a word (a final 's doesn't matter) with what leads to it and what trails it in its
    paragraph. Where that is over ``limit`` characters, the lead keeps half as many and the trail the rest, each cut at a
    space if it has one. A missing term raises.
    """
    words, gaps = _split(F.col("text"))
    plain = F.transform("words", lambda w: without_possessive(F.replace(F.lower(w), F.lit("’"), F.lit("'"))))
    place = F.array_position(plain, F.col("term")).cast("int")
    missing = F.raise_error(F.concat(F.lit("a text lacks the term "), F.col("term"))).cast("int")
    rows = docs.select("id", "text", "term", words.alias("words"), gaps.alias("gaps")).withColumn("place", F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(missing))
    rows = rows.select("id", "text", "term", F.element_at("words", F.col("place")).alias("hit"), _ahead(F.col("words"), F.col("gaps"), F.col("place") - 1).alias("at"))
    rest = F.substring("text", F.col("at") + F.length("hit") + 1, F.length("text"))
    lead, trail = F.substring_index(F.substring("text", F.lit(1), F.col("at")), "\n\n", -1), F.substring_index(rest, "\n\n", 1)
    parts = rows.select("id", "text", "term", "hit", "at", lead.alias("lead"), trail.alias("trail"))
    half = limit // 2
    long = F.length("lead") + F.length("hit") + F.length("trail") > limit
    room = limit - F.least(F.length("lead"), F.lit(half)) - F.length("hit")
    parts = parts.select("*", F.when(long & (F.length("lead") > half), F.right(F.col("lead"), F.lit(half))).alias("near"), F.when(long & (F.length("trail") > room), F.left(F.col("trail"), room)).alias("far"))
    last_word = F.length(F.substring_index("far", " ", -1))
    kept_lead = F.coalesce(F.substring("near", F.instr("near", " ") + 1, F.lit(half)), "lead")
    kept_trail = F.coalesce(F.when(F.instr("far", " ") > 0, F.left(F.col("far"), F.length("far") - last_word - 1)).otherwise(F.col("far")), "trail")
    cut = parts.select("id", "text", "term", (F.col("at") - F.length(kept_lead)).alias("start"), F.concat(kept_lead, "hit", kept_trail).alias("excerpt"))
    return _shown(cut.withColumn("end", F.col("start") + F.length("excerpt")), ("id", "term"), F.col("excerpt"), context)
