"""Text columns: cleaning, sentences, keyword predicates, lexicon ratios and name parsing; all native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ANALYST_KEYWORDS, EXECUTIVE_KEYWORDS, GUIDANCE_KEYWORDS, UNCERTAINTY_WORDS

# What a sentence is longer than, the forms of a file's name, and the quarter in a slug.
SENTENCE = 20
FULL_NAME, SLUG_NAME = r"^([A-Z]+)_(\d{4}-\d{2}-\d{2})_(Q\d-\d{4})$", r"^([A-Z]+)_(\d{2}-\d{2})-(.+)$"
SLUG_QUARTER, SLUG_YEAR = r"q(\d)-\d{4}", r"q\d-(\d{4})"
#: Unicode white space, no-break spaces included.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokens(c: Column) -> Column:
    """Words between white space; none in an empty or null text."""
    return F.filter(F.split(F.coalesce(clean(c), F.lit("")), " "), lambda x: x != "")


def sentences(c: Column, longer_than: int = SENTENCE) -> Column:
    """Sentences after ``.``, ``!`` or ``?`` and white space that are longer than the limit.

    Splits by rule: abbreviations end sentences too, unlike in a trained tokenizer.
    """
    parts = F.split(F.regexp_replace(clean(c), r"([.!?])\s+", "$1\x01"), "\x01")
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def has_any(c: Column, keywords: Iterable[str], whole_words: bool = False) -> Column:
    """Whether the lower-cased text has any keyword, by default also inside words."""
    one = "|".join(re.escape(k) for k in keywords)
    return F.lower(c).rlike(rf"\b(?:{one})\b" if whole_words else one)


def is_guidance(c: Column, keywords: Iterable[str] = GUIDANCE_KEYWORDS) -> Column:
    return has_any(c, keywords)


def word_count(sents: Column) -> Column:
    """Words in all texts of an array."""
    return F.aggregate(sents, F.lit(0), lambda n, s: n + F.size(tokens(s)))


def lexicon_share(sents: Column, lexicon: Sequence[str] = UNCERTAINTY_WORDS, digits: int = 5) -> Column:
    """Share of words that are in the lexicon as they stand, case aside; 0 without words.

    Punctuation is part of a word, so ``risk,`` is not ``risk``.
    """
    hits = lambda words: F.size(F.filter(words, lambda w: w.isin(*lexicon)))
    share = lambda words: F.when(F.size(words) > 0, F.round(hits(words) / F.size(words), digits)).otherwise(0.0)
    return let(tokens(F.lower(F.array_join(sents, " "))), share)


def described_role(c: Column, whole_words: bool = False) -> Column:
    """operator, executive, analyst or unknown, by the first list that a description matches."""
    return (
        F.when(F.lower(c).contains("operator"), "operator")
        .when(has_any(c, EXECUTIVE_KEYWORDS, whole_words), "executive")
        .when(has_any(c, ANALYST_KEYWORDS, whole_words), "analyst")
        .otherwise("unknown")
    )


def fallback_role(c: Column) -> Column:
    return F.when(has_any(c, EXECUTIVE_KEYWORDS), "executive").when(has_any(c, ANALYST_KEYWORDS), "analyst").otherwise("unknown")


def speaker_name(raw: Column) -> Column:
    return F.trim(F.split(raw, "--")[0])


def speaker_title(raw: Column) -> Column:
    """The last part after ``--``, if there is one."""
    parts = F.split(raw, "--")
    return F.when(F.lower(speaker_name(raw)) == "operator", "Operator").when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))).otherwise("")


def first_name(name: Column) -> Column:
    return F.lower(F.coalesce(F.get(tokens(name), F.lit(0)), F.lit("")))


def file_name_fields(name: Column, suffix: str = "") -> Column:
    """(ticker, date, quarter) of ``T_YYYY-MM-DD_Qn-YYYY`` or ``T_MM-DD-slug``, else the parts between underscores.

    A slug's fiscal year becomes the date's year; without a quarter date and quarter are empty.
    """
    stem = F.regexp_replace(name, rf"(?:{re.escape(suffix)})?(?:\.\w+)?$", "") if suffix else name
    take = lambda p, k, c=stem: F.regexp_extract(c, p, k)
    rest = take(SLUG_NAME, 3)
    q, year = F.regexp_extract(rest, SLUG_QUARTER, 1), F.regexp_extract(rest, SLUG_YEAR, 1)
    parts = F.split(stem, "_")
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    found = F.struct(take(FULL_NAME, 1).alias("ticker"), take(FULL_NAME, 2).alias("date"), take(FULL_NAME, 3).alias("quarter"))
    by_slug = F.struct(
        take(SLUG_NAME, 1).alias("ticker"),
        F.when(q != "", F.concat_ws("-", year, take(SLUG_NAME, 2))).otherwise("").alias("date"),
        F.when(q != "", F.concat(F.lit("Q"), q, F.lit("-"), year)).otherwise("").alias("quarter"),
    )
    split = F.struct(at(0).alias("ticker"), at(1).alias("date"), at(2).alias("quarter"))
    return F.when(stem.rlike(FULL_NAME), found).when(stem.rlike(SLUG_NAME), by_slug).otherwise(split)


def url_date(url: Column, first: int = 6) -> Column:
    """Three path parts joined by ``-`` from the one at ``first`` (0-based); ``unknown`` if there are fewer."""
    parts = F.split(url, "/")
    return F.when(F.size(parts) > first + 2, F.concat_ws("-", *[F.get(parts, F.lit(first + k)) for k in range(3)])).otherwise("unknown")


def is_transcript(text: Column, markers: Iterable[str]) -> Column:
    return has_any(text, markers)


def error_tags(tags: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tags.items()]))


def weighted_sum(terms: Sequence[tuple[float, Column]]) -> Column:
    """Sum of weight x column, null if any is; null without terms."""
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in terms]) if terms else F.lit(None).cast("double")
