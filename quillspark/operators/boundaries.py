"""Sentence boundaries learnt without labels from counts over a whole table, after the published method of Kiss and Strunk (2006).

A word that ends in a full stop is an abbreviation if the stop belongs to it far more often than chance would have it, by a log-likelihood
ratio that favours short words with inner stops and punishes those that also come without. After an
abbreviation, a number or a single letter the next word decides: how it is written elsewhere, whether it often starts sentences, and
whether the two form a collocation. All counts are aggregations with map-side combine; all decisions are joins and native
expressions, and only words that are abbreviations, numbers or letters travel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.stage import scope, staged

# Fixed values of the published method: least scores of abbreviations, collocations and sentence starters, and how surely a stop follows an abbreviation.
ABBREVIATION, COLLOCATION, STARTER, SURE = 0.3, 7.88, 30.0, 0.99
#: Learnt words that are broadcast at most; more are joined by a shuffle.
BROADCAST_WORDS = 200_000
NUMBER = "##"


@dataclass
class Boundaries:
    """Tables: words (word, abbreviation, starter, lower, upper_inside: how often it is written so) and pairs (word, next)."""

    words: DataFrame
    pairs: DataFrame


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?]+$", "")


def _type(bare: Column) -> Column:
    """The word in lower case without its last stops; all numbers are one."""
    own = F.lower(F.regexp_replace(bare, r"[.!?]+$", ""))
    return F.when(own.rlike(r"^[0-9][0-9.,\-]*$"), NUMBER).otherwise(own)


def _split(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., w, n): the words of every text that has any."""
    return docs.select(*keep, t.tokens(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n, dots, lower, upper_inside) of all types: how often they come, end in one full stop, and are written so.

    ``upper_inside``: with a capital though the word before ends in no stop. Words are counted as they stand first, so what
    is costly is done once for each of them.
    """
    cased = lambda w: F.lower(F.right(w, F.lit(1))) != F.upper(F.right(w, F.lit(1)))
    open_ends = F.transform(F.slice("w", 1, F.col("n") - 1), lambda w: cased(w) | ~w.rlike(r"[.!?]\P{L}*$"))
    own = _split(docs, text_col).select(F.explode(F.arrays_zip(F.col("w").alias("raw"), F.concat(F.array(F.lit(False)), open_ends).alias("inside"))).alias("x"))
    raw = own.select("x.*").groupBy("raw", "inside").agg(F.count(F.lit(1)).alias("c"))
    bare = _bare(F.col("raw"))
    typed = raw.select("c", "raw", "inside", bare.alias("bare")).withColumn("word", _type(F.col("bare"))).where("word <> ''")
    many = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    return typed.groupBy("word").agg(
        many(_dot(F.col("raw"))).alias("dots"), F.sum("c").alias("n"), many(F.col("bare").rlike(r"^\p{Ll}")).alias("lower"), many(F.col("bare").rlike(r"^\p{Lu}") & F.col("inside")).alias("upper_inside")
    )


def _dot(raw: Column) -> Column:
    return raw.endswith(".") & ~raw.endswith("..")


def stops(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., pos, word, next, next_upper, next_lower) of the words that end in one full stop and have a next word."""
    zipped = F.arrays_zip(F.slice("w", 1, F.col("n") - 1).alias("raw"), F.slice("w", 2, F.col("n")).alias("after"))
    pairs = F.transform(zipped, lambda x, i: F.struct(i.alias("pos"), x["raw"].alias("raw"), x["after"].alias("after")))
    own = _split(docs, text_col, *keep).select(*keep, F.explode(F.filter(pairs, lambda x: _dot(x["raw"]))).alias("x"))
    rows = own.select(*keep, "x.pos", _bare(F.col("x.raw")).alias("bare"), _bare(F.col("x.after")).alias("follows"))
    found = rows.select(*keep, "pos", _type(F.col("bare")).alias("word"), _type(F.col("follows")).alias("next"), F.col("follows").rlike(r"^\p{Lu}").alias("next_upper"), F.col("follows").rlike(r"^\p{Ll}").alias("next_lower"))
    return found.where("word <> '' and next <> ''")


def _term(n: Column, p: Column) -> Column:
    """n * log p, 0 for no n."""
    return F.when(n <= 0, 0.0).otherwise(n * F.ln(F.greatest(p, F.lit(1e-300))))


def _ratio(together: Column, first: Column, second: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that ``second`` follows ``first`` more or less often than elsewhere."""
    p = second / n
    p1 = together / first
    p2 = (second - together) / F.greatest(n - first, F.lit(1))
    like = lambda k, m, q: _term(k, q) + _term(m - k, 1 - q)
    return -2 * (like(together, first, p) + like(second - together, n - first, p) - like(together, first, p1) - like(second - together, n - first, p2))


def _special(word: Column) -> Column:
    """Numbers and single letters, after which a stop may belong to them."""
    return (word == NUMBER) | word.rlike(r"^\p{L}$")


def learn(docs: DataFrame, text_col: str = "text", broadcast: int = BROADCAST_WORDS) -> Boundaries:
    """Boundaries learnt from all texts; null and empty ones add nothing."""
    with scope() as own:
        counts = staged(word_counts(docs, text_col), "words")
        total, dots = counts.agg(F.sum("n"), F.sum("dots")).first()
        total, dots = total or 1, dots or 0
        chance = min(max(dots / total, 1e-12), 1 - 1e-12)
        n, c = F.col("n"), F.col("dots")
        like = lambda p: c * F.ln(F.lit(p)) + (n - c) * F.ln(F.lit(1 - p))
        size = F.length(F.replace("word", F.lit("."), F.lit("")))
        inner = F.length("word") - size + 1
        score = -2 * (like(chance) - like(SURE)) * F.exp(-size.cast("double")) * inner * F.pow(F.greatest(size, F.lit(1)).cast("double"), -(n - c).cast("double"))
        short = (c > 0) & F.col("word").rlike(r"\p{L}") & ~_special(F.col("word")) & (score >= ABBREVIATION)
        scored = staged(counts.withColumn("abbreviation", short), "scored")
        # the second pass: what follows a stop that ends a sentence, and what follows one that may not
        known = scored.where("abbreviation").select(F.col("word").alias("_a"))
        known = F.broadcast(known) if known.count() <= broadcast else known
        ended = stops(docs, text_col).join(known, F.col("word") == F.col("_a"), "left")
        seen = staged(ended.groupBy(F.when(F.col("_a").isNotNull() | _special(F.col("word")), F.col("word")).alias("word"), "next").agg(F.count(F.lit(1)).alias("together")), "stops")
        ends = seen.where("word is null").select("next", "together")
        breaks = ends.agg(F.sum("together")).first()[0] or 1
        starts = ends.join(counts.select(F.col("word").alias("next"), "n"), "next")
        more = F.col("together") / F.lit(breaks) > F.col("n") / F.lit(total)
        starts = starts.where(more & (_ratio(F.col("together"), F.lit(breaks), F.col("n"), F.lit(total)) >= STARTER)).select(F.col("next").alias("_s"))
        words = scored.join(starts, F.col("word") == F.col("_s"), "left").select("word", "abbreviation", F.col("_s").isNotNull().alias("starter"), "lower", "upper_inside")
        both = seen.where("word is not null and together > 1").join(counts.select("word", F.col("n").alias("n1")), "word").join(counts.select(F.col("word").alias("next"), F.col("n").alias("n2")), "next")
        more = F.col("together") / F.col("n1") > F.col("n2") / F.lit(total)
        pairs = both.where(more & (_ratio(F.col("together"), F.col("n1"), F.col("n2"), F.lit(total)) >= COLLOCATION)).select("word", "next")
        out = Boundaries(staged(words, "boundaries"), staged(pairs, "pairs"))
        own.keep(out.words, out.pairs)
    return out


def no_breaks(docs: DataFrame, boundaries: Boundaries, text_col: str = "text", broadcast: int = BROADCAST_WORDS) -> DataFrame:
    """(h1, h2, joined): hashes of a text and the positions of its words whose full stop ends no sentence; only texts that have one."""
    w = boundaries.words
    short = w.where("abbreviation").select(F.col("word").alias("_a"))
    short = F.broadcast(short) if short.count() <= broadcast else short
    own = docs.where(F.col(text_col).isNotNull()).select(text_col, *_hashes(F.col(text_col)))
    doubted = stops(own, text_col, "h1", "h2").join(short, F.col("word") == F.col("_a"), "left").where(F.col("_a").isNotNull() | _special(F.col("word")))
    # equal texts need one look; so few rows are left that all that is known of the next word comes by a join
    doubted = doubted.dropDuplicates(["h1", "h2", "pos"])
    following = w.select(F.col("word").alias("next"), "starter", F.col("lower").alias("n_lower"), F.col("upper_inside").alias("n_inside"))
    rows = doubted.join(following, "next", "left").join(boundaries.pairs.withColumn("pair", F.lit(True)), ["word", "next"], "left")
    starter = F.coalesce("starter", F.lit(False)) & F.col("next_upper")
    written = F.col("next_upper") & (F.coalesce("n_lower", F.lit(0)) > 0) & (F.coalesce("n_inside", F.lit(0)) == 0)
    joined = (
        F.when(F.coalesce("pair", F.lit(False)) & ~F.coalesce("starter", F.lit(False)), True)
        .when(F.col("_a").isNotNull(), ~(written | starter))
        .otherwise(F.col("next_lower") | (F.col("word").rlike(r"^\p{L}$") & F.col("next_upper") & (F.coalesce("n_lower", F.lit(0)) == 0)))
    )
    return rows.where(joined).groupBy("h1", "h2").agg(F.collect_set("pos").alias("joined"))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def split(docs: DataFrame, boundaries: Boundaries, text_col: str = "text", out: str = "sentences", longer_than: int = 20) -> DataFrame:
    """``docs`` with its sentences longer than the limit: those of the rule, joined where a stop is known to end none.

    A null text has none. Rows, equal ones too, come as they are.
    """
    h1, h2 = _hashes(F.col(text_col))
    found = no_breaks(docs, boundaries, text_col).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "joined")
    rows = docs.join(found, (h1 == F.col("_h1")) & (h2 == F.col("_h2")), "left")

    def parts(words: Column) -> Column:
        """Words up to each place where a sentence ends, and what is left after the last."""
        ends = F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].rlike(r"[.!?]$")), lambda x: x["i"])
        kept = F.array_except(ends, F.coalesce("joined", F.array().cast("array<int>")))
        spans = lambda e: F.arrays_zip(F.slice(e, 1, F.size(e) - 1).alias("a"), F.slice(e, 2, F.size(e)).alias("b"))
        cut = t.let(F.concat(F.array(F.lit(-1)), kept, F.array(F.size(words) - 1)), spans)
        return F.transform(cut, lambda x: F.array_join(F.slice(words, x["a"] + 2, x["b"] - x["a"]), " "))

    found = t.let(t.tokens(F.col(text_col)), parts)
    return rows.withColumn(out, F.filter(found, lambda s: F.length(s) > longer_than)).drop("_h1", "_h2", "joined")
