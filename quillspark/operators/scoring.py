"""Tone of sections: a scorer for sentences, weighted section means and transcript scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

SECTIONS = {"prep": "prepared_remarks", "qa_ceo": "qa_ceo", "qa_anal": "qa_analyst", "guidance": "guidance_sentences"}
#: Sentences that a model gets at once.
BATCH = 16
#: What a model makes of a list of texts: for each, labels with their scores.
Model = Callable[[list[str]], list[dict[str, float]]]


def lexicon_scorer(positive: Sequence[str], negative: Sequence[str]) -> Callable[[Column], Column]:
    """A deterministic scorer in native expressions: shares of positive and negative words, the rest neutral."""

    def score(sentence: Column) -> Column:
        def shares(words: Column) -> Column:
            n = F.size(words)
            share = lambda lexicon: F.when(n > 0, F.size(F.filter(words, lambda w: w.isin(*lexicon))) / n).otherwise(0.0)
            return F.struct(share(positive).alias("positive"), share(negative).alias("negative"))

        found = t.let(t.tokens(F.lower(sentence)), shares)
        return t.let(found, lambda x: F.struct(x["positive"].alias("positive"), x["negative"].alias("negative"), (1 - x["positive"] - x["negative"]).alias("neutral")))

    return score


def pick_device() -> str:
    """The fastest device of the worker that runs this: mps, cuda or cpu."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "mps" if torch.backends.mps.is_available() else "cuda" if torch.cuda.is_available() else "cpu"


def load_classifier(name: str, max_tokens: int = 512, batch: int = BATCH) -> Model:
    """A text classification model by name, for ``model_scorer(lambda: load_classifier(name))``; needs transformers there."""
    from transformers import pipeline

    run = pipeline("text-classification", model=name, top_k=None, truncation=True, max_length=max_tokens, device=pick_device())
    return lambda texts: [{x["label"].lower(): x["score"] for x in found} for found in run(texts, batch_size=batch)]


def model_scorer(load: Callable[[], Model], batch: int = BATCH) -> Callable[[Column], Column]:
    """A scorer that loads a model once in every worker and hands it Arrow batches.

    Labels that the model leaves out are 0, neutral 1; a batch on which it fails is neutral as a whole.
    """

    @F.pandas_udf("positive double, negative double, neutral double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for s in parts:
            out = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    found = model(some)
                except Exception:  # the whole batch counts as neutral
                    found = [{} for _ in some]
                out += [(float(x.get("positive", 0.0)), float(x.get("negative", 0.0)), float(x.get("neutral", 1.0))) for x in found]
            yield pd.DataFrame(out, columns=["positive", "negative", "neutral"])

    return scored


def section_scores(sents: DataFrame, scorer: Callable[[Column], Column], keys: Sequence[str]) -> DataFrame:
    """(keys..., pos, neg, net, n_sents) from rows (keys..., sentence): means weighted by words, at least one each.

    ``net`` is the difference of the unrounded means.
    """
    w = F.greatest(F.size(t.tokens(F.col("sentence"))), F.lit(1))
    rows = sents.where(F.col("sentence").isNotNull()).withColumns({"_s": scorer(F.col("sentence")), "_w": w})
    p, q = F.sum(F.col("_w") * F.col("_s.positive")) / F.sum("_w"), F.sum(F.col("_w") * F.col("_s.negative")) / F.sum("_w")
    return rows.groupBy(*keys).agg(F.round(p, 5).alias("pos"), F.round(q, 5).alias("neg"), F.round(p - q, 5).alias("net"), F.count(F.lit(1)).cast("int").alias("n_sents"))


def score_transcripts(transcripts: DataFrame, scorer: Callable[[Column], Column], keys: Sequence[str] = ("ticker", "date", "quarter", "source", "word_count", "sentence_count")) -> DataFrame:
    """The 24 score columns for every transcript; sections without sentences score zero.

    All sections are one exploded table and one aggregation. A transcript is known by two hashes of its keys and sections, so
    repeated rows are scored once and keep their repeats.
    """
    whole = [*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *SECTIONS.values()]
    own = transcripts.withColumn("_id", F.concat(F.hex(F.xxhash64(*whole)), F.lit("-"), F.hex(F.xxhash64(*whole, F.lit(1)))))
    parts = F.array(*[F.struct(F.lit(name).alias("section"), F.col(c).alias("sents")) for name, c in SECTIONS.items()])
    long = own.dropDuplicates(["_id"]).select("_id", F.explode(parts).alias("p")).select("_id", "p.section", F.explode("p.sents").alias("sentence"))
    scores = section_scores(long, scorer, ["_id", "section"])
    wide = scores.groupBy("_id").agg(*[F.max(F.when(F.col("section") == s, F.col(c))).alias(f"{s}_{c}") for s in SECTIONS for c in ("pos", "neg", "net", "n_sents")])
    joined = own.join(wide, "_id", "left")
    zero = {f"{s}_{c}": F.coalesce(f"{s}_{c}", F.lit(0 if c == "n_sents" else 0.0)) for s in SECTIONS for c in ("pos", "neg", "net", "n_sents")}
    done = joined.withColumns(zero | {"lm_uncertainty": t.lexicon_share(F.concat("prepared_remarks", "qa_ceo"))})
    done = done.withColumn("qa_delta", F.round(F.col("qa_ceo_net") - F.col("prep_net"), 5))
    return done.select(*keys, *zero, "lm_uncertainty", "qa_delta")
