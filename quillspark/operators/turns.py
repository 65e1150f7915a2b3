"""Speaker turns, roles and transcript assembly, relationally: long tables of elements, participants and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t


# Least length of a participant's line, and what a piece of speech is longer than.
LINE, PIECE = 3, 10


def role_lookup(participants: DataFrame) -> DataFrame:
    """(doc_id, key, role) from (doc_id, pos, line): full names, of which the last line wins, and first names, of which
    the first does unless a key is taken already.

    A key's role is that of the last line whose whole name it is; without one, of the first line whose first name it is.
    A line that sets a first name before that name's own line is overwritten by it, so order between the two is moot.
    """
    lines = participants.where(F.length(F.trim("line")) >= LINE).withColumn("line", F.trim("line"))
    named = lines.select("doc_id", "pos", t.speaker_name(F.col("line")).alias("name"), t.described_role(F.col("line")).alias("role")).where("name <> ''")
    keys = F.array(
        F.struct(F.lower("name").alias("key"), F.lit(1).alias("whole"), F.col("pos").alias("rank")),
        F.struct(t.first_name(F.col("name")).alias("key"), F.lit(0).alias("whole"), (-F.col("pos")).alias("rank")),
    )
    long = named.select("doc_id", "role", F.explode(keys).alias("k")).select("doc_id", "k.*", "role")
    return long.groupBy("doc_id", "key").agg(F.max_by("role", F.struct("whole", "rank")).alias("role"))


def resolve_roles(turns: DataFrame, lookup: DataFrame) -> DataFrame:
    """``turns`` (doc_id, speaker_raw, ...) with speaker_name, speaker_title and role.

    Operator by name, then full name, then first name, then keywords. A known "unknown" ends the search.
    """
    name = t.speaker_name(F.col("speaker_raw"))
    own = turns.withColumns({"speaker_name": name, "speaker_title": t.speaker_title(F.col("speaker_raw")), "_full": F.lower(name), "_first": t.first_name(name)})
    for k in ("_full", "_first"):
        side = lookup.select(F.col("doc_id").alias(f"{k}_d"), F.col("key").alias(f"{k}_k"), F.col("role").alias(f"{k}_r"))
        own = own.join(side, (F.col("doc_id") == F.col(f"{k}_d")) & (F.col(k) == F.col(f"{k}_k")), "left")
    role = F.when(F.col("_full") == "operator", "operator").otherwise(F.coalesce("_full_r", "_first_r", t.fallback_role(F.col("speaker_raw"))))
    return own.withColumn("role", role).drop(*[c for k in ("_full", "_first") for c in (k, f"{k}_d", f"{k}_k", f"{k}_r")])


def speaker_turns(elements: DataFrame, lookup: DataFrame) -> DataFrame:
    """Turns (doc_id, section, turn, speaker_*, role, text, sentences) from (doc_id, section, pos, is_label, label, text).

    A label opens a turn and the texts up to the next one are its speech; texts before any label, turns without text
    and the operator's are dropped. A document's section is bounded by its page.
    """
    w = Window.partitionBy("doc_id", "section").orderBy("pos")
    numbered = elements.withColumn("turn", F.sum(F.col("is_label").cast("int")).over(w)).where("turn > 0")
    parts = F.array_sort(F.collect_list(F.when(F.length("text") > PIECE, F.struct("pos", "text"))))
    grouped = numbered.groupBy("doc_id", "section", "turn").agg(
        F.max(F.when(F.col("is_label"), F.col("label"))).alias("speaker_raw"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text")
    )
    spoken = resolve_roles(grouped.where("text <> '' and speaker_raw <> ''"), lookup).where("role <> 'operator'")
    return spoken.withColumns({"sentences": t.sentences(F.col("text")), "text": t.clean(F.col("text"))})


def assemble(docs: DataFrame, turns: DataFrame, lookup: DataFrame) -> DataFrame:
    """Transcript columns for every row of ``docs`` (doc_id, has_prepared, has_qa, ...).

    Prepared remarks and answers are executives' sentences, questions analysts'; guidance is searched in the first two.
    """
    rows = F.array_sort(F.collect_list(F.struct("section", "turn", "speaker_raw", "speaker_name", "speaker_title", "role", "text", "sentences")))
    per_doc = turns.groupBy("doc_id").agg(rows.alias("speaker_turns"))
    known = lookup.select("doc_id").distinct().withColumn("_known", F.lit(True))
    empty = F.array().cast(per_doc.schema["speaker_turns"].dataType)
    out = docs.join(per_doc, "doc_id", "left").join(known, "doc_id", "left").withColumn("speaker_turns", F.coalesce("speaker_turns", empty))

    def said(section: str, role: str) -> F.Column:
        own = F.filter("speaker_turns", lambda x: (x["section"] == section) & (x["role"] == role))
        return F.flatten(F.transform(own, lambda x: x["sentences"]))

    out = out.withColumns({"prepared_remarks": said("prepared_remarks", "executive"), "qa_ceo": said("qa", "executive"), "qa_analyst": said("qa", "analyst")})
    every = F.concat("prepared_remarks", "qa_ceo", "qa_analyst")
    silent = (F.size("prepared_remarks") == 0) & (F.size("qa_ceo") == 0)
    tags = {"empty_role_lookup": F.col("_known").isNull(), "no_prepared_remarks": ~F.col("has_prepared"), "no_qa_section": ~F.col("has_qa"), "no_executive_sentences": silent}
    return out.withColumns({
        "guidance_sentences": F.filter(F.concat("prepared_remarks", "qa_ceo"), lambda s: t.is_guidance(s)),
        "word_count": t.word_count(every), "sentence_count": F.size(every), "parse_errors": t.error_tags(tags),
    }).drop("_known")
