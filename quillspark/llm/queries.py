"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, decontamination, language_id, line_dedup, pii, quality, simhash_dedup, url_filter, vector_codes, warc, whitening
from .html import extract

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; these are not part of the repository."""
    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs)).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> and base_sha256 are of the base spans, spans are all."""
    found = pii.personal_data(read(spark, sf_dir, "documents"))

    def listed(base_only: bool) -> F.Column:
        own = lambda k: F.filter(k, lambda x: x["base"]) if base_only else F.col(k)
        text = lambda k: F.transform(own(k), lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
        return F.array_join(F.concat(*[text(k) for k in pii.KINDS]), ",")

    counts = [F.size(F.filter(k, lambda x: x["base"])).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(True), 256).alias("base_sha256"), listed(False).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages"))).drop("url")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = audio.store_tensors(audio.store(read(spark, sf_dir, "documents")))
    return audio.stored_digests(stored).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with its benchmark items; rows without an id are one document."""
    pairs = decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",")
    return pairs.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), items.alias("item_ids"), F.round(F.max("overlap"), 6).alias("overlap"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, what was removed, and the digest of what is left."""
    docs = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"),
        F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"),
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return done.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that is no long any more raises."""
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_warc": op5_warc,
    "op6_audio": op6_audio,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_html": op9_html,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}

#: A round of Lloyd's algorithm: every part's nearest entry of codebook c{k}, and the codebook that follows.
_ROUND = """,
a{k} as (
  select vec_id, part, x, min({{'d': cast(list_dot_product(x, c) * -2 + list_dot_product(x, x) + list_dot_product(c, c) as bigint), 'e': entry}}) as best from p join c{k} using (part) group by all)"""
_NEXT = """,
s{k} as (
  select part, entry, list(m order by place) as c from (
    select part, best.e as entry, place, floor(sum(x[place]) / count(*)) as m from a{k} cross join (select unnest(range(1, len(x) + 1)) as place from p limit (select max(len(x)) from p)) group by all) group by all),
c{n} as (select part, entry, coalesce(s{k}.c, c{k}.c) as c from c{k} left join s{k} using (part, entry))"""
_CODES = (
    """
with kept as (
  select vec_id, label, list_transform(embedding, lambda v: floor(256 * v::double)) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
p as (select vec_id, part, list_slice(x, part * (len(x) // 16) + 1, (part + 1) * (len(x) // 16)) as x from (select vec_id, x, unnest(range(16)) as part from kept)),
c0 as (select part, cast(dense_rank() over (order by vec_id) - 1 as bigint) as entry, x as c from p where vec_id in (select vec_id from kept order by vec_id limit 64))"""
    + "".join(_ROUND.format(k=k) + _NEXT.format(k=k, n=k + 1) for k in range(2))
    + _ROUND.format(k=2)
    + """,
coded as (select vec_id, string_agg(printf('%02x', best.e), '' order by part) as code, cast(sum(best.d) as bigint) as error from a2 group by 1),
books as (select sha256(string_agg(cast(cast(v as bigint) as varchar), ',' order by part, entry, place)) as digest from (select part, entry, unnest(c) as v, unnest(range(len(c))) as place from c2))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select digest from books) as codebooks_sha256 from coded join kept using (vec_id)
"""
)

ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": _CODES,
    "op1_url_filter": """
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from cut),
ruled as (
  select page_id, coalesce(host, '') as host, coalesce(path, '') as path,
    case when concat('.', host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
         when concat('.', host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
         when concat('.', host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
         when concat('.', host) like '%.net' and starts_with(path, '/') then 'net/' end as rule from parts)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from ruled
""",
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from f
""",
    # every item against every passage, by shingles alone
    "op8_decontamination": r"""
with b as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w, list_filter(list_transform(string_split_regex(text, '[\n.!?]+\s*'), lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')), lambda x: len(x) > 0) as parts from benchmark),
i as (
  select item_id, w, case when len(parts) > 1 then list_distinct(flatten(parts[:len(parts) - 1])) else list_distinct(w) end as question, list_distinct(parts[len(parts)]) as answer from b where len(w) > 0),
size as (select max(len(w)) as l from i),
ig as (select distinct item_id, array_to_string(w[p:p + 4], ' ') as g from (select item_id, w, unnest(case when len(w) < 5 then [1] else range(1, len(w) - 3) end) as p from i)),
total as (select item_id, count(*) as n from ig group by 1),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
dg as (select doc_id, p, len(w) as n, array_to_string(w[p:p + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
hit as (select doc_id, item_id, p, least(5, n - p + 1) as size, g, n from dg join ig using (g)),
placed as (select doc_id, item_id, g, unnest(range(0, (p - 1) // l + 1)) * l as s, p, size, n, l from hit cross join size),
share as (
  select doc_id, item_id, s, count(distinct g) as found from placed where p - 1 + size <= s + 3 * l and (size = 5 or p - 1 = s and size = n - s) group by 1, 2, 3),
good as (select doc_id, item_id, s, found * 1e0 / n as overlap from share join total using (item_id) where found >= 0.8 * n),
kept as (
  select good.doc_id, good.item_id, overlap, d.w[s + 1:s + 3 * l] as passage, question, answer from good join d on good.doc_id is not distinct from d.doc_id join i using (item_id) cross join size),
pairs as (
  select doc_id, item_id, overlap from kept where len(list_filter(question, lambda x: list_contains(passage, x))) >= 0.5 * len(question) and len(list_filter(answer, lambda x: list_contains(passage, x))) >= 0.5 * len(answer))
select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as item_ids, round(max(overlap), 6) as overlap from pairs group by 1
""",
}
