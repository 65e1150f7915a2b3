"""Tables of the factor engine derived from the relational test tables: prices, calls, scores, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.returns import by_ticker

#: The texts are invented, so lexicons of their own frequent words stand in.
GUIDANCE = ("the", "que", "und")
UNCERTAIN = ("of", "de", "der", "a", "no assurance")
POSITIVE, NEGATIVE = ("the", "le", "der", "and"), ("of", "de", "die", "in")
ROLES = {"user": "analyst", "assistant": "executive", "system": "operator"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter(c: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(c).cast("string"), F.lit("-"), F.year(c).cast("string"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's unit prices, many a day."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's highest unit price of a day."""
    # by ticker alone: steps that order a ticker's prices need no other exchange
    return by_ticker(quotes(spark, sf_dir)).groupBy("ticker", "date").agg(F.max("close").alias("close"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of ``prices``."""
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


#: Bytes of files of orders and their lines that one task joins, about.
PART_BYTES = 8 << 20


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's day.

    A task sorts its rows and holds sums for most of them, so large tables are joined in parts of about PART_BYTES, as many as
    the session's exchanges have at least, which must not be put together; small ones as Spark sees fit.
    """
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("d"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_tax", "l_quantity", "l_returnflag")
    parts = sum(_bytes(spark, f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem")) // PART_BYTES
    if parts > spark.sparkContext.defaultParallelism:
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        orders, lines = orders.repartition(parts, "l_orderkey"), lines.repartition(parts, "l_orderkey")
    return lines.join(orders, "l_orderkey").select(F.col("l_suppkey").alias("ticker"), quarter(F.col("d")).alias("quarter"), "d", "l_discount", "l_tax", "l_quantity", "l_returnflag")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each supplier and quarter, on its last order day, with four scores in exact arithmetic."""
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100, 0).cast("bigint"))
    n = F.count(F.lit(1))
    share = lambda x, per: F.round(x / (n * F.lit(float(per))), 6)
    return _sales(spark, sf_dir).groupBy("ticker", "quarter").agg(
        F.max("d").alias("date"), share(hundredths("l_discount"), 100).alias("guidance_net"), share(hundredths("l_tax"), 100).alias("qa_ceo_net"),
        share(hundredths("l_quantity"), 5000).alias("prep_net"), share(F.sum((F.col("l_returnflag") == "R").cast("bigint")), 1).alias("lm_uncertainty"),
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's nation as its sector; those of the last nations have none."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).where("n_nationkey < 20").select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("sector"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as labelled elements: every message opens a turn of its role; the first two are prepared remarks."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    section = F.when(F.col("turn") <= 1, "prepared_remarks").otherwise("qa")
    two = F.array(
        F.struct((F.col("turn") * 2).alias("pos"), F.lit(True).alias("is_label"), F.col("role").alias("label"), F.lit("").alias("text")),
        F.struct((F.col("turn") * 2 + 1).alias("pos"), F.lit(False).alias("is_label"), F.lit(None).cast("string").alias("label"), F.col("text").alias("text")),
    )
    return rows.select("doc_id", section.alias("section"), F.explode(two).alias("e")).select("doc_id", "section", "e.*")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's roles described as participants; the last line of a name wins."""
    rows = read(spark, sf_dir, "conversations").where(F.col("role").isNotNull()).groupBy(F.col("conv_id").alias("doc_id"), "role").agg(F.min("turn").alias("pos"))
    word = F.when(F.col("role") == "user", " -- Bank -- Analyst").when(F.col("role") == "assistant", " -- Company -- CEO").otherwise(" -- Operator")
    return rows.select("doc_id", "pos", F.concat("role", word).alias("line"))
