"""Filing lists: company keys, forms from parallel arrays, and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def padded_cik(c: Column) -> Column:
    """The company key in ten digits."""
    return F.lpad(c.cast("string"), 10, "0")


def company_key(companies: DataFrame, ticker: str) -> str:
    """The padded key of a ticker, case aside; raises if there is none."""
    rows = companies.where(F.upper("ticker") == ticker.upper()).select(padded_cik(F.col("cik")).alias("k")).limit(1).collect()
    if not rows:
        raise ValueError(f"no company key for {ticker}")
    return rows[0]["k"]


def company_keys(companies: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, cik) of every company that ``tickers`` names, case aside; the key is padded. Unknown tickers are left out."""
    wanted = tickers.select(F.upper("ticker").alias("_t")).distinct()
    return companies.join(wanted, F.upper("ticker") == F.col("_t"), "left_semi").select("ticker", padded_cik(F.col("cik")).alias("cik"))


def read_submissions(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Filing lists, one JSON object a file, or one a line."""
    return spark.read.schema(schemas.FILINGS).option("multiLine", whole_files).json(path)


def filings(submissions: DataFrame, form: str = "8-K") -> DataFrame:
    """(cik, form, date, accession, primary_document) of exactly that form."""
    r = "filings.recent"
    zipped = F.arrays_zip(F.col(f"{r}.form").alias("form"), F.col(f"{r}.filingDate").alias("date"), F.col(f"{r}.accessionNumber").alias("accession"), F.col(f"{r}.primaryDocument").alias("primary_document"))
    return submissions.select("cik", F.inline(zipped).alias("form", "date", "accession", "primary_document")).where(F.col("form") == form)


def _folder(base: str, cik: Column, accession: Column) -> tuple[Column, Column]:
    plain = F.replace(accession, F.lit("-"), F.lit(""))
    return F.concat(F.lit(base.rstrip("/") + "/"), cik.cast("bigint").cast("string"), F.lit("/"), plain, F.lit("/")), plain


def index_url(base: str, cik: Column, accession: Column) -> Column:
    """Address of a filing's index: the key without leading zeros, and the accession without dashes, twice."""
    folder, plain = _folder(base, cik, accession)
    return F.concat(folder, plain, F.lit("-index.htm"))


def document_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(_folder(base, cik, accession)[0], document)
