"""Parsed transcripts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from .stage import staged


def read_transcripts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Transcript files, one JSON object each."""
    return spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).option("pathGlobFilter", glob).json(path)


def read_or_errors(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Transcripts of the files that can be read, and (path, record, error) of those that are no JSON object of that form."""
    schema = StructType([*schemas.TRANSCRIPT.fields, StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path)
    read = staged(rows.withColumn("path", F.input_file_name()), "read")
    bad = read.where(F.col("_corrupt").isNotNull()).select("path", F.col("_corrupt").alias("record"), F.lit("unreadable JSON").alias("error"))
    return read.where(F.col("_corrupt").isNull()).drop("_corrupt", "path"), bad
