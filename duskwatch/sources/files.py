"""Content of files, for hashes and content rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, folder: str, strip: str = "") -> DataFrame:
    """(path, size, mtime, content) of all files below a folder; `strip` is what to take off the front of the addresses."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.when(F.startswith("path", F.lit(strip)), F.substr("path", F.lit(len(strip) + 1))).otherwise(F.col("path"))
    return got.select(path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")
