"""Reading input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def page_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """url, html, content_type and status of saved pages: files below a folder, read whole by Spark."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.expr("startswith(cast(substr(content, 1, 5) as string), '%PDF-')"), "application/pdf").otherwise("text/html")
    html = F.when(kind == "text/html", F.try_validate_utf8(F.col("content").cast("string")))
    return files.select(F.col("path").alias("url"), html.alias("html"), kind.alias("content_type"), F.lit(200).alias("status"))
