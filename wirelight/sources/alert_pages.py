"""Alert pages landed as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight import schemas

# One element of ``alerts`` per row, with its page's catalogue.
_COLUMNS = ["follow", "eventType", "event", "threats", "wisdom", "catalogue"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ALERT_PAGE).json(path)


def stream_pages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.ALERT_PAGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def parse_pages(lines: DataFrame) -> DataFrame:
    """Pages from JSON text (column value)."""
    return lines.select(F.from_json("value", schemas.ALERT_PAGE).alias("p")).select("p.*")


def explode_pages(pages: DataFrame) -> DataFrame:
    """One row per alert; a page without alerts gives none."""
    return pages.select(
        "follow", F.col("threats").alias("catalogue"), F.inline("alerts")
    ).select(*_COLUMNS)


def catalogue_entries(pages: DataFrame) -> DataFrame:
    """(id, title, severity, policy) of all threats the pages name."""
    return pages.select(F.explode("threats").alias("id", "t")).select("id", "t.*").distinct()
