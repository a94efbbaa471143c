"""Stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_FILE = 5_000_000


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store report rows by risk band, so that a reader of one band skips the rest.

    Rows are not moved to one writer per band: a band can hold most rows.
    """
    report.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("band").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
