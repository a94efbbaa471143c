"""Purging a stored table: only files that hold a row to drop are written anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.session import stored

JOURNAL = "_purge"   # a name with an underscore, which readers of the folder pass over


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _finish(spark: SparkSession, path: str) -> None:
    """Carry out a purge that was decided on; each step can be done again."""
    fs, folder = _files(spark, path), f"{path}/{JOURNAL}"
    if fs.exists(_path(spark, f"{folder}/files/_SUCCESS")):
        # One name per touched file.
        for row in spark.read.text(f"{folder}/files").collect():
            fs.delete(_path(spark, row.value), False)
        for status in fs.listStatus(_path(spark, f"{folder}/rows")):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                fs.rename(status.getPath(), _path(spark, f"{path}/{name}"))
    fs.delete(_path(spark, folder), True)


def purge_stored(
    spark: SparkSession, path: str, deleted_users: DataFrame, cutoff: dt.date, when: str = "ts"
) -> int:
    """Drop rows older than the cutoff and rows of deleted users from the Parquet files at `path`.

    Rows with a null time or user: a null time goes with the old ones, a null user stays.
    Files without a row to drop keep their names and are not written again; their footers
    and the two columns are all that is read of them. What stays of the touched files is
    written into a journal first, and only then are files exchanged: a run that failed is
    finished by the next. Readers may miss the touched files' rows in between. The folder
    has no partition columns. Returns the number of files exchanged.
    """
    _finish(spark, path)
    gone = stored(deleted_users.select("user_id").filter("user_id IS NOT NULL").distinct())
    rows = spark.read.parquet(path)
    fresh = F.coalesce(F.col(when) >= F.lit(cutoff), F.lit(False))
    file = F.col("_metadata.file_path").alias("_file")
    old = rows.filter(~fresh).select(file)
    theirs = rows.filter(fresh).select("user_id", file).join(gone, "user_id", "left_semi").select("_file")
    touched = sorted(r[0] for r in old.union(theirs).distinct().collect())
    if not touched:
        return 0
    folder = f"{path}/{JOURNAL}"
    kept = spark.read.schema(rows.schema).parquet(*touched).filter(fresh).join(gone, "user_id", "left_anti")
    kept.select(*rows.columns).write.parquet(f"{folder}/rows")
    spark.createDataFrame([(t,) for t in touched], "value string").coalesce(1).write.text(f"{folder}/files")
    _finish(spark, path)
    return len(touched)
