"""Running a stream into files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postvet.session import new_shared_path


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet files at `path`; the file log makes each row appear once.

    `once` reads all there is and stops; otherwise the stream keeps running.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run over all available input and return what came out."""
    spark = stream.sparkSession
    path, checkpoint = (new_shared_path(spark, f"{name}-{part}") for part in ("out", "state"))
    start(stream, path, checkpoint, once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
