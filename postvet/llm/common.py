"""What the operators of this folder share: session set-up, shipping, and small helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.session import configure, new_shared_path

# White space of the word rule `[^\x20\x09-\x0D]+`, which all operators here use.
WORD = r"[^\x20\x09-\x0D]+"
# Rows and bytes in one Arrow batch: texts can be 100 KB and more.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


class Memo(dict):
    """What `make` gave for the keys met so far, in bounded memory.

    Once `limit` keys are held they become the old generation, in which a key is still
    found, and is renewed, until the next turn: frequent keys are never made again.
    """

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def ready(spark: SparkSession) -> SparkSession:
    """Apply the session settings and put this package on the executors' path, once per context."""
    configure(spark)
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if not getattr(context, "_postvet_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="postvet-ship-"), "postvet.zip")
        with zipfile.ZipFile(archive, "w") as bundle:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        bundle.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        context._postvet_shipped = True
    return spark


class Scratch:
    """Tables that one operator writes to the shared folder, deleted when its result is written.

    A dropped or left table must not be read any more. `keep` writes the one table that
    the operator's result still reads. After a failure nothing is left either. With `shuffles`,
    shuffle files go as soon as their query ends too; otherwise they stay until the driver
    collects garbage, which an operator of many queries may not live to see.
    """

    # Wide dictionaries and zstd: ids repeat, and what is written here is read soon.
    LAYOUT = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, shuffles: bool = False):
        self.spark, self.paths, self.shuffles = spark, {}, shuffles

    def __enter__(self) -> Scratch:
        if self.shuffles:
            self.before = self.spark.conf.get(self.CLEANUP, None)
            self.spark.conf.set(self.CLEANUP, "true")
        return self

    def __exit__(self, *failure) -> None:
        if self.shuffles:
            if self.before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, self.before)
        for name in list(self.paths):
            self.drop(name)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.options(**self.LAYOUT).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        if name in self.paths:
            raise ValueError(f"{name} is stored already")
        self.paths[name] = new_shared_path(self.spark, name)
        return self._written(df, self.paths[name])

    def keep(self, df: DataFrame) -> DataFrame:
        return self._written(df, new_shared_path(self.spark, "kept"))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_hash(text: Column | str) -> Column:
    """64-bit hash of a text; tells apart rows that repeat an id. A null text hashes like none."""
    return F.xxhash64(text)


def map_texts(
    df: DataFrame, ids: list[str], text: str, schema: str,
    work: Callable[[list[str | None]], list[pa.Array]],
) -> DataFrame:
    """Rows of `ids` with new columns made from the text, batch by batch.

    `work` turns the texts of a batch into arrays for the columns that `schema`
    names. The texts themselves are not returned.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*ids).schema}
    full = ", ".join([*(f"`{n}` {kinds[n]}" for n in ids), schema])
    new = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.column(len(ids)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *made], [*ids, *new])

    return df.select(*ids, F.col(text).alias("__text")).mapInArrow(run, full)
