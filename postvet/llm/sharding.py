"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postvet.llm.common import ready

# Parts of a shard that are numbered apart, so that no shard is sorted in one task.
CELLS = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last of its jumps that lands below `shards`.

    A key jumps on with a chance of 1/(n+1) as shard n is appended, so it either stays
    or moves into the new shard. A key takes about ln(shards) jumps; no table is kept.
    """
    state = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    ahead = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_of(key: Column | str, shards: int) -> Column:
    """Shard of a key of any type: its 64-bit hash jumps. A null key has a hash as well."""

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Only the key and the number of shards decide. `grown_shard` is the shard if one more
    is appended: the same, or the new one. `slot` numbers the rows of a shard from 0
    without gaps: by a hash cell of the key, then key and text checksum; only figures
    are shuffled, and the cell counts come from the key column alone.

    Size is the UTF-8 length plus 8; a null text has length 0 and the checksum of no
    bytes, 0. Null keys share a shard. Rows that repeat a key share its shard and get
    slots of their own. An empty table gives no rows. Other columns are not looked at.
    """
    ready(docs.sparkSession)
    cell = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(CELLS)).alias("cell")
    where = shard_of(key, shards).alias("shard")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        docs.select(where, cell).groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .select(F.col("shard").alias("s1"), F.col("cell").alias("c1"),
                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), where,
        shard_of(key, shards + 1).alias("grown_shard"), cell,
    )
    inside = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("within", F.row_number().over(inside) - 1).join(
        offsets, (F.col("shard") == F.col("s1")) & (F.col("cell") == F.col("c1"))
    )
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("within")).cast("long").alias("slot"), "grown_shard",
    )
