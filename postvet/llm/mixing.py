"""Mixing sources to target weights: random keys, range cells, prefix sums, and an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postvet.llm.common import WORD, ready, text_hash
from postvet.session import stored

# Ranges of the random key within a source; a source of any size is spread over so many tasks.
CELLS = 4096


def word_count(text: Column | str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share
    `share` times all sizes by weight. A target stops at `epochs` times its source's
    size; what is over is shared again by weight among the rest. Sorted by the level at
    which they stop, the sources that stop come first, so one pass of running sums finds
    the level of all others. One row per source: this is the only window over all.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("__k", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__k") + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = (
        listed.withColumn("w", weight).withColumn("cap", cap)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        # The level if this source and all later ones stay open; the first one that holds counts.
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("holds", F.col("w") * F.col("level") <= F.col("cap"))
        .withColumn("chosen", F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything))
    )
    level = F.col("chosen")["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("w") * level, F.col("cap")))
    return stepped.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17,
) -> DataFrame:
    """(key, source, text_hash, size, source_size, target, taken) for every row.

    Each row gets a random key, a hash of its id and text. The rows of a source lie on a
    line in the order of these keys, each as long as its text has words. A source's
    target is laid along the line as often as it fits: full rounds take every row once,
    the last round ends at the exact word, so the row it ends in is taken in part.

    The line is summed in ranges of the key: a sum per range, running sums over the
    ranges, then running sums within each range. Equal random keys are ordered by id and
    text hash; rows that agree in these as well are the same for every purpose, so
    reruns agree. Null sources are one source, after all others; null texts have size 0
    and are taken 0 times. An empty table gives no rows. Other columns are not looked at.
    """
    ready(docs.sparkSession)
    named = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), text_hash(text).alias("text_hash"),
        word_count(text).alias("size"),
    )
    rows = stored(named.withColumn("r", F.xxhash64("key", "text_hash", F.lit(seed))))
    rows = rows.withColumn("cell", F.pmod(F.shiftright("r", 52), F.lit(CELLS)))
    cells = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    targets = source_targets(
        cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, epochs
    )
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("before", F.coalesce(F.sum("cell_size").over(running), F.lit(0)))
        .select(F.col("source").alias("s1"), F.col("cell").alias("c1"), "before")
    )
    targets = targets.withColumnRenamed("source", "s2")
    offsets = stored(
        offsets.join(targets, F.col("s1").eqNullSafe(F.col("s2")))
        .select("s1", "c1", "before", "source_size", "target")
    )
    inside = (
        Window.partitionBy("source", "cell").orderBy("r", "key", "text_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(
        offsets, F.col("source").eqNullSafe(F.col("s1")) & (F.col("cell") == F.col("c1"))
    )
    start = F.col("before") + F.col("within")
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - full * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select(
        F.col("key").alias(key), F.col("source").alias(source), "text_hash", "size", "source_size",
        "target", (full * F.col("size") + last).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, all columns kept.

    A row taken in part comes whole if at least half of its words are taken, else not:
    texts are never cut. Rows of no words are never taken. Rows that agree in id, source
    and text share one decision.
    """
    found = mix(docs, key, text, source, **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    decided = (
        found.groupBy(F.col(key).alias("__k"), F.col(source).alias("__s"), F.col("text_hash").alias("__h"))
        .agg(F.max(copies).alias("__n"))
    )
    marked = docs.withColumn("__t", text_hash(text))
    joined = marked.join(
        decided, marked[key].eqNullSafe(decided["__k"]) & marked[source].eqNullSafe(decided["__s"])
        & (F.col("__t") == F.col("__h"))
    )
    return joined.select(
        *[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("__n"))).alias("__copy")
    ).drop("__copy")
