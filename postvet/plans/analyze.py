"""The path from what was handed in to a stored report, kept up to date by its changes.

Pasted texts, pages and files become one table under one id. The stored table holds, per
posting, the masked text and the outcome of the text rules; it is cut into buckets by a
hash of the id. A refresh compares ids and content hashes only, reads the text rules over
what changed, and rewrites the buckets that hold a change. Pay limits move with every
offer, so the salary rule, score, band and verdict are worked out when the report is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.functions.text import masked
from postvet.operators import scam
from postvet.session import stored
from postvet.sources.ingest import page_text, submission_gate

PASTED, URL = "pasted", "url"
BUCKETS = 64
KEPT = ["origin", "id", "file_name", "content"]
SIGNALS = ["free_mail_domain", "email", "urgency", "vague", "payment"]
SCHEMA = (
    "posting_key string, origin string, id long, file_name string, content string, text string, "
    "free_mail_domain string, email boolean, urgency boolean, vague boolean, payment boolean, "
    "gone boolean, bucket int"
)


def handed_in(uploads: DataFrame, pages: DataFrame) -> DataFrame:
    """Uploads (posting_id, text, file_name) and pages (page_id, html) that pass the gate.

    `posting_key` is the origin and the id there; ids are unique within an origin.
    `content` is a hash of text and file name. A null text counts as empty.
    """
    pasted = uploads.select(
        F.lit(PASTED).alias("origin"), F.col("posting_id").cast("long").alias("id"), "text", "file_name"
    )
    from_url = page_text(pages).select(
        F.lit(URL).alias("origin"), F.col("page_id").cast("long").alias("id"), "text",
        F.lit(None).cast("string").alias("file_name"),
    )
    text, name = F.coalesce("text", F.lit("")), F.coalesce("file_name", F.lit(""))
    # The first hash has a fixed length, so no two pairs give one string.
    content = F.sha2(F.concat(F.sha2(name, 256), text), 256)
    return submission_gate(pasted.unionByName(from_url)).select(
        F.concat_ws(":", "origin", "id").alias("posting_key"), "origin", "id",
        text.alias("text"), "file_name", content.alias("content"),
    )


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("posting_key"), F.lit(buckets)).cast("int").alias("bucket")


def _read_rows(postings: DataFrame, rules: scam.Rules, buckets: int) -> DataFrame:
    """The text rules over whole texts as handed in; what is stored is masked."""
    prepared = postings.withColumns(
        {"posting_id": F.col("posting_key"), "_masked": masked(F.col("text"))}
    )
    read = scam.text_signals(prepared, rules, *KEPT, "_masked")
    return read.withColumnRenamed("posting_id", "posting_key").select(
        "posting_key", *KEPT, F.col("_masked").alias("text"), *SIGNALS,
        F.lit(False).alias("gone"), _bucket(buckets),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _write(rows: DataFrame, path: str) -> None:
    """Replace the buckets that have rows here; the others keep their files.

    Rows of a bucket are brought together; AQE splits one that is too large for a task.
    """
    (
        rows.hint("rebalance", "bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def refresh(
    postings: DataFrame, path: str, rules: scam.Rules = scam.Rules(), buckets: int = BUCKETS
) -> None:
    """Bring the stored table in line with `postings`, all that is handed in now.

    A posting that is no longer there leaves a row without content, so that its bucket is
    rewritten even if it was the last one. `rules` and `buckets` must stay those of the
    first run; for others start a new path. A run that failed is mended by the next, which
    finds whatever is missing as changed.
    """
    spark = postings.sparkSession
    if not _exists(spark, path):
        _write(_read_rows(postings, rules, buckets), path)
        return
    rows = _stored_rows(spark, path)
    held = rows.filter("NOT gone").select("posting_key", F.col("content").alias("_held"))
    # Ids and hashes only; texts take no part in the comparison.
    changes = stored(
        postings.select("posting_key", "content").join(held, "posting_key", "full_outer")
        .filter(~F.col("content").eqNullSafe(F.col("_held")))
        .select("posting_key", F.col("content").isNull().alias("_left"), _bucket(buckets)),
        rebalance=True,
    )
    # At most `buckets` numbers, so that the scan reads only these folders.
    touched = [r.bucket for r in changes.select("bucket").distinct().collect()]
    if not touched:
        return
    new = postings.join(changes.filter("NOT _left").select("posting_key"), "posting_key", "left_semi")
    kept = rows.filter(F.col("bucket").isin(touched)).join(
        changes.select("posting_key"), "posting_key", "left_anti"
    )
    left = changes.filter("_left").select("posting_key", "bucket", F.lit(True).alias("gone"))
    # Written aside first: the buckets read here are replaced below.
    whole = stored(
        kept.unionByName(_read_rows(new, rules, buckets))
        .unionByName(left, allowMissingColumns=True)
    )
    _write(whole, path)


def read_analysis(
    spark: SparkSession,
    path: str,
    offers: DataFrame,
    rules: scam.Rules = scam.Rules(),
    limits: DataFrame | None = None,
) -> DataFrame:
    """One row per stored posting: masked text, flags, score, band and verdict.

    `offers` (posting_id, pay, peer) belong to pasted postings; a page has no known pay.
    """
    high_pay = scam.salary_outliers(offers, rules.salary_quantile, limits).select(
        F.concat_ws(":", F.lit(PASTED), "posting_id").alias("posting_key"), F.lit(True).alias("salary")
    )
    rows = _stored_rows(spark, path).filter("NOT gone")
    # The texts are joined to nothing but the few outliers.
    flagged = (
        rows.join(high_pay, "posting_key", "left")
        .withColumn("salary", F.coalesce("salary", F.lit(False)))
        .withColumn("flags", scam.flag_texts())
    )
    judged = scam.verdict_label(scam.risk_band(scam.risk_score(flagged, rules.weights)))
    return judged.select(
        "posting_key", "origin", "id", "file_name", "text", "flags", "score", "band", "verdict"
    )
