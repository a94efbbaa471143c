"""What comes in: pasted text, pages at job URLs, resume files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.functions.text import html_text

# The file endings the upload box offers.
RESUME_ENDINGS = (".pdf", ".doc", ".docx")


def page_text(pages: DataFrame) -> DataFrame:
    """Plain text of the page at each job URL."""
    return pages.select("page_id", html_text(F.col("html")).alias("text"))


def posting_hosts(pages: DataFrame) -> DataFrame:
    """Scheme, host and path of each job URL; nulls for a malformed one."""
    part = {"scheme": "PROTOCOL", "host": "HOST", "path": "PATH"}
    return pages.select(
        "page_id",
        *[F.try_parse_url(F.col("url"), F.lit(p)).alias(n) for n, p in part.items()],
    )


def collect_postings(pasted: DataFrame, pages: DataFrame) -> DataFrame:
    """Pasted texts and page texts as one table. `id` is unique within `origin`."""
    from_text = pasted.select(
        F.lit("pasted").alias("origin"), F.col("posting_id").alias("id"), "text"
    )
    from_url = page_text(pages).select(F.lit("url").alias("origin"), F.col("page_id").alias("id"), "text")
    return from_text.unionByName(from_url)


def submission_gate(submissions: DataFrame) -> DataFrame:
    """Keep rows with some text, white space included, or with a file."""
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    return submissions.filter(has_text | F.col("file_name").isNotNull())


def size_mb(size: Column) -> Column:
    """Bytes as megabytes to two decimals."""
    return F.round(size / 1024 / 1024, 2)


def resume_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files under `path`; their content is never read.

    The endings are only a hint of the file picker, so other files are listed
    too, with `accepted` false. Spark's readers skip files of 0 bytes.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    endings = "|".join(e.replace(".", r"\.") for e in RESUME_ENDINGS)
    return files.select(
        name.alias("file_name"),
        F.col("length").alias("file_bytes"),
        size_mb(F.col("length")).alias("size_mb"),
        F.lower(name).rlike(f"({endings})$").alias("accepted"),
    )
