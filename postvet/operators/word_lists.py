"""Signals by word lists that are tables: their size is no part of the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.functions.text import email_domains, words
from postvet.operators import phrase_index
from postvet.session import stored


def listed_mail_flags(postings: DataFrame, domains: DataFrame) -> DataFrame:
    """Mail addresses per posting and the first one's domain that `domains` (domain) lists.

    Candidates are taken out of the text where it lies; only (id, place, domain) meets the
    table, which is broadcast if its measured size allows. Postings without an address are
    left out; a posting id that repeats is one posting.
    """
    listed = stored(domains.select(F.lower(F.trim("domain")).alias("domain")).distinct())
    read = postings.select(
        "posting_id", F.posexplode(email_domains(F.col("text"))).alias("_at", "domain")
    )
    known = listed.withColumn("_listed", F.lit(True))
    return (
        read.join(known, "domain", "left").groupBy("posting_id")
        .agg(
            F.count("*").cast("int").alias("emails"),
            F.min_by("domain", F.when(F.col("_listed"), F.col("_at"))).alias("_first"),
            F.coalesce(F.max("_listed"), F.lit(False)).alias("generic_email"),
        )
        .select(
            "posting_id", "emails",
            F.when(F.col("generic_email"), F.col("_first")).alias("free_mail_domain"), "generic_email",
        )
    )


def listed_phrase_hits(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """(posting_id, list, hits): how often entries of each list stand in a text.

    `entries` has (list, entry); an entry is one word or many, found whatever its case and
    the signs between its words. Each entry counts at each place where it stands, also where
    entries overlap. The entries are a trie kept as a table, so neither their number nor
    their length makes the plan larger. Null texts and entries without words have no hit.
    """
    known = stored(entries.select("list", "entry").distinct())
    index = phrase_index.build(known.select("entry").distinct(), words(F.col("entry")), "entry")
    read = stored(postings.select("posting_id", words(F.col("text")).alias("words")))
    found = phrase_index.count(read, "words", index, "posting_id")
    return (
        found.join(known, F.col("phrase") == F.col("entry"))
        .groupBy("posting_id", "list").agg(F.sum("n").alias("hits"))
    )
