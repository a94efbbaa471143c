"""Logical input tables over the driver's test tables (see FIXTURES.md).

The test tables hold no job data. Each method states which columns stand in for
what; every row of the table is used, and every pair of a line item is a submission.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.functions.text import email_domains, words
from postvet.operators.plans import plan_table
from postvet.operators.scam import Rules
from postvet.session import configure, stored

# Parameters that make invented prose trip the rules; the defaults never would.
RULES = Rules(
    salary_quantile=0.95,
    free_mail=("mail2.example.com", "mail5.example.com"),
    urgent=("thtion", "attion", "ertion"),
    urgency_min_hits=2,
    vague_max_distinct=0.55,
    vague_max_digits=0.002,
    payment=("thanea", "onbleea"),
)
AS_OF = dt.date(1999, 1, 1)
CUTOFF = dt.date(2024, 1, 10)
# Shares of the documents, in thousandths, between which a word is a skill or in the lexicon.
SKILL_SHARE = (10, 12)
LEXICON_SHARE = (20, 80)
GOOD_UP_TO = 40


class Fixtures:
    """Readers for one directory of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # Opening a table reads a file footer, so each is opened once.
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream; files that arrive later are picked up too.

        The table may be one file, a folder of part files, or several of either.
        """
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.folder}/{name}.parquet*")

    # --- postings

    def postings(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("posting_id"), "text", "source", "lang"
        )

    def headers(self) -> DataFrame:
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("posting_id"),
            F.col("o_custkey").alias("company_id"),
            F.col("o_orderdate").alias("posted_at"),
        )
        known = self.table("documents").select(F.col("doc_id").alias("posting_id"), "source")
        return known.join(orders, "posting_id")

    def offers(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("posting_id"),
            F.col("o_totalprice").alias("pay"),
            F.col("o_orderpriority").alias("peer"),
        )

    def timed_postings(self, documents: DataFrame) -> DataFrame:
        """Postings with pay, peer group and event time, for alerts."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("posting_id"),
            F.col("o_totalprice").alias("pay"),
            F.col("o_orderpriority").alias("peer"),
            F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        )
        return documents.select(F.col("doc_id").alias("posting_id"), "text").join(
            orders, "posting_id"
        )

    def company_postings(self, documents: DataFrame) -> DataFrame:
        companies = self.table("orders").select(
            F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("company_id")
        )
        return self.timed_postings(documents).join(companies, "posting_id")

    def watches(self) -> DataFrame:
        """Every event of a user is a company they watch: its id dealt round over the customers."""
        companies = F.lit(self.table("customer").count()).cast("long")
        return self.table("events").select("user_id", (F.pmod("event_id", companies) + 1).alias("company_id"))

    def mail_domains(self) -> DataFrame:
        """Half of all mail domains: those with an even number in their name."""
        seen = self.documents.select(F.explode(email_domains(F.col("text"))).alias("domain")).distinct()
        return seen.filter(F.regexp_extract("domain", "[0-9]+", 0).try_cast("int") % 2 == 0)

    def word_lists(self) -> DataFrame:
        """Negative lexicon words are urgent ones; skills stand for payment phrases."""
        urgent = self.lexicon().filter("weight < 0").select(F.lit("urgent").alias("list"), F.col("token").alias("entry"))
        return urgent.union(self.skills().select(F.lit("payment"), "skill"))

    def labels(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("posting_id"), F.col("toxic").alias("label")
        )

    def pages(self) -> DataFrame:
        return self.table("pages")

    def uploads(self) -> DataFrame:
        """Some postings without text, some with a file: by language and source."""
        return self.documents.select(
            F.col("doc_id").alias("posting_id"),
            F.when(F.col("lang") == "es", "").otherwise(F.col("text")).alias("text"),
            F.when(F.col("source") < "src15", F.format_string("%d.pdf", "doc_id")).alias("file_name"),
            F.col("n_chars").cast("long").alias("file_bytes"),
        )

    # --- companies and reviews

    def companies(self) -> DataFrame:
        """Customers and suppliers, whose ids are kept apart by their sign."""
        customers = self.table("customer").select(
            F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name")
        )
        return customers.union(self.table("supplier").select(-1 - F.col("s_suppkey"), "s_name"))

    def first_seen(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("first_seen")
        )

    def registry_listings(self) -> DataFrame:
        return (
            self.table("orders")
            .select(F.col("o_custkey").alias("company_id"), F.col("o_orderstatus").alias("registry"))
        )

    def reviews(self, orders: DataFrame | None = None) -> DataFrame:
        return (
            (self.table("orders") if orders is None else orders)
            .select(
                F.col("o_orderkey").alias("review_id"),
                F.col("o_custkey").alias("company_id"),
                (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"),
                F.col("o_orderdate").cast("timestamp").alias("reviewed_at"),
            )
        )

    def review_texts(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("review_id"), "text")

    def timed_review_texts(self, documents: DataFrame) -> DataFrame:
        """Texts of the orders' reviews, written 0, 1 or 2 days after them."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("review_id"), "o_orderdate")
        later = F.make_dt_interval(F.pmod("review_id", F.lit(3)).cast("int"))
        return documents.select(F.col("doc_id").alias("review_id"), "text").join(orders, "review_id").select(
            "review_id", "text", (F.col("o_orderdate").cast("timestamp") + later).alias("written_at")
        )

    @cached_property
    def document_frequency(self) -> DataFrame:
        """In how many texts each word occurs, and in how many of a thousand."""
        return stored(
            self.documents.select(F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
            .groupBy("token").agg(F.count("*").alias("df"))
            .withColumn("docs", F.lit(self.number_of_documents).cast("long"))
        )

    @cached_property
    def number_of_documents(self) -> int:
        return self.documents.count()

    def words_between(self, share: tuple[int, int]) -> DataFrame:
        low, high = share
        return self.document_frequency.filter(
            (F.col("df") * 1000 >= F.col("docs") * low) & (F.col("df") * 1000 <= F.col("docs") * high)
        )

    def lexicon(self) -> DataFrame:
        good = F.col("df") * 1000 <= F.col("docs") * GOOD_UP_TO
        return self.words_between(LEXICON_SHARE).select("token", F.when(good, 1.0).otherwise(-1.0).alias("weight"))

    # --- resumes

    def texts(self) -> DataFrame:
        return self.documents.select("doc_id", "text")

    def submissions(self) -> DataFrame:
        """Resume-posting pairs: the keys of every line item, dealt round over the documents."""
        docs = F.lit(self.number_of_documents).cast("long")
        return (
            self.table("lineitem")
            .select(F.pmod("l_partkey", docs).alias("resume_id"), F.pmod("l_orderkey", docs).alias("posting_id"))
            .distinct()
        )

    def skills(self) -> DataFrame:
        """Words in about one document of a hundred, and every whole benchmark passage."""
        single = self.words_between(SKILL_SHARE).select(F.col("token").alias("skill"))
        return single.union(self.table("benchmark").select("text")).distinct()

    def resume_vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("resume_id"), F.col("embedding").alias("v")
        )

    def posting_vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("posting_id"), F.col("embedding").alias("v")
        )

    # --- users

    def user_events(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "view", "scan")
            .when(F.col("event_type") == "purchase", "verified")
            .otherwise(F.col("event_type"))
        )
        return self.table("events").select("event_id", "ts", "user_id", kind.alias("event_type"))

    def plans(self) -> DataFrame:
        return plan_table(self.spark)

    def subscriptions(self) -> DataFrame:
        third = F.pmod("user_id", F.lit(3))
        return self.table("events").select("user_id").distinct().select(
            "user_id",
            F.when(third == 0, "Free").when(third == 1, "Pro").otherwise("Enterprise").alias("plan"),
            F.when(F.pmod("user_id", F.lit(2)) == 0, "monthly").otherwise("yearly").alias("billing"),
        )

    def plan_changes(self) -> DataFrame:
        """Every signup event chooses a plan."""
        third = F.pmod("event_id", F.lit(3))
        return self.table("events").filter("event_type = 'signup'").select(
            "user_id",
            F.when(third == 0, "Free").when(third == 1, "Pro").otherwise("Enterprise").alias("plan"),
            F.col("ts").alias("valid_from"),
        )

    def profile_ops(self) -> DataFrame:
        level = F.get_json_object("props", "$.k").cast("int")
        return (
            self.table("events")
            .select(
                "user_id",
                F.col("event_id").alias("seq"),
                F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
                F.concat(F.lit("s"), F.floor(level / 10).cast("string")).alias("skill"),
            )
        )

    def profiles(self) -> DataFrame:
        listed = self.registry_listings().select(F.col("company_id").alias("user_id")).distinct()
        return (
            self.table("customer")
            .select(
                F.col("c_custkey").alias("user_id"),
                F.col("c_name").alias("first_name"),
                F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("last_name"),
                F.when(F.col("c_nationkey") < 10, "").otherwise(F.lit("x")).alias("email"),
            )
            .join(listed.withColumn("bio", F.lit("x")), "user_id", "left")
        )

    def deleted_users(self) -> DataFrame:
        return self.table("events").filter("event_type = 'error' AND value > 90").select("user_id")

    def teams(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("posting_id"), F.col("source").alias("team")
        )

    def chat(self) -> DataFrame:
        role = F.when(F.col("role") == "assistant", "bot").otherwise(F.col("role"))
        return self.table("conversations").select("conv_id", "turn", role.alias("role"), "text")
