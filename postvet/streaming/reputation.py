"""Running reputation of companies, and scan sessions of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.functions.text import words
from postvet.operators import phrase_index
from postvet.session import stored


def reputation(
    reviews: DataFrame, window: str = "30 days", slide: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """Review count and mean per company and window, tumbling or sliding.

    On a stream, late reviews are dropped and a window comes out once the
    watermark has passed its end.
    """
    if reviews.isStreaming:
        reviews = reviews.withWatermark("reviewed_at", delay)
    span = F.window("reviewed_at", window, slide) if slide else F.window("reviewed_at", window)
    return (
        reviews.groupBy(span.alias("span"), "company_id")
        .agg(F.count("*").alias("reviews"), F.round(F.avg("rating"), 4).alias("mean_rating"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "company_id",
            "reviews",
            "mean_rating",
        )
    )


def text_reputation(
    reviews: DataFrame,
    texts: DataFrame,
    lexicon: DataFrame,
    window: str = "30 days",
    within: str = "1 day",
    delay: str = "1 day",
) -> DataFrame:
    """What review texts say of each company, by window of the review's time.

    `reviews` (review_id, company_id, reviewed_at) and `texts` (review_id, text, written_at)
    are both streams or both batches. A text counts if it is written at its review's time or
    up to `within` later; a later one never does. `text_score` is the mean weight of all
    lexicon words of the window. Texts without such a word, and reviews without a text,
    add nothing; repeated reviews count each, texts of one review and instant as one.

    On a stream both sides have a watermark of `delay`, so the state ends: words are folded
    per text, texts wait for their review and reviews for their text as long as `within`
    allows, and a window comes out when neither can add to it any more.
    """
    if texts.isStreaming:
        texts = texts.withWatermark("written_at", delay)
        reviews = reviews.withWatermark("reviewed_at", delay)
    kept = stored(lexicon.select("token", F.col("weight").cast("double").alias("weight")))
    table = phrase_index.byte_table(kept, F.col("token"), F.lit(1))
    likely = F.filter(words(F.col("text")), lambda w: phrase_index.mark(table, w) != F.lit(phrase_index.NONE))
    folded = (
        texts.select(F.col("review_id").alias("_review"), "written_at", F.explode(likely).alias("token"))
        .join(kept, "token")
        .groupBy("_review", "written_at")
        .agg(F.count("*").alias("_n"), F.sum("weight").alias("_sum"))
    )
    met = reviews.select("review_id", "company_id", "reviewed_at").join(
        folded,
        (F.col("review_id") == F.col("_review")) & (F.col("written_at") >= F.col("reviewed_at"))
        & (F.col("written_at") <= F.col("reviewed_at") + F.expr(f"INTERVAL {within}")),
    )
    score = F.round(F.col("_sum") / F.col("lexicon_words"), 4)
    return (
        met.groupBy(F.window("reviewed_at", window).alias("span"), "company_id")
        .agg(F.count("*").alias("texts"), F.sum("_n").alias("lexicon_words"), F.sum("_sum").alias("_sum"))
        .select(
            F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "company_id",
            "texts", "lexicon_words", score.alias("text_score"),
            F.when(score < 0, "Negative").when(score > 0, "Positive").otherwise("Mixed").alias("sentiment"),
        )
    )


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions per user from a stream; the batch twin is `usage_sessions`."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("span"), "user_id")
        .agg(F.count("*").alias("events"))
        .select(
            "user_id",
            F.col("span.start").alias("session_start"),
            F.col("span.end").alias("session_end"),
            "events",
        )
    )
