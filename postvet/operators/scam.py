"""Fraud signals, risk score, band and verdict of postings.

Text rules are projections: each reads a text once, where it lies, and only the
narrow outcome is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postvet.functions import text as T
from postvet.functions.quantile import group_quantile
from postvet.session import stored

# Default word lists; every one is a parameter of the rules.
FREE_MAIL = (
    "aol.com", "gmail.com", "gmx.com", "hotmail.com", "icloud.com", "mail.com",
    "outlook.com", "proton.me", "protonmail.com", "yahoo.com",
)
URGENT = (
    "act now", "apply immediately", "asap", "hurry", "immediate start", "last chance",
    "limited slots", "start today", "urgent", "urgently",
)
PAYMENT = (
    "application fee", "buy equipment", "buy your own equipment", "deposit required",
    "pay a deposit", "pay for training", "processing fee", "registration fee",
    "send money", "training fee", "upfront payment", "wire transfer",
)

# The flag texts and the verdict shown in the sample report; the
# texts for vagueness, payment and the two lower bands are ours.
SALARY_FLAG = "Unusually High Salary Range"
EMAIL_FLAG = "Generic Email Domain"
URGENCY_FLAG = "Urgency and Grammatical Errors"
VAGUE_FLAG = "Vague Job Description"
PAYMENT_FLAG = "Upfront Payment Request"
VERDICTS = {
    "high": "High Risk / Likely Scam",
    "suspicious": "Suspicious / Review Advised",
    "safe": "Low Risk / No Major Red Flags",
}

# The band limits.
SAFE_BELOW = 30
HIGH_FROM = 70

WEIGHTS = {"salary": 35, "email": 25, "urgency": 25, "vague": 10, "payment": 50}


@dataclass(frozen=True)
class Rules:
    """Everything the five rules can be tuned by."""

    salary_quantile: float = 0.95
    free_mail: Sequence[str] = FREE_MAIL
    urgent: Sequence[str] = URGENT
    urgency_min_hits: int = 2
    vague_max_distinct: float = 0.5
    vague_max_digits: float = 0.01
    payment: Sequence[str] = PAYMENT
    weights: Mapping[str, int] = field(default_factory=lambda: dict(WEIGHTS))


# --- rules over one text -----------------------------------------------------


def free_mail_domain(text: Column, free_mail: Sequence[str]) -> Column:
    """First free-mail domain in the text, else null."""
    listed = F.array(*[F.lit(d) for d in T.literal_list(free_mail)])
    found = F.filter(T.email_domains(text), lambda d: F.array_contains(listed, d))
    return F.try_element_at(found, F.lit(1))


def generic_email_flags(postings: DataFrame, free_mail: Sequence[str] = FREE_MAIL) -> DataFrame:
    """Mail addresses per posting and whether one is at a free-mail domain."""
    read = postings.select(
        "posting_id",
        F.array_size(T.emails(F.col("text"))).alias("emails"),
        free_mail_domain(F.col("text"), free_mail).alias("free_mail_domain"),
    )
    return read.filter("emails > 0").withColumn(
        "generic_email", F.col("free_mail_domain").isNotNull()
    )


def urgency_flags(
    postings: DataFrame, urgent: Sequence[str] = URGENT, min_hits: int = 2
) -> DataFrame:
    """Urgent wording, shouted words and punctuation runs per posting."""
    counts = {
        "urgent_words": T.phrase_hits(F.col("text"), urgent),
        "caps_words": F.regexp_count("text", F.lit(T.CAPS_WORD)),
        "punctuation_runs": F.regexp_count("text", F.lit(T.PUNCTUATION_RUN)),
    }
    read = postings.select(
        "posting_id", *[F.coalesce(count, F.lit(0)).alias(name) for name, count in counts.items()]
    )
    total = F.col("urgent_words") + F.col("caps_words") + F.col("punctuation_runs")
    return read.withColumn("urgency", total >= min_hits)


def _word_counts(postings: DataFrame, *others: str | Column) -> DataFrame:
    """Words, distinct words and words with digits.

    The text is lowered and split once; `others` can use `_lower`.
    """
    lowered = postings.withColumn("_lower", F.lower("text"))
    return lowered.withColumn("_words", T.words_in(F.col("_lower"))).select(
        "posting_id",
        F.array_size("_words").alias("words"),
        F.array_size(F.array_distinct("_words")).alias("distinct_words"),
        F.regexp_count("text", F.lit(T.NUMBER_WORD)).alias("number_words"),
        *others,
    )


def _shares() -> dict[str, Column]:
    return {
        "distinct_share": F.try_divide(F.col("distinct_words"), F.col("words")),
        "number_share": F.try_divide(F.col("number_words"), F.col("words")),
    }


def _is_vague(max_distinct: float, max_digits: float) -> Column:
    shares = _shares()
    low = (shares["distinct_share"] <= max_distinct) & (shares["number_share"] <= max_digits)
    return F.coalesce(low, F.lit(False))


def vague_language(
    postings: DataFrame, max_distinct: float = 0.5, max_digits: float = 0.01
) -> DataFrame:
    """Share of distinct words and of words with digits; vague if both are low."""
    return _word_counts(postings).withColumns(
        {
            **{name: F.round(share, 4) for name, share in _shares().items()},
            "vague": _is_vague(max_distinct, max_digits),
        }
    )


def upfront_payment_flags(postings: DataFrame, phrases: Sequence[str] = PAYMENT) -> DataFrame:
    """Postings that ask the applicant for money."""
    hits = postings.select("posting_id", T.phrase_hits(F.col("text"), phrases).alias("payment_hits"))
    return hits.filter("payment_hits > 0")


# --- rules over many postings ------------------------------------------------


def salary_limits(offers: DataFrame, q: float = 0.95) -> DataFrame:
    """Pay limit per peer group: the q-quantile, exact at any group size."""
    return group_quantile(offers, "peer", "pay", q, "pay_limit")


def salary_outliers(
    offers: DataFrame, q: float = 0.95, limits: DataFrame | None = None
) -> DataFrame:
    """Offers paying more than the limit of their peer group."""
    limits = stored(salary_limits(offers, q) if limits is None else limits)
    return (
        offers.select("posting_id", "peer", "pay")
        .join(limits, "peer")
        .filter(F.col("pay") > F.col("pay_limit"))
    )


def exact_reposts(postings: DataFrame) -> DataFrame:
    """Texts posted more than once, with the number of sources that carry them.

    Null texts and texts without a word are no reposts of each other.
    """
    return (
        postings.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("posting_id", "source", T.same_text_key(F.col("text")).alias("text_key"))
        .groupBy("text_key")
        .agg(
            F.min("posting_id").alias("first_posting"),
            F.count("*").alias("postings"),
            F.count_distinct("source").alias("sources"),
        )
        .filter("postings > 1")
    )


# --- flags, score, band, verdict ---------------------------------------------


def text_signals(postings: DataFrame, rules: Rules, *carried: str) -> DataFrame:
    """Outcome of the four text rules, one narrow row per posting.

    `carried` names further columns of `postings` to keep.
    """
    lowered = F.col("_lower")
    shouted = F.regexp_count("text", F.lit(T.SHOUTED))
    read = _word_counts(
        postings,
        *carried,
        free_mail_domain(F.col("text"), rules.free_mail).alias("free_mail_domain"),
        (T.phrase_hits_in(lowered, rules.urgent) + shouted).alias("_raised"),
        T.phrase_hits_in(lowered, rules.payment).alias("_payment"),
    )
    return read.select(
        "posting_id",
        *carried,
        "free_mail_domain",
        F.col("free_mail_domain").isNotNull().alias("email"),
        F.coalesce(F.col("_raised") >= rules.urgency_min_hits, F.lit(False)).alias("urgency"),
        _is_vague(rules.vague_max_distinct, rules.vague_max_digits).alias("vague"),
        F.coalesce(F.col("_payment") > 0, F.lit(False)).alias("payment"),
    )


def scam_flags(
    postings: DataFrame,
    offers: DataFrame | None = None,
    rules: Rules = Rules(),
    limits: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Ordered flag texts per posting, and the signals behind them.

    Without `offers`, postings carry their own pay and peer group and nothing but
    the small table of pay limits is joined. With `offers` (posting_id, pay, peer),
    the few outliers are joined by id. `limits` can be given if known already.
    `carry` names further columns of `postings` to keep.
    """
    if offers is None:
        known = stored(salary_limits(postings, rules.salary_quantile) if limits is None else limits)
        over = F.coalesce(F.col("pay") > F.col("pay_limit"), F.lit(False))
        # The texts are read first; what meets the limits is narrow.
        priced = [c for c in ("pay", "peer") if c not in carry]
        read = text_signals(postings, rules, *priced, *carry)
        signals = read.join(known.select("peer", "pay_limit"), "peer", "left").withColumn("salary", over)
    else:
        high_pay = salary_outliers(offers, rules.salary_quantile, limits).select(
            "posting_id", F.lit(True).alias("salary")
        )
        signals = (
            text_signals(postings, rules, *carry)
            .join(high_pay, "posting_id", "left")
            .withColumn("salary", F.coalesce("salary", F.lit(False)))
        )
    return signals.select("posting_id", *carry, *WEIGHTS, flag_texts().alias("flags"))


def flag_texts() -> Column:
    """Array of flag texts from the signal columns, in the report's order."""
    return F.array_compact(
        F.array(
            F.when(F.col("salary"), SALARY_FLAG),
            F.when(
                F.col("email"), F.format_string(f"{EMAIL_FLAG} (@%s)", F.col("free_mail_domain"))
            ),
            F.when(F.col("urgency"), URGENCY_FLAG),
            F.when(F.col("vague"), VAGUE_FLAG),
            F.when(F.col("payment"), PAYMENT_FLAG),
        )
    )


def risk_score(flags: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """Add `score`: the weights of the raised signals, 100 at most."""
    parts = [F.when(F.col(name), F.lit(w)).otherwise(F.lit(0)) for name, w in weights.items()]
    return flags.withColumn("score", F.least(F.lit(100), sum(parts[1:], parts[0])).cast("int"))


def band_of(score: Column) -> Column:
    """Band of a score; a missing score is high, as neither comparison holds."""
    return (
        F.when(score < SAFE_BELOW, "safe")
        .when((score >= SAFE_BELOW) & (score < HIGH_FROM), "suspicious")
        .otherwise("high")
    )


def risk_band(scored: DataFrame) -> DataFrame:
    return scored.withColumn("band", band_of(F.col("score")))


def verdict_label(banded: DataFrame, verdicts: Mapping[str, str] = VERDICTS) -> DataFrame:
    """Add the verdict text of the band."""
    table = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair])
    return banded.withColumn("verdict", F.try_element_at(table, F.col("band")))


def scam_analysis(
    postings: DataFrame,
    offers: DataFrame | None = None,
    rules: Rules = Rules(),
    limits: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The whole panel: flags, score, band and verdict per posting."""
    flags = scam_flags(postings, offers, rules, limits, carry)
    return verdict_label(risk_band(risk_score(flags, rules.weights)))


def flag_rows(report: DataFrame) -> DataFrame:
    """One row per flag; order and repeats stay, empty arrays give no row."""
    return report.select("posting_id", F.posexplode("flags").alias("pos", "flag"))


def ml_risk_score(
    postings: DataFrame, labels: DataFrame, features: int = 1 << 14, iterations: int = 20
) -> DataFrame:
    """Learn from labelled postings, score all of them as probability x 100."""
    pipeline = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=T.WORD_GAP),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol="label", probabilityCol="_probability",
                maxIter=iterations, regParam=0.1,
            ),
        ]
    )
    usable = postings.select("posting_id", "text").filter(F.col("text").isNotNull())
    marks = stored(
        labels.filter(F.col("label").isNotNull()).select("posting_id", F.col("label").cast("double")),
        rebalance=True,
    )
    model = pipeline.fit(usable.join(marks, "posting_id"))
    probability = vector_to_array("_probability")[1]
    return model.transform(usable).select(
        "posting_id", F.round(probability * 100, 2).alias("ml_score")
    )
