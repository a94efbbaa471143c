"""Every job as a query over the test tables: name -> (spark, folder) -> DataFrame.

Lists become text so that all columns are scalars. Stream queries run over all
available input and return what the stream wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.operators import (
    chat, company, history, plans, resume, reviews, risk_model, scam, usage, word_lists,
)
from postvet.plans import analyze, report
from postvet.session import new_shared_path, stored
from postvet.sources import ingest, purge, store
from postvet.sources.bindings import AS_OF, CUTOFF, RULES, Fixtures
from postvet.streaming.alerts import scam_alerts
from postvet.streaming.plan_alerts import plan_alerts, read_plan_alerts, start_plan_alerts
from postvet.streaming.reputation import reputation, session_stream, text_reputation
from postvet.streaming.sinks import drain

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ALERTED = ("Pro", "Enterprise")
PROFILE_FIELDS = ["first_name", "last_name", "email", "bio"]


def query(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """Register a function of the test tables under its own name."""
    REGISTRY[fn.__name__] = lambda spark, folder: fn(Fixtures(spark, folder))
    return fn


def _text(array: str):
    return F.array_join(array, "; ").alias(array)


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _second(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- sources and sinks


@query
def collect_postings(fx):
    return ingest.collect_postings(fx.postings(), fx.pages())


@query
def page_text(fx):
    return ingest.page_text(fx.pages())


@query
def posting_hosts(fx):
    return ingest.posting_hosts(fx.pages())


@query
def submission_gate(fx):
    kept = ingest.submission_gate(fx.uploads())
    return kept.withColumn("size_mb", ingest.size_mb(F.col("file_bytes")))


@query
def write_report(fx):
    path = new_shared_path(fx.spark, "report")
    scored = scam.scam_analysis(fx.postings(), fx.offers(), RULES)
    store.write_report(scored.select("posting_id", "score", "band", "verdict"), path)
    return store.read_report(fx.spark, path)


# --- scam detection


@query
def salary_limits(fx):
    limits = scam.salary_limits(fx.offers(), RULES.salary_quantile)
    return limits.withColumn("pay_limit", F.round("pay_limit", 4))


@query
def salary_outliers(fx):
    found = scam.salary_outliers(fx.offers(), RULES.salary_quantile)
    return found.withColumn("pay_limit", F.round("pay_limit", 4))


@query
def generic_email_flags(fx):
    return scam.generic_email_flags(fx.postings(), RULES.free_mail)


@query
def urgency_flags(fx):
    return scam.urgency_flags(fx.postings(), RULES.urgent, RULES.urgency_min_hits)


@query
def vague_language(fx):
    return scam.vague_language(fx.postings(), RULES.vague_max_distinct, RULES.vague_max_digits)


@query
def upfront_payment_flags(fx):
    return scam.upfront_payment_flags(fx.postings(), RULES.payment)


@query
def exact_reposts(fx):
    return scam.exact_reposts(fx.postings())


def _flags(fx):
    return scam.scam_flags(fx.postings(), fx.offers(), RULES)


def _scam(fx):
    return scam.scam_analysis(fx.postings(), fx.offers(), RULES)


@query
def scam_flags(fx):
    return _flags(fx).withColumn("flags", _text("flags"))


@query
def risk_score(fx):
    return scam.risk_score(_flags(fx), RULES.weights).select("posting_id", "score")


@query
def risk_band(fx):
    scored = scam.risk_score(_flags(fx), RULES.weights)
    return scam.risk_band(scored).select("posting_id", "score", "band")


@query
def verdict_label(fx):
    return _scam(fx).select("posting_id", "score", "band", "verdict")


@query
def flag_rows(fx):
    return scam.flag_rows(_flags(fx))


@query
def ml_risk_score(fx):
    return scam.ml_risk_score(fx.postings(), fx.labels())


@query
def ml_fold_counts(fx):
    return risk_model.fold_counts(fx.postings(), fx.labels())


@query
def ml_risk_out_of_fold(fx):
    return risk_model.out_of_fold_scores(fx.postings(), fx.labels())


@query
def listed_mail_flags(fx):
    return word_lists.listed_mail_flags(fx.postings(), fx.mail_domains())


@query
def listed_phrase_hits(fx):
    return word_lists.listed_phrase_hits(fx.postings(), fx.word_lists())


# --- company verification


def _number(column: str):
    """A whole number that may be missing, as other tools read it."""
    return F.col(column).cast("double").alias(column)


def _age(fx):
    return company.domain_age(fx.companies(), fx.first_seen(), AS_OF)


def _presence(fx):
    return company.online_presence(fx.companies(), fx.registry_listings())


def _verified(fx):
    return company.verify_company(
        fx.companies(), _age(fx), _presence(fx), fx.reviews(), min_days=365, min_registries=1
    )


@query
def domain_age(fx):
    return _age(fx).withColumn("domain_age_days", _number("domain_age_days"))


@query
def online_presence(fx):
    return _presence(fx)


@query
def unlisted_companies(fx):
    return company.unlisted_companies(fx.companies(), fx.registry_listings())


@query
def listed_companies(fx):
    return company.listed_companies(fx.companies(), fx.registry_listings())


@query
def verify_company(fx):
    return _verified(fx).withColumn("domain_age_days", _number("domain_age_days"))


@query
def verification_defaults(fx):
    shown = company.verification_defaults(_verified(fx))
    return shown.withColumn("domain_age_days", _number("domain_age_days"))


@query
def company_deep_dive(fx):
    found = company.company_deep_dive(fx.headers(), _scam(fx), fx.reviews())
    return found.withColumns(
        {"first_posting": _day("first_posting"), "last_posting": _day("last_posting")}
    )


# --- employee reviews


def _sentiment(fx):
    return reviews.sentiment_label(reviews.review_scores(fx.companies(), fx.reviews()))


@query
def review_scores(fx):
    return reviews.review_scores(fx.companies(), fx.reviews())


@query
def sentiment_label(fx):
    return _sentiment(fx)


@query
def review_lexicon_sentiment(fx):
    return reviews.review_lexicon_sentiment(fx.review_texts(), fx.lexicon())


@query
def review_summary(fx):
    return reviews.review_summary(fx.companies(), fx.reviews(), fx.review_texts())


@query
def pros_cons(fx):
    return reviews.pros_cons(fx.companies(), fx.reviews(), fx.review_texts(), fx.lexicon(), k=3)


# --- resume matching


def _skills(fx):
    """Resumes and postings are the same texts here, so they are read once."""
    found = stored(
        resume.extract_skills(fx.texts(), fx.skills()), rebalance=True
    )
    return (
        found.withColumnRenamed("doc_id", "resume_id"),
        found.withColumnRenamed("doc_id", "posting_id"),
    )


@query
def extract_skills(fx):
    return resume.extract_skills(fx.texts(), fx.skills())


@query
def match_percentage(fx):
    return resume.match_percentage(fx.submissions(), *_skills(fx)).drop("missing_skills")


@query
def missing_skills(fx):
    return resume.missing_skills(fx.submissions(), *_skills(fx))


@query
def keyword_suggestions(fx):
    return resume.keyword_suggestions(resume.missing_skills(fx.submissions(), *_skills(fx)), k=5)


@query
def best_jobs(fx):
    return resume.best_jobs(resume.match_percentage(fx.submissions(), *_skills(fx)), k=2)


@query
def text_similarity(fx):
    return resume.text_similarity(fx.submissions(), fx.texts(), k=2)


@query
def vector_match(fx):
    return resume.vector_match(fx.submissions(), fx.resume_vectors(), fx.posting_vectors(), k=5)


# --- profiles, usage, plans


@query
def profile_skills(fx):
    return usage.profile_skills(fx.profile_ops())


@query
def profile_completion(fx):
    return usage.profile_completion(fx.profiles(), PROFILE_FIELDS)


@query
def user_usage(fx):
    return usage.user_usage(fx.user_events())


@query
def user_rank(fx):
    return usage.user_rank(usage.user_usage(fx.user_events()))


@query
def profile_card(fx):
    used = usage.user_usage(fx.user_events())
    completion = usage.profile_completion(fx.profiles(), PROFILE_FIELDS)
    skills = usage.profile_skills(fx.profile_ops())
    card = usage.profile_card(completion, used, usage.user_rank(used), skills)
    return card.withColumn("rank", _number("rank"))


@query
def scan_quota(fx):
    return usage.scan_quota(fx.user_events(), fx.subscriptions(), fx.plans())


@query
def limited_history(fx):
    found = usage.limited_history(fx.user_events(), fx.subscriptions(), n=10)
    return found.select("user_id", "event_id", "event_type", _number("rank"))


@query
def plan_at(fx):
    return history.plan_at(fx.user_events(), fx.plan_changes(), fx.plans())


@query
def scan_quota_history(fx):
    return history.scan_quota_history(fx.user_events(), fx.plan_changes(), fx.plans())


@query
def limited_history_now(fx):
    current = history.current_plans(fx.plan_changes(), fx.plans())
    found = usage.limited_history(fx.user_events(), current, n=10)
    return found.select("user_id", "event_id", "event_type", _number("rank"))


@query
def plan_prices(fx):
    return plans.subscribed_prices(fx.subscriptions(), fx.plans())


@query
def plan_features(fx):
    return plans.subscribed_features(fx.subscriptions(), fx.plans())


@query
def subscription_charges(fx):
    return plans.subscription_charges(fx.subscriptions(), fx.plans())


@query
def charge_totals(fx):
    return plans.charge_totals(plans.subscription_charges(fx.subscriptions(), fx.plans()))


@query
def team_dashboard(fx):
    return plans.team_dashboard(_scam(fx), fx.teams())


@query
def purge_records(fx):
    kept = usage.purge_records(fx.user_events(), fx.deleted_users(), CUTOFF)
    return kept.select("event_id", "user_id", "event_type")


@query
def purge_stored(fx):
    """The stored events after a purge of their files, which are laid out by time."""
    path = new_shared_path(fx.spark, "events")
    events = fx.user_events()
    events.repartitionByRange("ts").write.parquet(path)
    purge.purge_stored(fx.spark, path, fx.deleted_users(), CUTOFF)
    return fx.spark.read.parquet(path).select("event_id", "user_id", "event_type")


@query
def redact_text(fx):
    return usage.redact_text(fx.texts())


# --- chat


@query
def chat_clean(fx):
    return chat.chat_clean(fx.chat())


@query
def chat_turn_pairs(fx):
    return chat.chat_turn_pairs(fx.chat())


@query
def chat_summary(fx):
    return chat.chat_summary(fx.chat())


# --- report


def full_report(fx: Fixtures) -> DataFrame:
    """The nested report."""
    resume_skills, job_skills = _skills(fx)
    inputs = report.Inputs(
        postings=fx.postings(),
        headers=fx.headers(),
        companies=fx.companies(),
        first_seen=fx.first_seen(),
        registry_listings=fx.registry_listings(),
        reviews=fx.reviews(),
        review_texts=fx.review_texts(),
        lexicon=fx.lexicon(),
        submissions=fx.submissions(),
        resume_skills=resume_skills,
        job_skills=job_skills,
        offers=fx.offers(),
    )
    return report.bulk_analysis(inputs, AS_OF, RULES)


@query
def analysis_report(fx):
    flat = report.flat_report(full_report(fx))
    return flat.withColumns({c: _number(c) for c in ("resume_id", "domain_age_days")})


@query
def analyze_path(fx):
    """The report after a refresh: first all texts without files, then the uploads."""
    path = new_shared_path(fx.spark, "analysis")
    first = fx.postings().withColumn("file_name", F.lit(None).cast("string"))
    for uploads in (first, fx.uploads()):
        analyze.refresh(analyze.handed_in(uploads, fx.pages()), path, RULES)
    found = analyze.read_analysis(fx.spark, path, fx.offers(), RULES)
    return found.withColumn("flags", _text("flags"))


# --- streams and their batch twins


def _alerts(fx, documents):
    limits = scam.salary_limits(fx.offers(), RULES.salary_quantile)
    found = scam_alerts(fx.timed_postings(documents), limits, RULES)
    return found.withColumn("flags", _text("flags"))


def _windows(found):
    return found.withColumns(
        {"window_start": _second("window_start"), "window_end": _second("window_end")}
    )


def _sessions(found):
    return found.withColumns(
        {"session_start": _second("session_start"), "session_end": _second("session_end")}
    )


@query
def scam_alerts_batch(fx):
    return _alerts(fx, fx.documents).withColumn("posted_at", _day("posted_at"))


@query
def scam_alerts_stream(fx):
    found = drain(_alerts(fx, fx.stream("documents")), "alerts")
    return found.withColumn("posted_at", _day("posted_at"))


def _told(found):
    return found.select("user_id", "posting_id", _day("posted_at"), "score", "band", _text("flags"))


@query
def plan_alerts_batch(fx):
    limits = scam.salary_limits(fx.offers(), RULES.salary_quantile)
    return _told(plan_alerts(
        fx.company_postings(fx.documents), limits, fx.watches(), fx.subscriptions(), RULES, entitled=ALERTED
    ))


@query
def plan_alerts_stream(fx):
    postings = fx.company_postings(fx.stream("documents"))
    path, checkpoint = (new_shared_path(fx.spark, f"plan-alerts-{part}") for part in ("out", "state"))
    start_plan_alerts(
        postings, lambda _: scam.salary_limits(fx.offers(), RULES.salary_quantile), lambda _: fx.watches(),
        lambda _: fx.subscriptions(), path, checkpoint, RULES, entitled=ALERTED, once=True,
    ).awaitTermination()
    return _told(read_plan_alerts(fx.spark, path))


@query
def text_reputation_batch(fx):
    return _windows(text_reputation(fx.reviews(), fx.timed_review_texts(fx.documents), fx.lexicon()))


@query
def text_reputation_stream(fx):
    texts = fx.timed_review_texts(fx.stream("documents"))
    found = text_reputation(fx.reviews(fx.stream("orders")), texts, fx.lexicon())
    return _windows(drain(found, "text-reputation"))


@query
def reputation_tumbling(fx):
    return _windows(reputation(fx.reviews(), "30 days"))


@query
def reputation_sliding(fx):
    return _windows(reputation(fx.reviews(), "60 days", "30 days"))


@query
def reputation_stream(fx):
    return _windows(drain(reputation(fx.reviews(fx.stream("orders")), "30 days"), "reputation"))


@query
def usage_sessions(fx):
    return _sessions(usage.usage_sessions(fx.user_events(), gap_seconds=14_400))


@query
def usage_sessions_stream(fx):
    events = fx.stream("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _sessions(drain(session_stream(events, "4 hours"), "sessions"))
