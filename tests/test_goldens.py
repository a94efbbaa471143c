
import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from postvet.operators import chat, company, plans, reviews, scam, usage
from postvet.sources import ingest, store


@pytest.mark.parametrize("score, band", [
    (0, "safe"), (29, "safe"), (30, "suspicious"), (69, "suspicious"), (70, "high"),
    (100, "high"), (None, "high"),
])
def test_risk_band(spark, score, band):
    df = spark.createDataFrame([(score,)], "score int")
    assert scam.risk_band(df).first()["band"] == band


def test_sample_report(spark):
    flags = spark.createDataFrame(
        [(1, True, True, True, False, False)],
        "posting_id int, salary boolean, email boolean, urgency boolean, vague boolean, payment boolean",
    )
    row = scam.verdict_label(scam.risk_band(scam.risk_score(flags))).first()
    assert (row["score"], row["band"], row["verdict"]) == (85, "high", "High Risk / Likely Scam")


def test_score_is_capped(spark):
    flags = spark.createDataFrame([(True,) * 5], ", ".join(f"{n} boolean" for n in scam.WEIGHTS))
    assert scam.risk_score(flags).first()["score"] == 100


def test_default_rules_on_a_scam_posting(spark):
    text = (
        "URGENT hiring!!! Earn now, earn now, earn now. Pay a deposit first. "
        "Write to boss@gmail.com or hr@corp.example."
    )
    postings = spark.createDataFrame([(1, text), (2, "We seek a nurse."), (3, None)],
                                     "posting_id long, text string")
    offers = spark.createDataFrame(
        [(1, 900.0, "a")] + [(i, 100.0 + i, "a") for i in range(2, 40)],
        "posting_id long, pay double, peer string",
    )
    got = {r["posting_id"]: r for r in scam.scam_analysis(postings, offers).collect()}
    assert got[1]["flags"] == [
        "Unusually High Salary Range", "Generic Email Domain (@gmail.com)",
        "Urgency and Grammatical Errors", "Upfront Payment Request",
    ]
    assert got[1]["score"] == 100 and got[1]["band"] == "high"
    assert got[2]["flags"] == [] and got[2]["band"] == "safe"
    assert got[3]["flags"] == [] and got[3]["score"] == 0


def test_flag_rows_keep_order_and_repeats(spark):
    report = spark.createDataFrame(
        [(1, ["b", "a", "b"]), (2, []), (3, None)], "posting_id int, flags array<string>"
    )
    assert rows(scam.flag_rows(report)) == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]


def test_submission_gate(spark):
    df = spark.createDataFrame(
        [(1, "", None), (2, " ", None), (3, None, None), (4, None, "cv.pdf"), (5, "x", "a.doc")],
        "posting_id int, text string, file_name string",
    )
    assert [r[0] for r in rows(ingest.submission_gate(df).select("posting_id"))] == [2, 4, 5]


@pytest.mark.parametrize("size, want", [(0, 0.0), (131072, 0.13), (1048576, 1.0), (5242, 0.0)])
def test_size_mb(spark, size, want):
    df = spark.createDataFrame([(size,)], "n long")
    assert df.select(ingest.size_mb(F.col("n"))).first()[0] == want


def test_resume_manifest(spark, tmp_path):
    for name, size in {"a.pdf": 131072, "My CV+%20.DOCX": 5, "notes.txt": 3, "sub/b.doc": 10}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
    got = ingest.resume_manifest(spark, str(tmp_path))
    assert sorted(rows(got)) == [
        ("My CV+%20.DOCX", 5, 0.0, True), ("a.pdf", 131072, 0.13, True),
        ("b.doc", 10, 0.0, True), ("notes.txt", 3, 0.0, False),
    ]
    assert "content" not in got._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_collect_postings(spark):
    pasted = spark.createDataFrame([(1, "text")], "posting_id long, text string")
    pages = spark.createDataFrame([(1, "u", "<p>page</p>")], "page_id long, url string, html string")
    assert sorted(rows(ingest.collect_postings(pasted, pages))) == [
        ("pasted", 1, "text"), ("url", 1, "page"),
    ]


def test_posting_hosts(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.example/jobs/1?x=1#y"), (2, "not a url"), (3, "http://b.example")],
        "page_id long, url string",
    )
    assert sorted(rows(ingest.posting_hosts(pages)))[0] == (1, "https", "a.example", "/jobs/1")
    assert sorted(rows(ingest.posting_hosts(pages)))[2][1:3] == ("http", "b.example")


def test_verification_defaults(spark):
    df = spark.createDataFrame(
        [(1, None, None, ""), (2, True, "5 Days", "ok"), (3, False, "", None)],
        "company_id int, is_verified boolean, domain_age string, online_presence string",
    )
    assert sorted(rows(company.verification_defaults(df))) == [
        (1, False, "Unknown", "N/A", "Unverified Entity"),
        (2, True, "5 Days", "ok", "Verified Business Entity"),
        (3, False, "Unknown", "N/A", "Unverified Entity"),
    ]


def test_company_checks(spark):
    companies = spark.createDataFrame([(i,) for i in range(1, 6)], "company_id int")
    seen = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1)), (1, dt.date(2020, 1, 1)), (2, dt.date(2025, 1, 1)),
         (3, dt.date(2023, 12, 27)), (5, dt.date(2020, 1, 1))],
        "company_id int, first_seen date",
    )
    listings = spark.createDataFrame(
        [(1, "x"), (1, "x"), (1, "y"), (3, "x"), (5, "x")], "company_id int, registry string"
    )
    rated = spark.createDataFrame([(1, 1, 4), (2, 3, 4)], "review_id int, company_id int, rating int")
    age = company.domain_age(companies, seen, dt.date(2024, 1, 1))
    assert sorted(rows(age)) == [
        (1, 1461, "1461 Days"), (2, None, None), (3, 5, "5 Days"), (4, None, None),
        (5, 1461, "1461 Days"),
    ]
    presence = company.online_presence(companies, listings)
    assert sorted(rows(presence))[0] == (1, 2, "Listed in 2 Registries")
    assert sorted(rows(presence))[1] == (2, 0, "Not Found in Major Registries")
    verified = company.verify_company(companies, age, presence, rated)
    assert {r[0]: r[1] for r in rows(verified)} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert sorted(rows(company.unlisted_companies(companies, listings))) == [(2,), (4,)]
    assert sorted(rows(company.listed_companies(companies, listings))) == [(1,), (3,), (5,)]


def test_reviews(spark):
    companies = spark.createDataFrame([(1,), (2,), (3,)], "company_id int")
    rated = spark.createDataFrame(
        [(10, 1, 5), (11, 1, 2), (12, 1, 3), (13, 1, 3), (20, 2, 0)],
        "review_id int, company_id int, rating int",
    )
    texts = spark.createDataFrame(
        [(10, "good good bad"), (12, ""), (13, "bad fine"), (20, "dull")],
        "review_id int, text string",
    )
    scored = reviews.sentiment_label(reviews.review_scores(companies, rated))
    # A mean of 0 is data; only a company without reviews has none.
    assert sorted(rows(scored)) == [
        (1, 4, 3.3, "Mixed"), (2, 1, 0.0, "Negative"), (3, 0, 0.0, "No Data"),
    ]
    summary = dict(rows(reviews.review_summary(companies, rated, texts)))
    assert summary == {1: "bad fine", 2: "dull", 3: "No employee reviews found for this entity."}
    lexicon = spark.createDataFrame(
        [("good", 1.0), ("fine", 0.5), ("bad", -1.0)], "token string, weight double"
    )
    found = reviews.pros_cons(companies, rated, texts, lexicon, k=1)
    assert sorted(rows(found)) == [(1, "good", "bad"), (2, None, None), (3, None, None)]
    mood = dict((r[0], r[2]) for r in rows(reviews.review_lexicon_sentiment(texts, lexicon)))
    assert mood == {10: 0.3333, 12: 0.0, 13: -0.25, 20: 0.0}


def test_plans(spark):
    table = plans.plan_table(spark)
    prices = {(r["plan"], r["billing"]): (r["price"], r["saving_percent"], r["popular"])
              for r in plans.plan_prices(table).collect()}
    assert prices == {
        ("Free", "monthly"): (0, 0.0, False), ("Free", "yearly"): (0, None, False),
        ("Pro", "monthly"): (12, 0.0, True), ("Pro", "yearly"): (9, 25.0, True),
        ("Enterprise", "monthly"): (59, 0.0, False), ("Enterprise", "yearly"): (49, 16.9, False),
    }
    features = plans.plan_features(table).filter("plan = 'Free'")
    assert rows(features)[0] == ("Free", 0, "3 Resume Scans per month")
    assert plans.plan_features(table).count() == 14
    users = spark.createDataFrame(
        [(1, "Pro", "yearly"), (2, "Pro", "yearly"), (3, "Free", "monthly")],
        "user_id int, plan string, billing string",
    )
    charges = plans.subscription_charges(users, table)
    assert sorted(rows(charges)) == [
        (1, "Pro", "yearly", 9), (2, "Pro", "yearly", 9), (3, "Free", "monthly", 0),
    ]
    assert sorted(rows(plans.charge_totals(charges))) == [
        ("Free", "monthly", 1, 0), ("Pro", "yearly", 2, 18),
    ]


def test_chat(spark):
    log = spark.createDataFrame(
        [(1, 0, "bot", "Hi! How can I help you check a job today?"), (1, 1, "user", "  \n\t"),
         (1, 2, "user", "  hello "), (1, 3, "bot", "reply"), (1, 4, "user", "more"),
         (2, 0, "user", "﻿"), (2, 7, "bot", "x")],
        "conv_id int, turn int, role string, text string",
    )
    clean = chat.chat_clean(log)
    assert sorted((r[0], r[1]) for r in rows(clean)) == [(1, 0), (1, 2), (1, 3), (1, 4), (2, 7)]
    assert "  hello " in [r["text"] for r in clean.collect()]
    assert sorted(rows(chat.chat_turn_pairs(clean))) == [
        (1, 2, "  hello ", "reply"), (1, 4, "more", None),
    ]
    # The message after the first user message is not a reply.
    assert sorted(rows(chat.chat_turn_pairs(log)))[0] == (1, 1, "  \n\t", None)
    assert sorted(rows(chat.chat_summary(clean))) == [(1, 2, 2, 0, 0, 0.5), (2, 0, 1, 0, 0, None)]


def test_profile_completion(spark):
    df = spark.createDataFrame([(1, "a", "", None), (2, "a", "b", "c")],
                               "user_id int, a string, b string, c string")
    assert sorted(rows(usage.profile_completion(df, ["a", "b", "c"]))) == [(1, 33.33), (2, 100.0)]


def test_purge(spark):
    log = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 3))],
        "user_id int, ts date",
    )
    gone = spark.createDataFrame([(3,), (3,)], "user_id int")
    assert [r[0] for r in rows(usage.purge_records(log, gone, dt.date(2024, 1, 2)))] == [2]


def test_stored_report_is_pruned_by_band(spark, tmp_path):
    report = spark.createDataFrame(
        [(1, 10, "safe"), (2, 80, "high"), (3, 90, "high")], "posting_id int, score int, band string"
    )
    store.write_report(report, str(tmp_path / "r"))
    high = store.read_report(spark, str(tmp_path / "r")).filter("band = 'high'")
    assert sorted(r["posting_id"] for r in high.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(band" in high._jdf.queryExecution().executedPlan().toString()


def test_reposts(spark):
    df = spark.createDataFrame(
        [(1, "Pay now!", "a"), (2, "pay NOW", "b"), (3, "pay now", "a"), (4, "else", "a")],
        "posting_id int, text string, source string",
    )
    assert [r[1:] for r in rows(scam.exact_reposts(df))] == [(1, 3, 2)]


def test_team_dashboard(spark):
    report = spark.createDataFrame([(1, 80, "high"), (2, 10, "safe"), (3, None, "high")],
                                   "posting_id int, score int, band string")
    teams = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "posting_id int, team string")
    got = {(r["team"], r["band"]): (r["level"], r["postings"], r["mean_score"])
           for r in plans.team_dashboard(report, teams).collect()}
    assert got == {
        ("a", "high"): (0, 1, 80.0), ("a", "safe"): (0, 1, 10.0), ("b", "high"): (0, 1, None),
        ("a", None): (1, 2, 45.0), ("b", None): (1, 1, None), (None, None): (3, 3, 45.0),
    }


def test_pay_may_come_with_the_posting_or_apart(spark):
    text = "urgent urgent: pay a deposit to boss@gmail.com"
    postings = spark.createDataFrame(
        [(i, text if i % 3 else "fine", 100.0 + i * i, f"p{i % 2}") for i in range(40)]
        + [(40, text, None, None), (41, text, 1e9, None)],
        "posting_id long, text string, pay double, peer string",
    )
    offers = postings.select("posting_id", "pay", "peer")
    together = scam.scam_analysis(postings)
    apart = scam.scam_analysis(postings.drop("pay", "peer"), offers)
    assert sorted(rows(together)) == sorted(rows(apart))
    assert together.filter("salary").count() > 0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_texts_that_are_null_or_empty(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "posting_id long, text string")
        assert [r[1:] for r in rows(scam.urgency_flags(df))] == [(0, 0, 0, False)] * 3
        assert [r["vague"] for r in scam.vague_language(df).collect()] == [False] * 3
        assert [r["words"] for r in scam.vague_language(df).collect()] == [None, 0, 0]
        assert scam.generic_email_flags(df).count() == 0
        assert scam.upfront_payment_flags(df).count() == 0
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_report_row_without_any_panel(spark):
    from postvet.plans.report import analysis_report

    headers = spark.createDataFrame([(1, 7)], "posting_id long, company_id long")
    scored = spark.createDataFrame(
        [], "posting_id long, band string, verdict string, score int, flags array<string>"
    )
    panels = spark.createDataFrame(
        [],
        "company_id long, company_verification struct<is_verified:boolean,domain_age:string,"
        "domain_age_days:int,online_presence:string>, reviews struct<sentiment:string,score:double,"
        "summary:string,pros:string,cons:string>",
    )
    matches = spark.createDataFrame(
        [], "posting_id long, resume_id long, match_percentage double, missing_skills array<string>"
    )
    row = analysis_report(headers, scored, panels, matches).first()
    assert row["band"] == "high" and row["scam_analysis"] is None and row["resume_match"] is None
    assert row["company_verification"].asDict() == {
        "is_verified": False, "domain_age": "Unknown", "domain_age_days": None,
        "online_presence": "N/A",
    }
    assert row["reviews"].asDict() == {
        "sentiment": "No Data", "score": 0.0,
        "summary": "No employee reviews found for this entity.", "pros": None, "cons": None,
    }
