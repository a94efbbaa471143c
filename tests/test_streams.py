"""Streams over several micro-batches: late rows, repeats, restarts, batch twins."""

import datetime as dt
import os

from conftest import rows
from pyspark.sql import functions as F

from postvet.operators import usage
from postvet.operators.scam import Rules
from postvet.sources.bindings import Fixtures
from postvet.streaming.alerts import scam_alerts
from postvet.streaming.plan_alerts import plan_alerts, read_plan_alerts, start_plan_alerts
from postvet.streaming.reputation import reputation, session_stream, text_reputation
from postvet.streaming.sinks import start

DAY = dt.datetime(2024, 1, 1)


def add_file(spark, folder, data, schema, n):
    """One more input file, newer than those before it."""
    path = folder / f"in-{n}"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(path))
    for name in os.listdir(path):
        os.utime(path / name, (1_700_000_000 + n, 1_700_000_000 + n))


def read(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(folder))
    )


def run(stream, tmp_path):
    start(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


REVIEWS = "review_id long, company_id long, rating int, reviewed_at timestamp"


def review(i, company, rating, days):
    return (i, company, rating, DAY + dt.timedelta(days=days))


def test_reputation_drops_late_rows_and_holds_open_windows(spark, tmp_path):
    source = tmp_path / "in"
    batches = [
        [review(1, 1, 5, 0), review(2, 1, 2, 5), review(3, 2, 4, 1), review(4, 2, 1, 40)],
        [review(6, 1, 1, 41)],
        [review(5, 1, 1, 6)],  # late: its window has come out
        [review(7, 1, 3, 100)],
    ]
    for n, batch in enumerate(batches):
        add_file(spark, source, batch, REVIEWS, n)
    got = run(reputation(read(spark, source, REVIEWS), "10 days", delay="1 day"), tmp_path)
    on_time = spark.createDataFrame([r for b in batches for r in b if r[0] != 5], REVIEWS)
    want = reputation(on_time, "10 days").filter(
        F.col("window_end") <= F.lit(DAY + dt.timedelta(days=99))
    )
    assert sorted(rows(got)) == sorted(rows(want))
    assert {r["reviews"] for r in got.collect()} == {1, 2}


def test_reputation_slides(spark):
    data = spark.createDataFrame([review(1, 1, 5, 0), review(2, 1, 2, 5)], REVIEWS)
    counts = sorted(r["reviews"] for r in reputation(data, "10 days", "5 days").collect())
    assert counts == [1, 1, 2]


POSTINGS = "posting_id long, text string, pay double, peer string, posted_at timestamp"
BAD = "URGENT urgent! Pay a deposit. boss@gmail.com"


def posting(i, text, days=0, pay=1.0):
    return (i, text, pay, "p", DAY + dt.timedelta(days=days))


def test_alerts_once_per_posting_and_after_restart(spark, tmp_path):
    limits = spark.createDataFrame([("p", 10.0)], "peer string, pay_limit double")
    source = tmp_path / "in"
    add_file(spark, source, [posting(1, BAD), posting(1, BAD), posting(2, "fine job")] * 20, POSTINGS, 0)
    add_file(spark, source, [posting(1, BAD, 1), posting(3, BAD, 1, 99.0)], POSTINGS, 1)
    stream = scam_alerts(read(spark, source, POSTINGS), limits, Rules())
    got = run(stream, tmp_path)
    assert sorted(r["posting_id"] for r in got.collect()) == [1, 3]
    assert {r["posting_id"]: r["flags"][0] for r in got.collect()} == {
        1: "Generic Email Domain (@gmail.com)", 3: "Unusually High Salary Range",
    }
    # Nothing new: a restart from the checkpoint adds nothing.
    assert run(stream, tmp_path).count() == 2
    add_file(spark, source, [posting(3, BAD, 2), posting(4, BAD, 2)], POSTINGS, 2)
    assert sorted(r["posting_id"] for r in run(stream, tmp_path).collect()) == [1, 3, 4]
    batch = scam_alerts(spark.read.parquet(*[str(source / f"in-{n}") for n in range(3)]), limits)
    assert sorted(r["posting_id"] for r in batch.collect()) == [1, 3, 4]


def test_a_peer_without_limit_is_scored(spark):
    limits = spark.createDataFrame([], "peer string, pay_limit double")
    batch = scam_alerts(spark.createDataFrame([posting(1, BAD, 0, 1e9)], POSTINGS), limits)
    assert batch.first()["score"] == 100


def test_sessions_match_the_batch_twin(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    source = tmp_path / "in"
    minutes = [0, 10, 35, 90, 100, 400, 401, 2_000]
    data = [(i, i % 2, DAY + dt.timedelta(minutes=m)) for i, m in enumerate(minutes * 2)]
    for n in range(2):
        part = sorted(data, key=lambda e: e[2])
        half = len(part) // 2
        add_file(spark, source, part[n * half : (n + 1) * half], schema, n)
    got = run(session_stream(read(spark, source, schema), "30 minutes", "1 hour"), tmp_path)
    end = DAY + dt.timedelta(minutes=2_000 - 60)
    want = usage.usage_sessions(spark.createDataFrame(data, schema), 1_800).filter(
        F.col("session_end") <= F.lit(end)
    )
    assert sorted(rows(got)) == sorted(rows(want)) and got.count() > 3


def test_alerts_follow_changed_limits_and_plans(spark, tmp_path):
    """Limits, watches and plans are read anew: what changes between two batches counts in the second."""
    schema = POSTINGS + ", company_id long"
    mild = "asap asap, a deposit"  # with a high pay only: urgency 25 + salary 35 < 70
    state = {"limit": 10.0, "plan": "Free"}
    limits = lambda s: s.createDataFrame([("p", state["limit"])], "peer string, pay_limit double")
    watches = lambda s: s.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8)], "user_id long, company_id long")
    plans = lambda s: s.createDataFrame([(1, "Pro"), (2, state["plan"]), (3, "Pro")], "user_id long, plan string")
    rules = Rules(weights={"salary": 70, "email": 1, "urgency": 1, "vague": 1, "payment": 1})
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        start_plan_alerts(read(spark, source, schema), limits, watches, plans, out, check, rules, once=True).awaitTermination()
        return sorted((r.user_id, r.posting_id, r.batch) for r in read_plan_alerts(spark, out).collect())

    add_file(spark, source, [(*posting(1, mild, 0, 11.0), 7), (*posting(2, mild, 0, 9.0), 7), (*posting(3, mild, 0, 99.0), None)], schema, 0)
    assert go() == [(1, 1, 0)]
    state.update(limit=8.0, plan="Pro")
    add_file(spark, source, [(*posting(1, mild, 1, 11.0), 7), (*posting(4, mild, 1, 9.0), 7), (*posting(5, mild, 1, 9.0), 8)], schema, 1)
    # User 2 is told of posting 1 as it comes again; user 1 knows it.
    assert go() == [(1, 1, 0), (1, 4, 1), (2, 1, 1), (2, 4, 1), (3, 5, 1)]
    assert go() == [(1, 1, 0), (1, 4, 1), (2, 1, 1), (2, 4, 1), (3, 5, 1)]
    batch = plan_alerts(spark.read.parquet(str(source / "in-0"), str(source / "in-1")), limits(spark), watches(spark), plans(spark), rules)
    assert sorted((r.user_id, r.posting_id) for r in batch.collect()) == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 4), (3, 5)]


def test_review_texts_meet_their_reviews_in_time(spark, tmp_path):
    texts = "review_id long, text string, written_at timestamp"
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "token string, weight double")
    at = lambda d: DAY + dt.timedelta(days=d)
    reviews = [[review(1, 1, 5, 0), review(2, 1, 2, 5), review(3, 2, 4, 6), review(4, 2, 1, 8)],
               [review(8, 9, 1, 100)], [review(9, 9, 1, 200)], [review(10, 9, 1, 300)]]
    # Text 2 comes late, text 4 is written too long after its review, 3 holds no word of the lexicon.
    written = [[(1, "Good good, bad", at(1)), (3, "so so", at(6)), (4, "bad", at(12))],
               [(8, "bad", at(100)), (7, "good", at(99))], [(2, "bad bad", at(6)), (9, "x", at(200))], [(10, "x", at(300))]]
    for n, (some, more) in enumerate(zip(reviews, written)):
        add_file(spark, tmp_path / "reviews", some, REVIEWS, n)
        add_file(spark, tmp_path / "texts", more, texts, n)

    def both(r, t):
        return text_reputation(r, t, lexicon, "10 days", "2 days")

    got = run(both(read(spark, tmp_path / "reviews", REVIEWS), read(spark, tmp_path / "texts", texts)), tmp_path)
    batch = both(spark.createDataFrame([r for b in reviews for r in b], REVIEWS),
                 spark.createDataFrame([t for b in written for t in b], texts))
    found = sorted((r.company_id, r.texts, r.lexicon_words, r.text_score, r.sentiment) for r in got.collect())
    every = sorted((r.company_id, r.texts, r.lexicon_words, r.text_score, r.sentiment) for r in batch.collect())
    assert found == [(1, 1, 3, 0.3333, "Positive"), (9, 1, 1, -1.0, "Negative")]
    # Reviews of one company 5 days apart can share a window of 10 days.
    assert sum(e[1] for e in every) == 3 and (9, 1, 1, -1.0, "Negative") in every


def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path):
    """A folder of part files, a single file, and files that come later, all under the table's name."""
    parts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    parts.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    parts.limit(1).write.parquet(str(tmp_path / "labels.parquet"))
    stream = Fixtures(spark, str(tmp_path)).stream("documents")
    assert sorted(rows(run(stream, tmp_path / "first"))) == sorted(rows(parts))
    add_file(spark, tmp_path / "later", [(99, "late")], "doc_id long, text string", 1)
    part = next(n for n in os.listdir(tmp_path / "later" / "in-1") if n.startswith("part-"))
    os.link(tmp_path / "later" / "in-1" / part, tmp_path / "documents.parquet.2")
    assert run(Fixtures(spark, str(tmp_path)).stream("documents"), tmp_path / "second").count() == 21


def test_alerts_without_a_batch_are_an_empty_table(spark, tmp_path):
    found = read_plan_alerts(spark, str(tmp_path / "nothing"))
    assert found.count() == 0 and "batch" in found.columns
