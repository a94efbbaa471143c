"""Jobs on ordered or large groups, against brute force on random small data."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postvet.functions import quantile
from postvet.functions.ordered import positions, with_next
from postvet.operators import plans, resume, scam, usage


def hot_groups(n, seed):
    """One group holds most of the rows."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.6 else rng.randrange(1, 9), i) for i in range(n)]


@pytest.mark.parametrize("runs", [1, 7, 64])
def test_positions_and_next(spark, runs):
    data = hot_groups(600, 5)
    df = spark.createDataFrame(data, "g int, seq long")
    want_pos, want_next = set(), set()
    for g in {g for g, _ in data}:
        seqs = sorted(s for k, s in data if k == g)
        for i, s in enumerate(seqs):
            want_pos.add((g, s, i))
            want_next.add((g, s, seqs[i + 1] if i + 1 < len(seqs) else None))
    assert set(rows(positions(df, ["g"], "seq", runs=runs))) == want_pos
    assert set(rows(with_next(df, ["g"], "seq", ["seq"], runs=runs))) == want_next


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("small", [1, 10_000_000])
@pytest.mark.parametrize("bins", [3, 4096])
def test_group_quantile(spark, monkeypatch, q, small, bins):
    monkeypatch.setattr(quantile, "SMALL_GROUP", small)
    monkeypatch.setattr(quantile, "BINS", bins)
    rng = random.Random(3)
    data = [("hot", rng.choice([1.0, 1.0, 2.5, rng.expovariate(0.001)])) for _ in range(3_000)]
    data += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("same", 4.0), ("same", 4.0), ("null", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = dict(rows(quantile.group_quantile(df, "k", "v", q, "x")))
    for key in {k for k, v in data if v is not None}:
        want = np.quantile([v for k, v in data if k == key], q)
        assert got[key] == pytest.approx(want, abs=1e-9), key
    assert "null" not in got


def replay(ops):
    """The list after each add (trimmed, once only) and remove (exact)."""
    held = []
    for op, skill in ops:
        if op == "add":
            skill = skill.strip()
            if skill and skill not in held:
                held.append(skill)
        else:
            held = [s for s in held if s != skill]
    return held


SKILLS = st.sampled_from(["React", "react", " React", "\tx ", "x", "", "  ", "Node.js"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["add", "remove"]), SKILLS), max_size=40))
def test_profile_skills(spark, ops):
    df = spark.createDataFrame(
        [(u, i, op, s) for i, (u, op, s) in enumerate(ops)],
        "user_id int, seq long, op string, skill string",
    )
    got = {(r["user_id"], r["pos"]): r["skill"] for r in usage.profile_skills(df).collect()}
    want = {
        (u, i): s
        for u in (1, 2, 3)
        for i, s in enumerate(replay([(op, s) for v, op, s in ops if v == u]))
    }
    assert got == want


def test_default_skills_replay(spark):
    start = ["React", "Node.js", "Python", "Job Analysis", "System Design"]
    ops = [("add", s) for s in start] + [("remove", "React"), ("add", "Python"), ("add", "React ")]
    df = spark.createDataFrame([(1, i, o, s) for i, (o, s) in enumerate(ops)],
                               "user_id int, seq long, op string, skill string")
    got = [s for _, s in sorted((r[1], r[2]) for r in rows(usage.profile_skills(df)))]
    assert got == ["Node.js", "Python", "Job Analysis", "System Design", "React"]


def random_events(n, seed=1, users=4):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 30)
    out = []
    for i in range(n):
        user = 0 if rng.random() < 0.5 else rng.randrange(users)
        ts = start + dt.timedelta(seconds=rng.randrange(0, 4 * 86_400, 300))
        out.append((i, ts, user, rng.choice(["scan", "verified", "x"])))
    return out


def events_df(spark, data):
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id int, event_type string")


def test_scan_quota(spark):
    data = random_events(400)
    users = spark.createDataFrame([(0, "Free"), (1, "Pro"), (2, "Free"), (9, "Free")],
                                  "user_id int, plan string")
    got = {r["event_id"]: r["allowed"]
           for r in usage.scan_quota(events_df(spark, data), users, plans.plan_table(spark)).collect()}
    want, seen = {}, {}
    for event, ts, user, kind in sorted(data, key=lambda e: (e[1], e[0])):
        if kind == "scan":
            key = (user, ts.strftime("%Y-%m"))
            seen[key] = seen.get(key, 0) + 1
            # User 3 has no subscription.
            want[event] = user == 1 or (user in (0, 2) and seen[key] <= 3)
    assert got == want


def test_usage_and_rank(spark):
    data = random_events(200)
    got = {r[0]: r[1:] for r in rows(usage.user_usage(events_df(spark, data)))}
    for user in {e[2] for e in data}:
        kinds = [e[3] for e in data if e[2] == user]
        assert got[user] == (kinds.count("scan"), kinds.count("verified"))
    table = spark.createDataFrame([(1, 5), (2, 7), (3, 5), (4, 0)], "user_id int, scans int")
    ranks = {r["user_id"]: r["rank"] for r in usage.user_rank(table).collect()}
    assert ranks == {2: 1, 1: 2, 3: 2, 4: 4}


def test_limited_history(spark):
    data = random_events(300)
    users = sorted({e[2] for e in data})
    plans = [(u, "Free" if i % 2 else "Pro") for i, u in enumerate(users)] + [(users[1], "Free")]
    table = spark.createDataFrame(plans, "user_id long, plan string")
    found = usage.limited_history(events_df(spark, data), table, 5).collect()
    got = {(r["user_id"], r["rank"]): r["event_id"] for r in found}
    for user, plan in plans:
        own = sorted(((e[1], e[0]) for e in data if e[2] == user), reverse=True)
        if plan == "Free":
            assert [got[user, i + 1] for i in range(min(5, len(own)))] == [e for _, e in own[:5]]
            own = own[:5]
        assert sum(r["user_id"] == user for r in found) == len(own)


@pytest.mark.parametrize("gap", [300, 900, 7_200])
def test_usage_sessions_match_the_built_in(spark, gap):
    df = events_df(spark, random_events(500))
    got = usage.usage_sessions(df, gap)
    want = (
        df.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
        .groupBy(F.session_window("ts", f"{gap} seconds").alias("w"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", "w.start", "w.end", "events")
    )
    assert sorted(rows(got)) == sorted(rows(want))


def test_vector_match(spark):
    rng = np.random.default_rng(4)
    vectors = [v.tolist() for v in rng.integers(-2, 3, size=(30, 4)).astype(float)]
    vectors[5] = [0.0] * 4
    vectors[6] = [float("nan")] + [1.0] * 3
    vectors[7] = [1.0] * 3
    vectors[9] = vectors[11] = vectors[12]
    table = [(i, v) for i, v in enumerate(vectors)]
    left = spark.createDataFrame(table, "resume_id long, v array<float>")
    right = spark.createDataFrame(table, "posting_id long, v array<float>")
    pairs = [(i, int(j)) for i in range(12) for j in rng.choice(32, 8, replace=False)]
    got = resume.vector_match(spark.createDataFrame(pairs, "resume_id long, posting_id long"), left, right, 4)
    want = set()
    for i in range(12):
        scored = []
        for j in (p for r, p in pairs if r == i):
            a, b = vectors[i], vectors[j] if j < 30 else []
            size = np.linalg.norm(a) * np.linalg.norm(b)
            cosine = round(float(np.dot(a, b) / size), 6) if len(a) == len(b) and size > 0 else None
            scored.append((cosine is None, -(cosine or 0.0), j, cosine))
        want |= {(i, j, c if c is None else c + 0.0, n + 1) for n, (_, _, j, c) in enumerate(sorted(scored)[:4])}
    assert {(r[0], r[1], r[2] if r[2] is None else r[2] + 0.0, r[3]) for r in rows(got)} == want


def skill_tables(spark):
    docs = spark.createDataFrame(
        [(1, "We use Python (FastAPI) and vector databases."), (2, "React, react! Node.js"),
         (3, "python fastapi; React; node js"), (4, "nothing here")],
        "doc_id long, text string",
    )
    names = ["Python (FastAPI)", "Vector Databases", "React", "Node.js", "Python", "!!"]
    skills = spark.createDataFrame([(n,) for n in names], "skill string")
    return resume.extract_skills(docs, skills)


def test_extract_skills(spark):
    assert sorted(rows(skill_tables(spark))) == [
        (1, "Python"), (1, "Python (FastAPI)"), (1, "Vector Databases"), (2, "Node.js"),
        (2, "React"), (3, "Node.js"), (3, "Python"), (3, "Python (FastAPI)"), (3, "React"),
    ]


def match_results(spark):
    found = skill_tables(spark)
    jobs = found.withColumnRenamed("doc_id", "posting_id")
    held = found.withColumnRenamed("doc_id", "resume_id")
    pairs = spark.createDataFrame(
        [(2, 1), (3, 1), (3, 2), (2, 3), (4, 3), (2, 4)], "resume_id long, posting_id long"
    )
    return resume.match_percentage(pairs, held, jobs), resume.missing_skills(pairs, held, jobs)


def test_matches(spark):
    matches, missing = match_results(spark)
    got = {(r["resume_id"], r["posting_id"]): (r["match_percentage"], r["missing_skills"])
           for r in matches.collect()}
    assert got == {
        (2, 1): (0.0, ["Python", "Python (FastAPI)", "Vector Databases"]),
        (3, 1): (66.67, ["Vector Databases"]), (3, 2): (100.0, []),
        (2, 3): (50.0, ["Python", "Python (FastAPI)"]),
        (4, 3): (0.0, ["Node.js", "Python", "Python (FastAPI)", "React"]), (2, 4): (None, []),
    }
    # A pair that lacks nothing gives no row.
    assert not missing.filter("resume_id = 3 AND posting_id = 2").count()
    assert missing.count() == 10
    best = {(r["resume_id"], r["rank"]): r["posting_id"] for r in resume.best_jobs(matches, 1).collect()}
    assert best == {(2, 1): 3, (3, 1): 2, (4, 1): 3}
    top = resume.keyword_suggestions(missing, 2).filter("resume_id = 2")
    assert sorted(rows(top)) == [(2, "Python", 2, 1), (2, "Python (FastAPI)", 2, 2)]


def test_matches_by_shuffle_joins(spark, shuffle_joins):
    test_matches(spark)


def test_text_similarity(spark):
    docs = spark.createDataFrame(
        [(1, "a a b"), (2, "a b c"), (3, "d"), (4, "")], "doc_id long, text string"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 1), (4, 2)], "resume_id long, posting_id long")
    got = {(r[0], r[1]): r[2] for r in rows(resume.text_similarity(pairs, docs, 5))}
    idf = {w: np.log(4 / n) for w, n in {"a": 2, "b": 2, "c": 1, "d": 1}.items()}
    one = np.array([2 * idf["a"], idf["b"], 0])
    two = np.array([idf["a"], idf["b"], idf["c"]])
    want = one @ two / np.linalg.norm(one) / np.linalg.norm(two)
    assert got[1, 2] == pytest.approx(want, abs=1e-4)
    assert (got[1, 3], got[1, 1], got[4, 2]) == (0.0, 1.0, 0.0)


def test_ml_risk_score(spark):
    bad = ["send money now fee", "pay fee send money", "money fee fee"]
    good = ["nurse team shift", "engineer team office", "teacher school office"]
    postings = spark.createDataFrame(list(enumerate(bad + good + ["send fee", "school team"])),
                                     "posting_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(6)],
                                   "posting_id long, label int")
    first = dict(rows(scam.ml_risk_score(postings, labels)))
    assert len(first) == 8 and all(0 <= s <= 100 for s in first.values())
    assert first[6] > 50 > first[7]
    assert first == dict(rows(scam.ml_risk_score(postings, labels)))


def test_skills_of_any_length_and_with_signs(spark):
    long = "Amazon Web Services Cloud Practitioner"
    docs = spark.createDataFrame([(1, f"I am an {long}."), (2, "plan c is net neutral"), (3, "C++ and C#, .NET too")],
                                 "doc_id long, text string")
    skills = spark.createDataFrame([(s,) for s in (long, "C++", "C#", ".NET")], "skill string")
    got = sorted(rows(resume.extract_skills(docs, skills)))
    assert got == [(1, long), (3, ".NET"), (3, "C#"), (3, "C++")]


def test_quota_without_time_and_with_two_plans(spark):
    from postvet.operators.plans import plan_table

    scans = spark.createDataFrame([(1, 7, "scan", None), (2, 8, "scan", None)],
                                  "event_id long, user_id long, event_type string, ts timestamp")
    plans = spark.createDataFrame([(7, "Free"), (8, "Free"), (8, "Pro")], "user_id long, plan string")
    got = usage.scan_quota(scans, plans, plan_table(spark)).select("event_id", "plan", "allowed")
    assert sorted(rows(got)) == [(1, "Free", False), (2, "Pro", True)]


def test_submissions_travel_with_numbers_of_skills(spark, shuffle_joins):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "resume_id long, posting_id long")
    held = spark.createDataFrame([(1, "a"), (1, "z"), (2, None), (2, "c"), (2, "c")], "resume_id long, skill string")
    jobs = spark.createDataFrame([(10, "c"), (10, "a"), (10, "b"), (10, "b"), (11, "a"), (12, None)], "posting_id long, skill string")
    missing = resume.missing_skills(pairs, held, jobs)
    plan = missing._jdf.queryExecution().optimizedPlan()
    kinds = [
        out.apply(i).dataType().simpleString()
        for out in (plan.collectLeaves().apply(0).output(), *_join_outputs(plan)) for i in range(out.size())
    ]
    assert "array<bigint>" in kinds and "array<string>" not in kinds
    assert sorted(map(tuple, missing.collect())) == [(1, 10, "b"), (1, 10, "c"), (2, 10, "a"), (2, 10, "b")]
    found = resume.skill_matches(pairs, held, jobs)
    assert sorted(map(tuple, found.collect())) == [
        (1, 10, 3, 1, ["b", "c"]), (1, 11, 1, 1, []), (2, 10, 3, 1, ["a", "b"]), (3, 12, 0, 0, []),
    ]


def _join_outputs(plan):
    """What each join below a node of a plan gives."""
    below = plan.children()
    found = [plan.output()] if plan.nodeName() == "Join" else []
    return found + [x for i in range(below.size()) for x in _join_outputs(below.apply(i))]
