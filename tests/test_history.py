"""Runs of equal count and plan history, against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from postvet.functions.ordered import in_runs, positions
from postvet.operators import history

START = dt.datetime(2024, 1, 1)
PLANS = [("Free", 3), ("Basic", 5), ("Pro", None), ("Enterprise", None)]
EVENTS = "event_id long, user_id long, event_type string, ts timestamp"
CHANGES = "user_id long, plan string, valid_from timestamp"


@pytest.mark.parametrize("step", [1, 1_700_000_000_000])
def test_runs_have_equal_counts(spark, step):
    """One hot group, order values far apart or close: no run holds much more than its share."""
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.7 else rng.randrange(1, 50), i * step) for i in range(8_000)]
    df = spark.createDataFrame(data, "g int, seq long")
    cut = in_runs(df, ["g"], ["seq"], runs=16)
    sizes = Counter(r._run for r in cut.select("_run").collect())
    assert sum(sizes.values()) == 8_000 and len(sizes) >= 14
    assert max(sizes.values()) < 2 * 8_000 / 16
    summaries = cut.groupBy("g").agg(F.count_distinct("_run").alias("n")).agg(F.max("n")).first()[0]
    assert summaries <= 16
    got = {(r.g, r.seq): r.pos for r in positions(df, ["g"], "seq", runs=16).collect()}
    for g in {g for g, _ in data}:
        for i, s in enumerate(sorted(s for k, s in data if k == g)):
            assert got[g, s] == i


def brute(events, changes):
    """Plan and quota of each event, row by row."""
    quota = dict(PLANS)
    # Most scans first, then the first by name.
    strength = {p: (q is not None, -(q or 0), p) for p, q in PLANS}
    seen, plan_of, allowed = Counter(), {}, {}
    for event_id, user, kind, ts in sorted(
        events, key=lambda e: (e[3] is None, e[3] or START, e[0])
    ):
        known = [c for c in changes if user is not None and ts is not None and c[0] == user
                 and c[2] is not None and c[2] <= ts and c[1] in quota]
        latest = max((c[2] for c in known), default=None)
        plan = min((c[1] for c in known if c[2] == latest), key=strength.get, default=None)
        plan_of[event_id] = plan
        if kind == "scan":
            if ts is None or user is None:
                allowed[event_id] = False
                continue
            month = (user, ts.year, ts.month)
            seen[month] += 1
            allowed[event_id] = plan is not None and (quota[plan] is None or seen[month] <= quota[plan])
    return plan_of, allowed


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_history(spark, seed):
    rng = random.Random(seed)

    def moment():
        # Coarse, so that events and changes meet at one instant.
        return None if rng.random() < 0.03 else START + dt.timedelta(hours=12 * rng.randrange(180))

    def user():
        return None if rng.random() < 0.02 else 0 if rng.random() < 0.6 else rng.randrange(1, 8)

    events = [(i, user(), rng.choice(["scan", "scan", "view"]), moment()) for i in range(400)]
    names = [p for p, _ in PLANS] + ["Unknown"]
    changes = [(user(), rng.choice(names), moment()) for _ in range(60)]
    plans = spark.createDataFrame(PLANS, "name string, scans_per_month int")
    args = (spark.createDataFrame(events, EVENTS), spark.createDataFrame(changes, CHANGES), plans)
    plan_of, allowed = brute(events, changes)
    got = history.plan_at(*args)
    assert sorted(rows(got.select("event_id", "plan"))) == sorted(plan_of.items())
    marked = history.scan_quota_history(*args)
    assert sorted(rows(marked.select("event_id", "allowed"))) == sorted(allowed.items())
    assert any(allowed.values()) and not all(allowed.values())


def test_no_changes_and_no_events(spark):
    plans = spark.createDataFrame(PLANS, "name string, scans_per_month int")
    events = spark.createDataFrame([(1, 1, "scan", START)], EVENTS)
    nothing = spark.createDataFrame([], CHANGES)
    assert rows(history.plan_at(events, nothing, plans)) == [(1, 1, None)]
    assert [r.allowed for r in history.scan_quota_history(events, nothing, plans).collect()] == [False]
    empty = spark.createDataFrame([], EVENTS)
    change = spark.createDataFrame([(1, "Pro", START)], CHANGES)
    assert rows(history.scan_quota_history(empty, change, plans)) == []


def test_current_plans(spark):
    plans = spark.createDataFrame(PLANS, "name string, scans_per_month int")
    day = dt.timedelta(days=1)
    changes = spark.createDataFrame(
        [(1, "Free", START), (1, "Pro", START + day), (2, "Free", START), (2, "Pro", START), (3, None, START)], CHANGES
    )
    assert sorted(rows(history.current_plans(changes, plans))) == [(1, "Pro"), (2, "Pro")]
    assert sorted(rows(history.current_plans(changes, plans, START))) == [(1, "Free"), (2, "Pro")]
