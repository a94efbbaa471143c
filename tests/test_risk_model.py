"""Out-of-fold scores: nobody is scored by a model that has seen them; pooled shares."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from postvet.operators import risk_model


@given(st.lists(st.tuples(st.integers(0, 9), st.floats(0, 1)), min_size=1, max_size=12))
def test_pooled_shares_never_fall_and_keep_the_sum(bins):
    counts = [n for n, _ in bins]
    positives = [round(n * p) for n, p in bins]
    shares = risk_model.pooled(counts, positives)
    if not sum(counts):
        assert shares == [None] * len(bins)
        return
    assert all(a <= b + 1e-12 for a, b in zip(shares, shares[1:]))
    assert sum(n * s for n, s in zip(counts, shares)) == pytest.approx(sum(positives))


def test_pooled_example():
    assert risk_model.pooled([0, 4, 4, 0, 2], [0, 2, 1, 0, 2]) == [3 / 8, 3 / 8, 3 / 8, 3 / 8, 1.0]


def test_scores_are_out_of_fold(spark):
    draw = random.Random(7)
    data, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        words = [f"w{draw.randint(0, 60)}" for _ in range(12)] + ([f"s{draw.randint(0, 3)}"] if bad and i % 3 else [])
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    # Its label can only be told by rows that share its one word, and there are none.
    data += [(1_000, "unique"), (1_001, None)]
    labels += [(1_000, 1), (1_000, 0), (5, None), (2_000, 1)]
    posts = spark.createDataFrame(data, "posting_id long, text string")
    marks = spark.createDataFrame(labels, "posting_id long, label int")
    got = {r.posting_id: r for r in risk_model.out_of_fold_scores(posts, marks, features=512).collect()}
    assert len(got) == 301 and got[1_000].ml_score < 50
    bad = [got[i].ml_score for i in range(300) if i % 4 == 0]
    good = [got[i].ml_score for i in range(300) if i % 4]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.75
    by_score = sorted((r.ml_score, r.calibrated) for r in got.values())
    assert all(a[1] <= b[1] for a, b in zip(by_score, by_score[1:]))
    folds = {r.fold: (r.postings, r.labelled) for r in risk_model.fold_counts(posts, marks).collect()}
    assert sum(n for n, _ in folds.values()) == sum(n for _, n in folds.values()) == 301
    lone = marks.filter("label = 0")
    assert {r.ml_score for r in risk_model.out_of_fold_scores(posts, lone, features=64).collect()} == {None}
