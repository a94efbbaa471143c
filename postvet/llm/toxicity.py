"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postvet.llm.common import map_texts, ready
from postvet.session import stored

PUNCTUATION = ".,;:!?\"'()[]{}<>*#%-_/\\"
PREFIXES = (4, 5, 6)
MEMO_WORDS = 1 << 18


@dataclass(frozen=True)
class Limits:
    """Bounds of the training sample and of the model; prediction has none."""

    toxic_rows: int = 4_000
    clean_rows: int = 8_000
    features: int = 4_096
    min_z: float = 3.0


@dataclass(frozen=True)
class Model:
    """Shared weights, ordered thresholds, and the feature each weight belongs to."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: list[dict[int, int]]) -> np.ndarray:
        """P(grade > k) for each row and threshold k, from the counts of its features."""
        eta = np.array([
            sum(np.log1p(n) * self.weights[i] for i, n in row.items()) for row in rows
        ], dtype=float).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta, -60, 60)))


def word_features(word: str) -> list[str]:
    """The word without outer punctuation, and its openings of 4, 5 and 6 characters."""
    word = word.strip(PUNCTUATION)
    if len(word) < 3:
        return []
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class _Memo(dict):
    """Features of each chunk met so far, as ids of the model; forgets all when full."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        known = self.known
        found = tuple(known[f] for f in word_features(chunk) if f in known)
        self[chunk] = found
        return found


def count_features(text: str | None, memo: _Memo) -> dict[int, int]:
    return Counter(
        i for found in map(memo.__getitem__, (text or "").lower().split()) if found for i in found
    )


def _signature(words: list[str]) -> int:
    """Least hash of the three-word runs; near copies mostly share it."""
    runs = zip(words, words[1:], words[2:])
    return min((xxhash.xxh3_64_intdigest("\x1f".join(r)) for r in runs),
               default=xxhash.xxh3_64_intdigest(" ".join(words))) >> 1


def training_sample(docs: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """Labelled rows, at most so many of each class, picked by a hash of the id.

    One row per id: of rows that repeat an id the smallest text, folded where they are
    read. The ids are few by their bound, so they are broadcast and only picked texts move.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.col("toxic").cast("int").alias("__toxic")
    )
    picked = stored(
        known.filter("__toxic > 0").orderBy(order, "doc_id").limit(limits.toxic_rows)
        .union(known.filter("__toxic = 0").orderBy(order, "doc_id").limit(limits.clean_rows))
        .groupBy("doc_id").agg(F.max("__toxic").alias("__toxic"))
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "__toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """Train on `docs` (doc_id, text) and `labels` (doc_id, toxic).

    The labels know only toxic or not. Toxic rows are graded: 2 if they hold more marked
    features than the mean toxic row, else 1; clean rows are 0. Marked are the
    features that toxic rows hold more often by `min_z` standard errors of the log odds.
    Near copies count once. Without rows of both classes the model rejects nothing.
    """
    ready(docs.sparkSession)

    def extract(texts):
        sigs, rows = [], []
        for text in texts:
            words = (text or "").lower().split()
            sigs.append(_signature(words))
            rows.append(sorted({f for w in set(words) for f in word_features(w)}))
        return [pa.array(sigs, pa.int64()), pa.array(rows, pa.list_(pa.string()))]

    sample = training_sample(docs, labels, limits)
    made = map_texts(
        sample, ["doc_id", "__toxic"], "text", "sig bigint, terms array<string>", extract
    ).withColumnRenamed("__toxic", "toxic")
    first = F.row_number().over(Window.partitionBy("sig").orderBy("doc_id"))
    made = stored(made.withColumn("__n", first).filter("__n = 1").drop("__n"))
    totals = {r["toxic"] > 0: r["n"] for r in made.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if not bad or not good:
        return Model({}, np.zeros(0), np.array([60.0]))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    marked = (
        made.select("toxic", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
        .filter("t >= 3").withColumn("z", z).filter(F.col("z") >= limits.min_z)
        .orderBy(F.desc("z"), "term").limit(limits.features)
    )
    terms = sorted(r["term"] for r in marked.select("term").collect())
    known = {t: i for i, t in enumerate(terms)}

    def count(texts):
        memo = _Memo(known)
        rows = [count_features(t, memo) for t in texts]
        return [pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))]

    chosen = made.select(F.col("doc_id").alias("__id"))
    rows = map_texts(
        sample.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left_semi"),
        ["doc_id", "__toxic"], "text", "ids array<int>, counts array<int>", count,
    ).orderBy("doc_id").collect()
    found = [sum(r["counts"]) for r in rows]
    middle = np.mean([n for n, r in zip(found, rows) if r["__toxic"] > 0])
    grades = np.array([1 + int(n > middle) if r["__toxic"] > 0 else 0 for n, r in zip(found, rows)])
    weights, thresholds = train(
        [r["ids"] for r in rows], [r["counts"] for r in rows], grades, len(terms)
    )
    return Model(known, weights, thresholds)


def train(
    ids: list[list[int]], counts: list[list[int]], grades: np.ndarray, width: int,
    steps: int = 1_000, rate: float = 0.1, ridge: float = 1e-5,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of P(grade <= k) = logistic(threshold_k - x w), by Adam.

    One weight vector serves all thresholds. These stay ordered: the gaps between them
    are exponentials of free parameters.
    """
    top = int(grades.max())
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    col = np.array([i for r in ids for i in r], dtype=np.int64)
    val = np.log1p(np.array([c for r in counts for c in r], dtype=float))
    every = np.arange(len(ids))
    free = np.zeros(width + top)
    free[width] = 1.0
    mean, square = np.zeros_like(free), np.zeros_like(free)

    def cuts(p):
        return p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1:]))])

    for step in range(1, steps + 1):
        eta = np.bincount(row, val * free[col], minlength=len(ids)) if len(col) else np.zeros(len(ids))
        # P(grade > k) for k = -1 .. top: a grade lies between two neighbours.
        tail = np.ones((len(ids), top + 2))
        tail[:, 1:-1] = 1 / (1 + np.exp(np.clip(cuts(free)[None, :] - eta[:, None], -60, 60)))
        tail[:, -1] = 0.0
        upper, lower = tail[every, grades], tail[every, grades + 1]
        share = np.maximum(upper - lower, 1e-12) * len(ids)
        slope = np.zeros_like(free)
        if len(col):
            off = -(1 - upper - lower) / len(ids)
            slope[:width] = np.bincount(col, val * off[row], minlength=width)
        slope[:width] += ridge * free[:width]
        by_cut = np.zeros(top + 2)
        np.add.at(by_cut, grades, upper * (1 - upper) / share)
        np.add.at(by_cut, grades + 1, -lower * (1 - lower) / share)
        by_cut = by_cut[1:-1]
        slope[width] = by_cut.sum()
        for k in range(1, top):
            slope[width + k] = by_cut[k:].sum() * np.exp(free[width + k])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope ** 2
        free -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return free[:width], cuts(free)


def score_texts(docs: DataFrame, model: Model, ids: list[str], text: str = "text") -> DataFrame:
    """(ids.., p_toxic, severity): P(grade >= 1) and the expected grade of every whole text.

    Null, empty and blank texts hold no feature and get the lowest score.
    """

    def work(texts):
        memo = _Memo(model.features)
        tails = model.tails([count_features(t, memo) for t in texts])
        return [pa.array(tails[:, 0], pa.float64()), pa.array(tails.sum(axis=1), pa.float64())]

    return map_texts(docs, ids, text, "p_toxic double, severity double", work)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose probability of being toxic is under `limit`."""
    @F.pandas_udf("double")
    def p_toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Memo(model.features)
        for texts in batches:
            rows = [count_features(t, memo) for t in texts]
            yield pd.Series(model.tails(rows)[:, 0])

    return docs.filter(p_toxic(F.col(text)) < limit)
