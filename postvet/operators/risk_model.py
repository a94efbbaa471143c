"""Risk learned from labels: every posting is scored by a model that has not seen it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postvet.functions import text as T
from postvet.session import stored

FOLDS = 3
BINS = 20


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """Fold of an id: the first 32 bits of its MD5 as text, modulo the number of folds."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(folds)).cast("int")


def fold_counts(postings: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(fold, postings, labelled, positive): what each fold holds. Null texts take no part."""
    marked = postings.filter("text IS NOT NULL").select("posting_id").join(_marks(labels), "posting_id", "left")
    return marked.groupBy(fold_of(F.col("posting_id"), folds).alias("fold")).agg(
        F.count("*").alias("postings"), F.count("label").alias("labelled"),
        F.count_if(F.col("label") > 0).alias("positive"),
    )


def _marks(labels: DataFrame) -> DataFrame:
    """One label per posting; of several the largest."""
    known = labels.filter("label IS NOT NULL").select("posting_id", F.col("label").cast("double"))
    return known.groupBy("posting_id").agg(F.max("label").alias("label"))


def pooled(counts: list[int], positives: list[float]) -> list[float | None]:
    """Shares of positives by bin that never fall: neighbours that do are pooled.

    An empty bin has the share of the last one before it, else of the first one after it;
    all are null without any count.
    """
    pools: list[list[float]] = []
    for at, (n, p) in enumerate(zip(counts, positives)):
        if n:
            pools.append([p, n, at])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                p, n, _ = pools.pop()
                pools[-1][0] += p
                pools[-1][1] += n
    if not pools:
        return [None] * len(counts)
    shares, at = [], 0
    for i in range(len(counts)):
        while at + 1 < len(pools) and pools[at + 1][2] <= i:
            at += 1
        shares.append(pools[at][0] / pools[at][1])
    return shares


def out_of_fold_scores(
    postings: DataFrame, labels: DataFrame, folds: int = FOLDS, bins: int = BINS,
    features: int = 1 << 14, iterations: int = 20,
) -> DataFrame:
    """(posting_id, fold, ml_score, calibrated): probability x 100 by the other folds' model.

    Ids fall into folds by hash, so a repeated id stays in one. `calibrated` is the share of
    labelled positives at such scores x 100: scores fall into `bins` bins, which are counted by
    Spark and pooled until shares rise with the score. Texts are read once and kept as word
    counts. Where the other folds hold fewer than two classes both figures are null. Null
    texts are left out.
    """
    counted = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=T.WORD_GAP),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
    ])
    usable = postings.select("posting_id", "text").filter("text IS NOT NULL")
    vectors = stored(
        counted.fit(usable).transform(usable)
        .select("posting_id", fold_of(F.col("posting_id"), folds).alias("fold"), "_tf")
        .join(_marks(labels), "posting_id", "left")
    )
    # At most `folds` rows.
    held = {r.fold: (r.labelled, r.positive) for r in vectors.groupBy("fold").agg(
        F.count("label").alias("labelled"), F.count_if(F.col("label") > 0).alias("positive")).collect()}
    learner = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="label", probabilityCol="_probability",
            maxIter=iterations, regParam=0.1,
        ),
    ])
    parts = []
    for fold in range(folds):
        mine = vectors.filter(F.col("fold") == fold)
        labelled, positive = (sum(n[i] for f, n in held.items() if f != fold) for i in (0, 1))
        if 0 < positive < labelled:
            model = learner.fit(vectors.filter((F.col("fold") != fold) & F.col("label").isNotNull()))
            score = vector_to_array("_probability")[1]
            parts.append(model.transform(mine).select("posting_id", "fold", "label", score.alias("p")))
        else:
            parts.append(mine.select("posting_id", "fold", "label", F.lit(None).cast("double").alias("p")))
    scored = stored(reduce(DataFrame.unionByName, parts))
    bin_of = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    # At most `bins` rows.
    found = {r.bin: (r.n, r.positive) for r in scored.filter("label IS NOT NULL AND p IS NOT NULL")
             .groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("positive")).collect()}
    shares = pooled(*zip(*[found.get(i, (0, 0.0)) for i in range(bins)]))
    share = F.get(F.array(*[F.lit(s).cast("double") for s in shares]), bin_of)
    return scored.select(
        "posting_id", "fold", F.round(F.col("p") * 100, 2).alias("ml_score"),
        F.round(share * 100, 2).alias("calibrated"),
    )
