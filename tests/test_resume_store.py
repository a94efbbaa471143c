"""The phrase index and the term-vector store against brute force, and the pairs they run over."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from conftest import FOLDER, rows
from pyspark.sql import functions as F

from postvet.functions.text import skill_words, words
from postvet.operators import phrase_index, resume, term_vectors
from postvet.session import stored
from postvet.sources.bindings import Fixtures


def brute_phrases(texts, phrases):
    return sorted(
        (i, p) for i, t in texts for p in phrases
        if p.split() and f" {' '.join(p.split())} " in f" {' '.join((t or '').split())} "
    )


def indexed(spark, phrases):
    table = spark.createDataFrame([(p,) for p in phrases], "skill string")
    return phrase_index.build(table, skill_words(F.col("skill")), "skill")


def made(seed, n=60):
    """Phrases that share beginnings, lie in each other and are up to 40 words long, and texts of them."""
    draw = random.Random(seed)
    stock = [f"w{i}" for i in range(12)]
    phrases = {" ".join(draw.choice(stock) for _ in range(draw.choice([1, 2, 3, 5, 17, 40]))) for _ in range(n)}
    for p in sorted(phrases)[::3]:
        ws = p.split()
        phrases |= {" ".join(ws[: draw.randint(1, len(ws))]), " ".join(ws + [draw.choice(stock)])}
    texts = [
        (i, " ".join(draw.choice([draw.choice(sorted(phrases)), draw.choice(stock), "other"]) for _ in range(draw.randint(0, 12))))
        for i in range(50)
    ]
    return sorted(phrases), texts + [(100, None), (101, "")]


@pytest.mark.parametrize("seed", range(3))
def test_phrases_of_any_shape(spark, seed):
    phrases, texts = made(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    skills = spark.createDataFrame([(p,) for p in phrases] + [("",), (None,), ("...",)], "skill string")
    assert sorted(rows(resume.extract_skills(docs, skills))) == brute_phrases(texts, phrases)


def test_phrases_without_broadcasts(spark, shuffle_joins):
    phrases, texts = made(7)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = resume.extract_skills(docs, spark.createDataFrame([(p,) for p in phrases], "skill string"))
    assert sorted(rows(found)) == brute_phrases(texts, phrases)


def test_levels_follow_branches_not_words(spark):
    long = " ".join(f"w{i}" for i in range(300))
    index = indexed(spark, [long, long + " end", "w0 other", "single"])
    # Root to "w0", on to the long phrase, on to its last word.
    assert index.levels == 3 and index.edges.count() == 5
    assert indexed(spark, []).levels == 0
    docs = spark.createDataFrame([(1, f"a {long} end b"), (2, long[:-2])], "doc_id long, text string")
    found = resume.extract_skills(docs, spark.createDataFrame([(long,), (long + " end",), ("zz",)], "skill string"))
    assert sorted(rows(found)) == [(1, long), (1, long + " end")]


def test_only_opening_words_become_rows(spark):
    index = indexed(spark, ["alpha beta gamma delta epsilon", "zeta"])
    docs = spark.createDataFrame([(1, "one two zeta three alpha beta five six seven eight " * 4)], "doc_id long, text string")
    split = docs.select("doc_id", skill_words(F.col("text")).alias("w"))
    made = rows(split.select(F.explode(phrase_index._runs("w", index.openers))))
    assert {r[0][0] for r in made} == {"zeta", "alpha"}
    assert {len(r[0]) for r in made if r[0][0] == "zeta"} == {1}
    assert max(len(r[0]) for r in made) == 16  # the next step from 5 words


def test_common_first_words_open_no_long_runs(spark):
    """A word that opens a long phrase makes no row unless the word after it fits too."""
    long = "the " + " ".join(f"w{i}" for i in range(60))
    index = indexed(spark, [long, "other one", "other"])
    text = "the cat saw the dog and the other man of the " + "house " * 40 + f"other one {long} the"
    split = spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", skill_words(F.col("text")).alias("w"))
    made = [r[0] for r in rows(split.select(F.explode(phrase_index._runs("w", index.openers))))]
    assert sorted(m[:2] for m in made) == [["other"], ["other", "one"], ["the", "w0"]]
    found = rows(phrase_index.count(split, "w", index))
    assert sorted(found) == [(1, "other", 2), (1, "other one", 1), (1, long, 1)]


def brute_cosines(texts, pairs):
    counts = {i: Counter(t) for i, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    vectors = {}
    for i, c in counts.items():
        v = {w: n * math.log(len(texts) / df[w]) for w, n in c.items() if df[w] < len(texts)}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / size for w, x in v.items()}
    return {
        (r, p): sum(x * vectors.get(p, {}).get(w, 0.0) for w, x in vectors.get(r, {}).items()) for r, p in pairs
    }


@pytest.mark.parametrize("cell", [3, 40, 1 << 14])
def test_cosines(spark, monkeypatch, cell):
    monkeypatch.setattr(term_vectors, "CELL_PAIRS", cell)
    draw = random.Random(cell)
    texts = {i: [f"w{int(30 * draw.random() ** 2)}" for _ in range(draw.randint(0, 40))] + ["all"] for i in range(40)}
    # One posting has half of all pairs; some ids have no text.
    pairs = {(draw.randint(0, 44), 5 if draw.random() < 0.5 else draw.randint(0, 44)) for _ in range(300)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = term_vectors.cosines(
        spark.createDataFrame(sorted(pairs), "resume_id long, posting_id long"), term_vectors.term_vectors(docs)
    )
    want = brute_cosines(texts, pairs)
    found = {(r[0], r[1]): r[2] for r in rows(got)}
    assert found.keys() == want.keys()
    for pair, value in want.items():
        assert found[pair] == pytest.approx(value, abs=1e-12)


def test_cosines_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "resume_id long, posting_id long")
    assert rows(resume.text_similarity(none, docs)) == []
    one = spark.createDataFrame([(1, 9), (1, 2)], "resume_id long, posting_id long")
    assert sorted(rows(resume.text_similarity(one, docs))) == [(1, 2, 0.0, 1), (1, 9, 0.0, 2)]


def test_a_vector_travels_once_per_cell(spark, monkeypatch):
    """What is shuffled of the vectors is bounded by rows and columns of the grid, not by pairs."""
    monkeypatch.setattr(term_vectors, "CELL_PAIRS", 100)
    pairs = spark.range(30).crossJoin(spark.range(30).withColumnRenamed("id", "posting_id")).withColumnRenamed("id", "resume_id")
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d"), F.col("id").cast("string")).alias("text"))
    df = term_vectors.cosines(pairs, term_vectors.term_vectors(docs))
    assert df.count() == 900
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_every_line_item_is_a_submission(spark):
    fx = Fixtures(spark, FOLDER)
    n = fx.documents.count()
    want = {(r[0] % n, r[1] % n) for r in fx.table("lineitem").select("l_partkey", "l_orderkey").collect()}
    assert {tuple(r) for r in fx.submissions().collect()} == want and len(want) > 5_000


def test_word_bands_are_shares(spark):
    fx = Fixtures(spark, FOLDER)
    n = fx.documents.count()
    df = Counter(w for r in fx.documents.select(words(F.col("text")).alias("w")).collect() for w in set(r.w))
    band = {w for w, c in df.items() if 10 * n <= 1000 * c <= 12 * n}
    skills = {r[0] for r in fx.skills().collect()}
    assert skills == band | {r.text for r in fx.table("benchmark").collect()}
    assert {r.token: r.weight for r in fx.lexicon().collect()} == {
        w: 1.0 if 1000 * c <= 40 * n else -1.0 for w, c in df.items() if 20 * n <= 1000 * c <= 80 * n
    }


def test_a_length_is_worked_out_once_per_text(spark):
    """Inside the function over the weights it would be summed anew for each of them."""
    docs = spark.createDataFrame([(1, "a b"), (2, "c a d"), (3, "b")], "doc_id long, text string")
    vectors = term_vectors.term_vectors(docs)
    assert " aggregate(" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    numbers = {t for r in vectors.collect() for t in r.terms}
    assert numbers == set(range(4))
    assert all(sum(w * w for w in r.weights) == pytest.approx(1) for r in vectors.collect())


@pytest.mark.parametrize("setting", ["CELL_ENTRIES", "TURN", "FEW_TERMS"])
def test_cosines_in_small_cells_and_turns(spark, monkeypatch, setting):
    texts = {i: [f"w{j % 7}" for j in range(i, 2 * i + 1)] for i in range(20)}
    pairs = [(i, j) for i in range(20) for j in range(0, 20, 3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    monkeypatch.setattr(term_vectors, setting, 3)
    got = term_vectors.cosines(spark.createDataFrame(pairs, "resume_id long, posting_id long"), term_vectors.term_vectors(docs))
    want = brute_cosines(texts, pairs)
    assert {(r[0], r[1]): r[2] for r in rows(got)} == {p: pytest.approx(v, abs=1e-12) for p, v in want.items()}


@pytest.mark.parametrize("hot", [1, 5, 1 << 19])
def test_vectors_in_pieces_and_bands(spark, monkeypatch, hot):
    """Rare terms and texts that share an id come in pieces; columns of the grid are worked on one by one."""
    monkeypatch.setattr(term_vectors, "HOT_TERMS", hot)
    monkeypatch.setattr(term_vectors, "CELL_ENTRIES", 100)
    monkeypatch.setattr(term_vectors, "BAND_CELLS", 1)
    written, write = [], term_vectors.stored
    monkeypatch.setattr(term_vectors, "stored", lambda df: written.append(write(df)) or written[-1])
    draw = random.Random(hot)
    texts = {i: [f"w{int(300 * draw.random() ** 3)}" for _ in range(draw.randint(0, 60))] for i in range(30)}
    split = [(i, " ".join(t)) for i, t in texts.items()]
    # Two ids come twice, one of them is no id; a text is missing.
    split[3:4] = [(3, " ".join(texts[3][:9])), (3, " ".join(texts[3][9:]))]
    split += [(None, "w0 other"), (None, "other"), (40, None)]
    texts |= {None: ["w0", "other", "other"]}
    docs = spark.createDataFrame(split, "doc_id long, text string")
    pairs = [(i, j) for i in range(30) for j in range(0, 30, 2)] + [(40, 1), (1, 40), (50, 51)]
    vectors, total = term_vectors.compact_vectors(docs)
    assert total == len(split) == 34
    df = Counter(w for t in texts.values() for w in set(t))
    weighted = {i: {w: n * math.log(total / df[w]) for w, n in Counter(t).items()} for i, t in texts.items()}
    length = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in weighted.items()}
    want = {
        (r, p): sum(x * weighted.get(p, {}).get(w, 0.0) for w, x in weighted.get(r, {}).items())
        / ((length.get(r) or 1) * (length.get(p) or 1)) for r, p in pairs
    }
    before = len(written)
    got = term_vectors.cosines(spark.createDataFrame(pairs, "resume_id long, posting_id long"), vectors, total)
    assert {(r[0], r[1]): r[2] for r in rows(got)} == {p: pytest.approx(v, abs=1e-12) for p, v in want.items()}
    # The pairs, the dealt pairs, and each column of the grid; the vectors are not written again.
    assert [w.columns[-1] for w in written[before:]] == ["posting_id"] * 2 + ["cosine"] * (len(written) - before - 2)
    assert len(written) - before > 4
    assert all(kind not in ("array<double>", "array<bigint>") for w in written for _, kind in w.dtypes)


def test_short_numbers():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**62, 5])
    for sizes in ([9], [0, 4, 0, 5, 0], [1] * 9):
        short = term_vectors._short(values, np.array(sizes))
        assert len(short) == len(sizes) and (term_vectors._long(short) == values).all()
        assert (term_vectors._long(short.slice(1)) == values[sizes[0]:]).all()
    assert len(term_vectors._long(term_vectors._short(values[:0], np.zeros(3, int)))) == 0


def test_shuffle_files_go_with_their_write(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    kept = stored(spark.range(1_000).repartition(7).groupBy(F.col("id") % 10).count())
    for _ in range(50):
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert kept.count() == 10
