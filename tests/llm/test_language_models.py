"""Class language model, whitening and phrases on small inputs, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("postvet.llm")

from postvet.llm import class_lm, phrases, whitening  # noqa: E402
from postvet.llm.common import Scratch  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n string, score string, row string, a string"


def odd_documents(spark, rows=()):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, clashing names."""
    long = " ".join(f"w{i % 97} x{i % 13}" for i in range(20_000))
    made = [
        (0, None, "en"), (1, "", None), (2, " \n\t", "en"), (3, "One", "fr"), (4, long, "en"), (5, "a b. a b", None),
        (6, "the same again", "en"), (6, "the same again", "en"), (6, "another of this id", None), (None, "no id", "de"),
        (8, "Ünï\x1cx ÀB c", "und"), (None, None, None),
    ]
    return spark.createDataFrame(
        [(*r, None, "clash", None, "clash", None) for r in [*made, *rows]], SCHEMA
    )


def made_texts(n, seed=3):
    """Texts of two kinds of words that take turns, with rare ones in between."""
    draw = random.Random(seed)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(9)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(1, 30)):
            words += [nouns[int(12 * draw.random() ** 2)], verbs[int(9 * draw.random() ** 3)]]
            if draw.random() < 0.1:
                words.append(f"rare{draw.randint(0, 60)}")
        texts.append(" ".join(words))
    return texts


# --- 11

def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def word_id(word):
    value = xxhash.xxh64_intdigest(word.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def brute_likelihood(pairs):
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    rows, cols = Counter(), Counter()
    for (k, c), n in pairs.items():
        rows[k] += n
        cols[c] += n
    return sum(map(f, pairs.values())) - sum(map(f, rows.values())) - sum(map(f, cols.values()))


def brute_scores(rows, shape, turn_of):
    """The whole operator by plain loops: each exchange recounts the class pairs of the corpus."""
    end = ("end",)
    texts = [tokens_of(t) for _, t in rows]
    learned = [w for (i, _), w in zip(rows, texts) if not is_held_out(i)]
    count = Counter(w for ws in learned for w in ws)
    ranked = sorted(count, key=lambda w: (-count[w], word_id(w)))
    core = ranked[:shape.core]
    bigrams = Counter((a, b) for ws in learned for a, b in zip([end, *ws], [*ws, end]))
    inner = {p: n for p, n in bigrams.items() if all(w == end or w in core for w in p)}
    of = {w: 1 + i % (shape.classes - 1) for i, w in enumerate(core)} | {end: 0}

    def class_pairs(of, bigrams=inner):
        made = Counter()
        for (a, b), n in bigrams.items():
            made[of[a], of[b]] += n
        return made

    now = brute_likelihood(class_pairs(of))
    for turn in range(shape.rounds):
        moves = []
        for i, w in enumerate(core):
            if turn_of(i) % shape.turns != turn % shape.turns:
                continue
            by_class = [brute_likelihood(class_pairs({**of, w: c})) for c in range(1, shape.classes)]
            best = max(range(len(by_class)), key=lambda c: (round(by_class[c] - by_class[0], 6), -c)) + 1
            if by_class[best - 1] > by_class[of[w] - 1] + 1e-6:
                moves.append((w, best))
        while moves:
            tried = of | dict(moves)
            value = brute_likelihood(class_pairs(tried))
            if value >= now:
                of, now = tried, value
                break
            moves = moves[::2] if len(moves) > 1 else []
    matrix = np.zeros((shape.classes, shape.classes))
    for (k, c), n in class_pairs(of).items():
        matrix[k, c] = n
    every = dict(of)
    for w in ranked[shape.core:]:
        worth = np.zeros(shape.classes)
        for h in range(shape.classes):
            for (a, b), n in bigrams.items():
                if a == w and b in of:
                    worth[h] += n * math.log((matrix[h, of[b]] + 0.5) / (matrix[h].sum() + 0.5 * shape.classes))
                if b == w and a in of:
                    worth[h] += n * math.log((matrix[of[a], h] + 0.5) / (matrix[:, h].sum() + 0.5 * shape.classes))
        every[w] = 1 + int(np.round(worth[1:], 6).argmax())
    # The model.
    total, kinds = Counter(), Counter()
    for w in ranked:
        total[every[w]] += count[w]
        kinds[every[w]] += 1
    total[0] = len(learned)
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    all_pairs, tokens = class_pairs(every, bigrams), sum(total.values())
    out = Counter()
    for (k, _), n in all_pairs.items():
        out[k] += n

    def follow(k, c):
        if k is None:
            return sum(kinds[j] / len(ranked) * follow(j, c) for j in range(shape.classes))
        return (all_pairs[k, c] + shape.smoothing * total[c] / tokens) / (out[k] + shape.smoothing)

    def probability(k, w):
        if w == end:
            return follow(k, 0)
        if w in every:
            return follow(k, every[w]) * (count[w] - d) / total[every[w]]
        return sum(follow(k, c) * d * kinds[c] / total[c] for c in range(shape.classes) if kinds[c])

    found = []
    for (i, _), ws in zip(rows, texts):
        line = [end, *ws, end]
        score = sum(math.log10(probability(every.get(a), b)) for a, b in zip(line, line[1:]))
        base = sum(math.log10(((len(learned) if w == end else count[w]) + 0.5) / (tokens + 0.5 * (len(count) + 2))) for w in line[1:])
        found.append((i, is_held_out(i), len(ws) + 1, 1 + sum(w in count for w in ws), tokens, base, score))
    return found


@pytest.mark.parametrize("core, hot", [(21, 1000), (60, 70), (15, 30)])
def test_class_model(spark, core, hot):
    texts = made_texts(60) + ["unseen words here n1", "n0 v0 n0", None, "", "N1 V1", "n1 v1 rare3"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "n2 v2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shape = class_lm.Shape(classes=4, core=core, hot=hot, rounds=4, smoothing=5.0)
    turns = {r[0]: r[1] for r in spark.range(core).select(F.col("id").cast("int"), F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(2))).collect()}
    want = brute_scores(rows, shape, turns.get)
    got = [tuple(r) for r in class_lm.score_texts(docs, shape=shape).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9), a


def test_gain_is_the_change_of_the_likelihood():
    draw = np.random.default_rng(4)
    words, size = draw.integers(0, 9, 400), 4
    of = np.append(draw.integers(1, size, 8), 0)  # the last word stands for the boundary

    def matrix(of):
        made = np.zeros((size, size))
        np.add.at(made, (of[words[:-1]], of[words[1:]]), 1)
        return made

    for word in range(8):
        others = words[1:][(words[:-1] == word) & (words[1:] != word)], words[:-1][(words[1:] == word) & (words[:-1] != word)]
        right, left = (np.bincount(of[o], minlength=size).astype(float) for o in others)
        twice = float(((words[:-1] == word) & (words[1:] == word)).sum())
        gain = class_lm.Board(matrix(of)).gains(of[word], right, left, twice)
        for c in range(1, size):
            moved = of.copy()
            moved[word] = c
            change = class_lm.Board(matrix(moved)).likelihood() - class_lm.Board(matrix(of)).likelihood()
            assert gain[c] - gain[of[word]] == pytest.approx(change, abs=1e-8)


def test_exchange_separates_kinds_of_words(spark):
    docs = spark.createDataFrame(list(enumerate(made_texts(300))), "doc_id long, text string")
    with Scratch(spark) as scratch:
        ids, _, _ = class_lm.most_frequent(class_lm.count_words(docs, "doc_id", "text"), 21)
        coded = class_lm.encode(docs, "doc_id", "text", ids)
        lists = scratch.stored(class_lm.neighbour_lists(class_lm.core_pairs(coded, 21)), "lists")
        classes, _ = class_lm.exchange(lists, 21, class_lm.Shape(classes=3, core=21, rounds=8))
    named = {word_id(w): w for w in [f"n{i}" for i in range(12)] + [f"v{i}" for i in range(9)]}
    kinds = {(named[int(i)][0], int(c)) for i, c in zip(ids, classes)}
    assert len(kinds) == 2 and len({c for _, c in kinds}) == 2


def test_probabilities_sum_to_one():
    counts, classes = np.array([5.0, 3, 2, 1, 1]), np.array([1, 2, 1, 2, 2])
    model = class_lm.ClassModel(
        counts, classes, np.array([4.0, 7, 5]), np.array([0.0, 2, 3]), 16, 6, 0.4, 4
    )
    after = model.transitions(np.array([[0, 3, 1], [2, 1, 4], [2, 3, 0]]), 2.0)
    words = 10 ** model.emission(counts, classes)
    for row in after:
        assert row[0] + (row[classes] * words).sum() + row[-1] == pytest.approx(1)


def test_class_model_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = class_lm.score_texts(docs, shape=class_lm.Shape(classes=4, core=8, hot=20, rounds=2)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert class_lm.score_texts(docs.limit(0)).collect() == []
    alone = class_lm.score_texts(docs.filter("doc_id = 4"), shape=class_lm.Shape(classes=4, core=8, rounds=2)).first()
    assert alone.n_tokens == 40_001
    only_held = spark.createDataFrame([(i, "a b") for i in range(99) if is_held_out(i)], "doc_id long, text string")
    assert {(r.score, r.base_score, r.train_tokens, r.n_known) for r in class_lm.score_texts(only_held).collect()} == {(0.0, 0.0, 0, 0)}


def test_class_model_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = class_lm.score_texts(docs, shape=class_lm.Shape(classes=32, core=2000, rounds=4)).filter("held_out").agg(
        F.sum("score"), F.sum("base_score")
    ).first()
    assert sums[0] > 0.9 * sums[1] > sums[1]


def test_most_frequent_words_are_a_prefix(spark):
    draw = random.Random(1)
    words = [(draw.randint(-(1 << 63), (1 << 63) - 1), min(50, int(1 / (draw.random() + 1e-3)))) for _ in range(600)]
    table = spark.createDataFrame(words, "id long, c long")
    want = sorted(words, key=lambda w: (-w[1], w[0]))
    for size in (0, 1, 7, 100, 599, 600, 5000):
        ids, counts, is_hot = class_lm.most_frequent(table, size)
        got = list(zip(ids.tolist(), counts.tolist()))
        assert got == want[:len(got)] and min(size, 600) - 3 <= len(got) <= size
        assert table.filter(is_hot).count() == len(got)


# --- 12

def brute_whiten(vectors, k):
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept))]
    x = np.array([v for _, v in kept], float) - np.array(sums) / n
    cov = x.T @ x / n
    values, axes = np.linalg.eigh(cov)
    white = x @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in kept]
    return kept, n, deviation, white, values[::-1][:k] / np.trace(cov)


def compared(got, vectors, k):
    kept, n, deviation, white, explained = brute_whiten(vectors, k)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9
    sign = {}
    for (i, _), dev, line in zip(kept, deviation, white):
        rows = by_row[i, dev]
        assert sorted(rows) == list(range(1, k + 1))
        for c, value in enumerate(line, 1):
            assert abs(rows[c].whitened) == pytest.approx(abs(value), abs=1e-6)
            assert rows[c].explained == pytest.approx(explained[c - 1], rel=1e-9)
            if abs(value) > 1e-3:
                assert sign.setdefault(c, np.sign(rows[c].whitened * value)) == np.sign(rows[c].whitened * value)


def vectors_of(n, size, seed=5):
    draw = np.random.default_rng(seed)
    spread = draw.standard_normal((n, size)) * np.linspace(0.1, 2, size)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(spread)]


def test_whitening(spark):
    rows = vectors_of(300, 12)
    odd = [(None, [0.5] * 12), (7, rows[7][1]), (900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12),
           (903, [1.0] * 11 + [float("inf")]), (904, [1.0, 2.0]), (905, []), (906, [1e30] + [0.0] * 11)]
    docs = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, n string, component double")
    got = whitening.whiten(docs.repartition(5), 8).collect()
    # Other lengths and what passes 64 bits are left out too.
    compared(got, rows + odd[:2], 8)
    assert len(got) == 302 * 8


def test_whitening_of_few_and_equal_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []
    three = [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.5, 0.0]), (3, [2.0, 7.0, 0.0])]
    compared(whitening.whiten(spark.createDataFrame(three, kind)).collect(), three, 2)
    # Equal eigenvalues: any basis of their plane will do, but it must be orthogonal.
    cross = [(i, [(i == j) - (i == j + 4) + 0.0 for j in range(4)]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(cross, kind)).collect()
    assert len(got) == 32 and max(r.identity_error for r in got) < 1e-12
    assert {round(r.explained, 12) for r in got} == {0.25}


def test_whitening_beyond_64_bits(spark):
    big = [(i, [float(v * 10 ** 9) for v in x]) for i, x in vectors_of(40, 3)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>"), 3).collect()
    compared(got, big, 3)
    assert max(r.deviation for r in got) > 1 << 63


@pytest.mark.parametrize("kind", range(4))
def test_leading_eigen(kind):
    draw = np.random.default_rng(kind)
    for size in (1, 2, 3, 9, 64):
        q, _ = np.linalg.qr(draw.standard_normal((size, size)))
        values = [draw.random(size) + 0.1, np.r_[np.full(min(size, 5), 3.0), np.zeros(size - min(size, 5))],
                  10.0 ** draw.integers(-3, 8, size), np.ones(size)][kind]
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        k = min(size, 8)
        found, vectors = whitening.leading_eigen(matrix, k)
        assert found == pytest.approx(np.sort(values)[::-1][:k], rel=1e-9, abs=1e-12 * values.max())
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
        assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-13 * size * values.max()


# --- 13

def brute_phrases(rows, limit, least):
    grams, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    g = lang, *ws[i:i + k]
                    grams[g] = grams.get(g, 0) + 1
    candidates = {g: a for g, a in grams.items() if len(g) > 2 and a >= least}
    best = {}
    for g, a in candidates.items():
        lang, ws = g[0], g[1:]
        if len(ws) == 2 and any(100 * t >= 50 * a and h[0] == lang and ws in (h[1:3], h[2:4]) for h, t in candidates.items() if len(h) == 4):
            continue
        cuts = []
        for k in range(1, len(ws)):
            l, r = grams[lang, *ws[:k]], grams[lang, *ws[k:]]  # noqa: E741
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        best.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in best.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:limit])
    }


@pytest.mark.parametrize("limit, first", [(3, 1), (40, 1), (2000, 3)])
def test_phrases(spark, limit, first):
    draw = random.Random(8)
    stock = ["New York city", "of the", "in of", "hot dog! stand", "a a a a", "é ö", "tab\tted words", "x\x0by z", "Of The Day", "é ö"]
    rows = [
        (draw.choice(["en", "fr", None, "und"]), " ".join(draw.choice(stock) if draw.random() < 0.6 else f"w{draw.randint(0, 30)}" for _ in range(40)))
        for _ in range(150)
    ] + [("en", None), (None, ""), ("en", " ,,\n"), ("xx", "of the of the")]
    docs = spark.createDataFrame([(i, t, la, None, "c", "c", "c", "c") for i, (la, t) in enumerate(rows)], SCHEMA)
    got = {tuple(r) for r in phrases.top_phrases(docs, limit, first=first).collect()}
    want = brute_phrases(rows, limit, 10)
    assert got == want and len({r[0] for r in got}) == 3


def test_frontier_is_expanded_until_the_last_phrase_is_settled(spark):
    """The best pairs all lie in longer phrases, so a second round must find the others."""
    rows = [("en", f"p{i} q{i} r{i}") for i in range(30) for _ in range(12)]
    rows += [("en", f"s{i} t{i}") for i in range(20) for _ in range(11)] + [("en", f"s{i}") for i in range(20) for _ in range(9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in phrases.top_phrases(docs, 40, first=1).collect()}
    assert got == brute_phrases(rows, 40, 10) and len(got) == 40


def test_phrases_of_odd_tables(spark):
    docs = odd_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert {tuple(r) for r in phrases.top_phrases(docs, 50).collect()} == brute_phrases(rows, 50, 10)
    assert phrases.top_phrases(docs.limit(0)).collect() == []


def test_filters_hold_what_was_put_in(spark):
    words = [f"w{i}" for i in range(500)] + ["é", "日本"]
    rows = spark.createDataFrame([("en" if i % 2 else "und", w, words[-i]) for i, w in enumerate(words)], "lang string, w1 string, w2 string")
    one, two = phrases.bit_filter(rows, "w1"), phrases.bit_filter(rows, "w1", "w2")
    digest = lambda w: np.array([xxhash.xxh64_intdigest(w.encode(), 42)], np.uint64)
    for r in rows.collect():
        lang = phrases._language(r.lang)
        assert phrases._holds(one, phrases._places(lang, None, digest(r.w1))).all()
        assert phrases._holds(two, phrases._places(lang, digest(r.w1), digest(r.w2))).all()
    assert 0 < np.unpackbits(one).sum() <= len(words)
