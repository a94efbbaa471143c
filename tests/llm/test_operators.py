"""The training-data operators on small inputs, against brute force."""

import os
import random
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("postvet.llm")

from postvet.llm import (  # noqa: E402
    components, decontamination, language, licenses, mixing, near_dedup, sharding, simhash, token_counts,
    token_files, topk, toxicity,
)
from postvet.llm.common import Scratch  # noqa: E402
from postvet.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"
BYTE_BPE, WORD_BPE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
SPECIAL = "a <|endoftext|> b<|startoftext|>c"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def documents(spark, extra=()):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    texts = [
        None, "", " \n\t", "one", "Two words", SPECIAL, "Ünïcode ﬁ Σς 12½ 'll \x1c x y", LONG,
        "the same text again and again here", "the same text again and again here",
        "The SAME text again and again here", "😀 emoji, and\r\nlines!",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None, "clash", None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (8, "another text of the same id", None, "s1", 3, None, "x"), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- 1

def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.int64) * 7919 - 50
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = before != after
    assert (after[moved] == 24).all() and 0.03 < moved.mean() < 0.05
    sizes = np.bincount(before, minlength=24)
    assert sizes.min() > 0.8 * sizes.mean() and len(sizes) == 24


def test_shards(docs):
    rows = sharding.assign_shards(docs, 24).collect()
    assert len(rows) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) and r.law == "key" for r in rows)


# --- 2

def test_licenses(spark):
    apache, text = licenses.TEMPLATES["apache-2.0-notice"], licenses.TEMPLATES["mit-text"]
    rows = [
        (1, f"before {apache} after"), (2, apache.upper()), (3, "Licensed under the Apache License, Version 1.1."),
        (4, text.replace("free of charge", "without charge")), (5, "the license of a dog"), (6, None), (7, ""),
        (8, "Licensed under CC BY-SA 4.0."), (9, "x " * 9_000 + licenses.TEMPLATES["gpl-3.0-notice"]), (1, apache),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(collected(got, "doc_id", "license")) == [
        (1, "apache-2.0-notice"), (1, "apache-2.0-notice"), (2, "apache-2.0-notice"), (4, "mit-text"),
        (8, "cc-by-sa-4.0-notice"), (9, "gpl-3.0-notice"),
    ]
    four = got.filter("doc_id = 4").first()
    assert (four.missing, four.extra) == (["free", "of"], ["without"])


@pytest.mark.parametrize("sign", ["#", " *", "//", ";", "--", "%"])
def test_licenses_behind_comment_signs(sign):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        for width in (40, 76):
            lines = textwrap.wrap(template, width, break_long_words=False, break_on_hyphens=False)
            text = f"{sign} Some file\n{sign}\n" + "".join(f"{sign} {line}\n" for line in lines) + "int main() {}"
            got = scanner.scan(text)
            assert [(m.license, m.start, m.missing, m.extra) for m in got] == [(name, 5, [], [])], name


def test_licenses_with_any_one_word_edited():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("mit-text", "apache-2.0-header", "gpl-3.0-header", "bsd-text", "mpl-2.0-header"):
        words = licenses.TEMPLATES[name].split()
        for at, word in enumerate(words):
            if licenses._names(licenses._plain(word)):
                continue
            for edit in (["other"], [], [word, "other"]):
                for before in ("", "some text before it "):
                    text = before + " ".join(words[:at] + edit + words[at + 1:]) + " and what follows"
                    assert [m.license for m in scanner.scan(text)] == [name], (name, at, edit, before)
    several = licenses.TEMPLATES["mit-text"].replace("Permission is hereby", "Permissions are hereby")
    assert [m.license for m in scanner.scan(several)] == ["mit-text"]


@pytest.mark.parametrize("name, old, new, want", [
    ("gpl-3.0-notice", "GNU General", "GNU Lesser General", ["lgpl-3.0-notice"]),
    ("gpl-3.0-notice", "GNU General", "GNU Affero General", ["agpl-3.0-notice"]),
    ("lgpl-3.0-header", "Lesser ", "", ["gpl-3.0-header"]),
    ("gpl-3.0-header", "version 3", "version 2", ["gpl-2.0-header"]),
    ("lgpl-2.1-header", "2.1", "2.0", []),
    ("cc-by-4.0-notice", "CC BY 4.0", "CC BY NC 4.0", []),
    ("cc-by-sa-4.0-notice", "BY-SA", "BY-NC", ["cc-by-nc-4.0-notice"]),
    ("mit-text", "persons to whom", "persons by to whom", ["mit-text"]),
    ("mit-text", "to deal in", "12 to deal in", ["mit-text"]),
    ("bsd-3-clause-whole", "conditions are met:", "conditions are met: 1.", ["bsd-3-clause-whole"]),
])
def test_licenses_and_their_neighbours(name, old, new, want):
    text = licenses.TEMPLATES[name]
    assert old in text
    assert [m.license for m in licenses.Scanner(licenses.TEMPLATES).scan(f"a b {text.replace(old, new)} c")] == want


def test_licenses_without_their_own_template():
    """A neighbour's text is not named when its own template is absent."""
    for name, other in [("lgpl-3.0-notice", "gpl-3.0-notice"), ("agpl-3.0-header", "gpl-3.0-header"),
                        ("bsd-3-clause-whole", "bsd-2-clause-whole"), ("bsd-2-clause-whole", "bsd-3-clause-whole")]:
        scanner = licenses.Scanner({other: licenses.TEMPLATES[other]})
        assert scanner.scan(licenses.TEMPLATES[name]) == [], name


def test_licenses_against_every_block():
    """Anchors lose nothing against blocks at every word, and each named template ranks first that fits."""
    class Every(licenses.Scanner):
        def blocks(self, words):
            return {(s, len(t.words)) for t in self.templates for s in range(len(words))}

    names = ["apache-2.0-header", "gpl-3.0-header", "lgpl-3.0-header", "cc-by-sa-4.0-notice", "mit-notice", "bsd-text"]
    some = {n: licenses.TEMPLATES[n] for n in names}
    quick, slow = licenses.Scanner(some), Every(some)
    draw = np.random.default_rng(12)
    for _ in range(40):
        words = []
        for name in draw.choice(names, 2):
            part = some[name].split()
            for _ in range(int(draw.integers(0, 4))):
                at = int(draw.integers(0, len(part)))
                part[at:at + int(draw.integers(0, 2))] = [["other"], [], ["7"]][int(draw.integers(0, 3))]
            words += [f"w{x}" for x in draw.integers(0, 99, 4)] + part
        found, want = ([(m.license, m.start, m.missing, m.extra) for m in s.scan(" ".join(words))] for s in (quick, slow))
        assert found == want, words


# --- 3

def brute_targets(sizes, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] / total * left > epochs * sizes[s]]
        if not over:
            return target | {s: weight[s] / total * left for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())


def test_mix(spark):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), None, None if i % 10 == 0 else f"s{i % 10 if i % 2 else 1}", None, None, None)
            for i, n in enumerate(draw.integers(0, 90, 400))]
    df = documents(spark, rows)
    found = mixing.mix(df).collect()
    assert len(found) == df.count()
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed_rows(df).collect())
    assert max(copies.values()) <= 2 * 4 and not any(not (t or "").split() for _, t in copies)


# --- 4 and 6

def reference_ids(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs):
    rows = docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids), len(ids) > 1024)
                   for r, ids in zip(rows, reference_ids(BYTE_BPE, [r.text or "" for r in rows])))
    got = token_counts.token_counts(docs, BYTE_BPE, 1024)
    assert Counter(collected(got, "doc_id", "n_bytes", "n_tokens", "over_limit")) == want


def random_texts(n=3_000):
    draw = np.random.default_rng(7)
    signs = [chr(c) for c in range(1, 0x250)] + ["<|endoftext|>", "'s", " ", "́", "Σ", "ﬁ", "퟿"] + list("abC 1'<|") * 60
    return ["".join(draw.choice(signs, draw.integers(0, 50))) for _ in range(n)]


def test_random_texts_have_the_tokenizers_ids():
    texts = random_texts()
    for text, ids in zip(texts, reference_ids(BYTE_BPE, texts)):
        assert token_counts.count_tokens(text, BYTE_BPE) == len(ids), repr(text)
    for text, ids in zip(texts, reference_ids(WORD_BPE, texts)):
        assert token_files.encode(text, WORD_BPE) == np.array(ids, "<u4").tobytes(), repr(text)


def test_token_files(spark, docs, tmp_path):
    rows = docs.collect()
    got = token_files.token_files(docs, str(tmp_path / "t"), WORD_BPE, 1).orderBy("start").collect()
    ids = [i + [1] for i in reference_ids(WORD_BPE, [r.text or "" for r in rows])]
    want = Counter((r.doc_id, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan


# --- 5

def test_leaks(spark):
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 4))
    items = [" ".join(word() for _ in range(n)) for n in (3, 9, 20, 37, 59)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[4].split()
    edited[10] = "other"
    rows = [(i, f"{noise(40)} {t.upper()}, {noise(30)}") for i, t in enumerate(items)]
    rows += [(10, noise(900)), (11, None), (12, ""), (13, f"{noise(9_000)}\n{items[3]}"), (14, " ".join(edited)),
             (15, " ".join(items[3].split()[:20])), (0, f"{items[0]} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(items)] + [(200, None, 1), (201, "--", 1)],
                                  "item_id long, text string, start int")
    got = sorted(collected(decontamination.find_leaks(docs, bench), "doc_id", "item_id"))

    def best(text, item):
        a, b = decontamination.words_of(text), decontamination.words_of(item)
        bags = [decontamination._shingles(a[i:i + len(b)]) for i in range(len(a) - len(b) + 1)]
        return max((decontamination.similarity(x, decontamination._shingles(b)) for x in bags), default=0)

    want = sorted((d, 100 + i) for d, t in rows for i, x in enumerate(items) if t and best(t, x) >= 0.8)
    assert got == want and (14, 104) in got and (15, 103) not in got
    assert sorted(r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()) == [10, 11, 12, 15]


def brute_leaks(rows, items):
    """(document, item) pairs by comparing every window; a document shorter than the item is one."""
    found = []
    for d, text in rows:
        a = text.split()
        for i, item in enumerate(items):
            b = decontamination._shingles(item.split())
            size = len(item.split())
            bags = [decontamination._shingles(a[k:k + size]) for k in range(max(1, len(a) - size + 1))]
            if max(decontamination.similarity(x, b) for x in bags) >= 0.8:
                found.append((d, i))
    return sorted(found)


def test_leaks_close_to_the_limit(spark):
    draw = np.random.default_rng(8)
    fresh = lambda n: [f"w{x}" for x in draw.integers(0, 10**6, n)]
    items, rows = [], []
    for i in range(320):
        # 0.80 to 0.85: the window lacks a ninth to a twelfth of the shingles at one end.
        shingles = int(draw.choice([9, 18, 36, 90]))
        item = fresh(shingles + 4)
        lost = shingles // 9
        changed = item[:-lost] + fresh(lost) if i % 2 else fresh(lost) + item[lost:]
        items.append(" ".join(item))
        rows.append((i, " ".join(fresh(15) + changed + fresh(15))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = [(i, i) for i in range(320)]
    near = [(d, t) for d, t in rows if d < 20]
    assert brute_leaks(near, items[:20]) == want[:20]
    assert sorted(collected(decontamination.find_leaks(docs, bench), "doc_id", "item_id")) == want
    assert decontamination.drop_leaks(docs, bench).count() == 0


def test_leaks_in_documents_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(37)]
    cut = [words[:-1], words[1:], words[:35] + words[36:], words[:34], words[:20], words[:3], words[:18] + words[19:]]
    rows = [(i, " ".join(w)) for i, w in enumerate(cut)]
    items = [" ".join(words), " ".join(words[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_leaks(rows, items)
    assert [d for d, i in want if i == 0] == [0, 1, 2, 3]
    assert sorted(collected(decontamination.find_leaks(docs, bench), "doc_id", "item_id")) == want
    assert [r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()] == [5]


def test_window_prints_match_whole_fingerprints():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    starts = np.array([0, 5, 6, 250])
    got = decontamination.window_prints(keys, starts, 40)
    assert [int(np.uint64(simhash.fingerprint(keys[s:s + 40]) & (2**64 - 1))) for s in starts] == got.tolist()


# --- 7

def test_top_k(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in draw.normal(size=6).astype(np.float32)]) for i in range(700)]
    rows += [(50, rows[50][1]), (9_000, None), (9_001, [1.0, None]), (9_002, [float("nan")]), (9_003, []),
             (9_004, [0.5, 0.25]), (9_005, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collected(topk.top_k(df, df.filter("vec_id % 50 = 0"), 5), "query_id", "rank", "vec_id", "score")
    whole = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(256 * x)) for x in v]
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert sorted(got) == sorted(want)


def test_top_k_of_many_shelves(spark, monkeypatch):
    """The first shelf's scores prune the others; large components are summed exactly."""
    monkeypatch.setattr(topk, "SHELF_ROWS", 60)
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.integers(-3, 4, 4) / 256]) for i in range(400)]
    rows += [(500, [1e30, 1.0, 0.0, 0.0]), (501, [2.0 ** 27, 2.0 ** 27 + 0.5, 1.0, 3.0]), (550, [2.0 ** 20, 1.0, 2.0, 3.0]),
             (502, [-1e30, 2.0, 0.0, 0.0]), (503, [1e307, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(topk.top_k(df, df.filter("vec_id % 50 = 0"), 5), "query_id", "rank", "vec_id", "score")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i != 503}
    near = lambda s: min(max(s, -2**63), 2**63 - 1)
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-near(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert sorted(got) == sorted(want)


def test_top_k_rows_hold_one_vector(spark, monkeypatch):
    """No table has rows of whole shelves, and many rows of one id are dealt over shelves."""
    monkeypatch.setattr(topk, "SHELF_ROWS", 60)
    monkeypatch.setattr(topk, "PART_ROWS", 3)
    written, write = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df: written.append(write(df)) or written[-1])
    rows = [(7, [i / 256, 1.0]) for i in range(300)] + [(50 * i, [1.0, i / 256]) for i in range(8)] * 2 + [(7, [1.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.filter("vec_id % 50 = 0"), 3)
    whole = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows}
    want = []
    for q, w in ((i, v) for i, v in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:3])]
    assert sorted(collected(found, "query_id", "rank", "vec_id", "score")) == sorted(want)
    assert all(kind != "binary" for made in written for _, kind in made.dtypes)
    assert "shelf" not in [name for made in written for name in made.columns]


def test_blocks_are_pruned():
    draw = np.random.default_rng(4)
    matrix = np.concatenate([draw.normal(10 * (i % 4 == 0), 1, (topk.BLOCK_ROWS, 8)) for i in range(20)])
    queries, ids = np.abs(draw.normal(size=(3, 8))), np.arange(len(matrix))
    found, scores, scored = topk.search_block(queries, np.array([-1, -2, -3]), ids, matrix, 5)
    order = np.argsort(-(queries @ matrix.T), axis=1, kind="stable")[:, :5]
    assert (found == order).all() and scored < 0.5 * queries.shape[0] * len(matrix)


# --- 8

def test_toxicity(spark):
    draw = np.random.default_rng(8)
    clean = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "ne", "ti", "su", "vo")]

    def text(i):
        words = list(draw.choice(clean, 40))
        for n in range(1 + i % 6 if i % 3 == 0 else 0):
            words[n * 6] = ("idiot", f"vequ{draw.choice(clean)}")[n % 2]
        return " ".join(words)

    rows = [(i, text(i)) for i in range(400)] + [(1_000, None), (1_001, ""), (None, text(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    found = {r.doc_id: r for r in toxicity.score_texts(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(300, 400)]
    assert np.mean([(found[i].p_toxic >= 0.5) == (i % 3 == 0) for i in held]) > 0.95
    assert found[305].severity < found[303].severity
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert {1_000, 1_001, 301, 302} <= kept and 303 not in kept and None not in kept
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.keep_clean(docs, nothing).count() == len(rows)


def test_toxicity_sample_is_bounded_by_rows(spark):
    """An id on a third of the rows trains once; long texts and further columns do no harm."""
    rows = [(7, f"bad word {i}") for i in range(300)] + [(i, "clean " * (20_000 if i == 20 else 3)) for i in range(20, 620)]
    docs = spark.createDataFrame([(d, t, 1, 1, "x") for d, t in rows], "doc_id long, text string, toxic int, __n int, sig string")
    labels = spark.createDataFrame([(7, 1, 1)] * 5 + [(i, 1, int(i < 40)) for i in range(20, 620)],
                                   "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels, toxicity.Limits(toxic_rows=30, clean_rows=50)).collect()
    ids = [r.doc_id for r in sample]
    assert len(ids) == len(set(ids)) <= 80 and all(r.text == "bad word 0" for r in sample if r.doc_id == 7)
    assert toxicity.keep_clean(docs, toxicity.fit(docs, labels)).columns == docs.columns


# --- 9

def test_language_sample_is_bounded_by_rows(spark):
    """An id on a third of the rows counts once; predictions still come for each row."""
    rows = [(4, "the and wing " * 5, "aa", 1)] * 200 + [
        (i, ("the and wing " if i % 2 else "sch ung keit ") * 9, "aa" if i % 2 else "bb", 1) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, parts int")
    net = language.fit(docs, language.Limits(rows_per_lang=160))
    got = language.predict_languages(docs, net).collect()
    assert len(got) == len(rows)
    assert np.mean([r.lang_pred == ("aa" if r.doc_id % 2 or r.doc_id == 4 else "bb") for r in got]) > 0.95


def test_language(spark):
    draw = np.random.default_rng(6)
    parts = {"aa": ["the", "ing", "wh", "and"], "bb": ["sch", "ung", "über", "keit"], "cc": ["ción", "ñ", "ez", "los"]}
    rows = []
    for i in range(450):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(draw.choice(parts[lang], 3)) for _ in range(1 + i % 60)), lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "12 !?", "bb", "s"), (902, "", None, "s"), (None, "thewhing", None, None),
             (903, "schung " * 5_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language.predict_languages(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [by_id[i].lang_pred == rows[i][2] for i in range(450) if by_id[i].held_out]
    assert np.mean(right) > 0.95
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.predict_languages(docs, language.fit(docs.limit(0))).collect()} == {"und"}


# --- 10

def brute_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_values(n, radius, seed):
    """Fingerprints in chains and clusters around the radius, and some alone."""
    draw = np.random.default_rng(seed)
    out = [int(x) for x in draw.integers(0, 1 << 63, n // 3)]
    while len(out) < n:
        flips = draw.choice(64, draw.integers(1, 2 * radius + 1), replace=False)
        out.append(out[draw.integers(len(out))] ^ sum(1 << int(b) for b in flips))
    return sorted(set(out))


@pytest.mark.parametrize("radius", [1, 4, 8])
def test_trie_groups(radius):
    values = near_values(600, radius, radius)
    got = simhash.trie_groups(np.array(values, np.uint64), 0, radius)
    assert got.tolist() == brute_components(values, radius)


@pytest.mark.parametrize("radius, hot", [(4, 1 << 18), (4, 20), (8, 1 << 18)])
def test_links_join_the_same_components(spark, radius, hot):
    values = near_values(300, radius, 40 + radius)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, hot)
    roots = dict(collected(components.components(links), "node", "root"))
    mine, want = [roots.get(v, v) for v in signed], brute_components(values, radius)
    first = {}
    assert all(first.setdefault(a, b) == b for a, b in zip(mine, want))
    assert len(set(mine)) == len(set(want))


def test_simhash_components(spark, docs):
    rows = docs.collect()

    def fp(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not words:
            return 0
        shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    values = [fp(r.text) for r in rows]
    groups = brute_components(values, 4)
    least = {}
    for r, g in zip(rows, groups):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = simhash.simhash_components(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component) for r in got) == Counter(
        (r.doc_id, v, least.get(g)) for r, v, g in zip(rows, values, groups)
    )


def test_trie_forest():
    values = sorted(near_values(400, 6, 9))
    ends = simhash.trie_forest(np.array(values, np.uint64), 0, 6)
    assert all((values[a] ^ values[b]).bit_count() <= 6 for a, b in ends.T.tolist())
    root = simhash.trie_groups(np.array(values, np.uint64), 0, 6)
    # A forest: one link less than members for each group, and no link between groups.
    assert ends.shape[1] == len(values) - len(set(root.tolist()))
    assert (root[ends[0]] == root[ends[1]]).all()


def five_word_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_dedup(spark, docs):
    draw = np.random.default_rng(12)
    extra, at = [], 1_000
    for family in range(25):
        base = [f"w{x}" for x in draw.integers(0, 5_000, 200)]
        for copy in range(8):
            words = list(base)
            # Up to 12 edits: similarities on either side of 0.8, to the base and among copies.
            for place in draw.choice(200, int(draw.integers(0, 13)) if copy else 0, replace=False):
                words[place] = f"x{draw.integers(0, 10**9)}"
            extra.append((at, " ".join(words), "en", "s", None, None, None))
            at += 1
    table = docs.union(spark.createDataFrame(extra, SCHEMA))
    rows = table.collect()
    sets = [five_word_set(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        order = (r.doc_id is None, r.doc_id)
        least[find(i)] = min(least.get(find(i), order), order)
    kept = near_dedup.near_dedup(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id is None or r.doc_id for r in kept.collect()) == sorted(
        late or k for late, k in least.values()
    )


def brute_groups(texts):
    """Smallest position of each text's group, from all pairs."""
    sets = [five_word_set(t) for t in texts]
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root.tolist()


def kept_of(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in near_dedup.near_dedup(table).collect())


@pytest.mark.parametrize("few", [near_dedup.FEW_LINKS, 0])
def test_near_dedup_of_a_family_without_its_original(spark, few, monkeypatch):
    monkeypatch.setattr(near_dedup, "FEW_LINKS", few)
    draw = np.random.default_rng(3)
    base = [f"w{x}" for x in draw.integers(0, 5_000, 200)]
    texts = []
    for _ in range(400):
        words = list(base)
        for place in draw.choice(200, 3, replace=False):
            words[place] = f"x{draw.integers(0, 10**9)}"
        texts.append(" ".join(words))
    assert kept_of(spark, texts) == sorted(set(brute_groups(texts)))


def test_near_dedup_of_blocks(spark):
    draw = np.random.default_rng(4)
    fresh = lambda n: [f"w{x}" for x in draw.integers(0, 10**6, n)]
    texts = []
    for size in (60, 200, 600):
        for i in range(120):
            base, add = fresh(size), int(size * draw.uniform(0.17, 0.26))
            at = int(draw.integers(1, size))
            other = [base + fresh(add), fresh(add) + base, base[:at] + fresh(add) + base[at:], base[:size - add * 4 // 5]][i % 4]
            texts += [" ".join(base), " ".join(other)]
    want = sorted(set(brute_groups(texts)))
    assert 360 < len(want) < 720 - 90
    assert kept_of(spark, texts) == want


# --- all of them

def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    frames = [
        sharding.assign_shards(none, 24), licenses.scan_licenses(none), mixing.mix(none), mixing.mixed_rows(none),
        token_counts.token_counts(none, BYTE_BPE, 1024), decontamination.find_leaks(none, bench),
        decontamination.drop_leaks(none, bench), token_files.token_files(none, str(tmp_path / "e"), WORD_BPE, 1),
        topk.top_k(vectors, vectors, 5), language.predict_languages(none, language.fit(none)),
        simhash.simhash_components(none), near_dedup.near_dedup(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_texts(none, toxicity.fit(none, labels), ["doc_id"]).count() == 0


def test_token_files_are_read_in_the_order_of_their_numbers(spark):
    names = spark.createDataFrame([("part-99999-x.zstd.parquet",), ("part-100000-x.zstd.parquet",), ("part-00007-x.parquet",)], "name string")
    got = [r[0] for r in names.orderBy(token_files.part_number(F.col("name"))).select(token_files.part_number(F.col("name"))).collect()]
    assert got == [7, 99_999, 100_000]


def test_token_ids_are_not_shuffled_to_meet_the_file_table(spark, docs, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"), WORD_BPE, 1)
    read = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert "Exchange hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_a_frequent_shingle_meet_once_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL_NODES", 4, raising=False)
    held = {1: range(30), 2: range(20, 50), 3: [7]}
    tokens = spark.createDataFrame([(s, n) for s, nodes in held.items() for n in nodes], "shingle long, node long")
    about = spark.createDataFrame([(n, 10 + n % 5, 3 * n) for n in range(50)], "node long, n long, fp long")
    roots = spark.createDataFrame([(n, 0) for n in range(0, 50, 7)], "node long, root long")
    root = {n: 0 if n % 7 == 0 else n for n in range(50)}
    want = [
        (a, b, root[a], root[b], 10 + a % 5, 10 + b % 5, (3 * a ^ 3 * b).bit_count())
        for nodes in held.values() for a in nodes for b in nodes
        if a < b and root[a] != root[b] and min(a % 5, b % 5) + 10 >= 0.8 * (max(a % 5, b % 5) + 10)
    ]
    assert sorted(map(tuple, near_dedup._apart(tokens, about, roots, 0.8).collect())) == sorted(want)


def test_best_pairs_are_folded_in_a_hash_table(spark):
    rng = random.Random(5)
    pairs = [(a, b, a % 7, b % 5 + 10, rng.randrange(1, 60), rng.randrange(1, 60), rng.randrange(64))
             for a in range(30) for b in range(30, 60)]
    table = spark.createDataFrame(pairs, "a long, b long, ra long, rb long, na long, nb long, bits int")
    best = near_dedup._best(table.repartition(3), ["ra", "rb"])
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    found = set(map(tuple, best.collect()))
    assert found <= {(a, b, na, nb) for a, b, _, _, na, nb, _ in pairs}
    rank = {(a, b): (bits, int(abs(na - nb) / (na + nb) * (1 << 23))) for a, b, _, _, na, nb, bits in pairs}
    got = {(a, b) for a, b, _, _ in found}
    for end in {p[2] for p in pairs} | {p[3] for p in pairs}:
        of_end = [p[:2] for p in pairs if end in p[2:4]]
        least = min(rank[p] for p in of_end)
        assert any(rank[p] == least for p in of_end if p in got)


def test_near_groups_leaves_no_shuffle_files(spark):
    """Files of ended queries would add up to several times the input."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {
            name for folder in local.localDirsString() for _, _, names in os.walk(folder)
            for name in names if name.startswith("shuffle_")
        }

    before, setting = files(), spark.conf.get(Scratch.CLEANUP, None)
    table = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(60)], "doc_id long, text string")
    found = near_dedup.near_groups(table)
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert found.select("root").distinct().count() == 30
    assert spark.conf.get(Scratch.CLEANUP, None) == setting


@pytest.mark.parametrize("before", [64, 3, 0])
def test_pairs_meet_for_their_first_shared_shingle(spark, before, monkeypatch):
    """Copies far from each other made a row for every two of them and each shingle they share."""
    monkeypatch.setattr(near_dedup, "BEFORE", before, raising=False)
    draw, sets = np.random.default_rng(6), []
    for edits in (2, 4, 9):
        base = [f"w{x}" for x in draw.integers(0, 5_000, 200)]
        for _ in range(40):
            words = list(base)
            for place in draw.choice(200, edits, replace=False):
                words[place] = f"x{draw.integers(0, 10**9)}"
            sets.append(simhash.shingle_hashes(" ".join(words), 5, distinct=True))
    none = np.array([], np.uint64), np.array([], np.int64)
    firsts = [near_dedup.prefix(s, 0.8, none).view(np.int64).tolist() for s in sets]
    nodes = spark.createDataFrame(list(enumerate(firsts)), "node long, prefix array<bigint>")
    about = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node long, n long, fp long")
    roots = spark.createDataFrame([], "node long, root long")
    tokens = near_dedup._placed(near_dedup._tokens(nodes, roots))
    met = [(r.a, r.b) for r in near_dedup._apart(tokens, about, roots, 0.8).collect()]
    shared = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    alike = {
        (i, j) for j in range(len(sets)) for i in range(j)
        if shared(i, j) >= 0.8 * (len(sets[i]) + len(sets[j]) - shared(i, j))
    }
    assert len(alike) > 700 and alike <= set(met)
    if before == 64:
        each = sum(len(set(firsts[i]) & set(firsts[j])) for j in range(len(sets)) for i in range(j))
        assert len(met) == len(set(met)) < each / 10


def test_central_pairs_grow_with_the_tokens(spark):
    tokens = spark.createDataFrame([(s, n, s) for s in range(3) for n in range(200)], "shingle long, node long, at int")
    about = spark.createDataFrame([(n, 50, 1 if n == 77 else 9) for n in range(200)], "node long, n long, own long")
    roots = spark.createDataFrame([(5, 77), (77, 77)], "node long, root long")
    pairs = near_dedup._central(tokens, about, roots, 0.8, 1).collect()
    # All meet the node with the fewest shingles of its own, but for one of its group.
    assert sorted((r.a, r.b) for r in pairs) == sorted((min(n, 77), max(n, 77)) for n in range(200) if n not in (5, 77))
