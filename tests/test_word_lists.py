"""Word lists as tables: brute force, order of mail domains, long lists."""

import random

from conftest import rows
from pyspark.sql import functions as F

from postvet.operators import word_lists

ENTRIES = "list string, entry string"
POSTINGS = "posting_id long, text string"


def hits(spark, texts, entries):
    posts = spark.createDataFrame(list(enumerate(texts)), POSTINGS)
    return sorted(rows(word_lists.listed_phrase_hits(posts, spark.createDataFrame(entries, ENTRIES))))


def test_phrases_count_at_every_place(spark):
    texts = ["Pay now, pay NOW! pay", "a a a", None, "", "wire-transfer of a wire", "nothing"]
    entries = [("p", "pay now"), ("p", "pay"), ("u", "now pay"), ("p", "a a"), ("u", "wire transfer"), ("u", "--"), ("u", None),
               ("p", "pay")]
    assert hits(spark, texts, entries) == [(0, "p", 5), (0, "u", 2), (1, "p", 2), (4, "u", 1)]


def test_phrases_against_every_run(spark):
    draw = random.Random(4)
    word = lambda: draw.choice("abcd")
    texts = [" ".join(word() for _ in range(draw.randint(0, 30))) for _ in range(40)]
    entries = sorted({(draw.choice("xy"), " ".join(word() for _ in range(draw.randint(1, 6)))) for _ in range(60)})
    want = {}
    for n, text in enumerate(texts):
        tokens = text.split()
        for name, entry in entries:
            size = len(entry.split())
            found = sum(tokens[i:i + size] == entry.split() for i in range(len(tokens)))
            if found:
                want[n, name] = want.get((n, name), 0) + found
    assert hits(spark, texts, entries) == sorted((*k, n) for k, n in want.items())


def test_a_long_list_is_no_part_of_the_plan(spark):
    entries = spark.range(100_000).select(F.lit("p").alias("list"), F.concat(F.lit("w"), "id").alias("entry"))
    posts = spark.createDataFrame([(1, "w5 w99999 w100000 w5")], POSTINGS)
    found = word_lists.listed_phrase_hits(posts, entries)
    assert rows(found) == [(1, "p", 3)]
    assert "w4711" not in found._jdf.queryExecution().toString()


def test_mail_domains_in_order(spark, shuffle_joins):
    posts = spark.createDataFrame([
        (1, "a@work.com b@Free.COM c@other.net"), (2, "x@work.com"), (3, "none"), (4, None), (5, "q@other.net q@free.com"),
    ], POSTINGS)
    listed = spark.createDataFrame([("free.com",), ("OTHER.net",), ("free.com",), (None,)], "domain string")
    assert sorted(rows(word_lists.listed_mail_flags(posts, listed))) == [
        (1, 3, "free.com", True), (2, 1, None, False), (5, 2, "other.net", True),
    ]
    assert rows(word_lists.listed_mail_flags(posts.limit(0), listed)) == []
