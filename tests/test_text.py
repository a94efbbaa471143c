import pytest
from pyspark.sql import functions as F

from postvet.functions import text as T


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("\t x \n", "x"), ("﻿a ", "a"), (" ", ""), ("a b", "a b"), (None, None),
])
def test_browser_trim(spark, raw, want):
    assert one(spark, raw, T.browser_trim) == want


@pytest.mark.parametrize("raw, want", [
    ("", "none"), (None, "none"), ("x", "x"), (" ", " "),
])
def test_or_default(spark, raw, want):
    assert one(spark, raw, lambda c: T.or_default(c, "none")) == want


def test_words(spark):
    assert one(spark, "Ünder-stand, C3PO!  x", T.words) == ["ünder", "stand", "c3po", "x"]
    assert one(spark, "...", T.words) == []
    assert one(spark, None, T.words) is None


@pytest.mark.parametrize("n, want", [
    (1, ["a", "b"]),
    (2, ["a", "b", "a b", "b a"]),
    (3, ["a", "b", "a b", "b a", "a b a"]),
    (9, ["a", "b", "a b", "b a", "a b a"]),
])
def test_phrases(spark, n, want):
    df = spark.createDataFrame([(["a", "b", "a"],)], "w array<string>")
    assert df.select(T.phrases("w", n)).first()[0] == want


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([([],)], "w array<string>")
    assert df.select(T.phrases("w", 3)).first()[0] == []
    with pytest.raises(ValueError):
        T.phrases("w", 0)


@pytest.mark.parametrize("raw, want", [
    ("write to Jo.Doe@Gmail.com or b@x.co.uk.", ["gmail.com", "x.co.uk"]),
    ("a@b.com_x@c.com", ["b.com", "c.com"]),
    ("a@b no", []),
    ("@home", []),
    ("none", []),
])
def test_email_domains(spark, raw, want):
    assert one(spark, raw, T.email_domains) == want


def test_long_runs_stay_fast(spark):
    junk = "a" * 200_000
    assert one(spark, junk + " @ x@y.zz", T.email_domains) == ["y.zz"]
    assert one(spark, junk, lambda c: F.regexp_count(c, F.lit(T.NUMBER_WORD))) == 0
    assert one(spark, junk.upper(), lambda c: F.regexp_count(c, F.lit(T.CAPS_WORD))) == 1
    assert one(spark, "<script " * 2_000, lambda c: F.length(T.html_text(c))) > 0


@pytest.mark.parametrize("raw, want", [
    ("ACT NOWx ABCD abcD XABCDx 1ABCD ABCD", 2), ("ÄÖÜÄ", 1), ("ABC", 0), ("", 0),
])
def test_caps_words(spark, raw, want):
    assert one(spark, raw, lambda c: F.regexp_count(c, F.lit(T.CAPS_WORD))) == want


@pytest.mark.parametrize("raw, want", [("a1 2 b c33c4 ½x", 4), ("abc", 0), ("a-1-2", 2)])
def test_number_words(spark, raw, want):
    assert one(spark, raw, lambda c: F.regexp_count(c, F.lit(T.NUMBER_WORD))) == want


@pytest.mark.parametrize("raw, want", [
    ("Act  now! ACT\nNOW, react nowhere; urgent", 3), ("urgently", 0), ("", 0), (None, None),
])
def test_phrase_hits(spark, raw, want):
    assert one(spark, raw, lambda c: T.phrase_hits(c, ["act now", "urgent"])) == want


@pytest.mark.parametrize("bad", [[], ["  "]])
def test_phrase_list_is_checked(spark, bad):
    with pytest.raises(ValueError):
        T.phrase_hits(F.lit("x"), bad)


def test_long_lists_and_signs(spark):
    many = [f"word{i}" for i in range(5_000)] + ["$500 deposit"]
    assert one(spark, "Send a $500  deposit to word77.", lambda c: T.phrase_hits(c, many)) == 2
    assert one(spark, "C++, C# and .NET. Go net.", T.skill_words) == ["c++", "c#", "and", ".net", "go", "net"]


def test_less_than_is_text(spark):
    assert one(spark, "a < b and c > d<br/>e", T.html_text) == "a < b and c > d e"


def test_html_text(spark):
    html = (
        "<html><style>p{}</style><SCRIPT>var a='<p>';</SCRIPT><!-- x <b> --><body>"
        "<p>Pay &amp;  perks&nbsp;&lt;b&gt;</p>\n<p>&quot;Now&#39;</p></body>"
    )
    assert one(spark, html, T.html_text) == "Pay & perks <b> \"Now'"
    assert one(spark, "&amp;lt;", T.html_text) == "&lt;"


@pytest.mark.parametrize("raw, want", [
    ("mail a@b.com, call +1 (555) 555-1234.", "mail [email], call [phone]."),
    ("on 2024 and 123456", "on 2024 and 123456"),
    ("call 555-1234", "call [phone]"),
    ("card 1234567890123456", "card [phone]"),
    ("id a5551234567", "id a5551234567"),
    ("+5551234567", "[phone]"),
    ("++5551234567", "++5551234567"),
])
def test_masked(spark, raw, want):
    assert one(spark, raw, T.masked) == want


def test_same_text_key(spark):
    a, b, c = (one(spark, t, T.same_text_key) for t in ("Pay NOW!", "pay, now", "now pay"))
    assert a == b != c


def test_references_as_the_standard_library_reads_them(spark):
    """Every name, with and without semicolon, and numbers in both bases."""
    import html as standard

    raw = [f"x&{name} y" for name in standard.entities.html5] + [f"&{name}z" for name in T.OPEN_NAMES]
    numbers = [9, 39, 65, 128, 130, 150, 159, 163, 8211, 8364, 0xD800, 0xDFFF, 0x110000, 0x1F600, 0, 10**30]
    raw += [f"a&#{n};b" for n in numbers] + [f"a&#x{n:X}z;" for n in numbers] + [f"&#{n} &#x{n:x};" for n in numbers]
    raw += ["", "&", "&&", "a & b", "&;", "&#;", "&#x;", "&#xg", "&nosuch;", "&amp;amp;", "&amplt;", "&notit;", "&amp", "a&"]
    df = spark.createDataFrame([(r,) for r in raw] + [(None,)], "raw string")
    got = {r.raw: r.out for r in df.select("raw", T.references_decoded(F.col("raw")).alias("out")).collect()}
    assert got.pop(None) is None
    assert {r for r in raw if got[r] != standard.unescape(r)} == set()


@pytest.mark.parametrize("raw, want", [
    ("a<!-- x > <b> y", "a"), ("a<script>if (a < b) {} </b>", "a"), ("a<style>p{}", "a"),
    ("<a title=\"x > y\" href='<b>'>z</a>", "z"), ("a <b c d", "a <b c d"), ("<!-- <script> -->b", "b"),
    ("<p it's>x</p> isn't", "x isn't"), ("&pound;5 &#8211; &#x20AC;6", "\u00a35 \u2013 \u20ac6"),
    ("<script><!-- </script>k", "k"), ("<?xml v='1'?>x", "x"),
])
def test_markup(spark, raw, want):
    assert one(spark, raw, T.html_text) == want


@pytest.mark.parametrize("piece", ["<!--", "<script>", "<a b='", "<a =\"<", "<b ", "<", "&", "&#", "<a x=1 "])
def test_unclosed_markup_takes_linear_time(spark, piece):
    import time

    start = time.time()
    one(spark, piece * 100_000, T.html_text)
    assert time.time() - start < 20
