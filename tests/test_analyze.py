"""The stored report after changes, against a report built anew."""

import glob
import os

from conftest import rows
from pyspark.sql import functions as F

from postvet.operators import scam, usage
from postvet.plans import analyze

UPLOADS = "posting_id long, text string, file_name string"
PAGES = "page_id long, html string"
OFFERS = "posting_id long, pay double, peer string"


def tables(spark, uploads, pages):
    return analyze.handed_in(spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(pages, PAGES))


def files(path):
    """Data files by bucket."""
    return {
        os.path.basename(folder): sorted(os.listdir(folder)) for folder in glob.glob(f"{path}/bucket=*")
    }


def shown(spark, path, offers):
    df = analyze.read_analysis(spark, path, spark.createDataFrame(offers, OFFERS))
    return sorted(rows(df.withColumn("flags", F.array_join("flags", "; "))), key=str)


def test_refresh_rewrites_what_changed_only(spark, tmp_path):
    path = str(tmp_path / "report")
    uploads = [(i, f"A plain posting number {i} at mail{i}@gmail.com, call +1 555 123 4567", None) for i in range(60)]
    uploads += [(100, "", "cv.pdf"), (101, "", None), (102, None, None)]
    pages = [(i, f"<p>Wire transfer &amp; hurry {i}</p>") for i in range(20)] + [(50, None), (51, "<b></b>")]
    offers = [(i, 10.0 if i else 900.0, "p") for i in range(60)]
    analyze.refresh(tables(spark, uploads, pages), path, buckets=16)
    first, before = shown(spark, path, offers), files(path)
    assert {r[0] for r in first} == (
        {f"pasted:{i}" for i in range(60)} | {"pasted:100"} | {f"url:{i}" for i in range(20)}
    )
    assert all("gmail" not in r[4] and "555" not in r[4] for r in first)
    by_key = {r[0]: r for r in first}
    assert "Generic Email Domain (@gmail.com)" in by_key["pasted:3"][5]
    assert scam.SALARY_FLAG in by_key["pasted:0"][5] and scam.SALARY_FLAG not in by_key["url:0"][5]
    assert scam.PAYMENT_FLAG in by_key["url:7"][5]

    # Nothing changed: no file is touched.
    analyze.refresh(tables(spark, uploads, pages), path, buckets=16)
    assert files(path) == before

    # One text changed: its bucket alone is rewritten.
    uploads[5] = (5, "Pay a deposit to apply", None)
    analyze.refresh(tables(spark, uploads, pages), path, buckets=16)
    after = files(path)
    assert set(after) == set(before)
    assert sum(after[b] != before[b] for b in before) == 1

    # Rows that go, come back, get a file, and new ones: as if built anew.
    gone = [u for u in uploads if u[0] not in (1, 2, 100)]
    analyze.refresh(tables(spark, gone, pages[1:]), path, buckets=16)
    assert "pasted:1" not in {r[0] for r in shown(spark, path, offers)}
    back = gone + [(1, "back again", "x.pdf"), (200, "new", None)]
    back[0] = (0, back[0][1], "with.pdf")
    analyze.refresh(tables(spark, back, pages), path, buckets=16)
    anew = str(tmp_path / "anew")
    analyze.refresh(tables(spark, back, pages), anew, buckets=16)
    assert shown(spark, path, offers) == shown(spark, anew, offers)


def test_everything_goes_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "report")
    analyze.refresh(tables(spark, [(1, "a text", None)], [(1, "<p>x</p>")]), path)
    assert len(shown(spark, path, [])) == 2
    analyze.refresh(tables(spark, [], []), path)
    assert shown(spark, path, []) == []
    analyze.refresh(tables(spark, [(1, "a text", None)], []), path)
    assert [r[0] for r in shown(spark, path, [])] == ["pasted:1"]


def test_limits_count_when_the_report_is_read(spark, tmp_path):
    path = str(tmp_path / "report")
    analyze.refresh(tables(spark, [(i, f"text {i}", None) for i in range(4)], []), path)
    for top in range(4):
        offers = [(i, 100.0 if i == top else 1.0, "p") for i in range(4)]
        flagged = [r[0] for r in shown(spark, path, offers) if scam.SALARY_FLAG in r[5]]
        assert flagged == [f"pasted:{top}"]


def test_content_tells_text_from_file_name(spark):
    got = tables(spark, [(1, "ab", "c"), (2, "a", "bc"), (3, "abc", None), (4, "abc", "")], [])
    marks = {r.id: r.content for r in got.collect()}
    assert len({marks[1], marks[2], marks[3]}) == 3 and marks[3] == marks[4]


def test_profile_card(spark):
    completion = spark.createDataFrame([(1, 50.0), (2, 100.0)], "user_id long, completion double")
    used = spark.createDataFrame([(2, 4, 1), (3, 9, 0)], "user_id long, scans long, verified long")
    skills = spark.createDataFrame([(2, 0, "a"), (2, 1, "b")], "user_id long, pos long, skill string")
    card = usage.profile_card(completion, used, usage.user_rank(used), skills)
    assert sorted(rows(card)) == [
        (1, None, 50.0, 0, 0, 0), (2, 2, 100.0, 4, 1, 2), (3, 1, 0.0, 9, 0, 0),
    ]
