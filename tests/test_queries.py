"""The registered queries: against their SQL twins, and the shape of their plans."""

import os
import sys

import duckdb
import pytest
from conftest import FOLDER

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

QUERIES, ORACLES = dict(entry.REGISTRY), dict(entry.ORACLES)
NO_SQL = {"ml_risk_score", "ml_risk_out_of_fold"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def built(spark):
    """Build each query once; its plan and its rows are checked separately."""
    frames = {}

    def build(name):
        if name not in frames:
            frames[name] = QUERIES[name](spark, FOLDER)
        return frames[name]

    return build


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(built, db, name):
    got, want = built(name).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert check.rows(got) == check.rows(want)


# These cover every kind of join in the jobs.
@pytest.mark.parametrize("name", [
    "salary_outliers", "pros_cons", "text_similarity", "scan_quota", "chat_turn_pairs",
    "profile_skills", "extract_skills", "analysis_report",
])
def test_same_without_broadcasts(spark, db, shuffle_joins, name):
    df = QUERIES[name](spark, FOLDER)
    assert "BroadcastHashJoin" not in plan(df)
    assert check.rows(df.toPandas()) == check.rows(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"ml_risk_score"}))
def test_plan_has_no_product_and_no_row_python(built, name):
    text = plan(built(name))
    for part in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert part not in text
    # One window runs unpartitioned: the ranks of the distinct scan counts.
    assert ("SinglePartition" in text) == (name in {"user_rank", "profile_card"})


@pytest.mark.parametrize("name", ["limited_history", "best_jobs", "keyword_suggestions", "pros_cons",
                                  "text_similarity", "vector_match", "scan_quota"])
def test_top_k_is_limited_before_the_exchange(built, name):
    assert "Partial" in [
        line.rsplit(", ", 1)[-1] for line in plan(built(name)).splitlines()
        if "WindowGroupLimit" in line
    ]


def nodes(node):
    """All nodes of a logical plan."""
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


@pytest.mark.parametrize("name", ["scam_flags", "company_deep_dive", "team_dashboard"])
def test_joins_carry_no_texts(built, name):
    joins = [n for n in nodes(built(name)._jdf.queryExecution().optimizedPlan())
             if n.nodeName() == "Join"]
    assert joins
    for join in joins:
        assert "text#" not in join.output().mkString(",")


def test_limits_meet_no_texts(spark):
    """Postings that carry their pay are read before the limits are joined."""
    from postvet.operators import scam

    postings = spark.createDataFrame(
        [(i, "text of a posting", float(i), "p") for i in range(9)], "posting_id long, text string, pay double, peer string"
    )
    plan_ = scam.scam_flags(postings)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes(plan_) if n.nodeName() == "Join"]
    assert joins and not any("text#" in j.output().mkString(",") for j in joins)
    assert sorted(r.posting_id for r in scam.scam_flags(postings).filter("salary").collect()) == sorted(
        r.posting_id for r in scam.salary_outliers(postings).collect()
    )


def test_scans_read_only_what_they_need(built):
    text = plan(built("user_usage"))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    text = plan(built("purge_records"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-10T00:00)" in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["posting_id", "resume_id", "company_id", "band"]
    assert df.count() >= 200


def test_nested_report(spark):
    from postvet.plans.registry import full_report
    from postvet.sources.bindings import Fixtures

    report = full_report(Fixtures(spark, FOLDER))
    kinds = {f.name: f.dataType.simpleString() for f in report.schema}
    assert kinds["scam_analysis"] == "struct<verdict:string,score:int,flags:array<string>>"
    assert kinds["company_verification"] == (
        "struct<is_verified:boolean,domain_age:string,domain_age_days:int,online_presence:string>"
    )
    assert kinds["reviews"] == (
        "struct<sentiment:string,score:double,summary:string,pros:string,cons:string>"
    )
    assert kinds["resume_match"] == "struct<match_percentage:double,missing_skills:array<string>>"
    # One row per submission, and one for each posting without any.
    fixtures = Fixtures(spark, FOLDER)
    pairs, headers = fixtures.submissions(), fixtures.headers()
    met = pairs.join(headers, "posting_id", "left_semi").count()
    assert report.count() == met + headers.join(pairs, "posting_id", "left_anti").count()
    assert report.filter("resume_id IS NOT NULL").count() == met


def test_report_shuffles_no_matches(spark, shuffle_joins):
    """Names of missing skills meet the postings where they are made: no exchange carries them."""
    from postvet.operators import resume
    from postvet.plans import report

    def empty(columns):
        return spark.createDataFrame([(None,) * len(columns)], ", ".join(f"{c} {k}" for c, k in columns.items()))

    matches = resume.match_percentage(
        empty({"resume_id": "bigint", "posting_id": "bigint"}), empty({"resume_id": "bigint", "skill": "string"}),
        empty({"posting_id": "bigint", "skill": "string"}),
    )
    found = empty({"posting_id": "bigint", "band": "string", "verdict": "string", "score": "int", "flags": "array<string>"})
    panels = empty({
        "company_id": "bigint",
        "company_verification": "struct<is_verified: boolean, domain_age: string, domain_age_days: int, online_presence: string>",
        "reviews": "struct<sentiment: string, score: double, summary: string, pros: string, cons: string>",
    })
    made = report.analysis_report(empty({"posting_id": "bigint", "company_id": "bigint"}), found, panels, matches)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = made._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [part for part in text.split("\n\n") if ") Exchange" in part.strip().split("\n")[0]]
    carried = [part for part in exchanges if "_held" in part and "resume_id" in part]
    assert exchanges and carried
    assert not [part for part in exchanges if "resume_match" in part or ("_names" in part and "resume_id" in part)]
