"""Rules worked out by hand, one case a row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchflow.operators import classify as cls
from matchflow.operators import filters as flt
from matchflow.operators import joins as joi
from matchflow.operators import reports as rep
from matchflow.operators import scoring as sco
from matchflow.operators import upserts as ups

NOW = "2026-06-01 00:00:00"
AT = dt.datetime(2026, 6, 1)


@pytest.mark.parametrize(
    "slug, good",
    [("acme", True), (" Acme ", True), ("a", False), ("x" * 25, True), ("x" * 26, False), ("x" * 20 + "-" + "y" * 20, True), ("x" * 61, False), ("a-" + "x" * 59, False), ("12345", False), ("12a45", True), ("register", False), ("DASHBOARD", False), ("admin", False), ("team", False), ("sign-in", False), ("baz", False),
     ("nv", False), ("io", True), ("tkd", True), ("wwdc", True), ("js", False), (None, False)],
)
def test_slugs(spark, slug, good):
    df = spark.createDataFrame([(slug,)], "ats_slug string")
    assert flt.filter_valid_slugs(df).count() == good


@pytest.mark.parametrize(
    "text, fenced",
    [("We use E-Verify.", True), ("everify", True), ("e-verifying", False), ("eligibility to work in the U.S.", True), ("Authorized  to work in United States", True), ("authorized to work in the USA", True), ("authorized to work in the USSR", False), ("within Canada only", False), ("Europe only", False), (None, False)],
)
def test_fences_in_texts(spark, text, fenced):
    df = spark.createDataFrame([("Developer", None, text, None)], "title string, location_name string, normalized_text string, is_fenced boolean")
    assert flt.with_fence_flag(df).first()["fenced"] is fenced
    assert flt.with_fence_flag(df.withColumn("is_fenced", F.lit(True))).first()["fenced"] is True


@pytest.mark.parametrize(
    "text, hq, want",
    [("Based in NYC, or nyc.", "NYC", "Based in  , or  ."), ("A (Rome) b", "(Rome)", "A   b"), ("Remote work", "remote", "  work"), ("x.y xzy", "x.y", "  xzy"), ("MÜNCHEN calls", "München", "  calls"), ("Stay", "", "Stay"), ("Stay", None, "Stay"), (None, "NYC", None), (r"a \E b", r"\E", "a   b")],
)
def test_own_place_leaves_the_text(spark, text, hq, want):
    assert cls.strip_hq(spark.createDataFrame([(text, hq)], "normalized_text string, hq string"), "hq").first()["stripped"] == want


@pytest.mark.parametrize(
    "source, workplace, place, want",
    [("lever", "hybrid", "Worldwide", "onsite"), ("lever", "on-site", None, "onsite"), ("greenhouse", "hybrid", "Worldwide", "global"), ("greenhouse", None, "Remote - EMEA, APAC, LATAM", "global"), ("lever", "remote", "Europe or Asia", "undetermined"), ("lever", "remote", "Remote, Germany", "country_fenced"), ("lever", None, "Remote", "undetermined"),
     ("lever", None, "Berlin", "onsite"), ("lever", "remote", "Berlin", "undetermined"), ("lever", "remote", None, "undetermined"), ("lever", None, None, "undetermined"), ("lever", None, "Anywhere", "global")],
)
def test_scope_of_a_place(spark, source, workplace, place, want):
    df = spark.createDataFrame([(source, workplace, place)], "ats_source string, workplace_type string, location_name string")
    assert df.select(cls.place_scope()).first()[0] == want


def test_feed_counts_web_postings_only(spark):
    rows = [("lever", "a", "Frontend Developer", None, "Anywhere"), ("lever", "a", "React Developer", None, "Remote"), ("lever", "a", "Accountant", None, "Anywhere"), ("lever", "b", "Accountant", None, "Anywhere")]
    got = {r["ats_slug"]: r for r in cls.profile_company_feed(spark.createDataFrame(rows, "ats_source string, ats_slug string, title string, workplace_type string, location_name string")).collect()}
    assert (got["a"]["jobs"], got["a"]["webdev"], got["a"]["global_jobs"], got["a"]["undetermined"], got["a"]["addressable"], got["a"]["global_share"], got["a"]["passed"]) == (3, 2, 1, 1, 1.5, 0.5, True)
    assert (got["b"]["webdev"], got["b"]["addressable"], got["b"]["passed"]) == (0, 0.0, False)


@pytest.mark.parametrize(
    "blocker, want",
    [("Remote but US only", "geographic"), ("Remote role, must reside in the EU", "geographic"), ("On-site three days", "workplace"), ("hybrid role", "workplace"), ("Missing Kubernetes", "skills"), ("requires strong people skills", "skills"), ("Requires relocation", "travel"), ("Frequent travel", "travel"),
     ("Vue experience", "domain"), ("jquery", "domain"), ("salary below range", "other"), ("US only", "other")],
)
def test_categories_of_blockers(spark, blocker, want):
    rows = [("rejected", AT - dt.timedelta(days=29), [blocker]), ("rejected", AT - dt.timedelta(days=31), [blocker]), ("approved", AT, [blocker]), ("rejected", AT, None)]
    got = rep.rejection_categories(spark.createDataFrame(rows, "status string, evaluated_at timestamp, llm_blockers array<string>"), NOW).collect()
    assert [tuple(r) for r in got] == [(want, 1)]


def test_one_old_approval_makes_a_company_hot(spark):
    companies = spark.createDataFrame([(1, "l", "a", "probation", True), (2, "l", "b", "active", True), (3, "l", "c", "dead", True), (4, "l", "d", "active", False), (5, "l", "e", "dormant", True)], "id long, ats_source string, ats_slug string, tier string, polling_enabled boolean")
    jobs = spark.createDataFrame([(i, "l", s, "active", AT - dt.timedelta(days=d), ["react"] if t else ["go"]) for i, s, d, t in ((1, "a", 10, 1), (2, "b", 10, 0), (3, "e", 100, 1))], "id long, ats_source string, ats_slug string, status string, detected_at timestamp, extracted_tags array<string>")
    personas = spark.createDataFrame([(1, ["css", "go"]), (2, ["go"])], "id long, must_have_tags array<string>")
    day = lambda d: AT - dt.timedelta(days=d)
    rows = [(1, 1, "approved", day(200), day(201)), (1, 2, "approved", day(5), day(6)), (2, 2, "approved", day(5), day(5)), (2, 1, "approved", day(366), day(366)), (3, 1, "pending", None, day(29)), (3, 1, "pending", None, day(31)), (3, 1, "rejected", day(3), day(3))]
    got = {r["id"]: tuple(r)[1:] for r in sco.employer_openness(companies, jobs, spark.createDataFrame(rows, "job_id long, persona_id long, status string, evaluated_at timestamp, created_at timestamp"), personas, NOW).collect()}
    assert got == {1: (0, 1, 0, 1, "active_hot"), 2: (0, 0, 0, 0, "active"), 5: (0, 0, 1, 0, "dormant")}


def test_reconciled_postings(spark):
    kind = "id long, remote_scope string, location_countries array<string>, job_embedding array<float>, is_fenced boolean, status string, normalized_at timestamp"
    rows = [(1, "global", ["US"], [1.0], None, "active", AT), (2, "country_fenced", ["US"], [1.0], False, "active", None), (3, "onsite", None, None, None, "rejected", None), (4, "global", None, [1.0], True, "active", None), (5, None, ["US"], [1.0], True, "rejected", AT)]
    done = ups.reconcile(spark.createDataFrame(rows, kind), NOW)
    got = {r["id"]: tuple(r)[1:7] for r in done.collect()}
    assert got[1] == ("global", None, [1.0], None, "active", AT)
    assert got[2] == ("country_fenced", ["US"], None, True, "active", None)
    assert got[3] == ("onsite", None, None, None, "rejected", AT)
    assert got[4] == ("global", None, [1.0], False, "active", None)
    assert got[5] == (None, ["US"], [1.0], True, "rejected", AT)
    assert {tuple(r) for r in ups.reconciliation_log(done).collect()} == {("global-scope-null-countries", "applied", 1), ("fenced-null-embedding", "applied", 1), ("is-fenced-consistency", "applied", 2), ("rejected-normalized-at", "applied", 1)}
    again = ups.reconcile(done.drop("fixes"), NOW)  # idempotent
    assert {r["status"] for r in ups.reconciliation_log(again).collect()} == {"already-ok"}


def test_order_of_postings(spark):
    day = lambda d: AT - dt.timedelta(days=d)
    rows = [(1, None, day(3), 10.0, 2, "dead"), (2, day(1), day(9), 10.0, 2, "active"), (3, day(2), None, None, None, None), (4, day(5), None, 20.0, 3, None)]
    df = spark.createDataFrame(rows, "id long, published_at timestamp, detected_at timestamp, compensation_max double, fusion_score long, tier string")
    order = lambda key: [r["id"] for r in joi.sort_postings(df, key, 9).collect()]
    assert order("newest") == [2, 3, 1, 4] and order("oldest") == [4, 1, 3, 2]
    assert order("salary") == [4, 2, 1, 3]
    assert order("quality") == [4, 1, 2, 3]
