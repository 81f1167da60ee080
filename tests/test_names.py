import random

import pytest
from pyspark.sql import functions as F

from matchflow.operators import joins, names, upserts


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(
    "raw, want",
    [("Stripe", "stripe"), ("META PLATFORMS", "meta platforms"), ("Stripe Inc.", "stripe"), ("Acme Technologies Co.", "acme technologies"), ("Smith, Jones & Co.", "smith jones &"), ("O'Reilly", "oreilly"),
     ("  Foo   Bar  ", "foo bar"), ("", ""), ("The Company", ""), ("Companyco Theo", "companyco theo"), ("Acme/Co Labs", "acme labs"), (None, None)],
)
def test_normalized_names(spark, raw, want):
    assert table(spark, [raw]).select(names.normalized_name(F.col("name"))).first()[0] == want


def test_names_that_match_by_hand(spark):
    layoffs = spark.createDataFrame([(1, "Meta"), (2, "The Acme Company"), (3, "Meta Platforms Inc."), (4, "A Inc."), (5, "AB Inc."), (6, "PayPal"), (7, None), (8, "Big Acme Corp")], "layoff_id long, company string")
    companies = spark.createDataFrame([(10, "Meta Platforms"), (11, "Acme"), (12, "META, Inc."), (13, "ab"), (14, "Stripe"), (15, "Cabal"), (16, "x")], "id long, company_name string")
    assert pairs(joins.match_layoffs(layoffs, companies)) == {(1, 10), (1, 12), (2, 11), (3, 10), (3, 12), (8, 11), (5, 13), (5, 15)}


def test_containment_is_brute_force_both_ways(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé 1") for _ in range(rng.randint(0, 5)))
    left = [word() for _ in range(300)] + [word() + word() + word() for _ in range(100)] + [None, "", "a"]
    right = [word() + word() for _ in range(300)] + ["abc" * 20, None, "b"] + left[:40]
    want = {(a, b) for a in left for b in right if a and b and min(len(a), len(b)) >= 2 and (a in b or b in a)}
    got = names.names_match(table(spark, left * 2), table(spark, right * 2))
    assert pairs(got) == want and len(want) > 500
    assert pairs(names.contained(table(spark, left), table(spark, right))) == {(a, b) for a, b in want if a in b}
    assert names.contained(table(spark, []), table(spark, right)).count() == names.contained(table(spark, left), table(spark, [])).count() == 0


def test_containment_has_no_nested_loop(spark):
    left, right = (spark.range(20_000).selectExpr(f"concat('{p} ', cast(id as string), ' labs') AS name") for p in ("new", "big new"))
    plan = names.names_match(left, right)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_demotion_looks_at_the_own_name(spark):
    layoffs = spark.createDataFrame([(1, "Acme Inc"), (2, "Zeta 100% Co")], "layoff_id long, company string")
    companies = spark.createDataFrame([(1, "The Acme Corp", None), (2, "Zeta", "zeta"), (3, None, "bigacme"), (4, "Ac-me", None)], "id long, company_name string, canonical_name string")
    assert pairs(joins.layoffs_to_demote(layoffs, companies)) == {(1, 1), (1, 3)}


def test_names_in_news_feeds(spark):
    feed = """<rss><channel><title>News</title>
    <item><title>Stripe - 500 layoffs</title></item><item><title>Meta lays off 11000 employees</title></item><ITEM><TITLE>Twitter layoffs</TITLE></ITEM>
    <item><title><![CDATA[Acme Corp – 200 layoffs]]></title></item><item><title>Smith &amp; Co - 50 layoffs</title></item><item><title>O&#39;Reilly - 30</title></item>
    <item><title>Stripe lays off 200 more</title></item><item><title>X</title></item><item><link>no title</link></item></channel></rss>"""
    got = names.layoff_names(spark.createDataFrame([(feed,), ("",), ("not xml",), (None,)], "xml string"), "xml")
    assert sorted(r[0] for r in got.collect()) == ["Acme Corp", "Meta", "O'Reilly", "Smith & Co", "Stripe", "Twitter"]


def test_pairs_of_layoffs_and_companies_are_made_by_the_last_join(spark):
    layoffs = spark.createDataFrame([(i, f"Acme {i % 2}") for i in range(10)] + [(10, None)], "layoff_id long, company string")
    companies = spark.createDataFrame([(1, "Acme 0 Labs", None), (2, "Beta", "acme 1"), (3, "Acme 0 Labs", "acme 0"), (4, "Gamma", None)], "id long, company_name string, canonical_name string")
    want = {(i, c) for i in range(10) for c in ((1, 3) if i % 2 == 0 else (2,))}
    assert pairs(joins.layoffs_to_demote(layoffs, companies)) == want
    assert pairs(joins.companies_laid_off(layoffs, companies)) == {(1,), (2,), (3,)}
    sent = joins.match_layoffs(layoffs, companies)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in sent.splitlines() if "Join" in line)  # the outermost
    assert "(l#" in last


def test_sides_of_name_joins_are_not_broadcast(spark):
    layoffs = spark.range(30).selectExpr("id AS layoff_id", "concat('Acme ', id, ' Labs') AS company")
    companies = spark.range(40).selectExpr("id", "concat('Acme ', id, ' Labs Inc.') AS company_name", "cast(null AS string) AS canonical_name")
    for df in (joins.match_layoffs(layoffs, companies), joins.layoffs_to_demote(layoffs, companies), joins.companies_laid_off(layoffs, companies)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert sent and all("[slot#" in line for line in sent)  # slots are bounded, names are not


def test_full_slots_lose_no_names(spark, monkeypatch):
    left, right = ([f"{p}{i} labs" for i in range(40)] for p in ("", "new 1"))
    want = {(a, b) for a in left for b in right if a in b}
    for slots in (1, 7):
        monkeypatch.setattr(names, "SLOTS", slots)
        assert pairs(names.contained(table(spark, left), table(spark, right))) == want and len(want) > 40


def test_laid_off_companies_are_not_broadcast(spark):
    layoffs = spark.range(30).selectExpr("id AS layoff_id", "concat('Acme ', id, ' Labs') AS company")
    companies = spark.range(40).selectExpr("id", "concat('Acme ', id, ' Labs') AS company_name", "cast(null AS string) AS canonical_name", "'active_hot' AS tier", "id % 2 = 0 AS polling_enabled")
    df = upserts.demote_layoffs(companies, joins.companies_laid_off(layoffs, companies))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all("[slot#" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert {r["id"] for r in df.filter("new_tier = 'active'").collect()} == set(range(0, 30, 2))
