"""Postings' part of the hard checks, the replay of past matches and the text of payloads: once, and only where it can matter."""

import re

from matchflow.functions import constants as C
from matchflow.operators import scoring
from matchflow.plans import jobs as jobs_
from matchflow.sources import feeds


def test_posting_checks_try_patterns_where_the_text_can_match(spark):
    texts = ["You MUST be  Authorized to work within the EU", "must be here", "work from\nanywhere", "W8BEN or w-8ben", "remote – global", "Senior level expected", "seniorlevel  expected", None, "", "any  country"]
    places = ["Remote, Rome/Oslo", "remote", "Oslo", None, "Remote / , Rome", "A,B,C", "REMOTE, x, y", " ", "Remote", "remote,,a/b"]
    jobs = spark.createDataFrame([(i, None, t, p) for i, (t, p) in enumerate(zip(texts, places))], "id int, title string, normalized_text string, location_name string")
    jobs = jobs.selectExpr("*", "CAST(NULL AS array<string>) AS location_countries", "CAST(NULL AS double) AS compensation_max", "CAST(NULL AS double) AS compensation_min", "CAST(NULL AS string) AS compensation_currency")
    checked = scoring.with_places(jobs)
    got = {r.id: r for r in checked.collect()}
    for i, text in enumerate(texts):
        found = lambda ps: any(re.search(p, text or "", re.I) for p in ps)  # noqa: B023, E731
        assert (got[i]._fence, got[i]._welcome, got[i]._senior) == (found(C.WORK_AUTH_FENCES), found(C.CONTRACTOR_WELCOMES), found([C.SENIOR_TEXT])), text
        place = (places[i] or "").lower()
        assert got[i]._spread == (len([x for x in re.split("[,/]", place) if x.strip(" ")]) >= 3 if "remote" in place else None), place
    plan = checked.select("_fence", "_welcome")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan  # before, every text went through the whole alternation of 8 and of 13 patterns


def test_replay_counts_pairs_with_their_own_status(spark):
    row = {"match_id": 1, "job_id": 1, "user_id": 1, "title": "Engineer", "normalized_text": "x", "location_name": "Rome", "remote_scope": "global", "workplace_type": "remote", "country": "IT", "years_of_experience": 3, "experience_max_years": 5}
    rows = [row | {"match_id": i, "match_status": s, "years_of_experience": y} for i, (s, y) in enumerate([("approved", 3), ("approved", 20), ("approved", 3), ("pending", 20), (None, 3)])]
    pairs = spark.createDataFrame(rows).selectExpr("*", "CAST(NULL AS array<string>) AS location_countries", "CAST(NULL AS array<string>) AS preferred_compliance", "0D AS expected_comp_min", "CAST(NULL AS double) AS compensation_max", "CAST(NULL AS double) AS compensation_min", "CAST(NULL AS string) AS compensation_currency")
    got = jobs_.gate_replay(pairs)
    assert {tuple(r) for r in got.collect()} == {("approved", True, 2), ("approved", False, 1), ("pending", False, 1), (None, True, 1)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_markup_is_gone_through_once(spark):
    htmls = ["<p>a</p><p>b</p>", " \t<b>a</b>\t \tb  <br/>\n\n\n\n\nc&nbsp; ", "<ul><li>x</ul>\n \n", "", None, "a b c", "\x0b\f\ra\tb\n", "&amp;lt; &lt;b&gt;"]
    df = spark.createDataFrame([(h, "lever", "T", p) for h in htmls for p in (None, "", "plain ")], "html string, source string, title string, plain string")
    got = feeds.with_full_text(df)

    def text(html):
        out = re.sub("<[^>]*>", " ", re.sub(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br)\b[^>]*>", "\n", html))
        for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
            out = out.replace(entity, char)
        return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", out)).strip(" \t\n\x0b\f\r")

    for r in got.collect():
        want = " ".join(x for x in (r.plain, text(r.html) or None if r.html is not None else None) if x is not None).strip(" ")
        assert (r.description, r.full_text) == (want, f"T {want}".strip(" ")), r
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]*>") == 1 and not {"_told", "_text"} & set(got.columns)
