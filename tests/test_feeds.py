import datetime as dt
import json

import pytest


from matchflow.sources import feeds as f

AT = dt.datetime(2026, 3, 1, 12, 0)
MS = int(AT.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
ISO = "2026-03-01T12:00:00Z"
CASES = {
    "greenhouse": (
        {"jobs": [{"id": 7, "title": "Dev", "location": {"name": "Remote - EU"}, "absolute_url": "u", "content": "<p>a &amp; b</p><br>c", "departments": [{"name": "Eng"}, {"name": "X"}], "company_name": "", "first_published": ISO}, {"id": 8, "title": "Dev", "location": {"name": "In-Office, Rome"}}]},
        [{"external_job_id": "7", "title": "Dev", "workplace_type": "remote", "department": "Eng", "company_name": None, "job_url": "u", "published_at": AT, "full_text": "Dev a & b\n\nc"}, {"external_job_id": "8", "workplace_type": "on-site", "full_text": "Dev"}],
    ),
    "lever": (
        [{"id": "l", "text": "Dev", "categories": {"location": "Rome", "commitment": "Full-time", "department": "D", "team": "T"}, "descriptionPlain": "", "description": "<b>Hi</b>", "lists": [{"text": "Stack", "content": "<li>Go</li>"}], "workplaceType": "onsite", "createdAt": MS, "applyUrl": "a", "salaryRange": {"min": 5, "max": 9.5, "currency": "EUR"}}],
        [{"workplace_type": "on-site", "employment_type": "full-time", "team": "T", "published_at": AT, "pay_min": 5.0, "pay_max": 9.5, "pay_currency": "EUR", "description": "Hi Stack \nGo", "apply_url": "a"}],
    ),
    "ashby": (
        {"jobs": [{"id": "a", "title": "Dev", "location": "Rome", "descriptionPlain": "plain", "descriptionHtml": "<p>html</p>", "isRemote": "true", "employmentType": "Temporary", "publishedAt": ISO, "isListed": False, "compensation": {"min": 1, "max": 2, "currency": "USD"}}, {"id": "b", "title": "D", "workplaceType": "OnSite", "isRemote": True}]},
        [{"workplace_type": "remote", "employment_type": "contract", "description": "plain", "pay_max": 2.0, "status": "unlisted"}, {"workplace_type": "on-site", "status": None}],
    ),
    "smartrecruiters": (
        {"content": [{"id": "s", "name": "Dev", "location": {"city": "Rome", "region": "", "country": "it", "remote": True, "hybrid": True}, "typeOfEmployment": {"label": "Permanent"}, "department": {"label": "Eng"}, "company": {"name": "Co"}, "releasedDate": ISO}, {"id": "t", "name": "Dev", "jobAd": {"sections": {"jobDescription": {"text": "<p>x</p>"}, "qualifications": {"text": "y"}}}}]},
        [{"location_name": "Rome, it", "workplace_type": "hybrid", "employment_type": "full-time", "full_text": "Dev, Eng department, Permanent, Remote, at Co", "description": "", "company_name": "Co"}, {"description": "x\n y", "workplace_type": None}],
    ),
    "workable": ({"jobs": [{"shortcode": "w", "title": "Dev", "workplace": "on_site", "location": {"city": "Rome"}, "employmentType": "Part-time", "description": "d", "url": "u"}]}, [{"external_job_id": "w", "workplace_type": "on-site", "employment_type": "part-time", "location_name": "Rome", "job_url": "u"}]),
    "recruitee": ({"offers": [{"id": 3, "title": "Dev", "locations": [{"city": "Rome", "country": "IT"}], "hybrid": True, "employment_type_code": "fulltime_permanent", "description": "a", "requirements": "b", "status": "closed", "published_at": "2026-03-01 12:00:00 UTC"}]}, [{"external_job_id": "3", "location_name": "Rome, IT", "workplace_type": "hybrid", "employment_type": "full-time", "description": "a b", "status": "closed", "published_at": AT}]),
    "remoteok": (
        [{"legal": "notice"}, {"id": 1, "position": "Dev", "location": "Lisbon, Portugal", "tags": ["React"], "salary_min": 0, "salary_max": 9, "url": "u", "date": ISO}, {"slug": "s", "position": "Dev", "location": "EMEA"}, {"position": "Dev", "location": "Christ Church"}],
        [{"external_job_id": "1", "remote_scope": "country_fenced", "location_countries": ["PT"], "tags": ["react"], "pay_min": None, "pay_max": 9.0, "pay_currency": "USD", "apply_url": "u"}, {"external_job_id": "s", "remote_scope": "region_fenced", "location_countries": None}, {"external_job_id": "", "remote_scope": "global"}],
    ),
    "remotive": ({"jobs": [{"id": 1, "title": "Dev", "candidate_required_location": "USA", "job_type": "full_time", "publication_date": "2026-03-01T12:00:00"}, {"id": 2, "candidate_required_location": "Worldwide", "job_type": "volunteer"}]}, [{"remote_scope": "country_fenced", "employment_type": "full-time", "published_at": AT}, {"remote_scope": "global", "employment_type": "volunteer", "title": ""}]),
    "arbeitnow": ({"data": [{"slug": "b", "title": "Dev", "remote": True, "job_types": ["Freelance"], "created_at": 1}, {"slug": "c", "remote": False}]}, [{"workplace_type": "remote", "remote_scope": "global", "employment_type": "contract", "published_at": None}, {"workplace_type": None, "remote_scope": "unknown"}]),
    "himalayas": (
        {"jobs": [{"jobSlug": "h", "title": "Dev", "locationRestrictions": ["Germany"], "minSalary": 5}, {"companySlug": "c", "title": "t", "locationRestrictions": ["Germany", "Canada"]}, {"jobSlug": "i", "title": "LATAM dev", "locationRestrictions": []}, {"jobSlug": "k", "title": "t", "locationRestrictions": ["Worldwide", "Germany"]}, {"jobSlug": "m", "title": "t", "locationRestrictions": ["Nowhere"]}]},
        [{"remote_scope": "country_fenced", "location_countries": ["DE"], "job_url": "https://himalayas.app/jobs/h", "pay_min": 5.0, "pay_currency": "USD"}, {"external_job_id": "c-t", "remote_scope": "region_fenced", "location_countries": ["DE", "CA"], "location_name": "Germany, Canada", "job_url": None}, {"remote_scope": "region_fenced"}, {"remote_scope": "global"}, {"remote_scope": "country_fenced", "location_countries": ["Nowhere"]}],
    ),
    "jobicy": ({"jobs": [{"id": 5, "jobTitle": "Dev", "jobGeo": " USA ", "jobType": ["full-time"], "salaryMin": 10}, {"id": 0, "jobTitle": "x"}, {"id": 6}, {"id": 7, "jobTitle": "y", "jobGeo": "Anywhere"}]}, [{"external_job_id": "5", "location_name": "USA", "remote_scope": "country_fenced", "employment_type": "full-time", "pay_min": 10.0}, {"external_job_id": "7", "remote_scope": "global"}]),
    "justjoin": (
        {"data": [{"guid": "g", "slug": "s", "title": "Dev", "requiredSkills": [" Go", "go", ""], "niceToHaveSkills": ["SQL"], "workplaceType": {"label": "Office", "value": "office"}, "experienceLevel": "Senior", "employmentTypes": [{"type": "b2b", "from": 10, "to": 0, "currency": "pln"}], "city": "Rome", "countryCode": "it", "publishedAt": ISO}, {"slug": "t", "workplaceType": "remote", "experienceLevel": {"value": "mid"}}]},
        [{"tags": ["go", "sql"], "workplace_type": "on-site", "employment_type": "contract", "pay_min": 120.0, "pay_max": None, "pay_currency": "PLN", "years_min": 5, "years_max": 8, "remote_scope": "country_fenced", "location_countries": ["IT"], "location_name": "Rome, it", "job_url": "https://justjoin.it/job-offer/s"}, {"external_job_id": "t", "workplace_type": "remote", "years_min": 3, "remote_scope": "global"}],
    ),
    "nofluffjobs": (
        {"postings": [{"id": "n", "name": "Co", "title": "Dev", "technology": "React", "category": "frontend", "seniority": ["Mid", "Senior"], "fullyRemote": False, "location": {"fullyRemote": True, "places": [{"city": "Wien", "country": {"code": "AUT", "name": "Austria"}}, {"city": "Rome", "country": {"code": "IT", "name": "Italy"}}]}, "salary": {"from": 2, "to": 3, "type": "uod", "currency": "pln"}, "url": "x", "posted": MS, "tiles": {"values": [{"value": "CSS", "type": "requirement"}, {"value": "no", "type": "category"}]}}, {"id": "o", "fullyRemote": True, "location": {"fullyRemote": False}}, {"id": "p", "title": "T", "location": {"fullyRemote": True, "places": [{"city": "X"}]}}]},
        [{"tags": ["react", "css"], "plain": "Dev at Co. Technology: React. Category: frontend. Seniority: Mid, Senior. Required skills: CSS", "location_name": "Wien, Austria / Rome, Italy", "remote_scope": "region_fenced", "location_countries": ["AT", "IT"], "employment_type": "contract", "pay_max": 36.0, "years_min": 3, "years_max": 5, "published_at": AT}, {"external_job_id": "p", "remote_scope": "country_fenced", "location_countries": ["PL"], "plain": "T at", "tags": []}],
    ),
    "workingnomads": (
        {"hits": {"hits": [{"_source": {"id": 4, "title": "Dev", "locations": ["USA"], "position_type": "ft", "annual_salary_usd": 7, "tags": ["PHP"], "pub_date": ISO}}, {"_source": {"id": 5, "expired": True}}, {"_id": "x"}, {"_source": {"slug": "s", "locations": [{"city": "Rome", "country": "Italy", "continent": "World"}]}}, {"_source": {"id": 6, "location_base": "Remote", "location_extra": "Anywhere"}}]}},
        [{"external_job_id": "4", "location_name": "USA", "remote_scope": "country_fenced", "employment_type": "ft", "pay_max": 7.0, "tags": ["php"]}, {"external_job_id": "s", "location_name": "Rome, Italy", "remote_scope": "country_fenced"}, {"location_name": "Remote — Anywhere", "remote_scope": "global"}],
    ),
    "fourdayweek": (
        {"jobs": [{"id": "f", "title": "Dev", "company": {"name": "Co", "hires_worldwide": True}, "work_arrangement": "remote", "locations": [{"city": "A"}, {"city": "Rome", "country": "Italy", "is_primary": True}], "stack": [{"slug": "Go"}, {"name": "SQL"}], "posted": MS // 1000, "salary_lower": 1}, {"id": "e", "is_expired": True}, {"id": "h", "work_arrangement": "Hybrid", "locations": [{"continent": "Europe"}]}, {"slug": "l", "remote": True, "location": "Spain", "tags": ["JS"], "posted_date": ISO}]},
        [{"company_name": "Co", "location_name": "Rome, Italy", "tags": ["go", "sql"], "remote_scope": "global", "pay_min": 1.0, "published_at": AT}, {"location_name": "Europe", "workplace_type": "hybrid", "remote_scope": "unknown"}, {"external_job_id": "l", "remote_scope": "country_fenced", "tags": ["js"], "published_at": AT}],
    ),
}


@pytest.fixture(scope="module")
def postings(spark):
    rows = [(s, n, json.dumps(p)) for n, (s, (p, _)) in enumerate(CASES.items())]
    rows += [("lever", 100, "not json"), ("nobody", 101, "[]"), ("ashby", 102, '{"data": []}'), ("remotive", 103, '{"jobs": []}'), ("lever", 104, None), (None, 105, "[]")]
    raw = spark.createDataFrame(rows, "source string, n int, payload string")
    return f.with_board_scope(f.with_full_text(f.read_feeds(raw, keys=("n",)))).collect(), raw


@pytest.mark.parametrize("source", list(CASES))
def test_postings_of_a_source(postings, source):
    got, want = [r for r in postings[0] if r["source"] == source and r["n"] < 100], CASES[source][1]
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert {k: r[k] for k in w} == w and r["fault"] is None


def test_faults_are_counted(postings):
    assert {(r["source"], r["fault"], r["n"]) for r in f.feed_faults(postings[1]).collect()} == {("lever", "not JSON", 2), ("nobody", "unknown source", 1), (None, "unknown source", 1), ("ashby", "no postings", 1)}
    assert not [r for r in postings[0] if r["n"] == 103]


def test_rss_board_and_union(spark):
    item = "<item><title>Acme: Dev: senior</title><region>Anywhere in the World</region><type>Full-Time</type><link>https://x.org/remote-jobs/acme-dev/</link><pubDate>Sun, 01 Mar 2026 12:00:00 +0000</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description></item>"
    raw = spark.createDataFrame([("weworkremotely", f"<rss>{item}<item><title>Plain</title><region>USA Only</region></item></rss>")], "source string, payload string")
    rows = f.with_board_scope(f.union_feeds(f.read_feeds(spark.createDataFrame([("lever", "[]")], "source string, payload string")), f.read_rss_board(raw))).collect()
    a, b = rows
    assert (a["title"], a["company_name"], a["external_job_id"], a["employment_type"], a["published_at"], a["remote_scope"], a["html"]) == ("Dev: senior", "Acme", "acme-dev", "full-time", AT, "global", "<p>Hi</p>")
    assert (b["title"], b["company_name"], b["job_url"], b["remote_scope"]) == ("Plain", None, None, "country_fenced")


def test_one_scan_reads_all_sources(postings):
    plan = f.read_feeds(postings[1])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Scan ") == 1
    assert "Exchange" not in plan


def test_paths_are_written_out():
    assert f.over("upper({a.b[0]:array<string>})") == "upper(try_variant_get(j, '$.a.b[0]', 'array<string>'))"
    assert f.over("{x-y}") == "try_variant_get(j, '$.x-y', 'string')"
    assert set(F_COLUMNS := {c for x in f.FEEDS.values() for c in x.columns}) <= set(f.COLUMNS) and len(F_COLUMNS) > 15
