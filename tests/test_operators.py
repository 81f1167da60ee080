"""Small tables with expectations worked out by hand, and properties that must hold on any table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchflow.functions import exprs as X
from matchflow.operators import classify, filters, joins, reports, routing, scoring, tags, upserts
from matchflow.plans import jobs as plans
from matchflow.plans.adapters import AS_OF, view
from matchflow.plans.queries import hashes
from matchflow.sources import discovery, payloads

SF = "/root/testdata/sf0.001"


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def titles(spark, *values, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)], "id long, title string").withColumns({k: F.lit(v) for k, v in more.items()})


def test_engineering_titles(spark):
    df = titles(spark, "Senior Frontend Engineer", "Account Executive", "Data Entry Clerk", "Software Engineers", "Reengineering", None)
    assert column(filters.filter_engineering_titles(df), "id") == [0, 3]


def test_country_fence_order(spark):
    rows = [("Engineer, US Remote", "Remote"), ("Engineer", "Remote, md"), ("Engineer", "São Paulo"), ("Engineer", "NAMER + EMEA"), ("Engineer", "Remote"), ("Engineer", None), ("Engineer", "Remote; Argentina")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, title string, location_name string")
    assert column(filters.with_country_fence(df), "fence") == ["title_fence", "location_us_state", "location_specific_city", "location_region", None, None, "location_country"]


def test_qa_needs_tags_or_title(spark):
    rows = [(0, "QA Lead", ["react"]), (1, "Automation Analyst", ["qa", "cypress", "selenium"]), (2, "Developer", ["qa", "cypress", "selenium"]), (3, "Quarterly", [])]
    df = spark.createDataFrame(rows, "id long, title string, extracted_tags array<string>").withColumn("is_qa", F.lit(None).cast("boolean"))
    assert column(filters.with_qa_flag(df), "qa") == [True, True, False, False]


def test_pay(spark):
    rows = [(0, 100000.0, "USD"), (1, 100000.0, None), (2, 100000.0, "XYZ"), (3, 4999.0, "USD"), (4, 100000.0, "eur"), (5, None, "USD")]
    df = spark.createDataFrame(rows, "id long, a double, c string").withColumn("usd", X.to_usd(F.col("a"), F.col("c")))
    assert column(df, "usd") == [100000.0, 100000.0, None, None, pytest.approx(108000.0), None]


def test_cosine_distance(spark):
    rows = [(0, [1.0, 0.0], [1.0, 0.0]), (1, [1.0, 0.0], [0.0, 2.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, [1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, a array<float>, b array<float>").withColumn("d", X.cosine_distance(F.col("a"), F.col("b")))
    assert column(df, "d") == [0.0, 1.0, 1.0, 1.0, 1.0]


def test_overlap_counts_repeats(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"], ["a"])], "id long, m array<string>, t array<string>")
    assert column(df.withColumn("n", X.overlap_count(F.col("m"), F.col("t"))), "n") == [2]


def test_tag_years_merge_overlaps(spark):
    d = lambda s: dt.date.fromisoformat(s) if s else None
    rows = [("2020-01-01", "2021-01-01"), ("2020-06-01", "2022-01-01"), ("2022-01-01", "2022-02-01"), ("2023-01-01", None), ("2024-01-01", "2023-01-01")]
    df = spark.createDataFrame([(1, d(s), d(e), ["go"]) for s, e in rows], "applicant_id long, start_date date, end_date date, canonical_skills_detected array<string>")
    assert [tuple(r) for r in tags.tag_experience(df, "2023-07-01").collect()] == [(1, "go", 762 + 181, 2.6)]


def test_scan_tags(spark):
    df = spark.createDataFrame([(0, "We use React, Node.js and k8s; not reactive."), (1, "C# on .NET"), (2, "")], "id long, t string")
    assert column(tags.scan_tags(df, "t"), "tags") == [["nodejs", "react"], ["csharp"], []]


def test_size_score_bands(spark):
    counts = [19, 20, 49, 50, 249, 250, 999, 1000, 5000, 5001, None]
    df = spark.createDataFrame([(i, n, False, False, "x") for i, n in enumerate(counts)], "id long, employee_count int, is_agency boolean, is_public boolean, discovery_source string")
    assert column(scoring.company_size_score(df), "raw_score") == [25, 15, 15, 0, 0, -5, -5, -15, -15, -25, 0]
    agency = scoring.company_size_score(df.withColumn("is_agency", F.lit(True)))
    assert set(column(agency, "advised_tier")) == {"dead"} and min(column(agency, "size_score")) == -0.3


@pytest.mark.parametrize("text, low, high", [("5-7 years of Go", 5, 7), ("3+ years", 3, None), ("10 to 12 years", 10, 12), ("no number", None, None)])
def test_experience(spark, text, low, high):
    r = classify.with_experience_range(spark.createDataFrame([(text,)], "normalized_text string")).first()
    assert (r["years_min"], r["years_max"]) == (low, high)


def test_utc_span(spark):
    df = spark.createDataFrame([(0, "UTC-8 to UTC+8"), (1, "utc-3 to utc+3"), (2, "utc")], "id long, normalized_text string")
    assert column(classify.with_utc_span(df), "span_scope") == ["global", "region_fenced", None]


def test_top_k_and_exclusions(spark):
    routed = routing.route_candidates(view(spark, SF, "job"), view(spark, SF, "persona"), k=2, strict=False)
    per_job = routed.groupBy("job_id").count().collect()
    assert per_job and all(r["count"] <= 2 for r in per_job)
    assert routed.filter("distance >= 0.75 OR overlap < 2").count() == 0


def test_match_score_range(spark):
    m = joins.match_view(*(view(spark, SF, n) for n in ("match_queue", "job", "persona", "applicant"))).withColumns({"quality": F.lit(None).cast("int"), "size_score": F.lit(None).cast("double")})
    r = scoring.match_score(m).agg(F.min("match_score"), F.max("match_score")).first()
    assert 0 <= r[0] < r[1] <= 100


def test_upsert_is_idempotent(spark):
    jobs = joins.dedupe_first(view(spark, SF, "job"), upserts.POSTING_KEY, ["id"])
    once = upserts.upsert_postings(jobs, jobs.filter("id < 300"), AS_OF)
    twice = upserts.upsert_postings(once, jobs.filter("id < 300"), AS_OF)
    assert once.drop("change").exceptAll(twice.drop("change")).count() == 0
    assert twice.filter("change = 'new'").count() == 0


def test_retention_and_kept_are_all(spark):
    jobs = view(spark, SF, "job")
    plan = upserts.retention_plan(jobs, AS_OF)
    assert plan.filter("rule IS NULL").count() + plan.filter("rule IS NOT NULL").count() == jobs.count()
    purge = upserts.purge_plan(jobs, view(spark, SF, "match_queue"), 120)
    assert purge.count() <= 120


def test_snapshot_of_a_day_is_one_row(spark, tmp_path):
    row = reports.public_stats(view(spark, SF, "job"), AS_OF).withColumn("snapshot_date", F.lit("1998-01-01"))
    for _ in range(2):
        discovery.write_snapshot(row, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 1


def test_bad_payloads_are_counted(spark):
    raw = spark.createDataFrame([("lever", "a", "{oops"), ("lever", "b", '[{"id":"1","text":"Dev"}]'), ("ashby", "c", '{"jobs":[]}')], "source string, slug string, payload string")
    rows = payloads.read_ats_payloads(raw).select("slug", "valid", "title").collect()
    assert sorted(map(tuple, rows)) == [("a", False, None), ("b", True, "Dev")]


def test_reprocess_takes_unmatched_postings_and_all_applicants(spark):
    jobs, personas, people, matches = view(spark, SF, "job"), view(spark, SF, "persona"), view(spark, SF, "applicant"), view(spark, SF, "match_queue").filter("job_id % 2 = 0")
    due = jobs.join(joins.reprocess_candidates(jobs, personas, matches), "id", "left_semi")
    every = scoring.hard_blockers(due.withColumnRenamed("id", "job_id").crossJoin(people))  # brute force: no profiles
    want = {r["job_id"] for r in every.filter("passes").select("job_id").distinct().collect()}
    by_profile = scoring.hard_blockers(due.withColumnRenamed("id", "job_id").crossJoin(plans.applicant_profiles(people)))
    assert want == {r["job_id"] for r in by_profile.filter("passes").select("job_id").distinct().collect()}
    got = {r["job_id"] for r in plans.reprocess(jobs, personas, people, matches, view(spark, SF, "job_label_override"), view(spark, SF, "applicant_company_block"), hashes(jobs)).select("job_id").distinct().collect()}
    assert got and got <= want and 0 < len(want) < due.count()
    assert not got & {r["job_id"] for r in matches.select("job_id").distinct().collect()}


def test_payloads_of_unknown_sources_are_counted(spark):
    raw = spark.createDataFrame([("nosuch", "[]"), (None, "[]"), ("arbeitnow", '{"data":[{"slug":"x","title":"Dev"}]}')], "source string, payload string")
    rows = payloads.read_board_feed(raw).select("source", "valid", "title").collect()
    assert sorted(map(tuple, rows), key=str) == [("arbeitnow", True, "Dev"), ("nosuch", False, None), (None, False, None)]


def test_title_blockers_follow_family_tags_and_levels(spark):
    js, php, dotnet, ai = ["react", "typescript"], ["php", "laravel"], ["csharp", "aspnet"], ["prompt-engineering", "react"]
    rows = [
        ("SharePoint Developer", js, [], "SharePoint", "platform"), ("SharePoint Developer", dotnet, [], None, None), ("Salesforce Engineer", dotnet, [], "Salesforce", "platform"),
        ("Drupal Developer", js, [], "Drupal", "platform"), ("Drupal Developer", php, [], None, None), ("Shopify Developer", php, [], "Shopify", "platform"), ("Shopify Developer", [], [], None, None),
        ("Senior C# Engineer", js, [], ".NET/C#", "platform"), ("Solutions Architect", js, [], "Architect", "role_family"), ("DevOps Engineer", [*js, "docker"], [], None, None),
        ("DevOps Engineer", js, [], "DevOps/SRE/Platform", "role_family"), ("AI Engineer", ai, [], None, None), ("AI Engineer", js, [], "AI Engineer (application)", "role_family"),
        ("Machine Learning Engineer", ai, [], "ML Engineer (research)", "role_family"), ("Tech Lead", js, ["Lead"], None, None), ("Tech Lead", js, ["staff"], "Engineering Manager", "role_family"),
        ("React Developer", js, [], None, None), (None, js, [], None, None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id long, title string, must_have_tags array<string>, seniority_levels array<string>")
    got = [(r["blocker"], r["blocker_type"]) for r in scoring.title_blockers(df).orderBy("id").collect()]
    assert got == [r[3:] for r in rows]


def test_rejection_reasons_in_their_order(spark):
    said = {
        "scope_text_restriction: EU": "scope_text_restriction", "This is an account executive job": "non_development_role", "Management role": "management_role", "Must be in EMEA": "geo_region_fenced",
        "Candidate must reside in Poland": "geo_country_fenced", "Wrong tech stack": "stack_mismatch", "Overqualified": "seniority_mismatch", "No visa": "contract_compliance", "Position filled": "stale", "Unclear": "other", "": "other",
    }
    df = spark.createDataFrame([(i, [t] if t else None) for i, t in enumerate(said)], "id long, llm_blockers array<string>")
    assert column(scoring.with_rejection_reason(df), "reason") == list(said.values())


def test_region_probes_fence_by_weight(spark):
    texts = ["UTC-3 to UTC+3", "salary in EUR", "salary in EUR, core hours overlap with ours", "must be based in Europe", "overlap of 4 hours", "remote, worldwide", "eligible to work in the UK"]
    df = classify.with_multi_probe(spark.createDataFrame(list(enumerate(texts)), "id long, normalized_text string"))
    assert column(df, "region_fence") == [True, False, True, True, False, False, True]


def test_scope_signals(spark):
    texts = ["We are remote-first.", "Germany only, or must be based in the UK", "E-Verify", "Remote - LATAM", "fully remote; relocation offered", "Work from anywhere", "must be in Berlin, Germany", None]
    got = classify.with_scope_signals(spark.createDataFrame(list(enumerate(texts)), "id long, normalized_text string")).orderBy("id").collect()
    assert [r["global_high"] for r in got] == [True, False, False, False, False, True, False, False]
    assert [r["fence_countries"] for r in got] == [[], ["DE", "GB"], ["US"], [], [], [], [], []]
    assert [r["fence_regions"] for r in got] == [[], [], [], ["latam"], [], [], [], []]
    assert (got[4]["medium"], got[4]["negatives"], got[6]["negatives"], got[5]["always_global"]) == (["global"], ["relocation_required"], ["city_level_restriction"], True)


def test_tags_are_scanned_by_label(spark):
    texts = ["C++, C and C# with Node.js", "Reactive streams, Going far", "React Native or React", "Spring Boot / Spring", "REST API, CI/CD; Ruby on Rails"]
    want = [["c", "cpp", "csharp", "nodejs"], [], ["react", "react-native"], ["spring", "spring-boot"], ["ci-cd", "rails", "rest"]]
    assert column(tags.scan_tags(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t"), "tags") == want
    raw = spark.createDataFrame([(0, ["Golang", "K8s", "React.js", "ruby-on-rails", "cobol", " PHP "])], "id long, t array<string>")
    assert column(tags.normalize_tags(raw, "t"), "t") == [["go", "kubernetes", "php", "rails", "react"]]


def test_actions_and_status_words(spark):
    rows = [(0, "active", "2024-01-01"), (1, "rejected", None), (2, "normalization_failed", None), (3, "gone", None), (4, "active", None)]
    df = spark.createDataFrame(rows, "id long, status string, normalized_at string")
    assert column(filters.with_normalization_action(df), "action") == ["skip:processed", "skip:rejected", "normalize:retry", "skip:aged_out", "normalize:new"]
    rows = [(0, "lever", "closed"), (1, "recruitee", " Closed"), (2, "recruitee", None), (3, "recruitee", "odd"), (4, "smartrecruiters", "on-hold")]
    assert column(filters.with_is_active(spark.createDataFrame(rows, "id long, ats_source string, source_status string")), "active") == [True, False, True, True, False]


def test_hard_checks_in_their_order(spark):
    post = dict(title="Engineer", location_name=None, workplace_type="remote", normalized_text=None, location_countries=None, experience_min_years=None, experience_max_years=None,
                compensation_min=None, compensation_max=None, compensation_currency="USD", remote_scope="undetermined")
    man = dict(country="RS", preferred_compliance=["w8ben"], expected_comp_min=60000.0, years_of_experience=8)
    fence, global_ = "You must reside in the country of work", "We are a distributed team; must reside in a quiet place"
    cases = [
        (dict(title="Software Engineer - Latam"), {}, "title_region_tag"), (dict(title="Software Engineer - EMEA"), {}, None), (dict(title="SDE - India"), {}, "title_region_tag"),
        (dict(title="SDE - India"), dict(country=None), None), (dict(location_countries=["MX", "AR"], remote_scope="country_fenced"), {}, "location_country_list"),
        (dict(location_countries=["Serbia"], remote_scope="country_fenced"), {}, None), (dict(location_countries=["MX"], remote_scope="global"), {}, None),
        (dict(location_name="Remote - Poland", remote_scope="country_fenced"), {}, "location_country_list"), (dict(location_name="Remote - USA", remote_scope="country_fenced"), {}, None),
        (dict(location_name="Remote - USA", remote_scope="country_fenced"), dict(preferred_compliance=[]), "location_country_list"),
        (dict(location_name="Remote, France, Spain", remote_scope="country_fenced"), {}, "location_country_list"), (dict(location_name="Pune, MH, in"), {}, "remote_specific_foreign_location"),
        (dict(location_name="Belgrade, Serbia"), {}, None), (dict(location_name="Poland / Remote / Poland", remote_scope="global"), {}, "remote_specific_foreign_location"),
        (dict(location_name="Berlin, Germany", workplace_type="on-site", remote_scope="onsite"), {}, "explicit_on_site"), (dict(location_name="London, UK", workplace_type="hybrid"), {}, "hybrid_foreign_location"),
        (dict(location_name="London, UK", workplace_type="hybrid", remote_scope="global"), {}, None), (dict(location_name="Pune, MH, in", workplace_type=None), {}, "null_workplace_specific_foreign_location"),
        (dict(location_name="APAC", workplace_type=None), {}, "region_fenced_location"), (dict(location_name="EMEA", workplace_type=None), {}, None), (dict(location_name="North America"), {}, None),
        (dict(location_name="North America"), dict(preferred_compliance=None), "region_fenced_location"), (dict(location_countries=["US"], normalized_text=fence), {}, "work_auth_fencing"),
        (dict(location_countries=["US"], normalized_text=global_), {}, None), (dict(location_countries=["DE"], normalized_text="A good job"), {}, "country_fenced_non_us"),
        (dict(location_countries=["US"], normalized_text="A good job"), {}, None), (dict(compensation_max=41000.0), {}, "compensation_mismatch"), (dict(compensation_max=42000.0), {}, None),
        (dict(compensation_max=100.0), {}, None), (dict(compensation_max=41000.0), dict(expected_comp_min=None), None), (dict(title="Senior Engineer", experience_max_years=6), dict(years_of_experience=11), "inverted_experience_band"),
        (dict(experience_max_years=2), {}, "experience_gap"), (dict(experience_max_years=3), {}, None), (dict(location_name="Cape Town, South Africa"), dict(country="ZA"), None),
        (dict(location_countries=["MX"], location_name="Berlin", workplace_type="on-site"), {}, "explicit_on_site"),
    ]
    schema = "job_id int, title string, location_name string, workplace_type string, normalized_text string, location_countries array<string>, experience_min_years int, experience_max_years int, compensation_min double, compensation_max double, compensation_currency string, remote_scope string, country string, preferred_compliance array<string>, expected_comp_min double, years_of_experience int"
    rows = [{"job_id": i, **post, **p, **man, **a} for i, (p, a, _) in enumerate(cases)]
    got = scoring.hard_blockers(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema))
    assert column(got, "pattern", "job_id") == [want for _, _, want in cases]
    assert set(got.columns) == {c.split()[0] for c in schema.split(", ")} | {"blockers", "passes", "pattern"}
    shut = scoring.hard_blockers(spark.createDataFrame([tuple({**rows[0], "location_name": "Lagos, Nigeria", "country": None}.values())], schema), ["NG"]).first()
    assert (shut["blockers"], shut["pattern"]) == (["excluded_country"], "excluded_country")


def test_countries_of_texts(spark):
    texts = ["Remote in Latin America", "Eastern Europe or South Korea", "Indiana", "New South Wales, U.S.", None]
    df = classify.extract_countries(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t")
    got = column(df, "countries")
    assert got[0] == ["AR", "BR", "CL", "CO", "MX", "PE", "US"] and {"BY", "RS", "KR", "PT"} <= set(got[1]) and got[2:] == [[], ["GB", "US"], []]


def test_scope_cascade_by_hand(spark):
    filler = "You will build things with people who like to build things, every day. "
    cases = [  # workplace, source, location, text, scope, countries, confidence
        ("hybrid", "lever", "Berlin", filler, "onsite", None, 1.0), ("hybrid", "greenhouse", None, filler + "We are a distributed team.", "global", None, 1.0),
        ("remote", "lever", "Americas, Europe, Asia", filler, "global", None, 0.7), ("remote", "lever", "Remote - Germany", filler, "country_fenced", ["DE"], 0.7), (None, "greenhouse", "Pune, India", filler, "onsite", None, 0.7),
        ("remote", "lever", "Oslo", filler + "Work from anywhere.", "global", None, 1.0), ("remote", "lever", "Oslo", filler + "We are a distributed team.", "undetermined", None, 0.0),
        ("remote", "lever", "Remote", filler + "US only.", "country_fenced", ["US"], 1.0), ("remote", "lever", "Remote", filler + "You must reside in Canada.", "country_fenced", ["CA"], 1.0),
        ("remote", "lever", None, filler + "EMEA only.", "region_fenced", "emea", 1.0), (None, "greenhouse", None, filler + "This is an on-site position.", "onsite", None, 1.0), ("remote", "lever", "Oslo, Norway", filler, "country_fenced", ["NO"], 0.7),
        ("remote", "lever", None, filler + "UTC-3 to UTC+3", "region_fenced", None, 1.0), ("remote", "lever", None, filler + "Fully remote.", "global", None, 0.7), ("remote", "lever", None, "Short.", "undetermined", None, 0.0),
        ("remote", "lever", None, filler, "undetermined", None, 0.0), ("remote", "lever", None, filler + "Fully remote, relocation offered.", "undetermined", None, 0.0),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "id long, workplace_type string, ats_source string, location_name string, normalized_text string")
    got = [(r["scope"], r["countries"], r["confidence"]) for r in classify.classify_remote_scope(df).orderBy("id").collect()]
    assert [(s, c) for s, _, c in got] == [(c[4], c[6]) for c in cases]
    assert [c for _, c, _ in got][:9] == [c[5] for c in cases][:9] and "ZA" in got[9][1]
    assert column(classify.infer_remote_scope(df), "inferred_scope")[2:6] == ["unknown", "country_fenced", "country_fenced", "global"]
