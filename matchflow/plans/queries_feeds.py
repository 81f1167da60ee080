"""Queries over payloads of all systems and boards, made from the postings in each source's own form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.plans.queries import query
from matchflow.sources import feeds

NAMES = list(feeds.FEEDS)
DAY = "date_format(detected_at, 'yyyy-MM-dd')"
HTML = "concat('<p>', normalized_text, '</p> <b>id</b> ', id)"
PAY = "CAST(id % 90 AS INT) + 10"
#: source -> (the place of the postings, a posting in Spark SQL, what DuckDB must find in it; the rest is in COMMON).
FORMS: dict[str, tuple[str, str, dict[str, str]]] = {
    "greenhouse": (
        "jobs", f"named_struct('id', id, 'title', title, 'company_name', company_name, 'content', {HTML}, 'location', named_struct('name', location_name), 'departments', array(named_struct('name', department)), 'first_published', {DAY})",
        {"workplace_type": "CASE WHEN location_name LIKE '%Remote%' THEN 'remote' END", "department": "department", "employment_type": "NULL", "pay_min": "NULL", "remote_scope": "NULL"},
    ),
    "lever": (
        "", f"named_struct('id', concat('l', id), 'text', title, 'descriptionPlain', '', 'description', {HTML}, 'lists', array(named_struct('text', 'Stack', 'content', '<ul>Go</ul>')), 'categories', named_struct('location', location_name, 'commitment', employment_type, 'team', 'T', 'department', department), 'workplaceType', workplace_type, 'createdAt', unix_millis(CAST(to_date(detected_at) AS TIMESTAMP)), 'salaryRange', named_struct('min', {PAY}))",
        {"external_job_id": "concat('l', CAST(id AS VARCHAR))", "company_name": "NULL", "department": "department", "remote_scope": "NULL", "full_text": "concat(FULL, ' Stack \nGo')"},
    ),
    "ashby": (
        "jobs", f"named_struct('id', concat('a', id), 'title', title, 'location', location_name, 'descriptionPlain', normalized_text, 'descriptionHtml', 'no', 'isRemote', workplace_type = 'remote', 'employmentType', IF(id % 3 = 0, 'FullTime', 'Temporary'), 'department', department, 'publishedAt', {DAY}, 'compensation', named_struct('min', {PAY}))",
        {"external_job_id": "concat('a', CAST(id AS VARCHAR))", "company_name": "NULL", "department": "department", "employment_type": "CASE WHEN id % 3 = 0 THEN 'full-time' ELSE 'contract' END", "workplace_type": "CASE WHEN workplace_type = 'remote' THEN 'remote' END", "remote_scope": "NULL", "full_text": "concat(title, ' ', normalized_text)"},
    ),
    "smartrecruiters": (
        "content", f"named_struct('id', concat('s', id), 'name', title, 'company', named_struct('name', company_name), 'location', named_struct('city', location_name, 'remote', workplace_type = 'remote', 'hybrid', workplace_type = 'hybrid'), 'typeOfEmployment', named_struct('label', employment_type), 'department', named_struct('label', department), 'releasedDate', {DAY})",
        {"external_job_id": "concat('s', CAST(id AS VARCHAR))", "location_name": "nullif(location_name, '')", "department": "department", "workplace_type": "CASE WHEN workplace_type IN ('remote', 'hybrid') THEN workplace_type END", "pay_min": "NULL", "remote_scope": "NULL",
         "full_text": "concat_ws(', ', title, concat(department, ' department'), employment_type, CASE WHEN workplace_type = 'remote' THEN 'Remote' ELSE nullif(location_name, '') END, concat('at ', company_name))"},
    ),
    "workable": (
        "jobs", f"named_struct('shortcode', concat('w', id), 'title', title, 'companyName', company_name, 'description', {HTML}, 'workplace', replace(workplace_type, '-', '_'), 'location', named_struct('city', location_name, 'country', ''), 'employmentType', employment_type, 'department', department, 'publishedAt', {DAY})",
        {"external_job_id": "concat('w', CAST(id AS VARCHAR))", "location_name": "nullif(location_name, '')", "department": "department", "pay_min": "NULL", "remote_scope": "NULL"},
    ),
    "recruitee": (
        "offers", f"named_struct('id', id, 'title', title, 'company_name', company_name, 'description', normalized_text, 'requirements', 'Go', 'locations', array(named_struct('city', location_name)), 'remote', workplace_type = 'remote', 'hybrid', workplace_type = 'hybrid', 'on_site', workplace_type = 'on-site', 'employment_type_code', IF(id % 3 = 0, 'fulltime_fixed_term', 'temporary'), 'department', department, 'published_at', {DAY})",
        {"location_name": "nullif(location_name, '')", "department": "department", "employment_type": "CASE WHEN id % 3 = 0 THEN 'full-time' ELSE 'contract' END", "pay_min": "NULL", "remote_scope": "NULL", "full_text": "concat(title, ' ', normalized_text, ' Go')"},
    ),
    "remoteok": (
        "", f"named_struct('id', concat('r', id), 'position', IF(id % 11 = 0, NULL, title), 'company', company_name, 'description', {HTML}, 'location', CASE id % 4 WHEN 1 THEN 'Worldwide' WHEN 2 THEN 'EMEA' WHEN 3 THEN 'Germany' END, 'salary_min', {PAY}, 'date', {DAY})",
        {"external_job_id": "concat('r', CAST(id AS VARCHAR))", "location_name": "CASE id % 4 WHEN 1 THEN 'Worldwide' WHEN 2 THEN 'EMEA' WHEN 3 THEN 'Germany' END", "workplace_type": "'remote'", "employment_type": "NULL", "remote_scope": "CASE id % 4 WHEN 2 THEN 'region_fenced' WHEN 3 THEN 'country_fenced' ELSE 'global' END"},
    ),
    "remotive": (
        "jobs", f"named_struct('id', id, 'title', title, 'company_name', company_name, 'candidate_required_location', location_name, 'description', {HTML}, 'job_type', employment_type, 'publication_date', {DAY})",
        {"workplace_type": "'remote'", "pay_min": "NULL", "employment_type": "BOARD"},
    ),
    "arbeitnow": (
        "data", f"named_struct('slug', concat('b', id), 'title', title, 'company_name', company_name, 'location', location_name, 'description', {HTML}, 'remote', workplace_type = 'remote', 'job_types', array(employment_type), 'created_at', {DAY})",
        {"external_job_id": "concat('b', CAST(id AS VARCHAR))", "workplace_type": "CASE WHEN workplace_type = 'remote' THEN 'remote' END", "pay_min": "NULL", "employment_type": "BOARD", "remote_scope": "CASE WHEN workplace_type = 'remote' THEN 'global' ELSE 'unknown' END"},
    ),
    "himalayas": (
        "jobs", f"named_struct('jobSlug', concat('h', id), 'title', title, 'companyName', company_name, 'excerpt', 'In short', 'locationRestrictions', CASE id % 4 WHEN 1 THEN array('Germany') WHEN 2 THEN array('Germany', 'Canada') WHEN 3 THEN array('Worldwide', 'Canada') ELSE array() END, 'minSalary', {PAY}, 'employmentType', employment_type, 'pubDate', {DAY})",
        {"external_job_id": "concat('h', CAST(id AS VARCHAR))", "location_name": "CASE id % 4 WHEN 1 THEN 'Germany' WHEN 2 THEN 'Germany, Canada' WHEN 3 THEN 'Worldwide, Canada' ELSE '' END", "workplace_type": "'remote'", "employment_type": "BOARD", "full_text": "concat(title, ' In short')",
         "remote_scope": "CASE id % 4 WHEN 1 THEN 'country_fenced' WHEN 2 THEN 'region_fenced' WHEN 3 THEN 'global' ELSE CASE WHEN regexp_matches(lower(title), 'emea|apac') THEN 'region_fenced' ELSE 'global' END END"},
    ),
    "jobicy": (
        "jobs", f"named_struct('id', id, 'jobTitle', title, 'companyName', company_name, 'jobDescription', {HTML}, 'jobGeo', location_name, 'jobType', array(employment_type), 'salaryMin', {PAY}, 'pubDate', {DAY})",
        {"location_name": "nullif(trim(location_name), '')", "workplace_type": "'remote'", "employment_type": "BOARD", "remote_scope": "CASE WHEN regexp_matches(lower(coalesce(location_name, '')), '^(worldwide|anywhere|global|remote|)$') THEN 'global' ELSE 'country_fenced' END"},
    ),
    "justjoin": (
        "data", f"named_struct('guid', concat('j', id), 'slug', 's', 'title', title, 'companyName', company_name, 'body', {HTML}, 'city', 'Rome', 'countryCode', IF(id % 3 = 0, NULL, 'it'), 'workplaceType', named_struct('label', 'x', 'value', IF(workplace_type = 'on-site', 'office', workplace_type)), 'employmentTypes', array(named_struct('type', employment_type, 'from', {PAY})), 'publishedAt', {DAY})",
        {"external_job_id": "concat('j', CAST(id AS VARCHAR))", "location_name": "CASE WHEN id % 3 = 0 THEN 'Rome' ELSE 'Rome, it' END", "employment_type": "BOARD", "pay_min": "(CAST(id % 90 AS INT) + 10) * 12", "remote_scope": "CASE WHEN id % 3 = 0 THEN 'global' ELSE 'country_fenced' END",
         "workplace_type": "coalesce(workplace_type, NULL)"},
    ),
    "nofluffjobs": (
        "postings", f"named_struct('id', concat('n', id), 'title', title, 'name', company_name, 'technology', 'React', 'location', named_struct('fullyRemote', id % 4 <> 0, 'places', IF(id % 3 = 0, array(), array(named_struct('city', 'X', 'country', named_struct('code', 'DE', 'name', 'Germany')), named_struct('city', 'Y', 'country', named_struct('code', IF(id % 3 = 1, 'DE', 'FR'), 'name', 'Z'))))), 'salary', named_struct('from', {PAY}, 'type', employment_type), 'posted', unix_millis(CAST(to_date(detected_at) AS TIMESTAMP)))",
        {"external_job_id": "concat('n', CAST(id AS VARCHAR))", "location_name": "CASE WHEN id % 3 <> 0 THEN 'X, Germany / Y, Z' END", "workplace_type": "'remote'", "employment_type": "BOARD", "pay_min": "(CAST(id % 90 AS INT) + 10) * 12", "full_text": "concat(title, ' ', title, ' at ', company_name, '. Technology: React')",
         "remote_scope": "CASE id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'country_fenced' ELSE 'region_fenced' END"},
    ),
    "workingnomads": (
        "", f"named_struct('_source', named_struct('id', id, 'title', title, 'company', company_name, 'description', {HTML}, 'locations', array(location_name), 'expired', id % 5 = 0, 'position_type', employment_type, 'pub_date', {DAY}))",
        {"workplace_type": "'remote'", "employment_type": "BOARD", "pay_min": "NULL", "remote_scope": "CASE WHEN location_name ILIKE '%remote%' THEN 'global' ELSE FREE END"},
    ),
    "fourdayweek": (
        "jobs", f"named_struct('id', concat('f', id), 'title', title, 'company', named_struct('name', company_name, 'hires_worldwide', id % 6 = 0), 'description', {HTML}, 'location', location_name, 'work_arrangement', workplace_type, 'job_type', employment_type, 'salary_lower', {PAY}, 'posted', unix_seconds(CAST(to_date(detected_at) AS TIMESTAMP)))",
        {"external_job_id": "concat('f', CAST(id AS VARCHAR))", "location_name": "nullif(location_name, '')", "employment_type": "BOARD", "remote_scope": "CASE WHEN id % 6 = 0 THEN 'global' WHEN workplace_type IS DISTINCT FROM 'remote' THEN 'unknown' ELSE FREE END"},
    ),
}
LABEL = "CASE WHEN e LIKE '%full%' THEN 'full-time' WHEN e LIKE '%part%' THEN 'part-time' WHEN e LIKE '%contract%' THEN 'contract' WHEN e LIKE '%intern%' THEN 'internship' END"
FULL = "concat(title, ' ', normalized_text, '\n id ', CAST(id AS VARCHAR))"
FREE = "CASE WHEN coalesce(trim(location_name), '') = '' OR regexp_matches(lower(location_name), 'world|anywhere|global') THEN 'global' ELSE 'country_fenced' END"
BOARD = f"CASE WHEN e = 'b2b' THEN 'contract' ELSE coalesce({LABEL}, e) END"
COMMON = {
    "external_job_id": "CAST(id AS VARCHAR)", "title": "title", "company_name": "company_name", "location_name": "location_name", "workplace_type": "workplace_type", "employment_type": LABEL, "department": "NULL",
    "pay_min": "CAST(id % 90 AS INT) + 10", "published_at": "CAST(CAST(detected_at AS DATE) AS TIMESTAMP)", "full_text": "FULL", "remote_scope": "FREE",
}
SEEN = "NOT ends_with(ats_slug, '13') AND CASE id % 15 WHEN 6 THEN id % 11 <> 0 WHEN 12 THEN id % 4 <> 0 WHEN 13 THEN id % 5 <> 0 ELSE true END"


def duck(column: str) -> str:
    """DuckDB: the column by source, which is the posting's number modulo 15."""
    found = {n: FORMS[s][2].get(column, COMMON[column]) for n, s in enumerate(NAMES)}
    out = "CASE id % 15 " + " ".join(f"WHEN {n} THEN {x}" for n, x in found.items()) + " END"
    for name, sql in (("FULL", FULL), ("FREE", FREE), ("BOARD", BOARD)):
        out = out.replace(name, sql)
    return f"CAST({out} AS DOUBLE)" if column == "pay_min" else out


def payloads(v) -> DataFrame:
    """One payload for each source and company; those of some companies are broken, and some come from nowhere known."""
    j = v.job.selectExpr("id", "ats_slug AS slug", "title", "company_name", "location_name", "workplace_type", "employment_type", "department", "normalized_text", "detected_at", "id % 15 AS n")
    items = []
    for few in range(0, len(NAMES), 5):  # all in one expression would be too much code for one method
        of = " ".join(f"WHEN {n} THEN to_json({FORMS[s][1]})" for n, s in list(enumerate(NAMES))[few : few + 5])
        items.append(j.filter(F.col("n").between(few, few + 4)).selectExpr("n", "slug", f"CASE n {of} END AS item"))
    rows = feeds.union_feeds(*items).groupBy("n", "slug").agg(F.array_join(F.collect_list("item"), ",").alias("items"))
    around = {n: ('{"hits":{"hits":[', "]}}") if s == "workingnomads" else (f'{{"{FORMS[s][0]}":[', "]}") if FORMS[s][0] else ("[", "]") for n, s in enumerate(NAMES)}
    whole = " ".join(f"WHEN {n} THEN concat('{a}', items, '{b}')" for n, (a, b) in around.items())
    names = " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(NAMES))
    bad = "CASE WHEN slug LIKE '%13' THEN CASE n % 3 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"other\": 1}' ELSE payload END ELSE payload END"
    out = rows.selectExpr("slug", "n", f"CASE n {names} END AS source", f"CASE n {whole} END AS payload")
    return out.selectExpr("CASE WHEN slug LIKE '%13' AND n % 3 = 2 THEN 'nobody' ELSE source END AS source", "slug", f"{bad} AS payload")


assert len(NAMES) == 15 and list(FORMS) == NAMES
E15 = "(SELECT *, lower(employment_type) AS e FROM job) x"
query(
    "set1_all_feeds",
    f"SELECT {str(NAMES)}[CAST(id % 15 AS INT) + 1] AS source, {', '.join(f'{duck(c)} AS {c}' for c in COMMON)} FROM {E15} WHERE {SEEN}",
    lambda v: feeds.with_board_scope(feeds.with_full_text(feeds.read_feeds(payloads(v)).filter("fault IS NULL"))).select("source", *COMMON),
)
query(
    "src2_feed_faults",
    f"SELECT CASE k WHEN 2 THEN 'nobody' ELSE source END AS source, CASE k WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no postings' ELSE 'unknown source' END AS fault, count(*) AS n FROM (SELECT DISTINCT ats_slug, id % 15 AS n, {str(NAMES)}[CAST(id % 15 AS INT) + 1] AS source, id % 15 % 3 AS k FROM job WHERE ends_with(ats_slug, '13')) x GROUP BY 1, 2",
    lambda v: feeds.feed_faults(payloads(v)),
)
