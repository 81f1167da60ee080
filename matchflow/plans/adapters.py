"""The domain tables as views over the test tables: column expressions that Spark and DuckDB read alike.

``view(spark, sf_dir, name)`` gives the Spark table; ``with_views(names, sql)`` puts the same views before a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Senior Frontend Engineer", "Account Executive", "Staff Backend Developer - EMEA", "QA Automation Engineer",
    "Data Entry Clerk", "React Native Developer", "Junior PHP Developer", "Lead Platform Engineer - US", "Sales Manager",
    "Full Stack Engineers", "Site Reliability Engineer", "Machine Learning Engineer", "Software Tester", "UX Designer",
    "Laravel Developer", "Solutions Architect", "Node.js Engineer", "Salesforce Developer", "Drupal / PHP Engineer", "Senior Shopify Developer", "C# Developer", "AI Engineer", "Tech Lead", "Computer Vision Researcher", "AppSec Engineer", "Security Clearance Analyst", "DevOps Engineer - APAC",
]
TEXTS = [
    "Work from anywhere in the world with React and TypeScript. 3-5 years of experience. You know Node.js and Next.js well, and have put C++ or C# to use.", "Must be authorized to work in the United States.",
    "TS/SCI clearance required for this role.", "We use Docker, Kubernetes and Go. 7+ years of experience. Core hours overlap with the team in Lisbon; we meet during our business hours.", "Hybrid, three days in the office in Berlin. Reactive people and Going concerns only; the pay is 60 000 EUR a year for Ruby on Rails work.",
    "Remote within Canada only. Laravel and PHP. You must hold a work permit for the province that you live in, and write clear English.", "Fully remote, worldwide. Node and GraphQL, UTC-3 to UTC+3.", "On-site in London.",
    "Remote, Europe only. Python and Django. We are only considering candidates from countries near ours, and PostgreSQL is our database.", "E-Verify employer. Java and Spring Boot, CI/CD and REST API design; eligible to work in the US. Tell us what you have made.", "short",
]
PLACES = ["Remote", "Remote - Worldwide", "Berlin, Germany", "Remote, md", "Remote; Argentina", "São Paulo", "NAMER + EMEA", "London", "United States", "Anywhere", "New York, NY", "", "Remote, Canada"]
FRONT = ["react", "vue", "angular", "svelte", "nextjs", "jquery", "remix"]
BACK = ["nodejs", "laravel", "django", "spring", "go", "rust", "rails", "fastapi", "dotnet", "nestjs", "symfony"]
TOOLS = ["docker", "aws", "kubernetes", "ci-cd", "graphql"]
MORE = ["typescript", "php", "python", "java", "csharp", "cypress", "selenium", "qa", "tailwindcss", "postgresql", "ruby", "javascript", "golang"]
SOURCES = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "remoteok", "himalayas"]
FOUND_BY = ["yc_directory", "hn_algolia", "google_cse", "workable_meta_search", "vc_portfolio", "certstream", "npm_registry"]

#: view -> (source tables and join, {column: expression}). «x|k» picks element k % size of list x; [a, b] is an array.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "job": (
        "orders LEFT JOIN embeddings ON vec_id = o_orderkey % 200",
        {
            "id": "o_orderkey", "ats_source": "«SOURCES|o_orderkey»", "ats_slug": "concat('co', CAST(o_custkey % 97 AS VARCHAR(20)))",
            "external_job_id": "concat('x', CAST(o_orderkey % 4001 AS VARCHAR(20)))",
            "title": "«TITLES|o_orderkey»", "normalized_text": "«TEXTS|o_orderkey»", "location_name": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE «PLACES|o_orderkey» END",
            "company_name": "concat('Company ', CAST(o_custkey % 97 AS VARCHAR(20)), CASE WHEN o_custkey % 2 = 0 THEN ', Inc.' ELSE ' Labs' END)",
            "extracted_tags": "[«FRONT|o_orderkey», «BACK|o_orderkey», «TOOLS|o_orderkey», «MORE|o_orderkey»]",
            "required_tags": "CASE WHEN o_orderkey % 4 = 0 THEN [«FRONT|o_orderkey», «MORE|o_orderkey»] END",
            "job_embedding": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE shifted(embedding) END",
            "status": "CASE o_orderkey % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'stale' WHEN 2 THEN 'gone' WHEN 3 THEN 'normalization_failed' ELSE 'active' END",
            "remote_scope": "CASE o_orderkey % 7 WHEN 0 THEN 'country_fenced' WHEN 1 THEN 'region_fenced' WHEN 2 THEN 'undetermined' WHEN 3 THEN 'onsite' ELSE 'global' END",
            "workplace_type": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'hybrid' WHEN 2 THEN 'on-site' ELSE 'remote' END",
            "raw_json": "CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE concat('payload ', CAST(o_orderkey AS VARCHAR(20))) END",
            "employment_type": "CASE o_orderkey % 6 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'contractor' WHEN 2 THEN 'B2B' WHEN 3 THEN 'Internship' WHEN 4 THEN 'part_time' END",
            "department": "CASE o_orderkey % 3 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Product' END",
            "compensation_min": "CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_totalprice END", "compensation_max": "o_totalprice * 1.25",
            "compensation_currency": "CASE o_orderkey % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'PLN' WHEN 2 THEN 'XXX' WHEN 3 THEN 'GBP' WHEN 4 THEN 'USD' END",
            "experience_min_years": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS INT) END",
            "experience_max_years": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS INT) + 2 END",
            "location_countries": "CASE o_orderkey % 8 WHEN 1 THEN ['US', 'CA'] WHEN 3 THEN ['DE'] WHEN 5 THEN ['Serbia', 'gb'] END",
            "is_fenced": "CASE o_orderkey % 9 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END", "is_natsec": "CASE o_orderkey % 23 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
            "is_qa": "CASE o_orderkey % 13 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
            "detected_at": "o_orderdate", "published_at": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate - INTERVAL 9 DAY END",
            "source_status": "CASE o_orderkey % 7 WHEN 0 THEN ' Closed' WHEN 1 THEN 'on-hold' WHEN 2 THEN 'open' WHEN 3 THEN 'Draft ' WHEN 4 THEN 'odd' WHEN 5 THEN 'filled' END",
            "last_seen_at": "o_orderdate + INTERVAL 20 DAY", "normalized_at": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END",
        },
    ),
    "persona": (
        "supplier LEFT JOIN embeddings ON vec_id = (s_suppkey * 7) % 200",
        {
            "id": "s_suppkey", "applicant_id": "s_suppkey % 40", "persona_label": "concat('persona ', CAST(s_suppkey AS VARCHAR(20)))",
            "must_have_tags": "[«FRONT|s_suppkey», «BACK|(s_suppkey * 3)», «MORE|(s_suppkey * 5)», «TOOLS|s_suppkey»]",
            "blocklist_tags": "CASE WHEN s_suppkey % 3 = 0 THEN [«MORE|(s_suppkey * 7)»] ELSE [] END",
            "seniority_levels": "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['junior'] WHEN 2 THEN ['senior', 'lead'] ELSE ['lead'] END",
            "persona_embedding": "shifted(embedding)",
        },
    ),
    "applicant": (
        "supplier",
        {
            "user_id": "s_suppkey", "country": "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'CA' ELSE 'RS' END",
            "assignment_types": "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ['remote'] ELSE ['hybrid', 'remote_local'] END",
            "preferred_compliance": "CASE s_suppkey % 4 WHEN 0 THEN ['w8ben'] WHEN 1 THEN ['w2', 'ic_global'] WHEN 2 THEN [] END",
            "expected_comp_min": "abs(s_acctbal) * 12", "years_of_experience": "CAST(s_suppkey % 15 AS INT)",
        },
    ),
    "company": (
        "customer",
        {
            "id": "c_custkey", "ats_source": "«SOURCES|c_custkey»", "ats_slug": "concat('co', CAST(c_custkey % 97 AS VARCHAR(20)))", "discovery_source": "«FOUND_BY|c_custkey»",
            "company_name": "concat('Company ', CAST(c_custkey AS VARCHAR(20)), CASE c_custkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Labs' ELSE ' Technologies GmbH' END)",
            "canonical_name": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('company', CAST(c_custkey AS VARCHAR(20)), CASE WHEN c_custkey % 10 = 1 THEN ' corp' ELSE '' END) END",
            "root_domain": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('company', CAST(c_custkey AS VARCHAR(20)), '.com') END",
            "tier": "CASE c_custkey % 5 WHEN 0 THEN 'active_hot' WHEN 1 THEN 'active' WHEN 2 THEN 'probation' WHEN 3 THEN 'dormant' ELSE 'dead' END",
            "health": "CASE WHEN c_custkey % 9 = 0 THEN 'dead' ELSE 'healthy' END", "consecutive_failures": "c_custkey % 5", "zero_yield_poll_count": "c_custkey % 6",
            "polling_enabled": "c_custkey % 11 <> 0", "is_agency": "c_custkey % 13 = 0", "is_public": "c_custkey % 7 = 0",
            "employee_count": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 6000 AS INT) END",
            "discovered_at": "TIMESTAMP '1995-01-01 00:00:00' + INTERVAL 1 DAY * CAST(c_custkey % 1300 AS INT)",
            "last_polled_at": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(c_custkey % 700 AS INT) END",
            "last_job_posted_at": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1997-12-20 00:00:00' + INTERVAL 1 DAY * CAST(c_custkey % 20 AS INT) END",
        },
    ),
    "company_poll": (
        "orders",
        {
            "id": "o_orderkey", "company_id": "o_custkey", "polled_at": "CAST(o_orderdate AS TIMESTAMP)",
            "status_code": "CASE (o_orderkey * 7 + o_custkey * 3) % 12 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN NULL WHEN 5 THEN 500 ELSE 200 END",
            "valid": "o_orderkey % 5 <> 0", "newest": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate - INTERVAL 2 DAY AS TIMESTAMP) END",
            "jobs": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS INT) END", "error": "concat('error ', CAST(o_orderkey % 5 AS VARCHAR(20)))",
        },
    ),
    "match_queue": (
        "lineitem",
        {
            "id": "l_orderkey * 10 + l_linenumber", "job_id": "l_orderkey", "persona_id": "l_suppkey", "applicant_id": "l_suppkey % 40",
            "overlap_score": "CAST((l_orderkey + l_suppkey) % 6 AS INT)", "cosine_distance": "CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE l_tax * 8 + l_discount END",
            "status": "CASE (l_orderkey + l_suppkey) % 8 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'error' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'stale' WHEN 5 THEN 'rejected' ELSE 'pending' END",
            "llm_confidence": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount * 5 END",
            "prompt_variant": "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END",
            "llm_blockers": "CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ['Location: US only', 'Requires clearance'] WHEN 2 THEN ['Seniority too junior'] WHEN 3 THEN ['Remote work is restricted to one region', 'Vue experience'] WHEN 4 THEN ['On-site three days', 'Requires relocation'] WHEN 5 THEN ['ANGULAR is required'] ELSE ['Missing stack skills', 'salary below range'] END",
            "is_read": "l_linenumber % 2 = 0", "created_at": "l_shipdate", "evaluated_at": "l_shipdate + INTERVAL 2 DAY", "stale_at": "CASE WHEN l_linenumber = 1 THEN l_shipdate + INTERVAL 3 DAY END",
        },
    ),
    "ingestion_log": (
        "events",
        {
            "id": "event_id", "source": "«SOURCES|user_id»", "type": "CASE WHEN user_id % 3 = 0 THEN 'poll' ELSE 'seed' END",
            "status": "CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'partial' ELSE 'success' END",
            "items_processed": "CAST(floor(value) AS INT)", "items_inserted": "CAST(floor(value / 2) AS INT)", "items_updated": "CAST(floor(value / 4) AS INT)",
            "items_rejected": "CAST(floor(value / 8) AS INT)", "items_skipped": "CAST(floor(value / 16) AS INT)",
            "error_message": "CASE WHEN event_type = 'error' THEN concat(CASE WHEN user_id % 9 < 5 AND event_id % 4 < 3 THEN 'Zod validation failed: error ' ELSE 'error ' END, CAST(user_id % 9 AS VARCHAR(20))) END", "error_details": "props",
            "started_at": "ts", "finished_at": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + INTERVAL 90 SECOND END", "created_at": "ts",
        },
    ),
    "source_health": (
        "supplier",
        {
            "source_name": "concat('source', CAST(s_suppkey AS VARCHAR(20)))", "status": "CASE s_suppkey % 4 WHEN 0 THEN 'disabled' WHEN 1 THEN 'degraded' ELSE 'healthy' END",
            "consecutive_failures": "s_suppkey % 6", "total_runs": "s_suppkey * 3 + 1", "total_failures": "s_suppkey",
            "disabled_at": "CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 1 HOUR * CAST(s_suppkey % 48 AS INT) END",
            "last_failure_at": "TIMESTAMP '1997-12-30 00:00:00' + INTERVAL 1 HOUR * CAST(s_suppkey % 48 AS INT)",
        },
    ),
    "alerts": (
        "events",
        {
            "id": "event_id", "type": "event_type", "source": "«SOURCES|user_id»", "is_active": "event_id % 5 = 0", "auto_retry_attempted": "event_id % 3 = 0",
            "auto_retry_succeeded": "event_id % 6 = 0", "created_at": "ts", "severity": "CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END",
        },
    ),
    "job_label_override": (
        "part",
        {
            "ats_slug": "concat('co', CAST(p_partkey % 97 AS VARCHAR(20)))", "title": "«TITLES|p_partkey»", "override_type": "CASE p_partkey % 3 WHEN 0 THEN 'geo_fenced' WHEN 1 THEN 'suppressed' ELSE 'other' END",
            "revoked_at": "CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '1997-01-01 00:00:00' END",
        },
    ),
    "audit_label": ("orders LEFT JOIN labels ON doc_id = o_orderkey % 200", {"job_id": "o_orderkey", "wrong": "CASE WHEN quality IS NOT NULL THEN quality = 0 OR toxic = 1 END"}),
    "applicant_company_block": ("customer", {"user_id": "c_custkey % 40", "ats_slug": "concat('co', CAST((c_custkey * 3) % 97 AS VARCHAR(20)))"}),
    "company_discovery_sources": (
        "orders", {"company_id": "o_custkey", "discovery_source": "«FOUND_BY|o_orderkey»", "discovered_at": "o_orderdate"},
    ),
    "working_history": (
        "lineitem",
        {
            "applicant_id": "l_suppkey", "start_date": "CAST(l_shipdate AS DATE)", "end_date": "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN CAST(l_shipdate - INTERVAL 5 DAY AS DATE) ELSE CAST(l_shipdate + INTERVAL 40 DAY AS DATE) END",
            "canonical_skills_detected": "[«FRONT|l_partkey», «BACK|l_orderkey»]",
        },
    ),
    "slugger_retry": (
        "customer",
        {"id": "c_custkey", "company_name": "c_name", "retry_count": "CAST(c_custkey % 5 AS INT)", "next_retry_at": "TIMESTAMP '1997-11-01 00:00:00' + INTERVAL 1 DAY * CAST(c_custkey % 90 AS INT)"},
    ),
    "layoffs": (
        "part",
        {
            "layoff_id": "p_partkey",
            "company": "CASE p_partkey % 6 WHEN 0 THEN concat('The COMPANY ', CAST(p_partkey % 997 AS VARCHAR(20)), ' Corp.') WHEN 1 THEN concat(CAST(p_partkey % 997 AS VARCHAR(20)), ' labs co.') WHEN 2 THEN concat('Big Company ', CAST(p_partkey % 997 AS VARCHAR(20)), ', Inc') WHEN 3 THEN concat('New ', CAST(p_partkey % 997 AS VARCHAR(20)), ' Technologies GmbH & Co.') WHEN 4 THEN concat('Company ', CAST(p_partkey % 997 AS VARCHAR(20)), ' Labs') END",
        },
    ),
}

AS_OF = "1998-01-01 00:00:00"
LISTS = {k: v for k, v in globals().items() if isinstance(v, list) and k.isupper()}


def _spelled(expr: str, duck: bool) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda items: ("[" + ", ".join(items) + "]") if duck else "array(" + ", ".join(items) + ")"

    def pick(m: re.Match) -> str:
        items, at = LISTS[m[1]], f"CAST({m[2]} % {len(LISTS[m[1]])} AS INT) + 1"
        return f"{listed(list(map(quote, items)))}[{at}]" if duck else f"element_at({listed(list(map(quote, items)))}, {at})"

    # vectors of one field have something in common, which random ones lack
    common = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 5e-2)" if duck else "transform(embedding, x -> CAST(x AS DOUBLE) + 5e-2)"
    expr = expr.replace("shifted(embedding)", common)
    if duck:
        expr = expr.replace("[]", "CAST([] AS VARCHAR[])")
    else:
        expr = expr.replace("[]", "CAST(array() AS array<string>)")
        expr = re.sub(r"(?<![«\w)])\[((?:[^\[\]«»]|«[^»]*»)*)\]", r"array(\1)", expr).replace("VARCHAR(20)", "STRING")
    return re.sub(r"«(\w+)\|([^»]*)»", pick, expr)


def dealt(df: DataFrame) -> DataFrame:
    """A table of a few small files, whose rows would all be worked on by one core, dealt to all of them; one of more
    parts than cores as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    first, _, rest = source.partition(" LEFT JOIN ")
    df = dealt(spark.read.parquet(f"{sf_dir}/{first}.parquet"))
    if rest:
        second, on = rest.split(" ON ")
        df = df.join(spark.read.parquet(f"{sf_dir}/{second}.parquet"), F.expr(on), "left")
    return df.selectExpr(*[f"{_spelled(e, False)} AS {c}" for c, e in columns.items()])


def with_views(sql: str) -> str:
    """The DuckDB query with the views that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS (SELECT {', '.join(f'{_spelled(e, True)} AS {c}' for c, e in VIEWS[v][1].items())} FROM {VIEWS[v][0]})" for v in used]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else sql
