"""Every operator applied to its whole table, with the DuckDB query that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X
from matchflow.operators import filters as flt
from matchflow.operators import joins as joi
from matchflow.operators import reports as rep
from matchflow.operators import routing as rou
from matchflow.operators import scoring as sco
from matchflow.operators import tags as tag
from matchflow.operators import upserts as ups
from matchflow.plans.adapters import AS_OF, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"


class Views:
    """The adapter views as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None, run: Callable[[Views], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Views(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = with_views(sql)


def words(terms: list[str], plural: bool = False) -> str:
    return X.any_word(terms, plural).replace("(?i)", "").replace("'", "''").replace("\\-", "-").replace("\\ ", " ")


def parts(terms: list[str]) -> str:
    return X.any_part(terms).replace("(?i)", "").replace("\\-", "-").replace("\\ ", " ")


def arr(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


IDS = lambda df: df.select("id")
NOWHERE = parts(C.REMOTE_INDICATORS + C.BROAD_REGIONS)
SPECIFIC = f"(lower(coalesce(location_name, '')) <> '' AND NOT regexp_matches(lower(coalesce(location_name, '')), '{NOWHERE}'))"
FENCE_WORDS = "|".join(C.FENCES)
FENCE = f"""CASE WHEN regexp_matches(lower(title), '{FENCE_WORDS}') THEN 'title_fence' WHEN p = '' THEN NULL
      WHEN regexp_matches(p, '{FENCE_WORDS}') THEN CASE WHEN regexp_matches(p, '{C.FENCING_REGIONS}') THEN 'location_region'
        WHEN list_has_any(regexp_extract_all(p, 'remote\\s*,\\s*([a-z][a-z])\\b', 1), {arr(C.US_STATES)}) THEN 'location_us_state' ELSE 'location_country' END
      WHEN regexp_matches(p, '{parts(C.REGION_TERMS)}') THEN 'location_region'
      WHEN list_has_any(regexp_extract_all(p, ',\\s*([a-z][a-z])\\b', 1), {arr(C.US_STATES)}) THEN 'location_us_state'
      WHEN regexp_matches(p, '{parts(C.NAMED_COUNTRIES)}') OR (length(p) <= 5 AND regexp_matches(p, '\\bus\\b')) THEN 'location_country'
      WHEN NOT regexp_matches(p, 'remote|anywhere|worldwide|global|distributed|any location') AND (contains(p, ';') OR length(p) < 50 OR regexp_matches(p, '^[a-z].*,\\s*[a-z]')) THEN 'location_specific_city' END"""
ends = lambda terms: "|".join(rf"\b{re.escape(t)}\b" for t in terms)

# --- filters and flags
query("flt1_engineering_titles", f"SELECT id, title FROM job WHERE regexp_matches(lower(title), '{words(C.ENGINEERING_TERMS, True)}')", lambda v: flt.filter_engineering_titles(v.job).select("id", "title"))
query("flt2_webdev_titles", f"SELECT id, title FROM job WHERE regexp_matches(lower(title), '{parts(C.WEBDEV_TERMS)}')", lambda v: flt.filter_webdev_titles(v.job).select("id", "title"))
query("flt3_country_fence", f"SELECT id, {FENCE} AS fence FROM (SELECT *, lower(trim(coalesce(location_name, ''))) AS p FROM job) t", lambda v: flt.with_country_fence(v.job).select("id", "fence"))
query(
    "flt4_fence_flag",
    f"SELECT id, coalesce(is_fenced, ({FENCE}) IS NOT NULL OR regexp_matches(lower(coalesce(normalized_text, '')), '\\b(e-?verify|(eligibility|authorized)\\s+to\\s+work\\s+in\\s+(the\\s+)?(u\\.?s\\.?a?|united\\s+states))\\b')) AS fenced FROM (SELECT *, lower(trim(coalesce(location_name, ''))) AS p FROM job) t",
    lambda v: flt.with_fence_flag(v.job).select("id", "fenced"),
)
query(
    "flt5_natsec_flag",
    f"""SELECT id, coalesce(is_natsec, regexp_matches(t, '{ends(C.NATSEC_WORDS)}') OR (regexp_matches(t, '{ends(C.NATSEC_HINTS)}') AND regexp_matches(t, '{ends(C.CLEARANCE_WORDS)}')), false) AS natsec
    FROM (SELECT *, lower(concat_ws(' ', title, substr(normalized_text, 1, 3000))) AS t FROM job) x""",
    lambda v: flt.with_natsec_flag(v.job).select("id", "natsec"),
)
query(
    "flt6_qa_flag",
    f"""SELECT id, coalesce(is_qa, regexp_matches(lower(title), '{words(C.QA_TITLE_TERMS)}') OR (len(list_intersect(extracted_tags, {arr(C.STACK_FAMILIES['qa'])})) >= 3
      AND NOT regexp_matches(lower(title), '{words(['developer', 'engineer', 'programmer'])}')), false) AS qa FROM job""",
    lambda v: flt.with_qa_flag(v.job).select("id", "qa"),
)
query("flt7_fresh", f"SELECT id FROM job WHERE published_at >= {NOW} - INTERVAL 60 DAY", lambda v: IDS(flt.filter_fresh(v.job, AS_OF)))
query("flt8_recent", f"SELECT id FROM job WHERE coalesce(published_at, detected_at) >= {NOW} - INTERVAL 60 DAY", lambda v: IDS(flt.filter_recent(v.job, AS_OF)))
query("flt9_is_active", "SELECT id, NOT coalesce(ats_source NOT IN ('greenhouse', 'lever', 'ashby', 'workable') AND lower(trim(source_status)) IN ('closed', 'archived', 'inactive', 'filled', 'unpublished', 'draft', 'expired', 'on_hold', 'on-hold', 'paused'), false) AS active FROM job", lambda v: flt.with_is_active(v.job).select("id", "active"))
query(
    "flt10_persona_tech",
    "SELECT id FROM job WHERE regexp_matches(lower(concat_ws(' ', array_to_string(extracted_tags, ' '), title, normalized_text)), '(^|[^a-z0-9])(go|php)([^a-z0-9]|$)|graphql|typescript')",
    lambda v: IDS(flt.filter_persona_tech(v.job, ["go", "php", "graphql", "typescript"])),
)
query(
    "flt11_search_postings",
    """SELECT id FROM job WHERE status = 'active' AND (title ILIKE '%react%' OR normalized_text ILIKE '%react%' OR list_contains(extracted_tags, 'React')) AND workplace_type IN ('remote', 'hybrid')
      AND (compensation_min IS NULL OR compensation_min >= 50000) AND (compensation_max IS NULL OR compensation_max <= 400000) AND (experience_min_years IS NULL OR experience_min_years >= 1) AND (experience_max_years IS NULL OR experience_max_years <= 9)
      AND department ILIKE '%eng%' AND list_has_any(extracted_tags, ['docker', 'aws', 'typescript'])""",
    lambda v: IDS(flt.search_postings(v.job, "React", ["remote", "hybrid"], min_pay=50000, max_pay=400000, min_years=1, max_years=9, department="eng", skills=["docker", "aws", "typescript"])),
)
query(
    "flt11_search_page",
    "SELECT id FROM job WHERE status = 'active' AND remote_scope = 'global' AND employment_type = 'contractor' AND coalesce(published_at, detected_at) >= TIMESTAMP '1995-01-01 00:00:00' ORDER BY coalesce(published_at, detected_at) DESC, id LIMIT 50 OFFSET 20",
    lambda v: IDS(flt.search_postings(v.job, scope="global", employment="contractor", posted_since="1995-01-01 00:00:00", limit=50, offset=20)),
)
query("flt12_servable", "SELECT id FROM job WHERE remote_scope = 'global' AND is_fenced IS NOT TRUE AND is_natsec IS NOT TRUE AND is_qa IS NOT TRUE", lambda v: IDS(flt.filter_servable(v.job)))
query(
    "flt13_match_status",
    f"""SELECT id, 'pending' AS seen FROM match_queue WHERE status IN ('pending', 'error') UNION ALL SELECT id, 'stale' FROM match_queue WHERE status = 'stale' AND stale_at >= {NOW} - INTERVAL 24 HOUR
    UNION ALL SELECT id, 'approved' FROM match_queue WHERE status = 'approved' AND NOT is_read UNION ALL SELECT id, 'viewed' FROM match_queue WHERE status = 'approved' AND is_read""",
    lambda v: (lambda m: flt.filter_match_status(m, "pending", AS_OF).select("id", F.lit("pending").alias("seen")).union(flt.filter_match_status(m, "stale", AS_OF).select("id", F.lit("stale"))).union(flt.filter_match_status(m, "approved", AS_OF).select("id", F.lit("approved"))).union(flt.filter_match_status(m, "viewed", AS_OF).select("id", F.lit("viewed"))))(v.match_queue),
)
SLUG_CASES = "CASE id % 9 WHEN 0 THEN {0} WHEN 1 THEN concat('acmeinternationalholdings', ats_slug) WHEN 2 THEN concat('acme-international-holdings-', ats_slug) WHEN 3 THEN substr(ats_slug, 3, 4) WHEN 4 THEN 'nv' WHEN 5 THEN ' IO ' ELSE ats_slug END"
SLUGS = SLUG_CASES.format(f"element_at(array({', '.join(map(repr, C.NAVIGATION_SLUGS))}), CAST(id % {len(C.NAVIGATION_SLUGS)} AS INT) + 1)"), SLUG_CASES.format(f"{arr(C.NAVIGATION_SLUGS)}[CAST(id % {len(C.NAVIGATION_SLUGS)} AS INT) + 1]")
query("flt14_valid_slugs", f"SELECT id FROM (SELECT id, lower(trim({SLUGS[1]})) AS s FROM company) c WHERE length(s) BETWEEN 2 AND 60 AND NOT regexp_matches(s, '^[0-9]+$') AND NOT list_contains({arr(C.NAVIGATION_SLUGS)}, s) AND (length(s) <= 25 OR regexp_matches(s, '[-_./]')) AND (length(s) > 2 OR regexp_matches(s, '[aeiou]'))", lambda v: IDS(flt.filter_valid_slugs(v.company.withColumn("ats_slug", F.expr(SLUGS[0])))))
query(
    "flt15_aggregators",
    "SELECT id FROM company WHERE ats_slug NOT IN (SELECT ats_slug FROM applicant_company_block WHERE user_id = 3) AND NOT regexp_matches(lower(company_name), '(company 1[0-9] |labs)')",
    lambda v: IDS(flt.filter_aggregators(v.company, v.applicant_company_block.filter("user_id = 3"), ["labs"]).filter("NOT lower(company_name) RLIKE 'company 1[0-9] '")),
)
query("flt16_career_domains", "SELECT page_id FROM pages WHERE len(string_split(h, '.')) >= 3 AND list_contains(['careers', 'career', 'jobs', 'job', 'work', 'talent', 'join', 'hiring', 'apply'], string_split(h, '.')[1])".replace("FROM pages", "FROM (SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'careers.' WHEN 1 THEN 'jobs.' ELSE '' END, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))) AS h FROM pages) p"),
      lambda v: flt.filter_career_domains(v.spark.read.parquet(f"{v.sf_dir}/pages.parquet").select("page_id", F.concat(F.when(F.col("page_id") % 4 == 0, "careers.").when(F.col("page_id") % 4 == 1, "jobs.").otherwise(""), F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))).alias("domain"))).select("page_id"))
query(
    "flt17_normalization_action",
    "SELECT id, CASE WHEN normalized_at IS NOT NULL THEN 'skip:processed' ELSE CASE status WHEN 'rejected' THEN 'skip:rejected' WHEN 'normalization_failed' THEN 'normalize:retry' WHEN 'stale' THEN 'skip:aged_out' WHEN 'gone' THEN 'skip:aged_out' ELSE 'normalize:new' END END AS action FROM job",
    lambda v: flt.with_normalization_action(v.job).select("id", "action"),
)
query("flt18_due_retries", f"SELECT id, retry_count FROM slugger_retry WHERE next_retry_at < {NOW} AND retry_count < 3 ORDER BY next_retry_at, id LIMIT 100", lambda v: flt.select_due_retries(v.slugger_retry, AS_OF).select("id", "retry_count"))
query("flt19_suspect_sample", f"SELECT id FROM job WHERE remote_scope = 'global' AND {SPECIFIC} ORDER BY md5(concat('s', CAST(id AS VARCHAR))), id LIMIT 50", lambda v: IDS(flt.sample_suspects(v.job, 50, "s")))

# --- tags
cases = lambda of, known: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in known.items()) + " END"
NAMED = "list_distinct(list_transform(regexp_extract_all(lower({0}), '" + tag.label_pattern() + "'), lambda x: " + cases("x", tag.LABEL_TAGS) + "))"
query("tag1_scan_tags", f"SELECT id, array_to_string(list_sort({NAMED.format('normalized_text')}), ',') AS tags FROM job", lambda v: tag.scan_tags(v.job, "normalized_text").select("id", F.array_join("tags", ",").alias("tags")))
RAW_TAGS = ["Golang", " k8s ", "React.js 18", "Ruby on Rails", "C++", "unheard of", "spring-boot", "node js, graphql"]  # spellings beside the extracted ones
query(
    "tag2_normalize_tags",
    f"""WITH t AS (SELECT id, unnest(list_concat(extracted_tags, [{arr(RAW_TAGS)}[1 + id % {len(RAW_TAGS)}]])) AS raw FROM job), l AS (SELECT id, lower(trim(raw)) AS x FROM t),
    k AS (SELECT id, x, coalesce({cases('x', tag.LABEL_TAGS)}, {cases('x', C.TAG_VARIANTS)}) AS known FROM l), n AS (SELECT id, unnest(CASE WHEN known IS NULL THEN {NAMED.format('x')} ELSE [known] END) AS tag FROM k)
    SELECT j.id, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM job j LEFT JOIN n ON n.id = j.id GROUP BY j.id""",
    lambda v: tag.normalize_tags(v.job.withColumn("extracted_tags", F.concat("extracted_tags", F.array(X.strings(RAW_TAGS)[(F.col("id") % len(RAW_TAGS)).cast("int")]))), "extracted_tags").select("id", F.array_join("extracted_tags", ",").alias("tags")),
)
DEFINING = arr(tag.DEFINING_TAGS)
query("tag3_normalize_postings", f"SELECT id, CASE WHEN length(normalized_text) < 100 THEN 'title_only' WHEN list_has_any(extracted_tags, {DEFINING}) THEN 'normalized' ELSE 'no_tags' END AS outcome FROM job", lambda v: tag.normalize_postings(v.job).select("id", "outcome"))
query(
    "tag4_aggregator_rows",
    f"SELECT id, CASE WHEN length(normalized_text) < 100 THEN 'title_only' WHEN list_has_any(extracted_tags, {DEFINING}) THEN 'normalized' ELSE 'no_tags' END AS outcome FROM job WHERE regexp_matches(lower(title), '{words(C.ENGINEERING_TERMS, True)}')",
    lambda v: tag.normalize_postings(flt.filter_engineering_titles(v.job)).select("id", "outcome"),
)
FAMS = [f for f in C.STACK_FAMILIES if f != "qa"]
count_of = lambda f: f"len(list_intersect(extracted_tags, {arr(C.STACK_FAMILIES[f])}))"
query(
    "tag5_stack_family",
    "WITH n AS (SELECT id, unnest(" + arr(FAMS) + ") AS f, unnest([" + ", ".join(map(str, range(len(FAMS)))) + "]) AS o, unnest([" + ", ".join(map(count_of, FAMS)) + "]) AS c FROM job) "
    "SELECT id, arg_max(f, c * 100 - o) FILTER (WHERE c > 0) AS family, string_agg(f, ',' ORDER BY o) FILTER (WHERE c > 0) AS families FROM n GROUP BY id",
    lambda v: tag.with_stack_family(v.job, "extracted_tags").select("id", "family", F.when(F.size("families") > 0, F.array_join("families", ",")).alias("families")),
)
query("tag7_stack_overlap", f"SELECT id, len(list_intersect(list_filter(extracted_tags, lambda x: NOT list_contains({arr(C.PROCESS_NOISE_TAGS)}, x)), ['react', 'docker', 'php', 'go'])) AS n FROM job", lambda v: v.job.select("id", tag.stack_overlap(F.col("extracted_tags"), X.strings(["react", "docker", "php", "go"])).alias("n")))
query("tag8_effective_tags", "SELECT id, array_to_string(CASE WHEN len(coalesce(required_tags, [])) > 0 THEN required_tags ELSE extracted_tags END, ',') AS tags FROM job", lambda v: v.job.select("id", F.array_join(X.effective_tags(F.col("required_tags"), F.col("extracted_tags")), ",").alias("tags")))
query(
    "tag11_tag_experience",
    f"""WITH s AS (SELECT applicant_id, unnest(canonical_skills_detected) AS tag, start_date AS s, coalesce(end_date, DATE '1998-01-01') AS e FROM working_history),
    a AS (SELECT *, max(e) OVER (PARTITION BY applicant_id, tag ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s WHERE e >= s),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY applicant_id, tag ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM a),
    m AS (SELECT applicant_id, tag, k, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)
    SELECT applicant_id, tag, CAST(sum(e - s) AS BIGINT) AS days, round(sum(e - s) / 365.25::DOUBLE, 1) AS years FROM m GROUP BY applicant_id, tag""",
    lambda v: tag.tag_experience(v.working_history, "1998-01-01"),
)
query(
    "tag12_personas_to_reembed",
    "SELECT id, array_to_string(list_sort(must_have_tags[2:2]), ',') AS changed FROM persona WHERE id % 2 = 1",
    lambda v: (lambda p: tag.personas_to_reembed(p, p.withColumn("must_have_tags", F.when(F.col("id") % 2 == 1, F.array_remove("must_have_tags", F.col("must_have_tags")[1])).otherwise(F.col("must_have_tags")))).select("id", F.array_join("changed", ",").alias("changed")))(v.persona),
)

# --- routing
EFF = "CASE WHEN len(coalesce(required_tags, [])) > 0 THEN required_tags ELSE extracted_tags END"
ROUTABLE = "status = 'active' AND remote_scope = 'global' AND job_embedding IS NOT NULL AND is_fenced IS NOT TRUE AND is_natsec IS NOT TRUE AND is_qa IS NOT TRUE"
DISJOINT = " OR ".join(f"(list_has_any(must_have_tags, {arr(C.STACK_FAMILIES[f])}) AND NOT list_has_any(extracted_tags, {arr(C.STACK_FAMILIES[f])}))" for f in FAMS)


def route_sql(strict: bool, jobs: str = "job") -> str:
    extra = (
        f"AND list_has_any(list_transform(list_intersect(must_have_tags, tags), lambda x: coalesce({cases('x', C.TAG_VARIANTS | tag.LABEL_TAGS)}, x)), {arr(C.DISTINCTIVE_TAGS)}) AND NOT list_has_any(blocklist_tags, extracted_tags) AND NOT ({DISJOINT})"
        if strict
        else ""
    )
    return f"""j AS (SELECT id AS job_id, {EFF} AS tags, extracted_tags, job_embedding, ats_slug, title FROM {jobs} WHERE {ROUTABLE}),
    pairs AS (SELECT job_id, p.id AS persona_id, applicant_id, ats_slug, title, len(list_filter(must_have_tags, lambda t: list_contains(tags, t))) AS overlap,
        1 - list_cosine_similarity(CAST(job_embedding AS DOUBLE[]), CAST(persona_embedding AS DOUBLE[])) AS distance
      FROM j, persona p WHERE len(list_filter(must_have_tags, lambda t: list_contains(tags, t))) >= 2 {extra}),
    scored AS (SELECT *, 0.6::DOUBLE * (1 - exp(-0.4::DOUBLE * least(overlap, 5))) + 0.4::DOUBLE * (1 - distance) AS score FROM pairs WHERE distance < 0.75),
    routed AS (SELECT job_id, persona_id, applicant_id, ats_slug, title, overlap, round(distance, 6) AS distance, round(score, 6) AS score,
        row_number() OVER (PARTITION BY job_id ORDER BY round(score, 9) DESC, persona_id) AS rank FROM scored QUALIFY rank <= 8)"""


query("joi1_tag_overlap", "SELECT j.id AS job_id, p.id AS persona_id, len(list_filter(must_have_tags, lambda t: list_contains(extracted_tags, t))) AS overlap FROM job j, persona p WHERE len(list_filter(must_have_tags, lambda t: list_contains(extracted_tags, t))) >= 2", lambda v: rou.tag_overlap_join(v.job.withColumn("tags", F.col("extracted_tags")), v.persona, 2))
query("srt1_route_candidates", f"WITH {route_sql(False)} SELECT * FROM routed", lambda v: rou.route_candidates(v.job, v.persona, strict=False))
query("joi2_strict_routing", f"WITH {route_sql(True)} SELECT * FROM routed", lambda v: rou.route_candidates(v.job, v.persona))
HASH = "sha256(concat_ws('|', lower(trim(company_name)), lower(trim(title)), regexp_replace(lower(trim(coalesce(location_name, ''))), ' +', ' ', 'g')))"
hashes = lambda j: j.select(F.col("id").alias("job_id"), X.text_hash(F.col("company_name"), F.col("title"), F.col("location_name")).alias("text_hash"))
SIBLING = "EXISTS (SELECT 1 FROM ok JOIN job o ON o.id = ok.job_id WHERE ok.persona_id = r.persona_id AND o.ats_slug = r.ats_slug AND o.title = r.title)"
query(
    "joi4_approved_siblings",
    f"WITH {route_sql(False)}, ok AS (SELECT DISTINCT job_id, persona_id FROM match_queue WHERE status = 'approved') SELECT job_id, persona_id FROM routed r WHERE NOT {SIBLING}",
    lambda v: rou.exclude_approved_siblings(rou.route_candidates(v.job, v.persona, strict=False), v.match_queue, v.job).select("job_id", "persona_id"),
)
query(
    "joi5_cross_posted",
    f"WITH {route_sql(False)}, h AS (SELECT id AS job_id, {HASH} AS text_hash FROM job), ok AS (SELECT DISTINCT m.job_id, m.persona_id, text_hash FROM match_queue m JOIN h ON h.job_id = m.job_id WHERE status = 'approved') "
    "SELECT r.job_id, r.persona_id FROM routed r JOIN h ON h.job_id = r.job_id WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.text_hash = h.text_hash AND ok.persona_id = r.persona_id AND ok.job_id <> r.job_id)",
    lambda v: rou.exclude_cross_posted(rou.route_candidates(v.job, v.persona, strict=False), v.match_queue, hashes(v.job)).select("job_id", "persona_id"),
)
query(
    "joi6_blocked_companies",
    f"WITH {route_sql(False)} SELECT job_id, persona_id FROM routed r WHERE NOT EXISTS (SELECT 1 FROM applicant_company_block b WHERE b.user_id = r.applicant_id AND b.ats_slug = r.ats_slug)",
    lambda v: rou.exclude_blocked_companies(rou.route_candidates(v.job, v.persona, strict=False), v.applicant_company_block).select("job_id", "persona_id"),
)
OVERRIDE = "EXISTS (SELECT 1 FROM job_label_override o WHERE revoked_at IS NULL AND override_type IN ('geo_fenced', 'suppressed') AND o.ats_slug = job.ats_slug AND o.title = job.title)"
query("joi7_label_overrides", f"SELECT id FROM job WHERE NOT {OVERRIDE}", lambda v: IDS(rou.apply_label_overrides(v.job, v.job_label_override)))
from matchflow.plans import queries_classify, queries_feeds, queries_levels, queries_more, queries_sources, queries_streaming  # noqa: E402, F401  registers the rest
