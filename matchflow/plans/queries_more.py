"""The rest of the query registry: joins, sorts, scores, reports and upserts."""

from __future__ import annotations

import functools
import re

from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X
from matchflow.operators import joins as joi
from matchflow.operators import names
from matchflow.operators import reports as rep
from matchflow.operators import routing as rou
from matchflow.operators import runs
from matchflow.operators import scoring as sco
from matchflow.operators import upserts as ups
from matchflow.operators import windows as win
from matchflow.plans import jobs
from matchflow.plans.adapters import AS_OF
from matchflow.plans.queries import HASH, IDS, NOW, OVERRIDE, SIBLING, SPECIFIC, arr, query, route_sql

CANON = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[ ,]+(inc|llc|ltd|gmbh|corp|corporation|limited|co)[.]?$', ''), ' (labs|technologies|technology|software|group|holdings|solutions)$', ''), '[,. ]', '', 'g')"
RATE = "CASE WHEN {1} > 0 THEN round(1e2 * {0} / {1}, 1) END"
rate = RATE.format

# --- joins
VIEW = """mv AS (SELECT m.*, j.title, j.ats_source, j.ats_slug, j.location_name, j.remote_scope, j.workplace_type, j.extracted_tags, p.must_have_tags, p.blocklist_tags, p.seniority_levels, a.country, a.assignment_types
  FROM match_queue m JOIN job j ON j.id = m.job_id JOIN persona p ON p.id = m.persona_id JOIN applicant a ON a.user_id = m.applicant_id)"""
mview = lambda v: joi.match_view(v.match_queue, v.job, v.persona, v.applicant)
query("joi8_match_view", f"WITH {VIEW} SELECT id, title, ats_slug, country, overlap_score FROM mv", lambda v: mview(v).select("id", "title", "ats_slug", "country", "overlap_score"))
KEYED = "(SELECT ats_source, ats_slug, arg_min(tier, id) AS tier, min(id) AS company_id FROM company GROUP BY ALL)"
query("joi9_with_company", f"SELECT j.id, c.tier, c.company_id FROM job j LEFT JOIN {KEYED} c USING (ats_source, ats_slug)", lambda v: joi.with_company(v.job, v.company).select("id", "tier", "company_id"))
query("joi10_unmatched_postings", "SELECT id FROM job WHERE status = 'active' AND remote_scope = 'global' AND NOT EXISTS (SELECT 1 FROM match_queue m WHERE m.job_id = job.id)", lambda v: IDS(joi.unmatched_postings(v.job, v.match_queue)))
query(
    "joi11_reprocess_candidates",
    "SELECT id FROM job WHERE status = 'active' AND list_has_any(extracted_tags, (SELECT list(DISTINCT t) FROM (SELECT unnest(must_have_tags) AS t FROM persona) x)) AND id NOT IN (SELECT job_id FROM match_queue) ORDER BY id LIMIT 1000",
    lambda v: joi.reprocess_candidates(v.job, v.persona, v.match_queue),
)
TIDY = "regexp_replace(lower(trim(company_name)), ' +', ' ', 'g')"
query("joi12_new_company_names", f"SELECT DISTINCT {TIDY} AS name FROM job EXCEPT SELECT {TIDY} FROM company", lambda v: joi.new_company_names(v.job, v.company))
query(
    "joi13_existing_companies",
    f"""WITH fresh AS (SELECT id + 7 AS id, company_name, CASE WHEN root_domain IS NOT NULL THEN concat('company', CAST(id + 3 AS VARCHAR), '.com') END AS root_domain FROM company),
    n AS (SELECT {CANON.format('company_name')} AS k, min(id) AS i FROM company GROUP BY 1), d AS (SELECT root_domain AS k, min(id) AS i FROM company WHERE root_domain IS NOT NULL GROUP BY 1)
    SELECT id, coalesce(n.i, d.i) AS known_id, CASE WHEN n.i IS NOT NULL THEN 'name' WHEN d.i IS NOT NULL THEN 'domain' END AS matched_by
    FROM (SELECT id, root_domain, {CANON.format("CASE WHEN id % 2 = 0 THEN company_name ELSE concat('fresh ', company_name) END")} AS k FROM fresh) f LEFT JOIN n ON n.k = f.k LEFT JOIN d ON d.k = f.root_domain""",
    lambda v: joi.match_existing_companies(
        v.company.selectExpr("id + 7 AS id", "CASE WHEN (id + 7) % 2 = 0 THEN company_name ELSE concat('fresh ', company_name) END AS company_name", "CASE WHEN root_domain IS NOT NULL THEN concat('company', CAST(id + 3 AS STRING), '.com') END AS root_domain"),
        v.company,
    ),
)
NAME = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\b(inc|llc|ltd|corp|corporation|co|company|the)\b\.?', '', 'g'), '[.,''/]', '', 'g'), '\s+', ' ', 'g'))".format
query(
    "joi14_layoffs",
    f"SELECT layoff_id, c.id FROM (SELECT layoff_id, {NAME('company')} AS l FROM layoffs) x JOIN (SELECT id, {NAME('company_name')} AS c FROM company) c ON length(l) >= 2 AND length(c) >= 2 AND (contains(l, c) OR contains(c, l))",
    lambda v: joi.match_layoffs(v.layoffs, v.company),
)
ENDING = "CASE layoff_id % 4 WHEN 0 THEN ' - 500 layoffs' WHEN 1 THEN ' lays off 30 people' WHEN 2 THEN ' Layoffs' ELSE '' END"
query(
    "joi14_layoff_names",
    "SELECT DISTINCT company AS name FROM layoffs WHERE length(company) > 1",
    lambda v: names.layoff_names(v.layoffs.selectExpr(f"concat('<rss><title>News</title><item><title>', CASE WHEN layoff_id % 2 = 0 THEN concat('<![CDATA[', company, {ENDING}, ']]>') ELSE concat(replace(company, '&', '&amp;'), {ENDING}) END, '</title><link>x</link></item><item/></rss>') AS xml"), "xml"),
)
query(
    "joi16_company_size",
    f"SELECT c.id, coalesce(employee_count, r.n) AS employee_count, is_public OR coalesce(r.p, false) AS is_public FROM company c LEFT JOIN (SELECT concat('company', CAST(p_partkey AS VARCHAR)) AS name, p_size * 100 AS n, p_partkey % 2 = 0 AS p FROM part) r ON r.name = {CANON.format('company_name')}",
    lambda v: joi.enrich_company_size(v.company, v.spark.read.parquet(f"{v.sf_dir}/part.parquet").selectExpr("concat('company', CAST(p_partkey AS STRING)) AS name", "p_size * 100 AS registry_count", "p_partkey % 2 = 0 AS registry_public")),
)
query("joi18_matches_to_verify", f"SELECT m.id AS match_id, job_id, title, ats_slug FROM match_queue m JOIN job j ON j.id = m.job_id WHERE m.status = 'approved' AND evaluated_at <= {NOW} AND j.status IN ('active', 'stale')", lambda v: joi.matches_to_verify(v.match_queue, v.job, AS_OF))
query("joi19_orphaned_uploads", f"SELECT user_id, id FROM (SELECT l_suppkey + 50 AS user_id, id, created_at AS uploaded_at FROM (SELECT id, created_at, persona_id AS l_suppkey FROM match_queue) q) u WHERE uploaded_at < {NOW} - INTERVAL 30 DAY AND user_id NOT IN (SELECT applicant_id FROM working_history)",
      lambda v: joi.orphaned_uploads(v.match_queue.selectExpr("persona_id + 50 AS user_id", "id", "created_at AS uploaded_at"), v.working_history, AS_OF, 30).select("user_id", "id"))
query(
    "joi20_resolve_companies",
    f"""WITH n AS (SELECT DISTINCT company_name AS name FROM job), v AS (SELECT name, unnest([{CANON.format('name')}, regexp_split_to_array(lower(trim(name)), '[ ,]')[1], regexp_replace(array_to_string(list_transform(list_filter(regexp_split_to_array(lower(trim(name)), '[^a-z0-9]+'), lambda p: p <> ''), lambda p: substr(p, 1, 1)), ''), ' ', '')]) AS slug, unnest([0, 1, 2]) AS o, {CANON.format('name')} AS canon FROM n),
    bn AS (SELECT {CANON.format('company_name')} AS canon, min(id) AS by_name FROM company GROUP BY 1), bs AS (SELECT ats_slug AS slug, min(id) AS by_slug FROM company GROUP BY 1),
    h AS (SELECT name, min(by_name) AS a, arg_min(by_slug, o) FILTER (WHERE by_slug IS NOT NULL) AS b FROM v LEFT JOIN bn USING (canon) LEFT JOIN bs USING (slug) GROUP BY name)
    SELECT name, coalesce(a, b) AS company_id, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'slug' END AS resolved_by FROM h""",
    lambda v: joi.resolve_companies(v.job.select(F.col("company_name").alias("name")).distinct(), v.company),
)
query("joi21_posting_by_id", "SELECT id, title, tier FROM (SELECT j.id, title, c.tier FROM job j LEFT JOIN " + KEYED + " c USING (ats_source, ats_slug) WHERE status = 'active') x", lambda v: joi.with_company(v.job.filter("status = 'active'"), v.company).select("id", "title", "tier"))

# --- sorts, windows
query("srt2_best_of_title", "SELECT id FROM job QUALIFY row_number() OVER (PARTITION BY ats_slug, title, id % 3 ORDER BY compensation_max DESC, id) = 1", lambda v: joi.route_dedup(v.job.withColumn("persona_id", F.col("id") % 3).withColumn("score", F.col("compensation_max")).withColumn("job_id", F.col("id"))).select("id"))
WHEN = "coalesce(published_at, detected_at)"
RANKED = "(SELECT j.*, c.tier, f.n AS fusion FROM job j LEFT JOIN " + KEYED + " c USING (ats_source, ats_slug) LEFT JOIN (SELECT company_id, count(DISTINCT discovery_source) AS n FROM company_discovery_sources GROUP BY 1) f ON f.company_id = c.company_id)"
TIER_PLACE = "CASE tier " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(C.TIERS)) + " END"
SORTS = {"newest": f"{WHEN} DESC", "oldest": WHEN, "salary": f"compensation_max DESC NULLS LAST, {WHEN} DESC", "quality": f"fusion DESC NULLS LAST, {TIER_PLACE} DESC NULLS LAST, {WHEN} DESC"}
query(
    "srt3_sort_postings",
    " UNION ALL ".join(f"(SELECT '{k}' AS k, id FROM {RANKED} x ORDER BY {o}, id LIMIT 50)" for k, o in SORTS.items()),
    lambda v: (lambda j: functools.reduce(lambda a, b: a.union(b), [joi.sort_postings(j, k, 50).select(F.lit(k).alias("k"), "id") for k in SORTS]))(joi.with_fusion(v.job, v.company, v.company_discovery_sources)),
)
query("srt5_poll_batch", "SELECT id FROM company WHERE tier = 'active' AND polling_enabled ORDER BY last_polled_at ASC NULLS FIRST, id LIMIT 100", lambda v: IDS(joi.poll_batch(v.company, "active", 100)))
query(
    "srt6_near_identical",
    "SELECT id FROM job QUALIFY row_number() OVER (PARTITION BY ats_slug, title, department, substr(lower(trim(normalized_text)), 1, 2000) ORDER BY CASE workplace_type WHEN 'remote' THEN 100 WHEN 'hybrid' THEN 50 ELSE 0 END DESC, published_at DESC NULLS LAST, id DESC) = 1",
    lambda v: IDS(joi.dedupe_near_identical(v.job)),
)
query("srt7_first_seen", "SELECT id FROM job QUALIFY row_number() OVER (PARTITION BY ats_source, ats_slug, external_job_id ORDER BY detected_at, id) = 1", lambda v: IDS(joi.dedupe_first(v.job, ["ats_source", "ats_slug", "external_job_id"], ["detected_at", "id"])))
query("srt8_share_by", "SELECT ats_source, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM job GROUP BY ats_source", lambda v: joi.share_by(v.job, "ats_source"))
query(
    "srt9_compare_rankings",
    """WITH s AS (SELECT job_id, id, persona_id, round(0.6::DOUBLE * least(coalesce(overlap_score, 0) / 5.0::DOUBLE, 1) + 0.4::DOUBLE * (1 - coalesce(cosine_distance, 1)), 9) AS a,
      round(0.6::DOUBLE * (1 - exp(-0.4::DOUBLE * least(coalesce(overlap_score, 0), 5))) + 0.4::DOUBLE * (1 - coalesce(cosine_distance, 1)), 9) AS b FROM match_queue),
    r AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY a DESC, id, persona_id) AS was, row_number() OVER (PARTITION BY job_id ORDER BY b DESC, id, persona_id) AS now FROM s)
    SELECT job_id, count(*) FILTER (WHERE was > 8 AND now <= 8) AS entered, count(*) FILTER (WHERE was <= 8 AND now > 8) AS left_top, count(*) FILTER (WHERE was <> now) AS moved FROM r GROUP BY job_id""",
    lambda v: joi.compare_rankings(v.match_queue),
)
query("srt11_top_errors", "SELECT source, error_message, count(*) AS n, max(created_at) AS last_seen FROM ingestion_log WHERE error_message IS NOT NULL GROUP BY ALL ORDER BY n DESC, source, error_message LIMIT 20", lambda v: joi.top_errors(v.ingestion_log, 20))
query("srt11_source_health", 'SELECT source_name, status, row_number() OVER (PARTITION BY status ORDER BY consecutive_failures DESC, source_name) AS place, CASE status WHEN \'disabled\' THEN 0 WHEN \'degraded\' THEN 1 ELSE 2 END AS "group" FROM source_health', lambda v: joi.source_health_list(v.source_health).select("source_name", "status", "place", "group"))
query("srt10_orphaned_companies", "SELECT id FROM company c WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.ats_source = c.ats_source AND j.ats_slug = c.ats_slug AND NOT ends_with(j.ats_slug, '7'))", lambda v: IDS(joi.orphaned_companies(v.company, v.job.filter("NOT endswith(ats_slug, '7')"))))

# --- scores
QUALITY = """quality AS (SELECT c.*, coalesce(a, 0) AS approved, coalesce(r, 0) AS rejected, coalesce(a, 0) + coalesce(r, 0) AS total, last_approved_at,
    CASE WHEN coalesce(a, 0) + coalesce(r, 0) > 0 THEN round(1e2 * coalesce(a, 0) / (coalesce(a, 0) + coalesce(r, 0)), 0) ELSE 50 END AS quality
  FROM company c LEFT JOIN (SELECT ats_source, ats_slug, count(*) FILTER (WHERE m.status = 'approved') AS a, count(*) FILTER (WHERE m.status = 'rejected') AS r, max(evaluated_at) FILTER (WHERE m.status = 'approved') AS last_approved_at
    FROM match_queue m JOIN job j ON j.id = m.job_id WHERE m.status IN ('approved', 'rejected') GROUP BY ALL) x USING (ats_source, ats_slug))"""
quality = lambda v: sco.company_quality(v.company, v.job, v.match_queue)
HAS = "CASE WHEN list_has_any(seniority_levels, {0}) THEN 1.0 ELSE 0.0 END".format
none = "len(coalesce({0}, [])) = 0".format
OWN = " OR ".join(f"(country = '{c}' AND regexp_matches(p, '{w}'))" for c, w in {"US": "(united states|u[.]s[.]|usa| america)", "CA": "canada", "DE": "germany", "RS": "serbia"}.items())
query(
    "sco1_match_score",
    f"""WITH {VIEW}, t AS (SELECT *, lower(coalesce(location_name, '')) AS p, lower(title) AS lt, coalesce(overlap_score, 0) AS ov, id % 101 AS quality, (id % 61 - 30) / 1e2 AS size_score FROM mv),
    s AS (SELECT id, (1 - coalesce(cosine_distance, 1)) * 0.25::DOUBLE + (1 - exp(-0.4::DOUBLE * least(ov, 5))) * 0.30::DOUBLE
      + (CASE WHEN workplace_type IS NULL OR {none('assignment_types')} THEN 0.5 WHEN list_contains(assignment_types, workplace_type) THEN 1.0
         WHEN workplace_type = 'hybrid' AND list_has_any(assignment_types, ['remote', 'remote_local']) THEN 0.5 WHEN workplace_type IN ('remote', 'on-site') AND list_contains(assignment_types, 'hybrid') THEN 0.5 ELSE 0.0 END)::DOUBLE * 0.12::DOUBLE
      + (CASE WHEN country IS NULL OR p = '' THEN 0.5 WHEN remote_scope = 'global' THEN 1.0 WHEN regexp_matches(p, 'remote|global|anywhere|worldwide') THEN CASE WHEN {OWN} THEN 1.0 WHEN regexp_matches(p, '(united states|usa|canada|argentina|germany|serbia)') THEN 0.2 ELSE 1.0 END ELSE 0.5 END)::DOUBLE * 0.08::DOUBLE
      + (CASE WHEN {none('seniority_levels')} THEN 0.5 WHEN regexp_matches(lt, '(junior|associate|entry|intern|trainee)') THEN {HAS("['junior']")} WHEN regexp_matches(lt, '(senior|sr[.]|sr )') THEN {HAS("['senior']")}
         WHEN regexp_matches(lt, '(lead|staff|principal|architect|manager|director|head|expert)') THEN {HAS("['lead', 'staff', 'principal']")} ELSE 0.5 END)::DOUBLE * 0.08::DOUBLE
      + (quality / 1e2 + size_score) * 0.17::DOUBLE
      - (CASE WHEN {none('blocklist_tags')} OR {none('extracted_tags')} THEN 0.0 WHEN list_has_any(blocklist_tags, extracted_tags) THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.10::DOUBLE
      - (CASE WHEN {none('must_have_tags')} OR {none('extracted_tags')} THEN 0.0 WHEN ov = 0 THEN 1.0 ELSE 1.0 - ov / least(len(must_have_tags), len(extracted_tags))::DOUBLE END)::DOUBLE * 0.10::DOUBLE
      - least(len(list_filter(list_distinct(extracted_tags), lambda x: list_contains({arr(C.OFF_FOCUS_TAGS)}, x) AND NOT list_contains(must_have_tags, x))) / 3.0::DOUBLE, 1) * 0.08::DOUBLE AS raw FROM t)
    SELECT id, round_even(round(greatest(0, least(1, raw)) * 100, 6), 0) AS match_score FROM s""",
    lambda v: sco.match_score(mview(v).withColumn("quality", F.col("id") % 101).withColumn("size_score", (F.col("id") % 61 - 30) / 100.0)).select("id", "match_score"),
)
ORIGIN = "CASE discovery_source " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in C.SOURCE_ORIGIN_SCORE.items()) + " ELSE 0 END"
query(
    "sco2_company_size_score",
    f"""SELECT id, raw_score, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, raw_score / 1e2)) AS size_score, CASE WHEN is_agency THEN 'dead' WHEN raw_score > 15 THEN 'active_hot' WHEN raw_score < -20 THEN 'dormant' END AS advised_tier
    FROM (SELECT *, CASE WHEN employee_count IS NULL THEN 0 WHEN employee_count > 5000 THEN -25 WHEN employee_count >= 1000 THEN -15 WHEN employee_count >= 250 THEN -5 WHEN employee_count >= 50 THEN 0 WHEN employee_count >= 20 THEN 15 ELSE 25 END
      + CASE WHEN is_agency THEN -40 ELSE 0 END + CASE WHEN is_public THEN -20 ELSE 0 END + {ORIGIN} AS raw_score FROM company) c""",
    lambda v: sco.company_size_score(v.company).select("id", "raw_score", "size_score", "advised_tier"),
)
query("sco3_company_quality", f"WITH {QUALITY} SELECT id, approved, rejected, total, quality, last_approved_at FROM quality", lambda v: quality(v).select("id", "approved", "rejected", "total", "quality", "last_approved_at"))
query("srt10_top_companies", f"WITH {QUALITY} SELECT id, quality, total FROM quality ORDER BY quality DESC, total DESC, id LIMIT 50", lambda v: joi.top_companies(quality(v), 50).select("id", "quality", "total"))
SORTED = {"best_match": "match_score DESC NULLS FIRST, created_at DESC NULLS FIRST", "newest": "created_at DESC NULLS FIRST", "oldest": "created_at ASC NULLS LAST"}
scored = lambda v: v.match_queue.withColumn("match_score", F.col("id") % 23)
query(
    "srt4_sort_matches",
    " UNION ALL ".join(f"SELECT * FROM (SELECT id, '{k}' AS sort_key FROM (SELECT *, id % 23 AS match_score FROM match_queue) m ORDER BY {o}, id LIMIT 20 OFFSET 40) {k}" for k, o in SORTED.items()),
    lambda v: functools.reduce(lambda a, b: a.union(b), [joi.sort_matches(scored(v), k, 20, 40).select("id", F.lit(k).alias("sort_key")) for k in SORTED]),
)
query("sco4_fusion_score", "SELECT id, 1 + coalesce(n, 0) AS fusion FROM company LEFT JOIN (SELECT company_id, count(DISTINCT discovery_source) AS n FROM company_discovery_sources GROUP BY 1) s ON s.company_id = id", lambda v: sco.fusion_score(v.company, v.company_discovery_sources).select("id", "fusion"))
FAMILIES = [f for f in C.STACK_FAMILIES if f != "qa"]
COUNTS = ", ".join(f"len(list_intersect(must_have_tags, {arr(C.STACK_FAMILIES[f])})) AS n_{f}" for f in FAMILIES)
MOST = "greatest(" + ", ".join(f"n_{f}" for f in FAMILIES) + ")"
FAMILY = f"CASE WHEN {MOST} = 0 THEN NULL " + " ".join(f"WHEN n_{f} = {MOST} THEN '{f}'" for f in FAMILIES) + " END"
BARRED = lambda p, f: f"WHEN regexp_matches(title, '(?i){p}')" + ("" if f == "enterprise" else f" AND family <> '{f}'")
PLATFORM = "CASE " + " ".join(f"{BARRED(p, f)} THEN '{n}'" for n, p, f in C.PLATFORM_PATTERNS) + " END"
LIFTED = {
    "AI Engineer (application)": f"list_contains(own, 'prompt-engineering') AND list_has_any(own, {arr(C.JS_SIGNAL_TAGS)})",
    "Engineering Manager": "list_has_any(list_transform(seniority_levels, lambda x: lower(x)), ['manager', 'lead', 'director'])",
}
lifted = lambda n, tags: LIFTED.get(n) or (f"list_has_any(own, {arr(tags)})" if tags else "false")
ROLE = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') AND NOT coalesce({lifted(n, t)}, false) THEN '{n}'" for n, p, t in C.ROLE_FAMILY_PATTERNS) + " END"
query(
    "sco5_title_blockers",
    f"""WITH {VIEW}, n AS (SELECT *, {COUNTS}, list_transform(must_have_tags, lambda x: lower(x)) AS own FROM mv), f AS (SELECT *, {FAMILY} AS family FROM n), b AS (SELECT id, {PLATFORM} AS platform, {ROLE} AS role FROM f)
    SELECT id, coalesce(platform, role) AS blocker, CASE WHEN platform IS NOT NULL THEN 'platform' WHEN role IS NOT NULL THEN 'role_family' END AS blocker_type FROM b""",
    lambda v: sco.title_blockers(joi.match_view(v.match_queue, v.job, sco.with_stack(v.persona), v.applicant)).select("id", "blocker", "blocker_type"),
)


def match_sql(postings: str) -> str:
    """DuckDB: the whole match job over a table of postings, as the tables of a WITH clause; the last one is ``found``."""
    return (
        f"left_over AS (SELECT * FROM {postings} job WHERE NOT {OVERRIDE}), {route_sql(True, 'left_over').replace('pairs', 'met')}, h AS (SELECT id AS job_id, {HASH} AS text_hash FROM job), ok AS (SELECT DISTINCT job_id, persona_id FROM match_queue WHERE status = 'approved'), okh AS (SELECT ok.*, text_hash FROM ok JOIN h ON h.job_id = ok.job_id)"
        f", kept AS (SELECT r.* FROM routed r JOIN h ON h.job_id = r.job_id WHERE NOT {SIBLING} AND NOT EXISTS (SELECT 1 FROM okh WHERE okh.text_hash = h.text_hash AND okh.persona_id = r.persona_id AND okh.job_id <> r.job_id) "
        "AND NOT EXISTS (SELECT 1 FROM applicant_company_block b WHERE b.user_id = r.applicant_id AND b.ats_slug = r.ats_slug)), "
        f"n AS (SELECT k.*, p.seniority_levels, {COUNTS}, list_transform(must_have_tags, lambda x: lower(x)) AS own FROM kept k JOIN persona p ON p.id = k.persona_id), f AS (SELECT *, {FAMILY} AS family FROM n), "
        f"found AS (SELECT job_id, persona_id, applicant_id, ats_slug, title, overlap, distance, score, rank FROM f WHERE ({PLATFORM}) IS NULL AND ({ROLE}) IS NULL)"
    )


query("pip2_match_job", f"WITH {match_sql('job')} SELECT * FROM found", lambda v: rou.match_job(v.job, v.persona, v.match_queue, v.job_label_override, v.applicant_company_block))
query(
    "pip2_upserted_matches",
    f"""WITH {match_sql('job')}, c AS (SELECT * FROM match_queue QUALIFY row_number() OVER (PARTITION BY job_id, persona_id ORDER BY id, created_at) = 1), r AS (SELECT job_id, persona_id, overlap AS o, distance AS d FROM found),
    b AS (SELECT *, o IS NULL OR coalesce(status IN ('mismatch', 'rejected', 'applied', 'approved'), false) AS stays FROM c FULL JOIN r USING (job_id, persona_id))
    SELECT job_id, persona_id, CASE WHEN stays THEN coalesce(status, 'pending') ELSE 'pending' END AS status, coalesce(o, overlap_score) AS overlap, CASE WHEN o IS NULL THEN cosine_distance ELSE d END AS cosine_distance, CASE WHEN stays THEN evaluated_at END AS evaluated_at FROM b""",
    lambda v: jobs.match_and_upsert(v.job, v.persona, v.match_queue, v.job_label_override, v.applicant_company_block).select("job_id", "persona_id", "status", "overlap", "cosine_distance", "evaluated_at"),
)
USD = "({0} * CASE upper(coalesce(compensation_currency, 'USD')) " + " ".join(f"WHEN '{k}' THEN {n}::DOUBLE" for k, n in C.USD_RATES.items()) + " END)"
USD_OK = f"(CASE WHEN {USD.format('compensation_max')} >= {C.PAY_FLOOR_USD} THEN {USD.format('compensation_max')} END)"
named_in = lambda p: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({p}, '(^|[^a-z])({'|'.join(map(re.escape, ns))})($|[^a-z])') THEN '{c}' END" for c, ns in C.LOCATION_COUNTRIES.items()) + "], lambda x: x IS NOT NULL)"
LOW = "lower(coalesce(location_name, ''))"
TITLE_TAG = "CASE " + " ".join(f"WHEN regexp_matches(regexp_extract(title, '\\s[-–—]\\s+(.+)$', 1), '(?i){p}') THEN '{r}'" for p, r in C.TITLE_REGIONS) + " END"
REGION = "CASE " + " ".join(f"WHEN contains({LOW}, '{r}') THEN '{r}' END" if r == C.BROAD_REGIONS[-1] else f"WHEN contains({LOW}, '{r}') THEN '{r}'" for r in C.BROAD_REGIONS)
#: postings with what the checks read of them: countries named (nd), listed (ls), region of place (rg) and title (tr), flags of the text
PLACED = f"""placed AS (SELECT *, {named_in(LOW)} AS nd, list_concat(list_transform(coalesce(location_countries, []), lambda c: upper(c)), {named_in("lower(array_to_string(coalesce(location_countries, []), ' ; '))")}) AS ls,
    {REGION} AS rg, {TITLE_TAG} AS tr, {SPECIFIC} AS spec, regexp_matches(coalesce(normalized_text, ''), '(?i){"|".join(C.WORK_AUTH_FENCES)}') AS fenced_text, regexp_matches(coalesce(normalized_text, ''), '(?i){"|".join(C.CONTRACTOR_WELCOMES)}') AS welcome,
    regexp_matches(coalesce(title, ''), '(?i){C.SENIOR_TITLE}') OR regexp_matches(coalesce(normalized_text, ''), '(?i){C.SENIOR_TEXT}') AS senior FROM job)"""
PAIRS = f"{PLACED}, pairs AS (SELECT m.id AS match_id, j.*, a.* FROM match_queue m JOIN placed j ON j.id = m.job_id JOIN applicant a ON a.user_id = m.applicant_id)"
pairs = lambda v, *more: v.match_queue.select(F.col("id").alias("match_id"), "job_id", "applicant_id", *more).join(sco.with_places(v.job).withColumnRenamed("id", "job_id"), "job_id").join(v.applicant.withColumn("applicant_id", F.col("user_id")), "applicant_id")
LISTED, TEXTED = "len(coalesce(location_countries, [])) > 0", "coalesce(normalized_text, '') <> ''"
US_OK = "coalesce(list_has_any(preferred_compliance, ['w8ben', 'ic_global']), false)"
FOREIGN = "NOT list_contains(nd, country)"  # the view's countries are all in the table of names
REMOTE = "(workplace_type IS NULL OR workplace_type = 'remote')"
GATED = f"{LISTED} AND {REMOTE} AND remote_scope NOT IN ('onsite', 'global') AND NOT list_contains(ls, country) AND {TEXTED} AND NOT welcome"
FITS = " OR ".join(f"(country = '{c}' AND regexp_matches(lower(tr), '{'|'.join(rs)}'))" for c, rs in C.FRIENDLY_REGIONS.items())
CLEAR = f"country IS NOT NULL AND {LOW} <> '' AND {FOREIGN}"
IN_REGION = " OR ".join(f"(rg = '{r}' AND country IN ({', '.join(repr(c) for c in cs)}))" for r, cs in C.REGION_MEMBERS.items())
PAY = "coalesce(compensation_max, compensation_min)"
CHECKS = [
    ("title_region_tag", f"tr IS NOT NULL AND country IS NOT NULL AND NOT ({FITS})"),
    ("work_auth_fencing", f"{GATED} AND fenced_text"), ("country_fenced_non_us", f"{GATED} AND NOT fenced_text AND NOT list_contains(ls, 'US')"),
    ("location_country_list", f"workplace_type IN ('remote', 'hybrid') AND remote_scope NOT IN ('global', 'region_fenced', 'undetermined', 'unknown') AND country IS NOT NULL AND CASE WHEN {LISTED} AND NOT {TEXTED} THEN NOT list_contains(ls, country) "
     f"WHEN NOT ({LISTED}) AND contains({LOW}, 'remote') THEN (len(list_filter(regexp_split_to_array({LOW}, '[,/]'), lambda x: trim(x) <> '')) >= 3 AND {FOREIGN}) OR coalesce(nd[1] <> country AND NOT (nd[1] = 'US' AND {US_OK}), false) ELSE false END"),
    ("remote_specific_foreign_location", f"{CLEAR} AND workplace_type = 'remote' AND ((remote_scope IN ('unknown', 'undetermined') AND spec) OR (remote_scope = 'global' AND len(nd) > 0 AND (NOT ({LISTED}) OR NOT {TEXTED}))) AND NOT (list_contains(nd, 'US') AND {US_OK})"),
    ("explicit_on_site", f"{CLEAR} AND (coalesce(workplace_type = 'on-site', false) OR remote_scope = 'onsite')"),
    ("hybrid_foreign_location", f"{CLEAR} AND workplace_type = 'hybrid' AND remote_scope NOT IN ('onsite', 'global')"),
    ("null_workplace_specific_foreign_location", f"{CLEAR} AND workplace_type IS NULL AND remote_scope IN ('unknown', 'undetermined') AND spec"),
    ("region_fenced_location", f"country IS NOT NULL AND rg IS NOT NULL AND {REMOTE} AND remote_scope <> 'global' AND NOT ({IN_REGION}) AND NOT (rg = 'north america' AND {US_OK})"),
    ("compensation_mismatch", f"{USD.format(PAY)} >= {C.PAY_FLOOR_USD} AND {USD.format(PAY)} < expected_comp_min * 0.7"),
    ("inverted_experience_band", "senior AND experience_max_years < 7 AND years_of_experience > 10"),
    ("experience_gap", "NOT (senior AND experience_max_years < 7 AND years_of_experience > 10) AND years_of_experience > experience_max_years + 5"),
]
BLOCKERS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CHECKS) + "], lambda x: x IS NOT NULL)"
query("sco6_hard_blockers", f"WITH {PAIRS} SELECT match_id, array_to_string({BLOCKERS}, ',') AS blockers, len({BLOCKERS}) = 0 AS passes FROM pairs", lambda v: sco.hard_blockers(pairs(v)).select("match_id", F.array_join("blockers", ",").alias("blockers"), "passes"))
query(
    "sco7_posting_rejections",
    f"WITH {PAIRS}, b AS (SELECT id, user_id, {BLOCKERS} AS b FROM pairs) SELECT id AS job_id, NOT bool_or(len(b) = 0) AS rejected, CASE WHEN NOT bool_or(len(b) = 0) THEN arg_min(CASE WHEN list_contains(b, 'title_region_tag') THEN 'title_region_tag' ELSE b[1] END, user_id) END AS pattern FROM b GROUP BY id",
    lambda v: sco.posting_rejections(sco.hard_blockers(pairs(v))),
)
REASON = "CASE " + " ".join(f"WHEN regexp_matches(b, '{w}') THEN '{n}'" for n, w in C.REJECTION_REASONS) + " ELSE 'other' END"
REASONED = "(SELECT *, lower(array_to_string(coalesce(llm_blockers, []), ' ')) AS b FROM match_queue)"
query("cls19_rejection_reason", f"SELECT id, {REASON} AS reason FROM {REASONED} m", lambda v: sco.with_rejection_reason(v.match_queue).select("id", "reason"))
DIST = "CASE WHEN len(o.v) = len(n.v) THEN 1 - list_cosine_similarity(o.v, n.v) ELSE 1 END"
query(
    "sco8_drift_status",
    f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), o AS (SELECT id, v, label % 3 AS h FROM e WHERE id % 5 <> 0), n AS (SELECT a.id, b.v, a.label % 4 AS h FROM e a JOIN e b ON b.id = a.id - a.id % 2)
    SELECT n.id, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' WHEN {DIST} > 0.15 THEN 'drifted' ELSE 'same' END AS drift FROM n LEFT JOIN o ON o.id = n.id""",
    lambda v: (lambda e: sco.drift_status(e.filter("id % 5 <> 0").selectExpr("id", "v", "label % 3 AS h"), e.alias("a").join(e.alias("b"), F.expr("b.id = a.id - a.id % 2")).selectExpr("a.id AS id", "b.v AS v", "a.label % 4 AS h")))(v.spark.read.parquet(f"{v.sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v", "label")),
)
query(
    "sco9_apply_verdicts",
    f"SELECT id, CASE WHEN status = 'pending' AND verdict = 'approved' THEN 'approved' WHEN status = 'pending' AND verdict IS NOT NULL THEN 'rejected' ELSE status END AS new_status, CASE WHEN status = 'pending' AND verdict <> 'approved' THEN {REASON} END AS rejection_reason FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'no' END AS verdict FROM {REASONED} r) m",
    lambda v: sco.apply_verdicts(v.match_queue, v.match_queue.filter("id % 3 < 2").selectExpr("id", "CASE id % 3 WHEN 0 THEN 'approved' ELSE 'no' END AS verdict").distinct()),
)
AGE = f"date_diff('day', CAST(evaluated_at AS DATE), CAST({NOW} AS DATE))"
FRONT = arr(C.FRONTEND_TAGS)
query(
    "sco10_employer_openness",
    f"""WITH m AS (SELECT ats_source, ats_slug, count(*) FILTER (WHERE m.status = 'approved' AND evaluated_at > {NOW} - INTERVAL 90 DAY) AS a, count(*) FILTER (WHERE m.status = 'approved' AND evaluated_at BETWEEN {NOW} - INTERVAL 365 DAY AND {NOW} - INTERVAL 90 DAY) AS y,
      count(*) FILTER (WHERE m.status = 'pending' AND created_at > {NOW} - INTERVAL 30 DAY) AS p FROM match_queue m JOIN job j ON j.id = m.job_id JOIN persona q ON q.id = m.persona_id WHERE q.id % 3 <> 0 AND list_has_any(must_have_tags, {FRONT}) GROUP BY 1, 2),
    o AS (SELECT ats_source, ats_slug, count(*) AS n FROM job WHERE detected_at > {NOW} - INTERVAL 90 DAY AND status = 'active' AND list_has_any(extracted_tags, {FRONT}) GROUP BY 1, 2)
    SELECT id, coalesce(a, 0) AS approved_90d, coalesce(y, 0) AS approved_year, coalesce(p, 0) AS pending_30d, coalesce(n, 0) AS frontend_jobs_90d, CASE WHEN coalesce(a, 0) > 0 OR coalesce(y, 0) > 0 THEN 'active_hot' ELSE tier END AS new_tier
    FROM company LEFT JOIN m USING (ats_source, ats_slug) LEFT JOIN o USING (ats_source, ats_slug) WHERE polling_enabled AND tier <> 'dead'""",
    lambda v: sco.employer_openness(v.company, v.job, v.match_queue, v.persona.withColumn("must_have_tags", F.when(F.col("id") % 3 != 0, F.col("must_have_tags")).otherwise(F.array(F.lit("go")))), AS_OF),
)

# --- reports
SUMMARY = f"""count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failure') AS failed, CAST(sum(items_processed) AS BIGINT) AS processed, CAST(sum(items_inserted) AS BIGINT) AS inserted, CAST(sum(items_rejected) AS BIGINT) AS rejected,
  round(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1e3), 3) AS avg_ms, {rate("count(*) FILTER (WHERE status = 'success')", 'count(*)')} AS success_rate, {rate('sum(items_inserted)', 'sum(items_processed)')} AS insert_rate"""
query("agg1_ingestion_summary", f"SELECT {SUMMARY} FROM ingestion_log", lambda v: rep.ingestion_summary(v.ingestion_log, []))
query("agg2_source_performance", f"SELECT source, {SUMMARY} FROM ingestion_log GROUP BY source", lambda v: rep.ingestion_summary(v.ingestion_log, ["source"]))
query("agg3_ingestion_trend", f"SELECT CAST(created_at AS DATE) AS day, source, {SUMMARY} FROM ingestion_log GROUP BY 1, 2", lambda v: rep.ingestion_summary(v.ingestion_log.withColumn("day", F.to_date("created_at")), ["day", "source"]))
OLD = "sum(CAST(json_extract_string(error_details, '$.k') AS INT))"
query("agg5_old_job_rate", f"SELECT source, CAST({OLD} AS BIGINT) AS old, CAST(sum(items_processed) AS BIGINT) AS processed, round({OLD} / sum(items_processed)::DOUBLE, 4) AS share FROM ingestion_log GROUP BY source HAVING sum(items_processed) > 0 AND {OLD} / sum(items_processed)::DOUBLE >= 0.3", lambda v: rep.old_job_rate(v.ingestion_log))
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(b, '(?i){p}') THEN '{n}'" for n, p in C.BLOCKER_CATEGORIES.items()) + " ELSE 'other' END"
query("agg6_rejection_categories", f"SELECT {CATEGORY} AS category, count(*) AS n FROM (SELECT unnest(llm_blockers) AS b FROM match_queue WHERE status = 'rejected' AND evaluated_at > {NOW} - INTERVAL 30 DAY) x GROUP BY 1", lambda v: rep.rejection_categories(v.match_queue, AS_OF))
query("agg7_approval_rate", f"SELECT prompt_variant, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) AS decided, {rate(chr(99) + 'ount(*) FILTER (WHERE status = ' + chr(39) + 'approved' + chr(39) + ')', 'count(*)')} AS rate FROM match_queue WHERE status IN ('approved', 'rejected') GROUP BY 1", lambda v: rep.approval_rate_by(v.match_queue, "prompt_variant"))
WIN = f"BETWEEN {NOW} - INTERVAL {{1}} DAY AND {NOW}".replace("BETWEEN", "{0} BETWEEN").format
query(
    "agg8_funnel",
    f"""SELECT *, {rate('approved', '(approved + rejected)')} AS rate FROM (SELECT count(*) AS detected, count(normalized_at) AS normalized FROM job WHERE {WIN('detected_at', 365)}) j,
    (SELECT count(*) AS candidates, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM match_queue WHERE {WIN('created_at', 365)}) m""",
    lambda v: rep.funnel(v.job, v.match_queue, AS_OF, 365),
)
query("agg9_pass_rate", f"SELECT ats_source, count(*) AS jobs, count(m.job_id) AS routed, {rate('count(m.job_id)', 'count(*)')} AS rate FROM job LEFT JOIN (SELECT DISTINCT job_id FROM match_queue) m ON m.job_id = id GROUP BY 1", lambda v: rep.pass_rate_by(v.job, v.match_queue, "ats_source"))
query("agg10_distribution", "SELECT least(n, 5) AS value, count(*) AS n FROM (SELECT company_id, count(DISTINCT discovery_source) AS n FROM company_discovery_sources GROUP BY 1) x GROUP BY 1", lambda v: rep.distribution(v.company_discovery_sources.groupBy("company_id").agg(F.countDistinct("discovery_source").alias("k")), F.least("k", F.lit(5))))
query(
    "agg11_system_overview",
    "SELECT * FROM (SELECT count(*) AS jobs, count(*) FILTER (WHERE status = 'active') AS active_jobs, count(job_embedding) AS embedded FROM job) j, (SELECT count(*) AS companies, count(*) FILTER (WHERE polling_enabled) AS polled, count(*) FILTER (WHERE tier = 'dead') AS dead FROM company) c, (SELECT count(*) AS matches, count(*) FILTER (WHERE status = 'pending') AS pending FROM match_queue) m",
    lambda v: rep.system_overview(v.job, v.company, v.match_queue),
)
query("agg12_target_stack", "SELECT remote_scope, count(*) FILTER (WHERE list_has_any(extracted_tags, ['react', 'nextjs', 'typescript']) OR regexp_matches(lower(title), '(react|frontend)')) AS on_stack, count(*) AS jobs FROM job GROUP BY 1", lambda v: rep.target_stack_metric(v.job, ["react", "nextjs", "typescript"], "(react|frontend)"))
query("agg13_corpus_ratios", "SELECT round(avg((remote_scope <> 'undetermined')::DOUBLE), 6) AS known_share, round(avg((remote_scope = 'undetermined')::DOUBLE), 6) AS unknown_share, round(avg((normalized_at IS NULL)::DOUBLE), 6) AS provisional_share FROM job WHERE status = 'active'", lambda v: rep.corpus_ratios(v.job))
query("agg14_breaker_metrics", "SELECT type, count(*) AS alerts, count(*) FILTER (WHERE auto_retry_attempted) AS tried, count(*) FILTER (WHERE auto_retry_attempted AND auto_retry_succeeded) AS succeeded, count(*) FILTER (WHERE is_active) AS active FROM alerts GROUP BY type", lambda v: rep.breaker_metrics(v.alerts))
LATE = "2024-01-20 00:00:00"
query(
    "agg16_stale_functions",
    f"SELECT e.source, max_gap_h, last_run FROM (SELECT concat('source', CAST(s_suppkey AS VARCHAR)) AS source, 1 AS max_gap_h FROM supplier UNION ALL SELECT DISTINCT source, 12 FROM ingestion_log) e LEFT JOIN (SELECT source, max(created_at) AS last_run FROM ingestion_log GROUP BY 1) l ON l.source = e.source WHERE last_run IS NULL OR (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last_run))) / 3600.0 > max_gap_h",
    lambda v: rep.stale_functions(v.ingestion_log, v.spark.read.parquet(f"{v.sf_dir}/supplier.parquet").selectExpr("concat('source', CAST(s_suppkey AS STRING)) AS source", "1 AS max_gap_h").unionByName(v.ingestion_log.select("source").distinct().withColumn("max_gap_h", F.lit(12))), "2024-02-01 00:00:00"),
)
DAY = lambda c: f"{c} > {NOW} - INTERVAL 24 HOUR"
STAGES = {
    "ingested": f"job WHERE {DAY('detected_at')}", "normalized": f"job WHERE {DAY('normalized_at')}", "embedded": f"job WHERE {DAY('normalized_at')} AND job_embedding IS NOT NULL", "routed": f"match_queue WHERE {DAY('created_at')}",
    "evaluated": f"match_queue WHERE {DAY('evaluated_at')}", "approved": f"match_queue WHERE status = 'approved' AND {DAY('evaluated_at')}",
    "dashboard": f"match_queue m JOIN job j ON j.id = m.job_id WHERE j.remote_scope = 'global' AND is_fenced IS NOT TRUE AND is_natsec IS NOT TRUE AND is_qa IS NOT TRUE AND {DAY('m.created_at')}",
}
query("agg17_stage_counters", " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) AS n, count(*) = 0 AS silent FROM {f}" for k, f in STAGES.items()), lambda v: rep.stage_counters(v.job, v.match_queue, AS_OF))
query("agg18_public_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE remote_scope = 'global') AS global_jobs, count(*) FILTER (WHERE remote_scope IN ('country_fenced', 'region_fenced')) AS fenced, count(*) FILTER (WHERE {WIN('detected_at', 7)}) AS new_this_week FROM job WHERE status = 'active'", lambda v: rep.public_stats(v.job, AS_OF))
query("agg19_trending_skills", "SELECT tag, count(*) AS n FROM (SELECT unnest(extracted_tags) AS tag FROM job WHERE status = 'active') x GROUP BY tag ORDER BY n DESC, tag LIMIT 15", lambda v: rep.trending_skills(v.job, 15))
query("agg22_duplicate_groups", f"SELECT {HASH} AS text_hash, count(*) AS n, count(DISTINCT ats_slug) AS slugs, min(id) AS first_id FROM job GROUP BY 1 HAVING count(*) > 1", lambda v: rep.duplicate_groups(v.job))
query("agg23_threshold_sweep", "SELECT threshold, count(*) AS matches, count(DISTINCT job_id) AS jobs FROM match_queue JOIN (SELECT unnest([0.21::DOUBLE, 0.33::DOUBLE, 0.47::DOUBLE]) AS threshold) t ON cosine_distance < threshold GROUP BY 1", lambda v: rep.threshold_sweep(v.match_queue, [0.21, 0.33, 0.47]))
query("agg24_score_separation", "SELECT status, count(*) AS n, round(avg(overlap_score), 6) AS overlap, round(avg(cosine_distance), 6) AS distance, round(min(cosine_distance), 6) AS lo, round(max(cosine_distance), 6) AS hi FROM match_queue WHERE status IN ('approved', 'rejected') GROUP BY 1", lambda v: rep.score_separation(v.match_queue))
query("agg24_mismatch_profile", "SELECT applicant_id, count(*) AS n, count(DISTINCT persona_id) AS personas, count(DISTINCT job_id) AS jobs FROM match_queue WHERE status = 'mismatch' GROUP BY 1", lambda v: rep.mismatch_profile(v.match_queue))
query("agg25_phrase_lift", "SELECT ats_source, round(avg((remote_scope = 'global')::DOUBLE) FILTER (WHERE regexp_matches(lower(normalized_text), '(anywhere|worldwide)')), 6) AS with_phrase, round(avg((remote_scope = 'global')::DOUBLE), 6) AS baseline, count(*) FILTER (WHERE regexp_matches(lower(normalized_text), '(anywhere|worldwide)')) AS hits FROM job GROUP BY 1", lambda v: rep.phrase_lift(v.job, "(?i)(anywhere|worldwide)"))
query("agg26_active_job_counts", "SELECT id, ats_source, ats_slug, coalesce(n, 0) AS active_job_count FROM company LEFT JOIN (SELECT ats_source, ats_slug, count(*) AS n FROM job WHERE status = 'active' GROUP BY ALL) j USING (ats_source, ats_slug)", lambda v: rep.active_job_counts(v.company, v.job))
query(
    "agg27_north_star",
    f"SELECT * FROM (SELECT count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE {WIN('detected_at', 1)}) AS new_1d, count(*) FILTER (WHERE remote_scope = 'global' AND status = 'active') AS global_active FROM job) j, (SELECT count(*) FILTER (WHERE status = 'approved' AND {WIN('evaluated_at', 7)}) AS approved_7d, count(*) FILTER (WHERE status = 'pending') AS waiting, count(DISTINCT applicant_id) AS applicants FROM match_queue) m",
    lambda v: rep.north_star(v.job, v.match_queue, AS_OF),
)
INVALID = "status = 'failure' AND contains(error_message, 'Zod validation failed')"
query(
    "agg28_validation_alert",
    f"""SELECT n AS runs, bad AS invalid, CASE WHEN n > 0 THEN round(bad / n::DOUBLE, 6) END AS rate, CASE WHEN n < 5 THEN 'wait' WHEN bad / n::DOUBLE >= 0.2 THEN 'open' ELSE 'resolve' END AS action
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {INVALID}) AS bad FROM ingestion_log WHERE created_at >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 60 MINUTE)""",
    lambda v: win.validation_alert(v.ingestion_log, "2024-01-30 23:00:00"),
)
query(
    "agg28_failure_spike",
    f"""SELECT pane, runs, invalid FROM (SELECT pane, sum(n) OVER w AS runs, sum(bad) OVER w AS invalid FROM (SELECT date_trunc('minute', created_at) AS pane, count(*) AS n, count(*) FILTER (WHERE {INVALID}) AS bad FROM ingestion_log GROUP BY 1)
      WINDOW w AS (ORDER BY pane RANGE BETWEEN INTERVAL 59 MINUTE PRECEDING AND CURRENT ROW)) WHERE runs >= 5 AND invalid / runs::DOUBLE >= 0.2""",
    lambda v: win.validation_spikes(v.ingestion_log),
)
query(
    "agg28_rolling_runs",
    """SELECT source, pane, runs, failed, sum(runs) OVER d AS runs_24h, sum(failed) OVER d AS failed_24h, sum(runs) OVER k AS runs_7d, sum(failed) OVER k AS failed_7d
    FROM (SELECT source, date_trunc('hour', created_at) AS pane, count(*) AS runs, count(*) FILTER (WHERE status = 'failure') AS failed FROM ingestion_log GROUP BY 1, 2)
    WINDOW d AS (PARTITION BY source ORDER BY pane RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW), k AS (PARTITION BY source ORDER BY pane RANGE BETWEEN INTERVAL 167 HOUR PRECEDING AND CURRENT ROW)""",
    lambda v: win.rolling_runs(v.ingestion_log, {"24h": 24, "7d": 168}, ["source"]),
)
query("agg30_match_counts", "SELECT applicant_id, count(*) AS matches, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'approved' AND NOT is_read) AS unread FROM match_queue GROUP BY 1", lambda v: rep.match_counts(v.match_queue))
STALE_SQL = "CASE WHEN remote_scope = 'global' AND p <> '' AND NOT regexp_matches(p, '(remote|worldwide|anywhere|global)') AND NOT regexp_matches(lower(normalized_text), '(anywhere|worldwide)') THEN CASE WHEN regexp_matches(p, '(emea|apac|namer|latam|europe)') THEN 'region_fenced' ELSE 'country_fenced' END ELSE remote_scope END"
P = "(SELECT *, lower(coalesce(location_name, '')) AS p FROM job)"
query("cls23_downgrade_global", f"SELECT id, {STALE_SQL} AS new_scope FROM {P} j", lambda v: ups.downgrade_stale_global(v.job).select("id", "new_scope"))
query(
    "agg31_reclassification_diff",
    f"SELECT remote_scope, new_scope, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (PARTITION BY remote_scope), 1) AS pct FROM (SELECT remote_scope, {STALE_SQL} AS new_scope FROM {P} j) x GROUP BY 1, 2",
    lambda v: rep.reclassification_diff(ups.downgrade_stale_global(v.job).drop("x"), F.col("new_scope")),
)
query(
    "agg33_gate_attrition",
    """SELECT count(*) AS pool, count(*) FILTER (WHERE f) AS fenced_alone, count(*) FILTER (WHERE f) AS fenced_in_turn, count(*) FILTER (WHERE s) AS natsec_alone, count(*) FILTER (WHERE NOT f AND s) AS natsec_in_turn, count(*) FILTER (WHERE q) AS qa_alone, count(*) FILTER (WHERE NOT f AND NOT s AND q) AS qa_in_turn,
    count(*) FILTER (WHERE u) AS unembedded_alone, count(*) FILTER (WHERE NOT f AND NOT s AND NOT q AND u) AS unembedded_in_turn, count(*) FILTER (WHERE NOT f AND NOT s AND NOT q AND NOT u) AS left_over
    FROM (SELECT is_fenced IS TRUE AS f, is_natsec IS TRUE AS s, is_qa IS TRUE AS q, job_embedding IS NULL AS u FROM job WHERE status = 'active' AND remote_scope = 'global') x""",
    lambda v: rep.gate_attrition(v.job),
)
query("agg35_active_alerts", "SELECT id, type, severity FROM alerts WHERE is_active", lambda v: v.alerts.filter("is_active").select("id", "type", "severity"))

# --- lifecycle
INCOMING = ["ats_source", "ats_slug", "concat(external_job_id, CASE WHEN id % 5 = 0 THEN 'n' ELSE '' END) AS external_job_id", "upper(title) AS title", "CASE WHEN id % 2 = 0 THEN location_name END AS location_name", "'hybrid' AS workplace_type", "compensation_max + 1 AS compensation_max", "'new payload' AS raw_json"]
TAKES = "CASE WHEN i.title IS NOT NULL THEN i.{0} ELSE c.{0} END AS {0}".format
query(
    "ups1_upsert_postings",
    f"""WITH cur AS (SELECT * FROM job QUALIFY row_number() OVER (PARTITION BY ats_source, ats_slug, external_job_id ORDER BY id) = 1), inc AS (SELECT {", ".join(INCOMING)} FROM cur WHERE id % 3 = 0)
    SELECT ats_source, ats_slug, external_job_id, {", ".join(map(TAKES, ["title", "location_name", "workplace_type", "compensation_max"]))}, CASE WHEN i.title IS NOT NULL AND c.normalized_at IS NULL THEN i.raw_json ELSE c.raw_json END AS raw_json, c.employment_type,
      CASE WHEN i.title IS NOT NULL AND (c.id IS NULL OR c.status IN ('stale', 'gone')) THEN 'active' ELSE c.status END AS status, CASE WHEN i.title IS NOT NULL THEN {NOW} ELSE c.last_seen_at END AS last_seen_at,
      CASE WHEN c.id IS NULL THEN 'new' WHEN i.title IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM cur c FULL JOIN inc i USING (ats_source, ats_slug, external_job_id)""",
    lambda v: (lambda c: ups.upsert_postings(c, c.filter("id % 3 = 0").selectExpr(*INCOMING), AS_OF))(joi.dedupe_first(v.job, ups.POSTING_KEY, ["id"])).select(
        *ups.POSTING_KEY, "title", "location_name", "workplace_type", "compensation_max", "raw_json", "employment_type", "status", "last_seen_at", "change"
    ),
)
query(
    "ups3_insert_companies",
    "SELECT discovery_source, CASE WHEN NOT regexp_matches(slug, '^[a-z][a-z0-9-]{1,59}$') THEN 'invalid' WHEN regexp_matches(lower(company_name), '(labs)') THEN 'blacklisted' WHEN slug IN (SELECT ats_slug FROM company WHERE id % 2 = 0) THEN 'known' ELSE 'inserted' END AS result, count(*) AS n FROM (SELECT *, CASE WHEN id % 10 = 0 THEN concat('9', ats_slug) ELSE ats_slug END AS slug FROM company) c GROUP BY 1, 2",
    lambda v: ups.insert_companies(v.company.filter("id % 2 = 0"), v.company.withColumn("ats_slug", F.expr("CASE WHEN id % 10 = 0 THEN concat('9', ats_slug) ELSE ats_slug END")), ["labs"]),
)
ONE = "(SELECT * FROM match_queue QUALIFY row_number() OVER (PARTITION BY job_id, persona_id ORDER BY id, created_at) = 1)"
query(
    "ups4_upsert_matches",
    f"""WITH c AS {ONE}, r AS (SELECT job_id + CASE WHEN id % 7 = 0 THEN 1000000 ELSE 0 END AS job_id, persona_id, 9 AS n, 0.5::DOUBLE AS d FROM c WHERE id % 2 = 0), b AS (SELECT *, n IS NULL OR coalesce(status IN ('mismatch', 'rejected', 'applied', 'approved'), false) AS stays FROM c FULL JOIN r USING (job_id, persona_id))
    SELECT job_id, persona_id, CASE WHEN stays THEN coalesce(status, 'pending') ELSE 'pending' END AS status, coalesce(n, overlap_score) AS overlap, CASE WHEN n IS NULL THEN cosine_distance ELSE d END AS cosine_distance,
      CASE WHEN stays THEN evaluated_at END AS evaluated_at, CASE WHEN stays THEN array_to_string(llm_blockers, '|') END AS llm_blockers, CASE WHEN stays THEN llm_confidence END AS llm_confidence, CASE WHEN stays THEN prompt_variant END AS prompt_variant FROM b""",
    lambda v: (lambda c: ups.upsert_matches(c, c.filter("id % 2 = 0").selectExpr("job_id + CASE WHEN id % 7 = 0 THEN 1000000 ELSE 0 END AS job_id", "persona_id", "9 AS overlap", "0.5D AS cosine_distance")))(joi.dedupe_first(v.match_queue, ["job_id", "persona_id"], ["id", "created_at"])).withColumn("llm_blockers", F.array_join("llm_blockers", "|")),
)
query("ups5_insert_absent", "SELECT company_id, discovery_source FROM (SELECT DISTINCT company_id, discovery_source FROM company_discovery_sources WHERE company_id % 2 = 0 UNION SELECT DISTINCT company_id, discovery_source FROM company_discovery_sources WHERE company_id % 3 = 0) x",
      lambda v: (lambda s: ups.insert_absent(s.filter("company_id % 2 = 0").distinct(), s.filter("company_id % 3 = 0"), ["company_id", "discovery_source"]))(v.company_discovery_sources.select("company_id", "discovery_source")))
query(
    "ups6_mark_stale",
    f"SELECT id, CASE WHEN s = 'stale' AND last_seen_at < {NOW} - INTERVAL 30 DAY THEN 'gone' ELSE s END AS status FROM (SELECT *, CASE WHEN status = 'active' AND (last_seen_at < {NOW} - INTERVAL 7 DAY OR published_at < {NOW} - INTERVAL 60 DAY) THEN 'stale' ELSE status END AS s FROM job) j",
    lambda v: ups.mark_stale(v.job, AS_OF).select("id", "status"),
)
query(
    "ups7_recalc_tiers",
    f"""SELECT id, CASE WHEN NOT polling_enabled THEN tier WHEN (health = 'dead' OR consecutive_failures >= 3) AND last_polled_at IS NOT NULL THEN 'dead'
      WHEN EXISTS (SELECT 1 FROM match_queue m JOIN job j ON j.id = m.job_id WHERE j.ats_source = c.ats_source AND j.ats_slug = c.ats_slug AND m.status = 'approved' AND evaluated_at > {NOW} - INTERVAL 30 DAY) THEN 'active_hot'
      WHEN discovered_at > {NOW} - INTERVAL 48 HOUR THEN 'active_hot' WHEN last_job_posted_at > {NOW} - INTERVAL 14 DAY THEN 'active' WHEN last_polled_at IS NULL THEN 'probation' WHEN zero_yield_poll_count < 3 THEN 'probation' ELSE 'dormant' END AS new_tier FROM company c""",
    lambda v: ups.recalc_tiers(v.company, v.job, v.match_queue, AS_OF).select("id", "new_tier"),
)
query(
    "ups8_quality_tiers",
    f"WITH {QUALITY} SELECT id, CASE WHEN quality > 50 AND approved > 3 THEN 'active_hot' WHEN quality < 10 AND total > 20 AND discovered_at <= {NOW} - INTERVAL 48 HOUR THEN 'dormant' ELSE tier END AS new_tier FROM quality",
    lambda v: ups.apply_quality_tiers(quality(v), AS_OF).select("id", "new_tier"),
)
query(
    "ups9_demote_layoffs",
    f"""SELECT c.id, CASE WHEN tier = 'active_hot' AND polling_enabled AND EXISTS (SELECT 1 FROM (SELECT {NAME('company')} AS l FROM layoffs) x WHERE length(l) >= 2
      AND (contains(lower(c.company_name), l) OR contains(lower(c.canonical_name), l))) THEN 'active' ELSE tier END AS new_tier FROM company c""",
    lambda v: ups.demote_layoffs(v.company, joi.companies_laid_off(v.layoffs, v.company)).select("id", "new_tier"),
)
# a company's polls numbered in order, the run of failures up to each, and what the last poll leaves
POLL_STATES = """WITH p AS (SELECT company_id, q.id, polled_at, status_code, valid, newest, jobs, error, NOT coalesce(status_code BETWEEN 200 AND 299, false) AS bad, {start} AS before FROM company_poll q JOIN company c ON c.id = q.company_id),
    g AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY company_id ORDER BY polled_at, id) AS grp, row_number() OVER (PARTITION BY company_id ORDER BY polled_at DESC, id DESC) AS back FROM p),
    r AS (SELECT *, CASE WHEN bad THEN count(*) FILTER (WHERE bad) OVER (PARTITION BY company_id, grp ORDER BY polled_at, id) + CASE WHEN grp = 0 THEN before ELSE 0 END ELSE 0 END AS run FROM g),
    state AS (SELECT company_id AS id, max(run) FILTER (WHERE back = 1) AS consecutive_failures, max(CASE WHEN NOT bad THEN CASE WHEN valid THEN 'healthy' ELSE 'degraded' END WHEN run >= 3 THEN 'dead' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code = 403 THEN 'blocked' WHEN status_code = 404 THEN 'dead' ELSE 'error' END) FILTER (WHERE back = 1) AS health,
      max(run) < 3 AS stays_enabled, max(polled_at) FILTER (WHERE back = 1) AS last_polled_at, max(error) FILTER (WHERE back = 1 AND bad) AS last_error, arg_max(coalesce(newest, polled_at), struct_pack(a := polled_at, b := id)) FILTER (WHERE NOT bad) AS last_job_posted_at,
      arg_max(coalesce(jobs, 0), struct_pack(a := polled_at, b := id)) FILTER (WHERE NOT bad) AS active_job_count FROM r GROUP BY company_id)"""
query(
    "ups10_company_polls",
    POLL_STATES.format(start="consecutive_failures")
    + """ SELECT c.id, coalesce(s.health, c.health) AS health, coalesce(s.consecutive_failures, c.consecutive_failures) AS consecutive_failures, polling_enabled AND coalesce(stays_enabled, true) AS polling_enabled, coalesce(s.last_polled_at, c.last_polled_at) AS last_polled_at,
      coalesce(s.last_job_posted_at, c.last_job_posted_at) AS last_job_posted_at, active_job_count, last_error FROM company c LEFT JOIN state s ON s.id = c.id""",
    lambda v: runs.fold_company_polls(v.company, v.company_poll),
)
query(
    "ups10_failure_runs",
    "WITH l AS (SELECT source, max(struct_pack(a := created_at, b := id)) FILTER (WHERE status <> 'failure') AS ok FROM ingestion_log GROUP BY 1) SELECT l.source, count(g.id) AS consecutive_failures FROM l LEFT JOIN ingestion_log g ON g.source = l.source AND g.status = 'failure' AND (l.ok IS NULL OR struct_pack(a := g.created_at, b := g.id) > l.ok) GROUP BY 1",
    lambda v: ups.failure_runs(v.ingestion_log),
)
query(
    "ups12_source_health_fold",
    """WITH g AS (SELECT *, sum(CASE WHEN status <> 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS grp FROM ingestion_log), r AS (SELECT source, grp, count(*) FILTER (WHERE status = 'failure') AS f FROM g GROUP BY ALL)
    SELECT source, max(f) AS longest, arg_max(f, grp) AS consecutive_failures, CASE WHEN max(f) >= 5 THEN 'disabled' WHEN arg_max(f, grp) >= 3 THEN 'degraded' ELSE 'healthy' END AS health FROM r GROUP BY source""",
    lambda v: ups.fold_source_results(v.ingestion_log),
)
#: companies as if half of them had been polled a month earlier
LONG_AGO = "SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN last_polled_at - INTERVAL 30 DAY ELSE last_polled_at END AS last_polled_at) FROM company"
long_ago = lambda v: v.company.withColumn("last_polled_at", F.expr("CASE WHEN id % 2 = 0 THEN last_polled_at - INTERVAL 30 DAY ELSE last_polled_at END"))
BACK = f"coalesce(health = 'dead' AND NOT polling_enabled AND last_polled_at < {NOW} - INTERVAL 7 DAY, false)"
query("ups11_revive", f"SELECT id, {BACK} AS revived, polling_enabled OR {BACK} AS polling_enabled, CASE WHEN {BACK} THEN 'healthy' ELSE health END AS health, CASE WHEN {BACK} THEN 0 ELSE consecutive_failures END AS consecutive_failures FROM ({LONG_AGO}) c", lambda v: ups.revive_companies(long_ago(v), AS_OF).select("id", "revived", "polling_enabled", "health", "consecutive_failures"))
BANNED = f"(status = 'disabled' AND disabled_at < {NOW} - INTERVAL 24 HOUR)"
query("ups13_recover_banned", f"SELECT source_name, CASE WHEN {BANNED} THEN 'healthy' ELSE status END AS new_status, CASE WHEN {BANNED} THEN 0 ELSE consecutive_failures END AS failures FROM source_health", lambda v: ups.recover_banned(v.source_health, AS_OF).select("source_name", "new_status", "failures"))
query(
    "ups14_retention_plan",
    f"SELECT id, CASE WHEN status = 'rejected' AND normalized_at < {NOW} - INTERVAL 1 DAY THEN 'rejected' WHEN status = 'gone' AND last_seen_at < {NOW} - INTERVAL 7 DAY THEN 'gone' WHEN status = 'normalization_failed' AND detected_at < {NOW} - INTERVAL 7 DAY THEN 'failed' WHEN coalesce(published_at, detected_at) < {NOW} - INTERVAL 30 DAY THEN 'ancient' END AS rule FROM job",
    lambda v: ups.retention_plan(v.job, AS_OF).select("id", "rule"),
)
query("ups14_expired_matches", f"SELECT id FROM match_queue WHERE status IN ('approved', 'rejected') AND created_at < {NOW} - INTERVAL 90 DAY", lambda v: IDS(ups.expired_matches(v.match_queue, AS_OF)))
LATER = "TIMESTAMP '2024-02-15 00:00:00'"
EXPIRED = {"delete_logs": f"ingestion_log WHERE created_at < {NOW} - INTERVAL 30 DAY", "delete_retries": f"slugger_retry WHERE next_retry_at < {NOW} - INTERVAL 30 DAY AND retry_count >= 3"}
query("ups14_expired_logs", f"SELECT id FROM {EXPIRED['delete_logs'].replace(NOW, LATER)}", lambda v: IDS(ups.expired_logs(v.ingestion_log, "2024-02-15 00:00:00")))
query("ups14_exhausted_retries", f"SELECT id FROM {EXPIRED['delete_retries']}", lambda v: IDS(ups.exhausted_retries(v.slugger_retry, AS_OF)))
query(
    "ups15_purge_plan",
    """WITH pool AS (SELECT id, detected_at, CASE status WHEN 'normalization_failed' THEN 0 WHEN 'rejected' THEN 1 WHEN 'gone' THEN 2 WHEN 'stale' THEN 3 WHEN 'active' THEN 4 END AS tier FROM job WHERE id NOT IN (SELECT job_id FROM match_queue WHERE status = 'approved')),
    n AS (SELECT tier, CASE WHEN tier = 4 THEN floor(count(*) * 0.2::DOUBLE)::BIGINT ELSE count(*) END AS n FROM pool WHERE tier IS NOT NULL GROUP BY tier), b AS (SELECT tier, greatest(0, least(n, 3000 - coalesce(sum(n) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS g FROM n),
    r AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY detected_at, id) AS place FROM pool) SELECT r.id, r.tier, place FROM r JOIN b USING (tier) WHERE place <= g""",
    lambda v: ups.purge_plan(v.job, v.match_queue, 3000),
)
FENCED = "remote_scope IN ('country_fenced', 'region_fenced', 'onsite')"
FIX = {
    "global-scope-null-countries": "remote_scope = 'global' AND location_countries IS NOT NULL", "fenced-null-embedding": f"{FENCED} AND job_embedding IS NOT NULL",
    "is-fenced-consistency": f"(({FENCED} AND is_fenced = false) OR (NOT {FENCED} AND is_fenced = true))", "rejected-normalized-at": "status = 'rejected' AND normalized_at IS NULL",
}
query("ups16_reconcile", " UNION ALL ".join(f"SELECT '{n}' AS fix_name, CASE WHEN count(*) > 0 THEN 'applied' ELSE 'already-ok' END AS status, count(*) AS n FROM job WHERE {hit}" for n, hit in FIX.items()), lambda v: ups.reconciliation_log(ups.reconcile(v.job, AS_OF)))
query(
    "ups16_reconciled_jobs",
    f"""SELECT id, CASE WHEN NOT coalesce({FIX['global-scope-null-countries']}, false) THEN array_to_string(location_countries, ',') END AS countries, job_embedding IS NOT NULL AND NOT {FENCED} AS embedded,
      CASE WHEN {FIX['is-fenced-consistency']} THEN NOT is_fenced ELSE is_fenced END AS is_fenced, CASE WHEN {FIX['rejected-normalized-at']} THEN {NOW} ELSE normalized_at END AS normalized_at FROM job""",
    lambda v: ups.reconcile(v.job, AS_OF).select("id", F.array_join("location_countries", ",").alias("countries"), F.col("job_embedding").isNotNull().alias("embedded"), "is_fenced", "normalized_at"),
)
query("ups17_backoff", f"SELECT id, retry_count + 1 AS retry_count, {NOW} + INTERVAL 1 DAY * CAST(7 * pow(2, retry_count + 1) AS INT) AS next_retry_at FROM slugger_retry", lambda v: ups.backoff(v.slugger_retry, AS_OF))
query("ups19_reset_matches", "SELECT id, CASE WHEN status = 'rejected' AND persona_id IN (SELECT id FROM persona WHERE id % 3 = 0) AND job_id IN (SELECT id FROM job WHERE status = 'active') THEN 'pending' ELSE status END AS status FROM match_queue", lambda v: ups.reset_persona_matches(v.match_queue, v.job, v.persona.filter("id % 3 = 0")))
query(
    "ups21_merge_alerts",
    "SELECT type, source, CASE WHEN c.w IS NULL THEN 'open' WHEN f.w IS NULL THEN 'resolve' ELSE 'keep' END AS action FROM (SELECT DISTINCT type, source, 1 AS w FROM alerts WHERE is_active AND id % 7 < 3) c FULL JOIN (SELECT DISTINCT CASE WHEN status = 'failure' THEN 'error' ELSE 'odd' END AS type, source, 1 AS w FROM ingestion_log) f USING (type, source)",
    lambda v: ups.merge_alerts(v.alerts.filter("id % 7 < 3"), v.ingestion_log.selectExpr("CASE WHEN status = 'failure' THEN 'error' ELSE 'odd' END AS type", "source")),
)
query("cls18_usd_pay", f"SELECT id, {USD_OK} AS usd FROM job", lambda v: v.job.select("id", X.to_usd(F.col("compensation_max"), F.col("compensation_currency")).alias("usd")))
query("cls21_canonical_name", f"SELECT id, {CANON.format('company_name')} AS name FROM company", lambda v: v.company.select("id", X.canonical_name(F.col("company_name")).alias("name")))
query("cls22_text_hash", f"SELECT id, {HASH} AS text_hash FROM job", lambda v: v.job.select("id", X.text_hash(F.col("company_name"), F.col("title"), F.col("location_name")).alias("text_hash")))
