"""Queries over the classification operators and the composed jobs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.operators import classify as cls
from matchflow.operators import filters as flt
from matchflow.operators import joins as joi
from matchflow.operators import reports as rep
from matchflow.operators import scoring as sco
from matchflow.operators import upserts as ups
from matchflow.plans import jobs
from matchflow.plans.adapters import AS_OF
from matchflow.sources import discovery as dis
from matchflow.plans.queries import DEFINING, NOW, ORACLE_SQL, SPECIFIC, arr, parts, query, route_sql, words
from matchflow.plans.queries_more import BLOCKERS, EXPIRED, FIX, PAIRS, PLACED, TITLE_TAG, long_ago, match_sql, named_in, pairs, rate

PLACE, TEXT = "lower(coalesce(location_name, ''))", "lower(coalesce(normalized_text, ''))"
has = "regexp_matches({0}, '{1}')".format
kind = lambda c: f"CASE WHEN {has(c, 'hybrid')} THEN 'hybrid' WHEN {has(c, '(remote|anywhere)')} THEN 'remote' WHEN {has(c, '(on-?site|in office)')} THEN 'on-site' END"
query("cls3_workplace_type", f"SELECT id, coalesce(workplace_type, {kind(PLACE)}, {kind(TEXT)}) AS inferred_workplace FROM job", lambda v: cls.with_workplace_type(v.job).select("id", "inferred_workplace"))
query(
    "cls4_employment_type",
    "SELECT id, CASE WHEN regexp_matches(t, '(fulltime|permanent|uop)') THEN 'full_time' WHEN contains(t, 'parttime') THEN 'part_time' WHEN regexp_matches(t, '(contract|b2b|freelance|zlecenie)') THEN 'contract' WHEN contains(t, 'intern') THEN 'internship' WHEN contains(t, 'temp') THEN 'temporary' END AS employment FROM (SELECT id, regexp_replace(lower(trim(employment_type)), '[ _-]', '', 'g') AS t FROM job) j",
    lambda v: cls.with_employment_type(v.job).select("id", "employment"),
)
query("cls5_title_region", f"SELECT id, {TITLE_TAG} AS title_region FROM job", lambda v: cls.with_title_region(v.job).select("id", "title_region"))
num = "TRY_CAST(nullif(regexp_extract({0}, '{1}', {2}), '') AS INT)".format
PAIR = "([0-9]{1,2}) ?(?:-|to) ?([0-9]{1,2}) ?(?:[+] ?)?years"
query("cls6_experience_range", f"SELECT id, coalesce({num(TEXT, PAIR, 1)}, {num(TEXT, '([0-9]{1,2}) ?[+]? ?years', 1)}) AS years_min, {num(TEXT, PAIR, 2)} AS years_max FROM job", lambda v: cls.with_experience_range(v.job).select("id", "years_min", "years_max"))
SPEC = SPECIFIC
NAMED = named_in(PLACE)
either = lambda ps: f"regexp_matches(concat_ws(' ', coalesce(location_name, ''), coalesce(normalized_text, '')), '(?i){'|'.join(ps)}')"
SCOPE = f"""CASE WHEN workplace_type IN ('on-site', 'hybrid') THEN 'onsite' WHEN {either(C.FIRST_GLOBAL)} THEN 'global' WHEN {either(C.FIRST_FENCED)} THEN 'country_fenced'
  WHEN {either([p for p, _ in C.REGION_SIGNALS if p.startswith(chr(92) + "bremote")])} THEN 'region_fenced' WHEN workplace_type = 'remote' AND trim({PLACE}) = 'remote' THEN 'global' WHEN len({NAMED}) > 0 OR {SPEC} THEN 'country_fenced' ELSE 'unknown' END"""
said = lambda ps: f"regexp_matches(coalesce(normalized_text, ''), '(?i){'|'.join(ps)}')"
hits = lambda pairs, flag="(?i)": "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(normalized_text, ''), '{flag}{p}') THEN '{n}' END" for p, n in pairs) + "], lambda x: x IS NOT NULL)"
tidy = lambda items: f"array_to_string(list_sort(list_distinct({items})), ',')"
query(
    "cls9_scope_signals",
    f"SELECT id, {said(C.ALWAYS_GLOBAL)} AS always_global, {said(C.GLOBAL_SIGNALS)} AS global_high, len({hits(cls.COUNTRY_FENCES)}) > 0 AS country_high, {tidy('list_filter(' + hits(cls.COUNTRY_FENCES) + ', lambda y: length(y) > 0)')} AS fence_countries, "
    f"{tidy(hits(C.REGION_SIGNALS))} AS fence_regions, {tidy(hits(C.MEDIUM_SIGNALS, ''))} AS medium, array_to_string({hits([s[:2] for s in C.NEGATIVE_SIGNALS], '')}, ',') AS negatives FROM job",
    lambda v: cls.with_scope_signals(v.job).select("id", "always_global", "global_high", "country_high", *[F.array_join(c, ",").alias(c) for c in ("fence_countries", "fence_regions", "medium", "negatives")]),
)
query("cls7_infer_scope", f"SELECT id, {SCOPE} AS inferred_scope FROM job", lambda v: cls.infer_remote_scope(v.job).select("id", "inferred_scope"))
FIRED = "[" + ", ".join(f"CASE WHEN {has(TEXT, '(?i)' + p)} THEN '{n}' END" for n, p, _ in C.REGION_PROBES) + "]"
WEIGHT = " + ".join(f"CASE WHEN {has(TEXT, '(?i)' + p)} THEN {w} ELSE 0 END" for _, p, w in C.REGION_PROBES)
query("cls11_multi_probe", f"SELECT id, array_to_string(list_filter({FIRED}, lambda x: x IS NOT NULL), ',') AS probes, {WEIGHT} >= 2 AS region_fence FROM job", lambda v: cls.with_multi_probe(v.job).select("id", "probes", "region_fence"))
SPAN = "abs({0} - {1})".format(num(TEXT, "utc ?([+-][0-9]{1,2}) ?(?:to|-|and) ?utc ?([+-][0-9]{1,2})", 2), num(TEXT, "utc ?([+-][0-9]{1,2}) ?(?:to|-|and) ?utc ?([+-][0-9]{1,2})", 1))
def countries(col: str) -> str:
    names = ", ".join(f"CASE WHEN regexp_matches({col}, '(^|[^a-z]){re.escape(n)}($|[^a-z])') THEN ['{c}'] END" for n, c in C.COUNTRIES.items())
    regions = ", ".join(f"CASE WHEN regexp_matches({col}, '(^|[^a-z]){n}($|[^a-z])') THEN {arr(cs)} END" for n, cs in C.TEXT_REGIONS.items())
    return f"list_sort(list_distinct(flatten(list_filter([{names}, {regions}], lambda x: x IS NOT NULL))))"


said_in = lambda ps: f"regexp_matches(t, '(?i){'|'.join(ps)}')"
first_of = lambda pairs, flag="(?i)": "CASE " + " ".join(f"WHEN regexp_matches(t, '{flag}{p}') THEN '{n}'" for p, n in pairs) + " END"
against = lambda kind: "(" + " OR ".join(f"regexp_matches(t, '{p}')" for p, _, k in C.NEGATIVE_SIGNALS if k == kind) + ")"
GROUPS = " + ".join(f"CAST(regexp_matches({PLACE}, '(^|[^a-z])({'|'.join(g)})($|[^a-z])') AS INT)" for g in C.MACRO_REGIONS)
SOFT = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}')" + (" AND NOT not_global" if sc == "global" else "") + f" THEN '{sc}'" for p, sc in C.MEDIUM_SIGNALS) + f" WHEN {SPAN.replace(TEXT, 'lower(t)')} <= 8 THEN 'region_fenced' WHEN {SPAN.replace(TEXT, 'lower(t)')} > 8 AND NOT not_global THEN 'global' END"
FIRED_IN = "[" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {w} ELSE 0 END" for _, p, w in C.REGION_PROBES) + "]"
MEMBERS = "CASE region " + " ".join(f"WHEN '{r}' THEN {arr(sorted(cs))}" for r, cs in C.TEXT_REGIONS.items()) + " END"
CODES = countries("lower(t)")
ROWS = [
    ("native", "onsite", "NULL", "step1_ats_native", "1"), ("open AND groups >= 3", "global", "NULL", "step1_regex", "0.7"), ("open AND nowhere AND len(nd) > 0", "country_fenced", "[nd[1]]", "step1_regex", "0.7"),
    ("workplace_type IS NULL AND spec", "onsite", "NULL", "step1_regex", "0.7"), ("g AND always", "global", "NULL", "step1_regex", "1"), ("g AND NOT spec", "global", "CASE WHEN len(codes) > 0 THEN codes END", "step1_regex", "1"),
    ("NOT g AND country IS NOT NULL", "country_fenced", "CASE WHEN country <> '' THEN [country] WHEN len(codes) > 0 THEN codes END", "step1_regex", "1"), ("NOT g AND region IS NOT NULL", "region_fenced", MEMBERS, "step1_regex", "1"),
    ("NOT g AND (onsite OR (never AND workplace_type IS DISTINCT FROM 'remote'))", "onsite", "NULL", "step1_regex", "1"), ("open AND NOT says AND spec", "country_fenced", "CASE WHEN len(nd) > 0 THEN [nd[1]] END", "step1_regex", "0.7"),
    ("long AND list_sum(ws) >= 2", "region_fenced", "NULL", "step1_regex", "CASE WHEN list_contains(ws, 2) THEN 1 ELSE 0.7 END"), ("long AND says AND NOT (g AND spec)", "global", "NULL", "step1_regex", "0.7"),
    ("NOT long", "undetermined", "NULL", "hard_fail", "0"), ("true", "undetermined", "NULL", "deterministic_only_no_signal", "0"),
]
by_row = lambda at, q="": "CASE " + " ".join(f"WHEN {r[0]} THEN {q}{r[at]}{q}" for r in ROWS) + " END"
CASCADE = f"""SELECT id, {by_row(1, "'")} AS scope, {by_row(2)} AS countries, {by_row(3, "'")} AS resolved_by, CAST({by_row(4)} AS DOUBLE) AS confidence
  FROM (SELECT *, g OR (country IS NULL AND region IS NULL AND NOT onsite AND NOT never AND coalesce(({SOFT}) = 'global', false)) AS says, {CODES} AS codes, {FIRED_IN} AS ws, length(t) >= 50 AS long
    FROM (SELECT *, {said_in(C.GLOBAL_SIGNALS)} AS g, {said_in(C.ALWAYS_GLOBAL)} AS always, {first_of(cls.COUNTRY_FENCES)} AS country, {first_of(C.REGION_SIGNALS)} AS region, workplace_type IS NULL AND {said_in(C.ONSITE_SIGNALS)} AS onsite, {against("all_remote")} AS never, {against("global")} AS not_global
      FROM (SELECT id, workplace_type, workplace_type IN ('on-site', 'hybrid') AND ats_source IS DISTINCT FROM 'greenhouse' AS native, (workplace_type IS NULL OR workplace_type = 'remote') AND coalesce(location_name, '') <> '' AS open, {GROUPS} AS groups, {NAMED} AS nd, {SPEC} AS spec, regexp_matches({PLACE}, '{parts(C.REMOTE_INDICATORS)}') AS nowhere,
        CASE WHEN coalesce(location_name, '') = '' THEN tidy ELSE regexp_replace(tidy, '(?i)' || regexp_escape(location_name), ' ', 'g') END AS t FROM (SELECT *, trim(regexp_replace(coalesce(normalized_text, ''), '\\s+', ' ', 'g')) AS tidy FROM job) a) b) c) d"""
query("cls8_scope_cascade", f"SELECT id, scope, array_to_string(countries, ',') AS countries, resolved_by, confidence FROM ({CASCADE}) x", lambda v: cls.classify_remote_scope(v.job).select("id", "scope", F.array_join("countries", ",").alias("countries"), "resolved_by", "confidence"))
query("cls24_reclassify_undetermined", f"SELECT x.id, scope FROM ({CASCADE}) x JOIN job o ON o.id = x.id WHERE o.remote_scope = 'undetermined'", lambda v: cls.classify_remote_scope(v.job.filter("remote_scope = 'undetermined'")).select("id", "scope"))
query("cls10_utc_span", f"SELECT id, {SPAN} AS span, CASE WHEN {SPAN} <= 8 THEN 'region_fenced' WHEN {SPAN} > 8 THEN 'global' END AS span_scope FROM job", lambda v: cls.with_utc_span(v.job).select("id", "span", "span_scope"))


query("cls12_countries", f"SELECT id, array_to_string({countries(PLACE)}, ',') AS countries FROM job", lambda v: cls.extract_countries(v.job, "location_name").select("id", F.array_join("countries", ",").alias("countries")))
query("cls13_strip_hq", "SELECT id, CASE WHEN coalesce(location_name, '') = '' THEN t ELSE regexp_replace(t, '(?i)' || regexp_escape(location_name), ' ', 'g') END AS stripped FROM (SELECT id, location_name, concat(normalized_text, ' We sit in ', upper(coalesce(location_name, '')), ' (', coalesce(location_name, ''), ').') AS t FROM job) x", lambda v: cls.strip_hq(v.job.withColumn("normalized_text", F.expr("concat(normalized_text, ' We sit in ', upper(coalesce(location_name, '')), ' (', coalesce(location_name, ''), ').')")), "location_name").select("id", "stripped"))
query("cls14_specific_location", f"SELECT id, {SPECIFIC} AS specific FROM job", lambda v: v.job.select("id", flt.is_specific(F.lower(F.coalesce("location_name", F.lit("")))).alias("specific")))
MACRO = " + ".join(f"CASE WHEN regexp_matches(p, '(^|[^a-z])({'|'.join(names)})($|[^a-z])') THEN 1 ELSE 0 END" for names in C.MACRO_REGIONS)
FEED = f"""CASE WHEN ats_source <> 'greenhouse' AND workplace_type IN ('on-site', 'hybrid') THEN 'onsite' WHEN {MACRO} >= 3 OR regexp_matches(p, 'worldwide|anywhere|global') THEN 'global'
  WHEN regexp_matches(p, '{parts(C.REMOTE_INDICATORS)}') AND len({named_in('p')}) > 0 THEN 'country_fenced' WHEN workplace_type IS NULL AND p <> '' AND NOT regexp_matches(p, '{parts(C.REMOTE_INDICATORS + C.BROAD_REGIONS)}') THEN 'onsite' ELSE 'undetermined' END"""
ONE_OF = {"global_jobs": "global", "fenced_jobs": "country_fenced", "onsite_jobs": "onsite", "undetermined": "undetermined"}
query(
    "cls15_company_feed",
    f"""SELECT *, global_jobs + 0.5::DOUBLE * undetermined AS addressable, CASE WHEN webdev > 0 THEN round(global_jobs / webdev::DOUBLE, 6) ELSE 0 END AS global_share, webdev >= 2 AS passed FROM (SELECT ats_source, ats_slug, count(*) AS jobs, count(*) FILTER (WHERE w) AS webdev,
      {', '.join(f"count(*) FILTER (WHERE w AND s = '{scope}') AS {n}" for n, scope in ONE_OF.items())} FROM (SELECT *, {FEED} AS s, regexp_matches(lower(title), '{parts(C.WEBDEV_TERMS)}') AS w FROM (SELECT *, lower(coalesce(location_name, '')) AS p FROM job) j) k GROUP BY 1, 2) x""",
    lambda v: cls.profile_company_feed(v.job),
)
WEB = f"count(*) FILTER (WHERE regexp_matches(lower(title), '{parts(C.WEBDEV_TERMS)}'))"
query("cls16_stack_gate", f"SELECT ats_source, ats_slug, {WEB} AS webdev, count(*) AS jobs, round({WEB} / count(*)::DOUBLE, 6) AS share, {WEB} >= 2 AS passes, CASE WHEN {WEB} > 2 THEN 'active' ELSE 'dormant' END AS initial_tier FROM job GROUP BY 1, 2", lambda v: cls.evaluate_stack_gate(v.job))
query("cls25_title_seniority", "SELECT id, CASE WHEN regexp_matches(t, '(junior|associate|entry|intern|trainee)') THEN 'junior' WHEN regexp_matches(t, '(senior|sr[.]|sr )') THEN 'senior' WHEN regexp_matches(t, '(lead|staff|principal|architect|manager|director|head|expert)') THEN 'lead' ELSE 'mid' END AS level FROM (SELECT id, lower(title) AS t FROM job) j", lambda v: cls.with_title_seniority(v.job).select("id", "level"))
BANNED = "['AR', 'DE', 'US', 'GB']"
query(
    "joi15_excluded_country",
    f"WITH {PLACED} SELECT id, coalesce(list_filter(list_transform(location_countries, lambda c: upper(c)), lambda c: list_contains({BANNED}, c))[1], CASE WHEN list_contains({BANNED}, nd[1]) THEN nd[1] END, list_filter({BANNED}, lambda c: list_contains(nd, c))[1]) AS excluded FROM placed",
    lambda v: cls.with_excluded_country(v.job, ["AR", "DE", "US", "GB"]).select("id", "excluded"),
)
query("joi17_prefilter_pairs", f"WITH {PAIRS} SELECT id AS job_id, count(*) AS applicants, count(*) FILTER (WHERE len({BLOCKERS}) = 0) AS passing FROM pairs GROUP BY id", lambda v: sco.hard_blockers(pairs(v)).groupBy("job_id").agg(F.count(F.lit(1)).alias("applicants"), F.count_if("passes").alias("passing")))

# --- reports and lifecycle jobs that build on them
CLEAN = "is_fenced IS NOT TRUE AND is_natsec IS NOT TRUE AND is_qa IS NOT TRUE"
HEALTH = {
    "unnormalized_jobs": f"SELECT count(*) FROM job WHERE status = 'active' AND normalized_at IS NULL AND raw_json IS NOT NULL AND detected_at < {NOW} - INTERVAL 1 HOUR",
    "unembedded_jobs": f"SELECT count(*) FROM job WHERE status = 'active' AND job_embedding IS NULL AND normalized_at IS NOT NULL AND remote_scope = 'global' AND {CLEAN}",
    "normalization_failed": "SELECT count(*) FROM job WHERE status = 'normalization_failed' AND normalized_at IS NULL",
    "null_country_fenced_jobs": "SELECT count(*) FROM job WHERE remote_scope = 'country_fenced' AND location_countries IS NULL",
    "companies_polled_4h": f"SELECT count(*) FROM company WHERE last_polled_at > {NOW} - INTERVAL 4 HOUR", "source_health_rows": "SELECT count(*) FROM source_health",
    "matches_24h": f"SELECT count(*) FROM match_queue WHERE created_at > {NOW} - INTERVAL 24 HOUR",
    "pending_matches_stale": f"SELECT count(*) FROM match_queue WHERE status = 'pending' AND created_at < {NOW} - INTERVAL 30 MINUTE",
    "approved_matches_24h": f"SELECT count(*) FROM match_queue WHERE status = 'approved' AND evaluated_at > {NOW} - INTERVAL 24 HOUR",
    "approval_rate_7d": f"SELECT coalesce(count(*) FILTER (WHERE status = 'approved') / nullif(count(*) FILTER (WHERE status IN ('approved', 'rejected')), 0)::DOUBLE, 0) FROM match_queue WHERE evaluated_at > {NOW} - INTERVAL 7 DAY",
    "avg_confidence_7d": f"SELECT coalesce(avg(llm_confidence), 0) FROM match_queue WHERE evaluated_at > {NOW} - INTERVAL 7 DAY",
    "stale_functions": f"SELECT count(*) FROM source_health h WHERE NOT EXISTS (SELECT 1 FROM ingestion_log l WHERE l.source = h.source_name AND l.created_at >= {NOW} - INTERVAL 36 HOUR)",
}
query(
    "agg15_pipeline_health",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round(n, 6) AS value, " + (f"n {jobs.HEALTH_ALERTS[m][0]} {jobs.HEALTH_ALERTS[m][1]}" if m in jobs.HEALTH_ALERTS else "false") + f" AS fires FROM (SELECT CAST(({q}) AS DOUBLE) AS n) {m}" for m, q in HEALTH.items()),
    lambda v: jobs.pipeline_health(v.job, v.match_queue, v.company, v.source_health, v.ingestion_log, v.source_health.select(F.col("source_name").alias("source"), F.lit(36).alias("max_gap_h")), AS_OF),
)
query("agg34_evaluate_feeds", f"SELECT ats_source, count(*) AS jobs, count(*) FILTER (WHERE h) AS on_stack, {rate('count(*) FILTER (WHERE h)', 'count(*)')} AS share FROM (SELECT *, regexp_matches(lower(concat_ws(' ', array_to_string(extracted_tags, ' '), title, normalized_text)), '(^|[^a-z0-9])(go|php)([^a-z0-9]|$)|graphql|typescript') AS h FROM job) j GROUP BY 1", lambda v: jobs.evaluate_feeds(v.job, ["go", "php", "graphql", "typescript"]))
query(
    "ups2_upsert_board_postings",
    f"""WITH cur AS (SELECT * FROM job QUALIFY row_number() OVER (PARTITION BY ats_source, ats_slug, external_job_id ORDER BY id) = 1), inc AS (SELECT ats_source, ats_slug, concat(external_job_id, CASE WHEN id % 5 = 0 THEN 'n' ELSE '' END) AS external_job_id, title, published_at, remote_scope, id % 2 = 0 AS embedded FROM cur WHERE id % 3 = 0 AND published_at >= {NOW} - INTERVAL 60 DAY)
    SELECT ats_source, ats_slug, external_job_id, coalesce(i.title, c.title) AS title, CASE WHEN coalesce(i.remote_scope, c.remote_scope) LIKE '%fenced' THEN false ELSE coalesce(i.embedded, false) OR c.job_embedding IS NOT NULL END AS embedded FROM cur c FULL JOIN inc i USING (ats_source, ats_slug, external_job_id)""",
    lambda v: (lambda c: ups.upsert_board_postings(c, c.filter("id % 3 = 0").selectExpr("ats_source", "ats_slug", "concat(external_job_id, CASE WHEN id % 5 = 0 THEN 'n' ELSE '' END) AS external_job_id", "title", "published_at", "remote_scope", "id % 2 = 0 AS embedded"), AS_OF))(joi.dedupe_first(v.job.withColumn("embedded", F.col("job_embedding").isNotNull()), ups.POSTING_KEY, ["id"])),
)
query("ups18_sweep_retry_flags", f"SELECT id, started_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE AND finished_at IS NULL AS cleared FROM ingestion_log", lambda v: ups.sweep_retry_flags(v.ingestion_log, "2024-01-20 00:00:00").select("id", "cleared"))
query(
    "ups20_apply_dismissals",
    "SELECT DISTINCT j.ats_slug, j.title, CASE m.id % 4 WHEN 0 THEN 'geo_fenced' WHEN 1 THEN 'suppressed' ELSE 'wrong_stack' END AS override_type FROM match_queue m JOIN job j ON j.id = m.job_id WHERE m.status = 'approved' AND m.id % 4 < 3 AND NOT EXISTS (SELECT 1 FROM job_label_override o WHERE o.revoked_at IS NULL AND o.ats_slug = j.ats_slug AND o.title = j.title AND o.override_type = CASE m.id % 4 WHEN 0 THEN 'geo_fenced' WHEN 1 THEN 'suppressed' ELSE 'wrong_stack' END)",
    lambda v: ups.dismissal_overrides(v.match_queue.filter("status = 'approved'").selectExpr("job_id", "CASE id % 4 WHEN 0 THEN 'location' WHEN 1 THEN 'not_interested' WHEN 2 THEN 'stack' ELSE 'other' END AS reason"), v.job, v.job_label_override),
)

# --- composed jobs
query("pip1_normalize_job", f"SELECT j.id, x.scope AS scope, CASE WHEN length(normalized_text) < 100 THEN 'title_only' WHEN list_has_any(extracted_tags, {DEFINING}) THEN 'normalized' ELSE 'no_tags' END AS outcome FROM job j JOIN ({CASCADE}) x ON x.id = j.id WHERE status NOT IN ('rejected', 'stale', 'gone') AND normalized_at IS NULL", lambda v: jobs.normalize_job(v.job).select("id", "scope", "outcome"))
query(
    "pip5_nightly_maintenance",
    f"SELECT status, rule, count(*) AS n FROM (SELECT s AS status, CASE WHEN s = 'rejected' AND normalized_at < {NOW} - INTERVAL 1 DAY THEN 'rejected' WHEN s = 'gone' AND last_seen_at < {NOW} - INTERVAL 7 DAY THEN 'gone' WHEN s = 'normalization_failed' AND detected_at < {NOW} - INTERVAL 7 DAY THEN 'failed' WHEN coalesce(published_at, detected_at) < {NOW} - INTERVAL 30 DAY THEN 'ancient' END AS rule FROM (SELECT *, CASE WHEN a = 'stale' AND last_seen_at < {NOW} - INTERVAL 30 DAY THEN 'gone' ELSE a END AS s FROM (SELECT *, CASE WHEN status = 'active' AND (last_seen_at < {NOW} - INTERVAL 7 DAY OR published_at < {NOW} - INTERVAL 60 DAY) THEN 'stale' ELSE status END AS a FROM job) x) y) z GROUP BY 1, 2",
    lambda v: jobs.nightly_maintenance(v.job, AS_OF).groupBy("status", "rule").agg(F.count(F.lit(1)).alias("n")),
)
query(
    "pip7_gate_replay",
    f"WITH {PAIRS.replace('m.id AS match_id, j.*', 'm.id AS match_id, m.status AS match_status, j.*')} SELECT match_status, len({BLOCKERS}) = 0 AS passes, count(*) AS n FROM pairs GROUP BY 1, 2",
    lambda v: jobs.gate_replay(pairs(v, F.col("status").alias("match_status"))),
)
query("pip8_backfill_hash", "SELECT count(*) AS rows_changed FROM job WHERE location_name IS NULL", lambda v: jobs.backfill(v.job, "location_name", F.coalesce("location_name", F.lit("unknown")), "id"))
query(
    "pip3_reprocess",
    f"WITH {PLACED}, due AS (SELECT * FROM placed WHERE id IN (SELECT id FROM ({ORACLE_SQL['joi11_reprocess_candidates']}) c)), pairs AS (SELECT j.*, a.* FROM due j, applicant a), fit AS (SELECT * FROM due WHERE id IN (SELECT id FROM pairs WHERE len({BLOCKERS}) = 0)), "
    f"{match_sql('fit')} SELECT job_id, persona_id, rank FROM found",
    lambda v: jobs.reprocess(v.job, v.persona, v.applicant, v.match_queue, v.job_label_override, v.applicant_company_block).select("job_id", "persona_id", "rank"),
)
STEP = "SELECT '{0}' AS step, count(*) AS n FROM {1}".format
AGED = f"(SELECT *, CASE WHEN a = 'stale' AND last_seen_at < {NOW} - INTERVAL 30 DAY THEN 'gone' ELSE a END AS s FROM (SELECT *, CASE WHEN status = 'active' AND (last_seen_at < {NOW} - INTERVAL 7 DAY OR published_at < {NOW} - INTERVAL 60 DAY) THEN 'stale' ELSE status END AS a FROM job) x)"
RULED = f"(SELECT * REPLACE (s AS status), status AS was, CASE WHEN s = 'rejected' AND normalized_at < {NOW} - INTERVAL 1 DAY THEN 'rejected' WHEN s = 'gone' AND last_seen_at < {NOW} - INTERVAL 7 DAY THEN 'gone' WHEN s = 'normalization_failed' AND detected_at < {NOW} - INTERVAL 7 DAY THEN 'failed' WHEN coalesce(published_at, detected_at) < {NOW} - INTERVAL 30 DAY THEN 'ancient' END AS rule FROM {AGED} y) z"
STEPS = [
    *[STEP(f"{s}_marked", f"{RULED} WHERE status = '{s}' AND was <> '{s}'") for s in ("stale", "gone")], *[STEP(f"delete_{r}", f"{RULED} WHERE rule = '{r}'") for r in ("rejected", "gone", "failed", "ancient")],
    STEP("tiers_changed", f"({ORACLE_SQL['ups7_recalc_tiers']}) t JOIN company c USING (id) WHERE t.new_tier IS DISTINCT FROM c.tier"), STEP("companies_revived", f"({ORACLE_SQL['ups11_revive']}) t WHERE revived"),
    STEP("delete_matches", f"({ORACLE_SQL['ups14_expired_matches']}) t"), *[STEP(n, sql) for n, sql in EXPIRED.items()], *[STEP(n, f"(SELECT * FROM {RULED} WHERE rule IS NULL) k WHERE {hit}") for n, hit in FIX.items()],
]
query("pip5_nightly_steps", " UNION ALL ".join(STEPS), lambda v: jobs.nightly_steps(v.job, v.match_queue, long_ago(v), v.ingestion_log, v.slugger_retry, AS_OF))
query("pip4_provisional_normalize", f"SELECT o.id, CASE WHEN length(o.normalized_text) >= 100 THEN x.scope ELSE 'undetermined' END AS scope FROM ({CASCADE}) x JOIN job o ON o.id = x.id WHERE o.normalized_at IS NULL", lambda v: jobs.provisional_normalize(v.job).select("id", "scope"))
CERTS = "CASE WHEN c_custkey % 3 = 0 THEN concat('co', c_custkey % 97, '.lever.co\nwww.lever.co') ELSE concat('X', c_custkey % 53, '.greenhouse.io') END AS name_value"
URLS = "CASE WHEN c_custkey % 2 = 0 THEN concat('https://jobs.lever.co/Co', c_custkey % 120, '/abc') ELSE 'https://example.com/a' END AS original"
query(
    "pip6_discover_companies",
    """SELECT ats AS ats_source, slug AS ats_slug, count(*) AS n_sources FROM (SELECT DISTINCT 'lever' AS ats, concat('co', CAST(c_custkey % 97 AS VARCHAR)) AS slug, 0 AS s FROM customer WHERE c_custkey % 3 = 0 UNION SELECT DISTINCT 'greenhouse', concat('x', CAST(c_custkey % 53 AS VARCHAR)), 0 FROM customer WHERE c_custkey % 3 <> 0
      UNION SELECT DISTINCT 'lever', concat('co', CAST(c_custkey % 120 AS VARCHAR)), 1 FROM customer WHERE c_custkey % 2 = 0) f WHERE (length(slug) > 2 OR regexp_matches(slug, '[aeiou]')) AND NOT EXISTS (SELECT 1 FROM company c WHERE c.ats_source = f.ats AND c.ats_slug = f.slug) GROUP BY 1, 2""",
    lambda v: (lambda c: jobs.discover_companies([dis.scan_certificates(c.selectExpr(CERTS)), dis.scan_url_archive(c.selectExpr(URLS))], v.company))(v.spark.read.parquet(f"{v.sf_dir}/customer.parquet")),
)
