"""Queries over reports with levels, distributions, audits, the breaker and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.operators import breaker as brk
from matchflow.operators import calibration as cal
from matchflow.operators import levels as lev
from matchflow.operators import reports as rep
from matchflow.operators import vector_join as vec
from matchflow.plans.adapters import AS_OF, SOURCES
from matchflow.plans.queries import NOW, arr, query
from matchflow.plans.queries_more import RATE, WIN
from matchflow.sources.discovery import read_snapshots, write_snapshot
from matchflow.streaming import streams as st

rate = RATE.format

AGE = f"greatest(floor((epoch({NOW}) - epoch(published_at)) / 86400), 0)"
query(
    "agg4_staleness",
    f"""WITH l AS (SELECT ats_source, CASE WHEN {AGE} < 1 THEN '<1d' WHEN {AGE} <= 7 THEN '2-7d' WHEN {AGE} <= 30 THEN '8-30d' WHEN {AGE} <= 60 THEN '30-60d' ELSE '>60d' END AS bucket FROM job WHERE status = 'active' AND published_at IS NOT NULL),
    g AS (SELECT s.source, b.bucket FROM (SELECT DISTINCT ats_source AS source FROM job WHERE ats_source IS NOT NULL UNION ALL SELECT NULL) s, (SELECT unnest({arr(lev.AGES)}) AS bucket) b)
    SELECT g.source, g.bucket, count(l.bucket) AS n, CASE WHEN (SELECT count(*) FROM l WHERE g.source IS NULL OR l.ats_source = g.source) > 0 THEN round(count(l.bucket) / (SELECT count(*) FROM l WHERE g.source IS NULL OR l.ats_source = g.source)::DOUBLE, 6) ELSE 0 END AS share
    FROM g LEFT JOIN l ON l.bucket = g.bucket AND (g.source IS NULL OR l.ats_source = g.source) GROUP BY g.source, g.bucket""",
    lambda v: lev.staleness_levels(v.job, AS_OF),
)
LIVE = "status = 'active' AND remote_scope = 'global'"
YIELD = f"count({{0}}) AS jobs, count({{0}}) FILTER (WHERE status = 'active') AS active, count({{0}}) FILTER (WHERE {LIVE}) AS global_active, count({{0}}) FILTER (WHERE {LIVE} AND job_embedding IS NOT NULL) AS addressable, {rate(f'count({{0}}) FILTER (WHERE {LIVE})', 'count({0}) FILTER (WHERE status = ' + chr(39) + 'active' + chr(39) + ')')} AS global_rate".format
query(
    "agg20_rank_sources",
    f"""SELECT 'discovery' AS level, discovery_source AS source, count(DISTINCT c.id) AS companies, count(DISTINCT c.id) FILTER (WHERE tier <> 'dead') AS live_companies, {YIELD('j.id').replace('status', 'j.status')} FROM company c LEFT JOIN job j ON j.ats_source = c.ats_source AND j.ats_slug = c.ats_slug GROUP BY 2
    UNION ALL SELECT CASE WHEN ats_source IN {tuple(C.TRACKING_SYSTEMS)} THEN 'system' ELSE 'board' END, ats_source, count(DISTINCT ats_slug), NULL, {YIELD('id')} FROM job GROUP BY 1, 2""",
    lambda v: lev.source_yield(v.company, v.job),
)
LATE = "detected_at > TIMESTAMP '1995-06-01 00:00:00' - INTERVAL 7 DAY"
SCOPES = {"jobs": "true", "global": "remote_scope = 'global'", "fenced": "remote_scope = 'country_fenced'", "region_fenced": "remote_scope = 'region_fenced'", "onsite": "remote_scope = 'onsite'", "matchable": "remote_scope = 'global' AND is_fenced = false AND status = 'active' AND job_embedding IS NOT NULL"}
COUNTS = ", ".join(f'count(*) FILTER (WHERE {hit}{w}) AS "{n}{tail}"' for tail, w in (("", ""), ("_late", f" AND {LATE}")) for n, hit in SCOPES.items())
SHARES = ", ".join(rate(f"count(*) FILTER (WHERE {SCOPES[n]}{w})", f"count(*) FILTER (WHERE true{w})") + f" AS {name}{tail}" for tail, w in (("", ""), ("_late", f" AND {LATE}")) for n, name in (("fenced", "fence_pct"), ("global", "global_pct")))
query(
    "agg21_fence_rate",
    f"""WITH k AS (SELECT *, CASE WHEN ats_source IN {tuple(C.REMOTE_NATIVE_BOARDS)} THEN 'remote-native' ELSE 'ats-polled' END AS kind FROM (SELECT * REPLACE (CASE WHEN ats_source = 'himalayas' THEN 'himalayas_direct' ELSE ats_source END AS ats_source) FROM job) x)
    SELECT CASE grouping(ats_source, kind) WHEN 1 THEN 'source' WHEN 2 THEN 'kind' ELSE 'all' END AS level, coalesce(ats_source, kind) AS source, {COUNTS}, {SHARES} FROM k GROUP BY GROUPING SETS ((ats_source), (kind), ())""",
    lambda v: lev.fence_levels(v.job.withColumn("ats_source", F.when(F.col("ats_source") == "himalayas", "himalayas_direct").otherwise(F.col("ats_source"))), "1995-06-01 00:00:00"),
)
def ranks(value: str, width: str, of: tuple[int, ...], source: str, by: str = "") -> str:
    """DuckDB: percentiles from the sorted values, each as the lower edge of its bin."""
    key, over = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    at = ", ".join(f"round(max(CASE WHEN r = least(CAST(floor({p} * n / 100) AS BIGINT), n - 1) THEN floor(x / {width}) * {p and width} END), 9) AS p{p}" for p in of)
    return f"SELECT {key}max(n) AS n, {at} FROM (SELECT {key}{value} AS x, row_number() OVER ({over} ORDER BY {value}) - 1 AS r, count(*) OVER ({over}) AS n FROM {source} WHERE {value} IS NOT NULL) x" + (f" GROUP BY {by}" if by else "")


MOMENTS = "SELECT overlap_score, count(cosine_distance) AS n, round(avg(cosine_distance), 6) AS mean, round(stddev_pop(cosine_distance), 6) AS sd, round(min(cosine_distance), 6) AS lo, round(max(cosine_distance), 6) AS hi FROM match_queue GROUP BY 1"
query(
    "agg23_calibration",
    f"SELECT m.*, p.* EXCLUDE (overlap_score, n) FROM ({MOMENTS}) m LEFT JOIN ({ranks('cosine_distance', '1e-4::DOUBLE', cal.PERCENTILES, 'match_queue', 'overlap_score')}) p ON p.overlap_score = m.overlap_score",
    lambda v: cal.moments(v.match_queue, "cosine_distance", ["overlap_score"]).join(cal.percentiles(v.match_queue, "cosine_distance", ["overlap_score"]).drop("n"), "overlap_score", "left"),
)
HIST = """SELECT '{0}' AS measure, b.bin, round(lo + b.bin * step, 6) AS lo, round(lo + b.bin * step + step, 6) AS hi, coalesce(n, 0) AS n FROM (SELECT min({0})::DOUBLE AS lo, (max({0})::DOUBLE - min({0})::DOUBLE) / 10 AS step FROM match_queue) e, (SELECT unnest(range(0, 10))::INT AS bin) b
  LEFT JOIN (SELECT least(floor(({0}::DOUBLE - lo) / step), 9)::INT AS bin, count(*) AS n FROM match_queue, (SELECT min({0})::DOUBLE AS lo, (max({0})::DOUBLE - min({0})::DOUBLE) / 10 AS step FROM match_queue) e WHERE {0} IS NOT NULL GROUP BY 1) c ON c.bin = b.bin""".format
query("agg23_histograms", f"{HIST('cosine_distance')} UNION ALL {HIST('overlap_score')}", lambda v: cal.histograms(v.match_queue, ["cosine_distance", "overlap_score"]))
query(
    "agg23_candidates",
    f"""WITH c AS (SELECT j.id, count(m.id) AS c FROM job j LEFT JOIN match_queue m ON m.job_id = j.id GROUP BY 1), p AS ({ranks('c', '1', (25, 50, 75), 'c')})
    SELECT s.*, p25, p50, p75, z.without, z.capped FROM (SELECT count(c) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd, round(min(c), 6) AS lo, round(max(c), 6) AS hi FROM c) s, p, (SELECT count(*) FILTER (WHERE c = 0) AS without, count(*) FILTER (WHERE c >= 8) AS capped FROM c) z""",
    lambda v: cal.candidates_per_job(v.job, v.match_queue),
)

# --- audits: the first by hash of each stratum, held against the labels
AT, GATES = "TIMESTAMP '1995-06-01 00:00:00'", ["clearance", "Seniority", "stack"]
DRAW = "QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('s', CAST(id AS VARCHAR))), id) <= {0}".format
REJECTED = f"SELECT g AS stratum, m.id, m.job_id FROM match_queue m, (SELECT unnest({arr(GATES)}) AS g) g WHERE m.status = 'rejected' AND evaluated_at > {AT} - INTERVAL 7 DAY AND evaluated_at <= {AT} AND contains(array_to_string(llm_blockers, ' '), g)"
SUSPECT = f"SELECT 'global' AS stratum, id, id AS job_id FROM job WHERE status = 'active' AND remote_scope = 'global' AND location_name IS NOT NULL AND location_name NOT IN {tuple(cal.GENERIC_PLACES)}"
query("flt19_rejected_sample", f"SELECT * FROM ({REJECTED}) x {DRAW(30)}", lambda v: cal.bottom_k(cal.rejected_by_gate(v.match_queue, GATES, "1995-06-01 00:00:00"), "stratum", "id", 30, "s"))
WILSON = "round((w / l + 3.8416 / (2 * l) {0} 1.96 * sqrt(w / l * (1 - w / l) / l + 3.8416 / (4 * l * l))) / (1 + 3.8416 / l), 6)".format


def audited(samples: str, above: float) -> str:
    return f"""SELECT stratum, sampled, CAST(l AS BIGINT) AS labelled, CAST(w AS BIGINT) AS wrong, CASE WHEN l > 0 THEN round(w / l, 6) ELSE 0 END AS rate, CASE WHEN l > 0 THEN {WILSON('-')} END AS low, CASE WHEN l > 0 THEN {WILSON('+')} END AS high, CASE WHEN l > 0 THEN w / l ELSE 0 END > {above} AS warn
    FROM (SELECT stratum, count(*) AS sampled, count(a.wrong)::DOUBLE AS l, count(*) FILTER (WHERE a.wrong)::DOUBLE AS w FROM ({samples}) s LEFT JOIN audit_label a ON a.job_id = s.job_id GROUP BY 1) x"""


query("agg32_false_rejections", audited(f"SELECT * FROM ({REJECTED}) x {DRAW(30)}", 0.1), lambda v: cal.audit(cal.bottom_k(cal.rejected_by_gate(v.match_queue, GATES, "1995-06-01 00:00:00"), "stratum", "id", 30, "s"), v.audit_label, 0.1))
query("agg32_audit_rate", audited(f"SELECT * FROM ({SUSPECT}) x {DRAW(50)}", 0.2), lambda v: cal.audit(cal.bottom_k(cal.suspect_globals(v.job), "stratum", "id", 50, "s"), v.audit_label, 0.2))

# --- the breaker: some postings wait, most of them at one source
WAITING = {"status": "CASE WHEN status IN ('rejected', 'stale', 'gone', 'normalization_failed') THEN 'provisional' ELSE status END", "ats_source": "CASE WHEN status IN ('rejected', 'stale', 'gone') THEN 'greenhouse' WHEN status = 'normalization_failed' THEN 'lever' ELSE ats_source END"}
HEALTH = f"SELECT {arr(SOURCES)}[CAST(total_failures AS INT) % 8 + 1] AS source, CASE WHEN total_failures = 6 THEN 'banned' ELSE status END AS status, consecutive_failures AS failures, total_failures % 5 AS escalations FROM source_health WHERE total_failures BETWEEN 1 AND 8"
VALUES = ", ".join(f"({', '.join('NULL' if x is None else repr(x) if isinstance(x, str) else str(x) for x in r)})" for r in C.BREAKER_RULES)
BROKEN = f"""h AS ({HEALTH}), j AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WAITING.items())}, remote_scope, detected_at FROM job),
    c AS (SELECT count(*) FILTER (WHERE remote_scope = 'global')::DOUBLE AS g, count(*) FILTER (WHERE remote_scope = 'country_fenced')::DOUBLE AS f, count(*) FILTER (WHERE remote_scope IN ('unknown', 'undetermined'))::DOUBLE AS u, count(*) FILTER (WHERE status = 'provisional')::DOUBLE AS p FROM j WHERE status IN ('active', 'provisional')),
    b AS (SELECT ats_source AS source, count(*) AS w FROM j WHERE status = 'provisional' AND detected_at < {NOW} - INTERVAL 1 HOUR GROUP BY 1),
    m AS (SELECT source, unnest(['failures_first', 'failures_again', 'escalations', 'backlog']) AS metric, unnest([CASE WHEN escalations = 0 THEN failures END, CASE WHEN escalations > 0 THEN failures END, escalations, coalesce(w, 0) / nullif(g + f + u + p, 0)]::DOUBLE[]) AS value FROM h LEFT JOIN b USING (source), c WHERE status <> 'banned'
      UNION ALL SELECT NULL, unnest(['known_ratio', 'unknown_share']), unnest([g / nullif(g + f, 0), u / nullif(g + f + u, 0)]) FROM c),
    r(metric, low, low_open, high, high_open, tier, action, severity) AS (VALUES {VALUES}),
    broken AS (SELECT source, tier, action, severity, m.metric, value FROM m JOIN r ON r.metric = m.metric AND value IS NOT NULL AND (low IS NULL OR value > low OR (NOT low_open AND value = low)) AND (high IS NULL OR value < high OR (NOT high_open AND value = high)))"""


def broken(v):  # noqa: ANN001, ANN201
    jobs = v.job.select(*[F.expr(e).alias(c) for c, e in WAITING.items()], "remote_scope", "detected_at")
    places = ", ".join(f"'{s}'" for s in SOURCES)
    health = v.source_health.filter("total_failures BETWEEN 1 AND 8").selectExpr(f"element_at(array({places}), CAST(total_failures AS INT) % 8 + 1) AS source", "CASE WHEN total_failures = 6 THEN 'banned' ELSE status END AS status", "consecutive_failures AS failures", "total_failures % 5 AS escalations")
    metrics = brk.source_metrics(health, jobs, AS_OF).unionByName(brk.corpus_metrics(jobs))
    return brk.broken_rules(metrics, brk.rules(v.spark))


query("agg29_broken_rules", f"WITH {BROKEN} SELECT source, tier, action, severity, metric, round(value, 9) AS value FROM broken", lambda v: broken(v).withColumn("value", F.round("value", 9)))
query("agg29_breaker", f"WITH {BROKEN} SELECT source, CASE WHEN bool_or(severity = 'hard_pause') THEN 'hard_pause' ELSE 'rate_reduction' END AS severity, string_agg(DISTINCT CAST(tier AS VARCHAR), ',' ORDER BY CAST(tier AS VARCHAR)) AS tiers FROM broken GROUP BY 1", lambda v: brk.dominant(broken(v)).select("source", "severity", F.array_join("tiers", ",").alias("tiers")))


# --- snapshots: the same day written twice is one row
def snapshots(v):  # noqa: ANN001, ANN201
    at = f"{st.work_folder(v.spark)}/snapshots"
    for day in ("1997-12-30", "1997-12-31", "1997-12-30", "1997-12-30"):
        write_snapshot(rep.north_star(v.job, v.match_queue, f"{day} 00:00:00").withColumn("snapshot_date", F.lit(day).cast("date")), at)
    return read_snapshots(v.spark, at)


STAR = "SELECT {1} AS snapshot_date, * FROM (SELECT count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE {0}) AS new_1d, count(*) FILTER (WHERE remote_scope = 'global' AND status = 'active') AS global_active FROM job) j, (SELECT count(*) FILTER (WHERE status = 'approved' AND {2}) AS approved_7d, count(*) FILTER (WHERE status = 'pending') AS waiting, count(DISTINCT applicant_id) AS applicants FROM match_queue) m"
query("src18_snapshots", " UNION ALL ".join(STAR.format(WIN("detected_at", 1).replace(NOW, f"TIMESTAMP '{d} 00:00:00'"), f"DATE '{d}'", WIN("evaluated_at", 7).replace(NOW, f"TIMESTAMP '{d} 00:00:00'")) for d in ("1997-12-30", "1997-12-31")), snapshots)

# --- all postings and personas whose vectors are close, whatever their tags
CLOSE = "SELECT j.id AS left_id, p.id AS right_id, round(d, 6) AS distance FROM (SELECT a.v AS a, b.v AS b, 1 - list_cosine_similarity(a.v, b.v) AS d FROM (SELECT DISTINCT job_embedding::DOUBLE[] AS v FROM job WHERE job_embedding IS NOT NULL) a, (SELECT DISTINCT persona_embedding::DOUBLE[] AS v FROM persona WHERE persona_embedding IS NOT NULL) b) x JOIN job j ON j.job_embedding::DOUBLE[] = x.a JOIN persona p ON p.persona_embedding::DOUBLE[] = x.b WHERE d < 0.55"
query("joi2_vector_join", CLOSE, lambda v: vec.vector_join(v.job, v.persona, C.GATE_DISTANCE, st.stored, ("id", "job_embedding"), ("id", "persona_embedding"), digits=6)[0])
