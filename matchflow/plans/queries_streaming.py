"""Streams run to the end of landed files that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.plans.queries import ORACLE_SQL, query, route_sql
from matchflow.plans.queries_more import POLL_STATES
from matchflow.streaming import streams as st


def landed(df: DataFrame, parts: int) -> DataFrame:
    """``df`` written as files of a landing folder and opened as a stream, in half as many batches as ``parts``; a batch has a
    file for each core, two at least."""
    at = st.work_folder(df.sparkSession)
    files = max(2, df.sparkSession.sparkContext.defaultParallelism)
    df.repartition(parts // 2 * files).write.parquet(f"{at}/landing")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/landing")


def in_order(df: DataFrame, by: str, cuts: int, files: int = 2, late: DataFrame | None = None) -> DataFrame:
    """``df`` landed in the order of a timestamp, a span of it a batch, each as ``files`` files of as many tasks; then
    ``late`` as a last batch."""
    at = st.work_folder(df.sparkSession)
    n = F.unix_timestamp(by)
    low, high = df.agg(F.min(n), F.max(n)).first()
    parts = [df.filter(F.least(F.lit(cuts - 1), F.floor((n - low) * cuts / max(1, high - low))) == i) for i in range(cuts)]
    for part in [*parts, *([late] if late is not None else [])]:
        part.repartition(files).write.mode("append").parquet(f"{at}/landing")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/landing")


def career_domains(v) -> DataFrame:
    c = v.spark.read.parquet(f"{v.sf_dir}/customer.parquet")
    message = "to_json(named_struct('message_type', CASE WHEN c_custkey % 5 = 0 THEN 'heartbeat' ELSE 'certificate_update' END, 'data', named_struct('leaf_cert', named_struct('all_domains', array(concat('Careers.acme', c_custkey % 90, '.com'), 'www.x.com')))))"
    m = c.selectExpr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey % 60) AS ts", f"{message} AS value")
    dns = c.selectExpr("concat('careers.acme', c_custkey % 90, '.com') AS name", "CASE WHEN c_custkey % 90 % 2 = 0 THEN 'jobs.lever.co' ELSE 'x.example.com' END AS value").distinct()
    return st.drain(st.stream_career_domains(landed(m, 6), dns))


query("str1_career_domains", "SELECT DISTINCT concat('careers.acme', CAST(c_custkey % 90 AS VARCHAR), '.com') AS domain, 'lever' AS ats, concat('acme', CAST(c_custkey % 90 AS VARCHAR)) AS company FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 90 % 2 = 0", career_domains)


def ingest(v) -> DataFrame:
    at = st.work_folder(v.spark)
    jobs = v.job.select("id", "title", "location_name", "normalized_text", "extracted_tags", "ats_source", "source_status", "is_natsec", "is_qa")
    st.stream_ingest(landed(jobs, 6), lambda df, n: st.put(df.select("id"), f"{at}/jobs", n), lambda df, n: st.put(df, f"{at}/log", n), at)
    log = v.spark.read.parquet(f"{at}/log").agg(F.sum("processed").alias("processed"), F.sum("inserted").alias("inserted"), F.sum("off_title").alias("off_title"))
    return log.crossJoin(v.spark.read.parquet(f"{at}/jobs").agg(F.countDistinct("id").alias("stored")))  # one row each


def _inner(name: str) -> str:
    """A query's own SELECT, without the views before it, for use inside another one."""
    return f"({ORACLE_SQL[name]})"


query("str2_stream_ingest", None, ingest)
ORACLE_SQL["str2_stream_ingest"] = (
    f"SELECT count(*) AS processed, count(*) FILTER (WHERE kept) AS inserted, count(*) FILTER (WHERE NOT eng) AS off_title, count(*) FILTER (WHERE kept) AS stored FROM "
    f"(SELECT a.id, e.id IS NOT NULL AS eng, e.id IS NOT NULL AND f.fence IS NULL AND NOT n.natsec AND NOT q.qa AND a.active AS kept FROM {_inner('flt9_is_active')} a LEFT JOIN {_inner('flt1_engineering_titles')} e ON e.id = a.id "
    f"JOIN {_inner('flt3_country_fence')} f ON f.id = a.id JOIN {_inner('flt5_natsec_flag')} n ON n.id = a.id JOIN {_inner('flt6_qa_flag')} q ON q.id = a.id) x"
)


query("str3_source_health", None, lambda v: st.stream_source_health(in_order(v.ingestion_log.select("source", "created_at", "id", "status").filter("created_at IS NOT NULL"), "created_at", 3)))
ORACLE_SQL["str3_source_health"] = ORACLE_SQL["ups12_source_health_fold"]
query("str3_company_health", POLL_STATES.format(start="0") + " SELECT id AS key, consecutive_failures, health, stays_enabled, last_polled_at, last_error, last_job_posted_at, active_job_count FROM state", lambda v: st.stream_company_health(in_order(v.company_poll, "polled_at", 3)))

LOG = lambda v: v.ingestion_log.select(F.col("created_at").cast("timestamp").alias("created_at"), "source", "status", "id")
ENDED = "(SELECT max(created_at) FROM ingestion_log) - INTERVAL 1 HOUR"
query(
    "str4_run_counters",
    f"SELECT date_trunc('hour', created_at) AS start, source, count(*) AS runs, count(*) FILTER (WHERE status = 'failure') AS failed FROM ingestion_log WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= {ENDED} GROUP BY 1, 2",
    lambda v: st.drain(st.stream_run_counters(in_order(LOG(v), "created_at", 3))),
)
for name, width, slide in (("24h", "24 hours", "1 hour"), ("7d", "7 days", "1 day")):
    unit, n = slide.split()[1], int(width.split()[0])
    query(
        f"str4_rolling_{name}",
        f"""WITH p AS (SELECT source, date_trunc('{unit}', created_at) AS h, count(*) AS n, count(*) FILTER (WHERE status = 'failure') AS f FROM ingestion_log GROUP BY 1, 2),
        w AS (SELECT source, unnest(generate_series(h + INTERVAL 1 {unit}, h + INTERVAL {n} {unit}, INTERVAL 1 {unit})) AS w_end, n, f FROM p)
        SELECT w_end AS "end", source, sum(n)::BIGINT AS runs, sum(f)::BIGINT AS failed FROM w WHERE w_end <= {ENDED} GROUP BY 1, 2""",
        lambda v, width=width, slide=slide: st.drain(st.stream_rolling_counters(in_order(LOG(v), "created_at", 2), width, slide)),
    )
# every 20th run comes after all others, in the third batch: late, unless its hour was open when the second batch began
query(
    "str4_late_runs",
    """WITH l AS (SELECT created_at, floor(epoch(created_at)) AS s, id % 20 = 0 AS after FROM ingestion_log), b AS (SELECT min(s) AS low, max(s) AS high FROM l WHERE NOT after),
    m AS (SELECT max(created_at) - INTERVAL 1 HOUR AS passed FROM l, b WHERE NOT after AND (s - low) * 2 < greatest(1, high - low)), e AS (SELECT max(created_at) - INTERVAL 1 HOUR AS passed FROM l),
    x AS (SELECT date_trunc('hour', created_at) + INTERVAL 1 HOUR AS h, after FROM l)
    SELECT count(*) AS seen, count(*) FILTER (WHERE h <= e.passed AND NOT (after AND h <= m.passed)) AS closed, count(*) FILTER (WHERE h > e.passed) AS open, count(*) FILTER (WHERE after AND h <= m.passed) AS late FROM x, m, e""",
    lambda v: st.stream_late_runs(in_order(LOG(v).filter("id % 20 <> 0"), "created_at", 2, late=LOG(v).filter("id % 20 = 0"))),
)
query("str5_stream_match", f"WITH {route_sql(False)} SELECT job_id, persona_id, rank FROM routed", lambda v: st.stream_match(landed(v.job, 6), v.persona, st.work_folder(v.spark)).select("job_id", "persona_id", "rank"))
