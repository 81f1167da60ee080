"""Reports: conditional aggregations, one scan each, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X


def since(column: str, as_of: str, days: int) -> Column:
    return (F.col(column) >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")) & (F.col(column) <= F.lit(as_of).cast("timestamp"))


def ingestion_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Runs by outcome, item sums, mean duration and safe rates; over all, or by source or day."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ms = (micros("finished_at") - micros("started_at")) / 1000
    out = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failure").alias("failed"),
        F.sum("items_processed").alias("processed"),
        F.sum("items_inserted").alias("inserted"),
        F.sum("items_rejected").alias("rejected"),
        F.round(F.avg(ms), 3).alias("avg_ms"),
    )
    return out.withColumn("success_rate", X.rate(F.col("succeeded"), F.col("runs"))).withColumn("insert_rate", X.rate(F.col("inserted"), F.col("processed")))


def old_job_rate(log: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Sources where a counter inside the run's details is a large share of what was processed."""
    old = F.get_json_object("error_details", "$.k").cast("int")
    out = log.groupBy("source").agg(F.sum(old).alias("old"), F.sum("items_processed").alias("processed"))
    return out.withColumn("share", F.round(F.col("old") / F.col("processed"), 4)).filter((F.col("processed") > 0) & (F.col("old") / F.col("processed") >= threshold))


def rejection_categories(matches: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Blockers of matches rejected in the last days, by the first category whose pattern they hold."""
    category = F.lit("other")
    for name, pattern in reversed(C.BLOCKER_CATEGORIES.items()):
        category = F.when(F.col("b").rlike(f"(?is){pattern}"), name).otherwise(category)
    recent = matches.filter((F.col("status") == "rejected") & (F.col("evaluated_at") > F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")))
    return recent.select(F.explode("llm_blockers").alias("b")).groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def approval_rate_by(matches: DataFrame, key: str) -> DataFrame:
    out = matches.filter(F.col("status").isin("approved", "rejected")).groupBy(key).agg(
        F.count_if(F.col("status") == "approved").alias("approved"), F.count(F.lit(1)).alias("decided")
    )
    return out.withColumn("rate", X.rate(F.col("approved"), F.col("decided")))


def funnel(jobs: DataFrame, matches: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: how many postings were found, normalised, routed, approved and rejected in the window."""
    j = jobs.filter(since("detected_at", as_of, days)).agg(F.count(F.lit(1)).alias("detected"), F.count("normalized_at").alias("normalized"))
    m = matches.filter(since("created_at", as_of, days)).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )
    both = j.crossJoin(m)  # one row by one row
    return both.withColumn("rate", X.rate(F.col("approved"), F.col("approved") + F.col("rejected")))


def pass_rate_by(jobs: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    routed = matches.select("job_id").distinct()
    j = jobs.join(routed, F.col("id") == F.col("job_id"), "left")
    out = j.groupBy(key).agg(F.count(F.lit(1)).alias("jobs"), F.count("job_id").alias("routed"))
    return out.withColumn("rate", X.rate(F.col("routed"), F.col("jobs")))


def distribution(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def system_overview(jobs: DataFrame, companies: DataFrame, matches: DataFrame) -> DataFrame:
    j = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "active").alias("active_jobs"), F.count("job_embedding").alias("embedded"))
    c = companies.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("polling_enabled")).alias("polled"), F.count_if(F.col("tier") == "dead").alias("dead"))
    m = matches.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("status") == "pending").alias("pending"))
    return j.crossJoin(c).crossJoin(m)  # one row each


def target_stack_metric(jobs: DataFrame, tags: list[str], words: str) -> DataFrame:
    hit = F.arrays_overlap("extracted_tags", X.strings(tags)) | F.lower("title").rlike(words)
    return jobs.groupBy("remote_scope").agg(F.count_if(hit).alias("on_stack"), F.count(F.lit(1)).alias("jobs"))


def corpus_ratios(jobs: DataFrame) -> DataFrame:
    unknown = F.col("remote_scope") == "undetermined"
    return jobs.filter(F.col("status") == "active").agg(
        F.round(F.avg((~unknown).cast("double")), 6).alias("known_share"),
        F.round(F.avg(unknown.cast("double")), 6).alias("unknown_share"),
        F.round(F.avg(F.col("normalized_at").isNull().cast("double")), 6).alias("provisional_share"),
    )


def breaker_metrics(alerts: DataFrame) -> DataFrame:
    tried = F.col("auto_retry_attempted")
    return alerts.groupBy("type").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(tried).alias("tried"), F.count_if(tried & F.col("auto_retry_succeeded")).alias("succeeded"), F.count_if(F.col("is_active")).alias("active")
    )


def stage_counters(jobs: DataFrame, matches: DataFrame, as_of: str) -> DataFrame:
    """What each of the seven stages moved within the day before, and ``silent`` for those that moved nothing."""
    fresh = lambda c: F.col(c) > F.expr(f"TIMESTAMP '{as_of}' - INTERVAL 24 HOURS")
    flags = X.true_(F.col("is_fenced")) | X.true_(F.col("is_natsec")) | X.true_(F.col("is_qa"))
    j = jobs.agg(F.count_if(fresh("detected_at")).alias("ingested"), F.count_if(fresh("normalized_at")).alias("normalized"), F.count_if(fresh("normalized_at") & F.col("job_embedding").isNotNull()).alias("embedded"))
    m = matches.agg(F.count_if(fresh("created_at")).alias("routed"), F.count_if(fresh("evaluated_at")).alias("evaluated"), F.count_if(fresh("evaluated_at") & (F.col("status") == "approved")).alias("approved"))
    served = jobs.filter((F.col("remote_scope") == "global") & ~flags).select(F.col("id").alias("job_id"))
    d = matches.filter(fresh("created_at")).join(served, "job_id", "left_semi").agg(F.count(F.lit(1)).alias("dashboard"))
    row = j.crossJoin(m).crossJoin(d)  # one row each
    return row.unpivot([], row.columns, "stage", "n").withColumn("silent", F.col("n") == 0)


def stale_functions(log: DataFrame, expected: DataFrame, as_of: str) -> DataFrame:
    """Expected sources without a run for longer than their gap in hours, or ever."""
    last = log.groupBy("source").agg(F.max("created_at").alias("last_run"))
    gap = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_run")) / 3600
    return expected.join(last, "source", "left").filter(F.col("last_run").isNull() | (gap > F.col("max_gap_h")))


def trending_skills(jobs: DataFrame, n: int) -> DataFrame:
    t = jobs.filter(F.col("status") == "active").select(F.explode("extracted_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc("n"), "tag").limit(n)


def public_stats(jobs: DataFrame, as_of: str) -> DataFrame:
    a = jobs.filter(F.col("status") == "active")
    scope = F.col("remote_scope")
    return a.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(scope == "global").alias("global_jobs"),
        F.count_if(scope.isin("country_fenced", "region_fenced")).alias("fenced"),
        F.count_if(since("detected_at", as_of, 7)).alias("new_this_week"),
    )


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    h = X.text_hash(F.col("company_name"), F.col("title"), F.col("location_name"))
    out = jobs.groupBy(h.alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ats_slug").alias("slugs"), F.min("id").alias("first_id"))
    return out.filter("n > 1")


def threshold_sweep(matches: DataFrame, thresholds: list[float]) -> DataFrame:
    """How many matches and postings each distance threshold lets through."""
    t = F.array(*map(F.lit, thresholds))
    passed = matches.select("job_id", "cosine_distance", F.explode(t).alias("threshold")).filter(F.col("cosine_distance") < F.col("threshold"))
    return passed.groupBy("threshold").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("job_id").alias("jobs"))


def score_separation(matches: DataFrame) -> DataFrame:
    d = F.col("cosine_distance")
    return matches.filter(F.col("status").isin("approved", "rejected")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap_score"), 6).alias("overlap"), F.round(F.avg(d), 6).alias("distance"), F.round(F.min(d), 6).alias("lo"), F.round(F.max(d), 6).alias("hi")
    )


def mismatch_profile(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("status") == "mismatch").groupBy("applicant_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("persona_id").alias("personas"), F.countDistinct("job_id").alias("jobs"))


def phrase_lift(jobs: DataFrame, pattern: str) -> DataFrame:
    """Share of global postings among those with a phrase and among all, by source."""
    hit, good = F.col("normalized_text").rlike(pattern), F.col("remote_scope") == "global"
    return jobs.groupBy("ats_source").agg(
        F.round(F.avg(F.when(hit, good.cast("double"))), 6).alias("with_phrase"), F.round(F.avg(good.cast("double")), 6).alias("baseline"), F.count_if(hit).alias("hits")
    )


def active_job_counts(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    n = jobs.filter(F.col("status") == "active").groupBy("ats_source", "ats_slug").agg(F.count(F.lit(1)).alias("active_job_count"))
    return companies.select("id", "ats_source", "ats_slug").join(n, ["ats_source", "ats_slug"], "left").fillna(0, ["active_job_count"])


def north_star(jobs: DataFrame, matches: DataFrame, as_of: str) -> DataFrame:
    j = jobs.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(since("detected_at", as_of, 1)).alias("new_1d"), F.count_if((F.col("remote_scope") == "global") & (F.col("status") == "active")).alias("global_active"))
    m = matches.agg(F.count_if((F.col("status") == "approved") & since("evaluated_at", as_of, 7)).alias("approved_7d"), F.count_if(F.col("status") == "pending").alias("waiting"), F.countDistinct("applicant_id").alias("applicants"))
    return j.crossJoin(m)  # one row each


def match_counts(matches: DataFrame) -> DataFrame:
    ok = F.col("status") == "approved"
    return matches.groupBy("applicant_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(ok).alias("approved"), F.count_if(ok & ~F.col("is_read")).alias("unread"))


def gate_attrition(jobs: DataFrame) -> DataFrame:
    """What each exclusion rejects of the active pool, by itself and after those before it."""
    gates = {"fenced": X.true_(F.col("is_fenced")), "natsec": X.true_(F.col("is_natsec")), "qa": X.true_(F.col("is_qa")), "unembedded": F.col("job_embedding").isNull()}
    alone, left, aggs = F.lit(True), F.lit(True), []
    for name, hit in gates.items():
        aggs += [F.count_if(hit).alias(f"{name}_alone"), F.count_if(left & hit).alias(f"{name}_in_turn")]
        left = left & ~hit
    return jobs.filter((F.col("status") == "active") & (F.col("remote_scope") == "global")).agg(F.count(F.lit(1)).alias("pool"), *aggs, F.count_if(left & alone).alias("left_over"))


def reclassification_diff(jobs: DataFrame, new: Column) -> DataFrame:
    """Old against new class, as counts and shares of the old one."""
    n = jobs.groupBy("remote_scope", new.alias("new_scope")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("remote_scope").agg(F.sum("n").alias("total"))
    return n.join(total, "remote_scope").select("remote_scope", "new_scope", "n", X.rate(F.col("n"), F.col("total")).alias("pct"))
