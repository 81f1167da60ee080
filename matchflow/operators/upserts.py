"""Lifecycle jobs: each makes the next version of a table from the current one, ready to be written to a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


TERMINAL = ["mismatch", "rejected", "applied", "approved"]
VERDICT_COLUMNS = ["evaluated_at", "llm_verdict", "llm_blockers", "llm_reasoning", "llm_confidence", "llm_model", "prompt_variant"]
POSTING_KEY = ["ats_source", "ats_slug", "external_job_id"]


def ago(as_of: str, interval: str) -> Column:
    return F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {interval}")


def upsert_postings(current: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Known postings take all incoming attributes (the raw payload only until they are normalised), come back to life and are
    seen now; new ones are active. ``change`` is new, updated or kept. ``incoming`` has one row a key."""
    own = [*POSTING_KEY, "status", "last_seen_at", "normalized_at", "change"]
    attributes = [c for c in incoming.columns if c not in own]
    others = [c for c in current.columns if c not in own + attributes]
    both = current.withColumn("_known", F.lit(1)).alias("c").join(incoming.withColumn("_came", F.lit(1)).alias("i"), POSTING_KEY, "full_outer")
    came, known, now = F.col("_came").isNotNull(), F.col("_known").isNotNull(), F.lit(as_of).cast("timestamp")
    done = F.col("c.normalized_at").isNotNull() if "normalized_at" in current.columns else F.lit(False)

    def next_value(c: str) -> Column:
        takes = came & ~done if c == "raw_json" else came
        return F.when(takes, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}") if c in current.columns else F.lit(None))

    status = F.when(came & (~known | F.col("c.status").isin("stale", "gone")), "active").otherwise(F.col("c.status"))
    change = F.when(~known, "new").when(came, "updated").otherwise("kept")
    return both.select(
        *POSTING_KEY, *[next_value(c).alias(c) for c in attributes], *[F.col(f"c.{c}") for c in others], *([F.col("c.normalized_at")] if "normalized_at" in current.columns else []),
        status.alias("status"), F.when(came, now).otherwise(F.col("c.last_seen_at")).alias("last_seen_at"), change.alias("change"),
    )


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and those incoming ones that aren't there yet; of equal keys the row that is smallest by its columns."""
    others = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*others)).alias("row")).select(*keys, "row.*") if others else incoming.distinct()
    fresh = one.select(*incoming.columns).join(current.select(*keys).distinct(), keys, "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def insert_companies(current: DataFrame, incoming: DataFrame, blacklist: list[str]) -> DataFrame:
    """What becomes of each incoming company: inserted, known, invalid or blacklisted; counters by group."""
    known = current.select("ats_slug", F.lit(True).alias("known")).distinct()
    j = incoming.join(known, "ats_slug", "left")
    result = (
        F.when(~F.col("ats_slug").rlike("^[a-z][a-z0-9-]{1,59}$"), "invalid")
        .when(F.lower("company_name").rlike("(" + "|".join(blacklist) + ")"), "blacklisted")
        .when(F.col("known"), "known")
        .otherwise("inserted")
    )
    return j.groupBy("discovery_source", result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def upsert_matches(current: DataFrame, routed: DataFrame) -> DataFrame:
    """Overlap and distance are always refreshed; decided matches keep status and verdict, others start over as pending without
    one, new ones are pending."""
    verdict = [c for c in VERDICT_COLUMNS if c in current.columns]
    c = current.select("job_id", "persona_id", F.col("status").alias("was"), F.col("overlap_score").alias("old_overlap"), F.col("cosine_distance").alias("old_distance"), *verdict)
    r = routed.select("job_id", "persona_id", F.col("overlap").alias("new_overlap"), F.col("cosine_distance").alias("new_distance"), F.lit(True).alias("came"))
    both = c.join(r, ["job_id", "persona_id"], "full_outer")
    came = F.coalesce("came", F.lit(False))
    stays = ~came | F.coalesce(F.col("was").isin(TERMINAL), F.lit(False))
    return both.select(
        "job_id", "persona_id", F.when(stays, F.coalesce("was", F.lit("pending"))).otherwise("pending").alias("status"), F.when(came, F.col("new_overlap")).otherwise(F.col("old_overlap")).alias("overlap"),
        F.when(came, F.col("new_distance")).otherwise(F.col("old_distance")).alias("cosine_distance"), *[F.when(stays, F.col(x)).alias(x) for x in verdict],
    )


def mark_stale(jobs: DataFrame, as_of: str) -> DataFrame:
    """Active ones unseen for 7 days or published over 60 days ago are stale; stale ones unseen for 30 days are gone."""
    s = F.when((F.col("status") == "active") & ((F.col("last_seen_at") < ago(as_of, "7 DAYS")) | (F.col("published_at") < ago(as_of, "60 DAYS"))), "stale").otherwise(F.col("status"))
    out = jobs.withColumn("status", s)
    return out.withColumn("status", F.when((F.col("status") == "stale") & (F.col("last_seen_at") < ago(as_of, "30 DAYS")), "gone").otherwise(F.col("status")))


def recalc_tiers(companies: DataFrame, jobs: DataFrame, matches: DataFrame, as_of: str) -> DataFrame:
    ok = matches.filter((F.col("status") == "approved") & (F.col("evaluated_at") > ago(as_of, "30 DAYS"))).select("job_id")
    hot = jobs.join(ok, F.col("id") == F.col("job_id"), "left_semi").select("ats_source", "ats_slug").distinct().withColumn("hot", F.lit(True))
    tier = (
        F.when(((F.col("health") == "dead") | (F.col("consecutive_failures") >= 3)) & F.col("last_polled_at").isNotNull(), "dead")
        .when(F.col("hot"), "active_hot")
        .when(F.col("discovered_at") > ago(as_of, "48 HOURS"), "active_hot")
        .when(F.col("last_job_posted_at") > ago(as_of, "14 DAYS"), "active")
        .when(F.col("last_polled_at").isNull(), "probation")
        .when(F.col("zero_yield_poll_count") < 3, "probation")
        .otherwise("dormant")
    )
    return companies.join(hot, ["ats_source", "ats_slug"], "left").withColumn("new_tier", F.when(F.col("polling_enabled"), tier).otherwise(F.col("tier"))).drop("hot")


def apply_quality_tiers(scored: DataFrame, as_of: str) -> DataFrame:
    """Promotion above 50 with over 3 approvals; demotion below 10 with over 20 decisions and an age of two days."""
    down = (F.col("quality") < 10) & (F.col("total") > 20) & (F.col("discovered_at") <= ago(as_of, "48 HOURS"))
    new = F.when((F.col("quality") > 50) & (F.col("approved") > 3), "active_hot").when(down, "dormant").otherwise(F.col("tier"))
    return scored.withColumn("new_tier", new)


def demote_layoffs(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """Hot, polled companies that a layoff names are active from now on. As many as are named may be laid off, so that they merge."""
    laid = hits.select("id").distinct().withColumn("laid", F.lit(True))
    down = F.col("laid") & (F.col("tier") == "active_hot") & F.col("polling_enabled")
    return companies.join(laid.hint("merge"), "id", "left").withColumn("new_tier", F.when(down, "active").otherwise(F.col("tier"))).drop("laid")


def failure_runs(log: DataFrame) -> DataFrame:
    """Consecutive failures at the end of each source's log: rows after its last success. A success resets."""
    last = log.groupBy("source").agg(F.max(F.when(F.col("status") != "failure", F.struct("created_at", "id"))).alias("ok"))
    after = log.join(last, "source").filter((F.col("status") == "failure") & (F.col("ok").isNull() | (F.struct("created_at", "id") > F.col("ok"))))
    return last.select("source").join(after.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("consecutive_failures"))


def day_of(column: str) -> Column:
    """The day of a timestamp; unknown ones come first."""
    return F.coalesce(F.to_date(column), F.to_date(F.lit("0001-01-01")))


def fold_source_results(log: DataFrame) -> DataFrame:
    """Health of each source from its log: 3 failures in a row degrade, 5 disable (and stay so).

    A source may hold most of the log, so that its days are folded apart, each to its runs of failures at either end and its
    longest one; then a source's days are merged in order, of which there are as many as the log has days."""
    w = W.partitionBy("source", "day").orderBy("created_at", "id")
    n = log.select("source", "status", "created_at", "id", day_of("created_at").alias("day")).withColumn("grp", F.sum(F.when(F.col("status") != "failure", 1).otherwise(0)).over(w))
    runs = n.groupBy("source", "day", "grp").agg(F.count_if(F.col("status") == "failure").alias("f"))
    days = runs.groupBy("source", "day").agg(
        F.coalesce(F.max(F.when(F.col("grp") == 0, F.col("f"))), F.lit(0)).alias("head"), F.max_by("f", "grp").alias("tail"), F.max("f").alias("top"), (F.max("grp") == 0).alias("whole")
    )
    merged = days.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("day", "head", "tail", "top", "whole"))).alias("days"))
    start = F.struct(F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("now"))
    step = lambda s, d: F.struct(F.greatest(s["longest"], d["top"], s["now"] + d["head"]).alias("longest"), F.when(d["whole"], s["now"] + d["head"]).otherwise(d["tail"]).alias("now"))
    out = merged.select("source", F.aggregate("days", start, step).alias("s")).select("source", "s.longest", F.col("s.now").alias("consecutive_failures"))
    status = F.when(F.col("longest") >= 5, "disabled").when(F.col("consecutive_failures") >= 3, "degraded").otherwise("healthy")
    return out.withColumn("health", status)


def revive_companies(companies: DataFrame, as_of: str) -> DataFrame:
    """Companies of dead health that have not been polled for a week are polled again: healthy, without failures."""
    back = F.coalesce((F.col("health") == "dead") & ~F.col("polling_enabled") & (F.col("last_polled_at") < ago(as_of, "7 DAYS")), F.lit(False))
    out = companies.withColumn("revived", back).withColumn("polling_enabled", F.col("polling_enabled") | F.col("revived"))
    return out.withColumn("health", F.when(F.col("revived"), "healthy").otherwise(F.col("health"))).withColumn("consecutive_failures", F.when(F.col("revived"), 0).otherwise(F.col("consecutive_failures")))


def recover_banned(health: DataFrame, as_of: str) -> DataFrame:
    back = (F.col("status") == "disabled") & (F.col("disabled_at") < ago(as_of, "24 HOURS"))
    return health.withColumn("new_status", F.when(back, "healthy").otherwise(F.col("status"))).withColumn("failures", F.when(back, 0).otherwise(F.col("consecutive_failures")))


def retention_plan(jobs: DataFrame, as_of: str) -> DataFrame:
    """``rule``: the first retention rule that would delete a posting; null keeps it."""
    rule = (
        F.when((F.col("status") == "rejected") & (F.col("normalized_at") < ago(as_of, "1 DAYS")), "rejected")
        .when((F.col("status") == "gone") & (F.col("last_seen_at") < ago(as_of, "7 DAYS")), "gone")
        .when((F.col("status") == "normalization_failed") & (F.col("detected_at") < ago(as_of, "7 DAYS")), "failed")
        .when(F.coalesce("published_at", "detected_at") < ago(as_of, "30 DAYS"), "ancient")
    )
    return jobs.withColumn("rule", rule)


def expired_matches(matches: DataFrame, as_of: str) -> DataFrame:
    return matches.filter(F.col("status").isin("approved", "rejected") & (F.col("created_at") < ago(as_of, "90 DAYS")))


def expired_logs(log: DataFrame, as_of: str) -> DataFrame:
    return log.filter(F.col("created_at") < ago(as_of, "30 DAYS"))


def exhausted_retries(retries: DataFrame, as_of: str) -> DataFrame:
    return retries.filter((F.col("next_retry_at") < ago(as_of, "30 DAYS")) & (F.col("retry_count") >= 3))


def purge_plan(jobs: DataFrame, matches: DataFrame, budget: int, active_share: float = 0.2) -> DataFrame:
    """At most ``budget`` postings to purge: failed, rejected, gone, stale, then active ones, oldest first; active ones
    are capped at a share of all active ones, and approved ones never go. Tiers are granted their part of the budget from the
    counts of the ones before; days of a tier are counted first, so that only days within the grant are ranked, each by itself."""
    tiers = ["normalization_failed", "rejected", "gone", "stale", "active"]
    tier = F.lit(None).cast("int")
    for i, t in enumerate(tiers):
        tier = F.when(F.col("status") == t, i).otherwise(tier)
    ok = matches.filter(F.col("status") == "approved").select(F.col("job_id").alias("id")).distinct()
    pool = jobs.select("id", "detected_at", day_of("detected_at").alias("day"), tier.alias("tier")).filter("tier IS NOT NULL").join(ok, "id", "left_anti")
    by_day = pool.groupBy("tier", "day").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_day.groupBy("tier").agg(F.sum("n").alias("n"))
    allowed = sizes.withColumn("n", F.when(F.col("tier") == 4, F.floor(F.col("n") * active_share)).otherwise(F.col("n")))
    before = allowed.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("tier").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # five rows
    grants = before.select("tier", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(budget) - F.col("before"))).alias("granted"))
    passed = by_day.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("tier").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    due = passed.join(grants, "tier").filter(F.col("earlier") < F.col("granted")).select("tier", "day", "earlier", "granted")
    place = F.row_number().over(W.partitionBy("tier", "day").orderBy("detected_at", "id")) + F.col("earlier")
    ranked = pool.join(due, ["tier", "day"]).withColumn("place", place.cast("int"))
    return ranked.filter(F.col("place") <= F.col("granted")).select("id", "tier", "place")


FIXES = ["global-scope-null-countries", "fenced-null-embedding", "is-fenced-consistency", "rejected-normalized-at"]


def reconcile(jobs: DataFrame, as_of: str) -> DataFrame:
    """The next version of ``jobs``: global postings without countries, fenced ones without a vector, flags that agree with
    the scope (unknown ones stay), rejected ones with a time; and ``fixes``, the rules that changed a row."""
    scope, fenced = F.col("remote_scope"), F.coalesce(F.col("remote_scope").isin("country_fenced", "region_fenced", "onsite"), F.lit(False))
    open_ = F.coalesce(~scope.isin("country_fenced", "region_fenced", "onsite"), F.lit(False))
    hits = [
        (scope == "global") & F.col("location_countries").isNotNull(),
        fenced & F.col("job_embedding").isNotNull(),
        (fenced & (F.col("is_fenced") == F.lit(False))) | (open_ & (F.col("is_fenced") == F.lit(True))),
        (F.col("status") == "rejected") & F.col("normalized_at").isNull(),
    ]
    staged = jobs.withColumn("fixes", F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in zip(FIXES, hits)])))
    fixed = lambda n: F.array_contains("fixes", FIXES[n])
    now = F.lit(as_of).cast(jobs.schema["normalized_at"].dataType)
    return staged.withColumns(
        {
            "location_countries": F.when(~fixed(0), F.col("location_countries")),
            "job_embedding": F.when(~fixed(1), F.col("job_embedding")),
            "is_fenced": F.when(fixed(2), ~F.col("is_fenced")).otherwise(F.col("is_fenced")),
            "normalized_at": F.when(fixed(3), now).otherwise(F.col("normalized_at")),
        }
    )


def reconciliation_log(reconciled: DataFrame) -> DataFrame:
    """(fix_name, status, n): of each rule, whether it was applied and to how many rows."""
    n = reconciled.agg(*[F.count_if(F.array_contains("fixes", f)).alias(f) for f in FIXES])
    rows = n.select(F.explode(F.array(*[F.struct(F.lit(f).alias("fix_name"), F.col(f"`{f}`").alias("n")) for f in FIXES])).alias("r")).select("r.*")
    return rows.select("fix_name", F.when(F.col("n") > 0, "applied").otherwise("already-ok").alias("status"), "n")


def backoff(retries: DataFrame, as_of: str) -> DataFrame:
    """One more try; the next in a week times two to the number of tries."""
    n = F.col("retry_count") + 1
    at = F.lit(as_of).cast("timestamp") + F.make_dt_interval((7 * F.pow(F.lit(2), n)).cast("int"))
    return retries.select("id", n.alias("retry_count"), at.alias("next_retry_at"))


def reset_persona_matches(matches: DataFrame, jobs: DataFrame, persona_ids: DataFrame) -> DataFrame:
    """Rejected matches of the given personas on active postings are pending again."""
    p = persona_ids.select(F.col("id").alias("persona_id")).distinct().withColumn("p", F.lit(True))
    j = jobs.filter(F.col("status") == "active").select(F.col("id").alias("job_id")).distinct().withColumn("j", F.lit(True))
    out = matches.join(p, "persona_id", "left").join(j, "job_id", "left")
    return out.select("id", F.when((F.col("status") == "rejected") & F.col("p") & F.col("j"), "pending").otherwise(F.col("status")).alias("status"))


def merge_alerts(current: DataFrame, fired: DataFrame) -> DataFrame:
    """Open a fired alert that isn't active, resolve an active one that no longer fires, keep the rest."""
    c = current.filter("is_active").select("type", "source").distinct().withColumn("was", F.lit(True))
    f = fired.select("type", "source").distinct().withColumn("fires", F.lit(True))
    both = c.join(f, ["type", "source"], "full_outer")
    return both.select("type", "source", F.when(F.col("was").isNull(), "open").when(F.col("fires").isNull(), "resolve").otherwise("keep").alias("action"))


def downgrade_stale_global(jobs: DataFrame) -> DataFrame:
    """Global postings at a specific place without global wording become fenced: by region, else by country."""
    place = F.lower(F.coalesce("location_name", F.lit("")))
    wrong = (F.col("remote_scope") == "global") & (place != "") & ~place.rlike("(remote|worldwide|anywhere|global)") & ~F.lower("normalized_text").rlike("(anywhere|worldwide)")
    scope = F.when(wrong & place.rlike("(emea|apac|namer|latam|europe)"), "region_fenced").when(wrong, "country_fenced").otherwise(F.col("remote_scope"))
    return jobs.withColumn("new_scope", scope)




def upsert_board_postings(current: DataFrame, incoming: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Fresh board postings over the known ones: the old embedding stays where the new row has none; fenced rows have none.
    ``current`` tells by ``embedded`` whether a row has a vector, or has ``job_embedding`` itself."""
    i = incoming.filter(F.col("published_at") >= ago(as_of, f"{days} DAYS")).select(*POSTING_KEY, F.col("title").alias("new_title"), F.col("remote_scope").alias("new_scope"), F.col("embedded").alias("new_embedded"))
    embedded = F.col("embedded") if "embedded" in current.columns else F.col("job_embedding").isNotNull()
    c = current.select(*POSTING_KEY, F.col("title").alias("old_title"), F.col("remote_scope").alias("old_scope"), embedded.alias("old_embedded"))
    both = c.join(i, POSTING_KEY, "full_outer")
    fenced = F.coalesce("new_scope", "old_scope").endswith("fenced")
    embedded = F.coalesce("new_embedded", F.lit(False)) | F.coalesce("old_embedded", F.lit(False))
    return both.select(*POSTING_KEY, F.coalesce("new_title", "old_title").alias("title"), F.when(fenced, False).otherwise(embedded).alias("embedded"))


def sweep_retry_flags(runs: DataFrame, as_of: str) -> DataFrame:
    """Runs in flight for more than ten minutes are cleared."""
    return runs.withColumn("cleared", (F.col("started_at") < ago(as_of, "10 MINUTES")) & F.col("finished_at").isNull())


def dismissal_overrides(actions: DataFrame, jobs: DataFrame, overrides: DataFrame) -> DataFrame:
    """New label overrides from dismissals (job_id, reason) whose reason stands for one, unless an active one is there."""
    types = {"location": "geo_fenced", "not_interested": "suppressed", "stack": "wrong_stack"}
    mapped = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("reason")]
    new = actions.select("job_id", mapped.alias("override_type")).filter("override_type IS NOT NULL").join(jobs.select(F.col("id").alias("job_id"), "ats_slug", "title"), "job_id")
    active = overrides.filter("revoked_at IS NULL").select("ats_slug", "title", "override_type").distinct()
    return new.select("ats_slug", "title", "override_type").distinct().join(active, ["ats_slug", "title", "override_type"], "left_anti")
