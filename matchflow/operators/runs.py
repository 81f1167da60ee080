"""Runs of failures: a log is folded slice by slice, and slices are merged in order.

A slice of a key's log is kept as the failures at its head and tail, its longest run of them, and whether it has nothing
else; two slices merge to one of the same form. So a key that holds most of a log sends a row a slice, and its slices are
folded by as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST_DAY = "0001-01-01"


def fold_slices(runs: DataFrame, key: str, unit: str = "hour", detail: Column | None = None) -> DataFrame:
    """(key, slice, n, failed, head, tail, top, whole, last, last_good) of ``runs`` (key, at, id, bad): by hour, or another
    unit, of ``at``; unknown times come first. Within a slice runs stand in the order of ``at`` and ``id``.

    ``last`` and ``last_good`` are ``detail`` (a string) of the last run, and of the last that was not bad."""
    when = F.coalesce(F.date_trunc(unit, "at"), F.lit(FIRST_DAY).cast("timestamp"))
    place = F.struct(F.col("at").isNotNull().alias("known"), "at", "id")
    rows = runs.select(F.col(key).alias("key"), when.alias("slice"), place.alias("place"), F.coalesce("bad", F.lit(False)).alias("bad"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    stretch = F.count_if(~F.col("bad")).over(W.partitionBy("key", "slice").orderBy("place"))
    last = F.max(F.struct("place", "detail"))
    by_stretch = rows.withColumn("stretch", stretch).groupBy("key", "slice", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("f"), last.alias("last"), F.max(F.when(~F.col("bad"), F.struct("place", "detail"))).alias("good")
    )
    return by_stretch.groupBy("key", "slice").agg(
        F.sum("n").alias("n"),
        F.sum("f").alias("failed"),
        F.coalesce(F.max(F.when(F.col("stretch") == 0, F.col("f"))), F.lit(0).cast("long")).alias("head"),
        F.max_by("f", "stretch").alias("tail"),
        F.max("f").alias("top"),
        (F.max("stretch") == 0).alias("whole"),
        F.max("last")["detail"].alias("last"),
        F.max("good")["detail"].alias("last_good"),
    )


def merge_slices(slices: DataFrame, before: Column | None = None) -> DataFrame:
    """(key, runs, failed, consecutive_failures, longest, last, last_good) of folded slices, one row for each key.

    ``before`` is the run of failures that a key brings along (a column of ``slices``, the same in all of a key's)."""
    start = F.lit(0).cast("long") if before is None else F.coalesce(before, F.lit(0)).cast("long")
    # of each slice 8 small values: as many structs as a key has slices
    row = F.struct("slice", "head", "tail", "top", "whole")
    merged = slices.withColumn("_start", start).groupBy("key").agg(
        F.array_sort(F.collect_list(row)).alias("slices"), F.sum("n").alias("runs"), F.sum("failed").alias("failed"), F.max("_start").alias("start"),
        F.max_by("last", "slice").alias("last"), F.max_by("last_good", F.when(F.col("last_good").isNotNull(), F.col("slice"))).alias("last_good"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("longest"), F.col("start").alias("now"))

    def step(s: Column, x: Column) -> Column:
        through = F.when(x["head"] > 0, s["now"] + x["head"]).otherwise(F.lit(0).cast("long"))
        return F.struct(F.greatest(s["longest"], x["top"], through).alias("longest"), F.when(x["whole"], s["now"] + x["head"]).otherwise(x["tail"]).alias("now"))

    out = merged.withColumn("s", F.aggregate("slices", zero, step))
    return out.select("key", "runs", "failed", F.col("s.now").alias("consecutive_failures"), "s.longest", "last", "last_good")


#: What a poll of a company leaves behind; ``fold_slices`` carries it as JSON.
POLL = "polled_at timestamp, status_code int, valid boolean, newest timestamp, jobs int, error string"


def poll_detail() -> Column:
    return F.to_json(F.struct("polled_at", "status_code", "valid", "newest", "jobs", "error"))


def failed_poll() -> Column:
    """No answer, or one that is not a success. An answer of another form than expected is a success, degraded."""
    return F.coalesce(~F.col("status_code").between(200, 299), F.lit(True))


def health_of_code(code: Column) -> Column:
    """Health after a failed poll; without an answer there is no code."""
    return F.when(code == 429, "rate_limited").when(code == 403, "blocked").when(code == 404, "dead").otherwise("error")


def poll_states(folded: DataFrame, limit: int = 3) -> DataFrame:
    """Health and counters of each key of merged polls: ``limit`` failures in a row are death, which stops polling for
    good; a later success makes the company healthy, but does not start polling again."""
    d = folded.withColumn("l", F.from_json("last", POLL)).withColumn("g", F.from_json("last_good", POLL))
    failing = F.col("consecutive_failures") > 0
    health = (
        F.when(failing & (F.col("consecutive_failures") >= limit), "dead").when(failing, health_of_code(F.col("l.status_code"))).when(F.col("l.valid"), "healthy").otherwise("degraded")
    )
    return d.select(
        "key",
        "consecutive_failures",
        health.alias("health"),
        (F.col("longest") < limit).alias("stays_enabled"),
        F.col("l.polled_at").alias("last_polled_at"),
        F.when(failing, F.col("l.error")).alias("last_error"),
        F.coalesce("g.newest", "g.polled_at").alias("last_job_posted_at"),
        F.when(F.col("g.polled_at").isNotNull(), F.coalesce("g.jobs", F.lit(0))).alias("active_job_count"),
    )


def fold_company_polls(companies: DataFrame, polls: DataFrame, unit: str = "day") -> DataFrame:
    """Companies after their polls (company_id, id, polled_at, status_code, valid, newest, jobs, error): the next state of
    each, from its run of failures so far. Companies without polls stay as they are."""
    runs = polls.withColumns({"at": F.col("polled_at"), "bad": failed_poll()})
    slices = fold_slices(runs, "company_id", unit, poll_detail())
    known = companies.select(F.col("id").alias("key"), F.col("consecutive_failures").alias("before"))
    new = poll_states(merge_slices(slices.join(known, "key"), F.col("before")))
    new = new.select(F.col("key").alias("id"), *[F.col(c).alias(f"new_{c}") for c in new.columns[1:]], F.lit(True).alias("polled"))
    out = companies.join(new, "id", "left")
    kept = lambda c: F.coalesce(f"new_{c}", c)
    return out.select(
        "id",
        F.when(F.col("polled"), F.col("new_health")).otherwise(F.col("health")).alias("health"),
        kept("consecutive_failures").cast("long").alias("consecutive_failures"),
        (F.col("polling_enabled") & F.coalesce("new_stays_enabled", F.lit(True))).alias("polling_enabled"),
        kept("last_polled_at").alias("last_polled_at"),
        kept("last_job_posted_at").alias("last_job_posted_at"),
        F.col("new_active_job_count").alias("active_job_count"),
        F.col("new_last_error").alias("last_error"),
    )
