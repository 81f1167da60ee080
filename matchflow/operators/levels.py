"""Reports at several levels from one scan: sources, kinds of sources and the whole, now and lately."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X

AGES = {"<1d": (None, 0), "2-7d": (1, 7), "8-30d": (8, 30), "30-60d": (31, 60), ">60d": (61, None)}


def age_in_days(when: Column, as_of: str) -> Column:
    """Whole days of 24 hours from ``when`` to ``as_of``; 0 for less than one, and for times to come."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(when.cast("timestamp"))
    return F.greatest(F.floor(seconds / 86400), F.lit(0))


def staleness_levels(jobs: DataFrame, as_of: str) -> DataFrame:
    """(source, bucket, n, share): active, dated postings by age, of each source that ever had a posting, and of all (null).

    Buckets are columns of one aggregation over two grouping sets, so that sources and buckets without postings have rows."""
    days = age_in_days(F.col("published_at"), as_of)
    live = (F.col("status") == "active") & F.col("published_at").isNotNull()
    within = lambda lo, hi: (F.lit(True) if lo is None else days >= lo) & (F.lit(True) if hi is None else days <= hi)
    n = [F.count_if(live & within(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(AGES.values())]
    wide = jobs.groupingSets([[F.col("ats_source")], []], F.col("ats_source")).agg(F.grouping_id().alias("level"), F.count_if(live).alias("total"), *n)
    wide = wide.filter((F.col("level") == 1) | F.col("ats_source").isNotNull())
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{i}").alias("n")) for i, b in enumerate(AGES)])).alias("r")
    share = F.when(F.col("total") > 0, F.round(F.col("r.n") / F.col("total"), 6)).otherwise(0.0)
    return wide.select("ats_source", "total", rows).select(F.col("ats_source").alias("source"), "r.bucket", "r.n", share.alias("share"))


def _global(status: bool = True) -> Column:
    hit = F.col("remote_scope") == "global"
    return hit & (F.col("status") == "active") if status else hit


def source_yield(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """(level, source, companies, live_companies, jobs, active, global_active, addressable, global_rate): yield of each
    discovery source, tracking system and board. Postings are counted once by company, and the levels add those up."""
    counts = {
        "jobs": F.count(F.lit(1)),
        "active": F.count_if(F.col("status") == "active"),
        "global_active": F.count_if(_global()),
        "addressable": F.count_if(_global() & F.col("job_embedding").isNotNull()),
    }
    by_company = jobs.groupBy("ats_source", "ats_slug").agg(*[c.alias(n) for n, c in counts.items()])
    sums = [F.sum(n).alias(n) for n in counts]
    found = companies.filter("discovery_source IS NOT NULL").join(by_company, ["ats_source", "ats_slug"], "left").fillna(0, list(counts))
    found = found.groupBy(F.lit("discovery").alias("level"), F.col("discovery_source").alias("source")).agg(F.countDistinct("id").alias("companies"), F.count_distinct(F.when(F.col("tier") != "dead", F.col("id"))).alias("live_companies"), *sums)
    level = F.when(F.col("ats_source").isin(C.TRACKING_SYSTEMS), "system").otherwise("board")
    none = F.lit(None).cast("long")
    own = by_company.groupBy(level.alias("level"), F.col("ats_source").alias("source")).agg(F.count("ats_slug").alias("companies"), none.alias("live_companies"), *sums)
    return found.unionByName(own).withColumn("global_rate", X.rate(F.col("global_active"), F.col("active")))


def fence_levels(jobs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(level, source, and for all time and the last days: jobs, global, fenced, region_fenced, onsite, matchable,
    fence_pct, global_pct) for each source, remote-native boards against polled systems, and the whole: one scan."""
    scope = F.col("remote_scope")
    wanted = {
        "jobs": F.lit(True),
        "global": scope == "global",
        "fenced": scope == "country_fenced",
        "region_fenced": scope == "region_fenced",
        "onsite": scope == "onsite",
        "matchable": _global() & ~F.coalesce("is_fenced", F.lit(True)) & F.col("job_embedding").isNotNull(),
    }
    late = F.col("detected_at") > F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")
    counts = [F.count_if(hit & w).alias(n + tail) for tail, w in (("", F.lit(True)), ("_late", late)) for n, hit in wanted.items()]
    kind = F.when(F.col("ats_source").isin(C.REMOTE_NATIVE_BOARDS), "remote-native").otherwise("ats-polled")
    j = jobs.withColumn("kind", kind)
    out = j.groupingSets([[F.col("ats_source")], [F.col("kind")], []], F.col("ats_source"), F.col("kind")).agg(F.grouping_id().alias("g"), *counts)
    level = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "kind").otherwise("all")
    rates = [X.rate(F.col(n + tail), F.col("jobs" + tail)).alias(name + tail) for tail in ("", "_late") for n, name in (("fenced", "fence_pct"), ("global", "global_pct"))]
    return out.select(level.alias("level"), F.coalesce("ats_source", "kind").alias("source"), *[n + tail for tail in ("", "_late") for n in wanted], *rates)
