"""Distributions without a buffer of their values: counts by bin, which merge, and sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a bin of distances: a percentile read from bins is below the true one by less than this.
WIDTH = 1e-4
PERCENTILES = (10, 25, 50, 75, 90)


def percentiles(df: DataFrame, value: str, keys: list[str], width: float = WIDTH, of: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys, n, p10, ...): the value that floor(p / 100 * n) others stand before (the last one at most), or less by less
    than ``width``: the lower edge of its bin.

    Bins are counted before the shuffle; a key has as many rows as bins that occur, whatever its number of values."""
    bins = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    ranked = bins.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("n", F.sum("c").over(w))
    edge = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("n") / 100), F.col("n") - 1), F.col("bin")))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.round(edge(p) * width, 9).alias(f"p{p}") for p in of])


def sketched_percentiles(df: DataFrame, value: str, keys: list[str], k: int = 200, of: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys, p10, ...) from a KLL sketch of each key, for values without known bounds: of a few KB however many they are,
    merged across tasks; ranks are within about 1.65 % at k = 200, not the same in each run."""
    s = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("s"))
    return s.select(*keys, *[F.kll_sketch_get_quantile_double("s", F.lit(p / 100)).alias(f"p{p}") for p in of])


def moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    c = F.col(value)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("sd"), F.round(F.min(c), 6).alias("lo"), F.round(F.max(c), 6).alias("hi"))


def histograms(df: DataFrame, values: list[str], bins: int = 10) -> DataFrame:
    """(measure, bin, lo, hi, n): ``bins`` of equal width from the least to the greatest of each measure, the last closed;
    bins without values have rows, measures without values none. Two scans: one for the bounds, one for the counts."""
    bounds = df.agg(*[f(F.col(v).cast("double")).alias(f"{v}_{n}") for v in values for n, f in (("lo", F.min), ("hi", F.max))])
    ends = bounds.select(F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(f"{v}_lo").alias("least"), F.col(f"{v}_hi").alias("most")) for v in values])).alias("e")).select("e.*").filter("least IS NOT NULL")
    step = F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) / bins).otherwise(1.0)
    ends = ends.withColumn("step", step)
    # equal values are counted first, then given their bin: what meets the bounds is a row for each distinct value
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])).alias("r")).select("r.*")
    counted = rows.filter("x IS NOT NULL").groupBy("measure", "x").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(ends), "measure")  # a row for each measure
    at = F.least(F.floor((F.col("x") - F.col("least")) / F.col("step")), F.lit(bins - 1)).cast("int")
    filled = counted.groupBy("measure", at.alias("bin")).agg(F.sum("c").alias("n"))
    grid = ends.select("measure", "least", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.col("least") + F.col("bin") * F.col("step")
    return grid.join(filled, ["measure", "bin"], "left").select("measure", "bin", F.round(lo, 6).alias("lo"), F.round(lo + F.col("step"), 6).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def candidates_per_job(jobs: DataFrame, matches: DataFrame, cap: int = 8) -> DataFrame:
    """One row: number of candidates of the postings given (none counts as 0): mean, deviation, least, most, quartiles, and
    how many postings have none or ``cap`` and more."""
    n = matches.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    c = jobs.select("id").join(n, "id", "left").select(F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    stats = moments(c, "c", []).crossJoin(percentiles(c, "c", [], 1.0, (25, 50, 75)).drop("n"))  # one row each
    return stats.crossJoin(c.agg(F.count_if(F.col("c") == 0).alias("without"), F.count_if(F.col("c") >= cap).alias("capped")))


def bottom_k(df: DataFrame, stratum: str, key: str, k: int, seed: str) -> DataFrame:
    """The ``k`` rows of each stratum whose keys have the smallest MD5 after ``seed``: the same on any partitioning, and
    cut to ``k`` rows a stratum in each task before they are shuffled."""
    w = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the score interval of a share."""
    p = hits / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.round(centre - spread, 6), F.round(centre + spread, 6)


def rejected_by_gate(matches: DataFrame, gates: list[str], as_of: str, days: int = 7) -> DataFrame:
    """(stratum, id, job_id): rejected matches of the last days whose blockers name a gate; one for each gate that they name."""
    recent = matches.filter((F.col("status") == "rejected") & (F.col("evaluated_at") > F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")) & (F.col("evaluated_at") <= F.lit(as_of).cast("timestamp")))
    text = F.array_join("llm_blockers", " ")
    named = F.explode(F.filter(F.array(*map(F.lit, gates)), lambda g: F.contains(text, g)))
    return recent.select(named.alias("stratum"), "id", "job_id")


GENERIC_PLACES = ["Remote", "remote", "Anywhere", "anywhere", "Worldwide", "worldwide"]


def suspect_globals(jobs: DataFrame) -> DataFrame:
    """(stratum, id, job_id): active postings called global that name a place."""
    hit = (F.col("status") == "active") & (F.col("remote_scope") == "global") & F.col("location_name").isNotNull() & ~F.col("location_name").isin(GENERIC_PLACES)
    return jobs.filter(hit).select(F.lit("global").alias("stratum"), "id", F.col("id").alias("job_id"))


def audit(samples: DataFrame, labels: DataFrame, warn_above: float) -> DataFrame:
    """(stratum, sampled, labelled, wrong, rate, low, high, warn) of samples (stratum, job_id) and labels (job_id, wrong):
    the share of wrong ones among those with a label, with its 95 % interval."""
    n = samples.join(labels.select("job_id", "wrong"), "job_id", "left").groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"), F.count("wrong").alias("labelled"), F.count_if("wrong").alias("wrong"))
    low, high = wilson(F.col("wrong"), F.col("labelled"))
    some = F.col("labelled") > 0
    rate = F.when(some, F.col("wrong") / F.col("labelled")).otherwise(0.0)
    return n.select("stratum", "sampled", "labelled", "wrong", F.round(rate, 6).alias("rate"), F.when(some, low).alias("low"), F.when(some, high).alias("high"), (rate > warn_above).alias("warn"))
