"""The ingestion breaker: metrics of sources and of the corpus held against a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import constants as C

SEVERITIES = ["normal", "rate_reduction", "hard_pause"]  # the later rules


def rules(spark: SparkSession) -> DataFrame:
    """(metric, low, low_open, high, high_open, tier, action, severity), as fixed in the constants."""
    kind = "metric string, low double, low_open boolean, high double, high_open boolean, tier int, action string, severity string"
    return spark.createDataFrame(C.BREAKER_RULES, kind)


def source_metrics(health: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """(source, metric, value) of each source that is not banned: failures in a row (before or after an escalation),
    escalations, and its provisional postings older than an hour as a share of the corpus."""
    old = (F.col("status") == "provisional") & (F.col("detected_at") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL 1 HOUR"))
    waiting = jobs.filter(old).groupBy(F.col("ats_source").alias("source")).agg(F.count(F.lit(1)).alias("waiting"))
    total = corpus_counts(jobs).select((F.col("global") + F.col("fenced") + F.col("unknown") + F.col("provisional")).alias("total"))
    s = health.filter(F.coalesce(F.col("status") != "banned", F.lit(True))).join(waiting, "source", "left").crossJoin(total)  # one row
    escalated = F.col("escalations") > 0
    values = {
        "failures_first": F.when(~escalated, F.col("failures")),
        "failures_again": F.when(escalated, F.col("failures")),
        "escalations": F.col("escalations"),
        "backlog": F.when(F.col("total") > 0, F.coalesce("waiting", F.lit(0)) / F.col("total")),
    }
    return _unpivoted(s, F.col("source"), values)


def corpus_counts(jobs: DataFrame) -> DataFrame:
    """One row of counts over active and provisional postings."""
    scope = F.col("remote_scope")
    return jobs.filter(F.col("status").isin("active", "provisional")).agg(
        F.count_if(scope == "global").alias("global"),
        F.count_if(scope == "country_fenced").alias("fenced"),
        F.count_if(scope.isin("unknown", "undetermined")).alias("unknown"),
        F.count_if(F.col("status") == "provisional").alias("provisional"),
    )


def corpus_metrics(jobs: DataFrame) -> DataFrame:
    """(source null, metric, value): the share of global ones among fenced and global postings, and of unknown ones."""
    c = corpus_counts(jobs)
    known = F.col("global") + F.col("fenced")
    values = {"known_ratio": F.when(known > 0, F.col("global") / known), "unknown_share": F.when(known + F.col("unknown") > 0, F.col("unknown") / (known + F.col("unknown")))}
    return _unpivoted(c, F.lit(None).cast("string"), values)


def _unpivoted(df: DataFrame, source, values: dict) -> DataFrame:  # noqa: ANN001
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]))
    return df.select(source.alias("source"), rows.alias("m")).select("source", "m.*").filter("value IS NOT NULL")


def broken_rules(metrics: DataFrame, table: DataFrame) -> DataFrame:
    """(source, tier, action, severity, metric, value) of each rule whose range holds its metric. A metric has few rules."""
    above = F.col("low").isNull() | (F.col("value") > F.col("low")) | (~F.col("low_open") & (F.col("value") == F.col("low")))
    below = F.col("high").isNull() | (F.col("value") < F.col("high")) | (~F.col("high_open") & (F.col("value") == F.col("high")))
    return metrics.join(table, "metric").filter(above & below).select("source", "tier", "action", "severity", "metric", "value")


def dominant(broken: DataFrame) -> DataFrame:
    """(source, severity, tiers): the worst severity of each source (null: the corpus) with a broken rule, and its tiers."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = broken.groupBy("source").agg(F.max(rank).cast("int").alias("rank"), F.sort_array(F.collect_set("tier")).alias("tiers"))
    return worst.select("source", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank")).alias("severity"), "tiers")
