"""Rolling counters over the run log, built from panes: a row is counted once, in its hour or minute, and windows add up panes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.functions import constants as C

SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def invalid_run() -> Column:
    """A run that failed because a payload was not of the expected form."""
    return F.coalesce((F.col("status") == "failure") & F.contains("error_message", F.lit(C.VALIDATION_FAILURE)), F.lit(False))


def run_panes(log: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """(keys, pane, runs, failed, invalid): runs of each minute, hour or day that has any, combined before the shuffle."""
    pane = F.date_trunc(unit, "created_at").alias("pane")
    n = log.filter("created_at IS NOT NULL").groupBy(*keys, pane)
    return n.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failure").alias("failed"), F.count_if(invalid_run()).alias("invalid"))


def rolling_runs(log: DataFrame, hours: dict[str, int], keys: list[str]) -> DataFrame:
    """For each hour of a source with runs: runs and failures of the hours up to it, one pair of columns for each width.

    A RANGE frame over the hours' panes, so that hours without runs count as hours; a source has one row an hour at most."""
    panes = run_panes(log, "hour", keys).withColumn("at", F.unix_timestamp("pane"))
    out = panes.select(*keys, "pane", "at", "runs", "failed")
    for name, n in hours.items():
        w = W.partitionBy(*keys).orderBy("at").rangeBetween(-(n - 1) * SECONDS["hour"], 0)
        out = out.withColumn(f"runs_{name}", F.sum("runs").over(w)).withColumn(f"failed_{name}", F.sum("failed").over(w))
    return out.drop("at")


def validation_spikes(log: DataFrame, minutes: int = 60, min_runs: int = 5, share: float = 0.2) -> DataFrame:
    """The minutes (pane, runs, invalid) at whose end the last ``minutes`` had at least ``min_runs`` runs, of which at least
    ``share`` were invalid. Up to one day at a time: panes of a day's last ``minutes`` also go to the next day."""
    if minutes > 24 * 60:
        raise ValueError("a window is a day long at most")
    panes = run_panes(log, "minute", []).withColumn("at", F.unix_timestamp("pane"))
    day = F.floor(F.col("at") / SECONDS["day"])
    reach = F.floor((F.col("at") + (minutes - 1) * SECONDS["minute"]) / SECONDS["day"])
    dealt = panes.withColumn("own", day).withColumn("day", F.explode(F.array_distinct(F.array(day, reach))))
    w = W.partitionBy("day").orderBy("at").rangeBetween(-(minutes - 1) * SECONDS["minute"], 0)
    summed = dealt.withColumns({c: F.sum(c).over(w) for c in ("runs", "invalid")}).filter(F.col("day") == F.col("own"))
    return summed.filter((F.col("runs") >= min_runs) & (F.col("invalid") / F.col("runs") >= share)).select("pane", "runs", "invalid")


def validation_alert(log: DataFrame, as_of: str, minutes: int = 60, min_runs: int = 5, share: float = 0.2) -> DataFrame:
    """One row: runs and invalid ones since ``minutes`` before ``as_of``, their share, and what to do: nothing where runs
    are too few to tell, else open the alert or resolve it."""
    recent = log.filter(F.col("created_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {minutes} MINUTES"))
    n = recent.agg(F.count(F.lit(1)).alias("runs"), F.count_if(invalid_run()).alias("invalid"))
    rate = F.when(F.col("runs") > 0, F.round(F.col("invalid") / F.col("runs"), 6))
    action = F.when(F.col("runs") < min_runs, "wait").when(F.col("invalid") / F.col("runs") >= share, "open").otherwise("resolve")
    return n.select("runs", "invalid", rate.alias("rate"), action.alias("action"))
