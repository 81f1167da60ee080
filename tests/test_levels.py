import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchflow.operators import breaker as b
from matchflow.operators import calibration as c
from matchflow.operators import levels as lv
from matchflow.sources.discovery import read_snapshots, write_snapshot

NOW = "2026-01-31 12:00:00"
AT = dt.datetime(2026, 1, 31, 12)


def test_stale_postings_at_the_borders(spark):
    ages = [0, 23, 24, 7 * 24, 8 * 24 - 1, 8 * 24, 30 * 24 + 23, 31 * 24, 60 * 24 + 23, 61 * 24, -5]
    rows = [("a", "active", AT - dt.timedelta(hours=h)) for h in ages] + [("a", "gone", AT), ("a", "active", None), ("empty", "gone", AT), (None, "active", AT)]
    got = {(r["source"], r["bucket"]): (r["n"], r["share"]) for r in lv.staleness_levels(spark.createDataFrame(rows, "ats_source string, status string, published_at timestamp"), NOW).collect()}
    assert [got["a", x][0] for x in lv.AGES] == [3, 3, 2, 2, 1] and got["a", "<1d"][1] == round(3 / 11, 6)
    assert [got["empty", x] for x in lv.AGES] == [(0, 0.0)] * 5
    assert got[None, "<1d"] == (4, round(4 / 12, 6)) and len(got) == 15


@pytest.mark.parametrize("n", [1, 2, 7, 100, 999])
def test_percentiles_are_below_the_true_ones_by_less_than_a_bin(spark, n):
    rng = random.Random(n)
    x = sorted(rng.random() for _ in range(n))
    r = c.percentiles(spark.createDataFrame([("k", v) for v in x] + [("k", None)], "k string, v double").repartition(3), "v", ["k"]).first()
    assert r["n"] == n
    for p in c.PERCENTILES:
        true = x[min(p * n // 100, n - 1)]
        assert true - c.WIDTH < r[f"p{p}"] + 1e-9 and r[f"p{p}"] <= true + 1e-9


def test_sketches_keep_their_error(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("double").alias("v")).repartition(16)
    ranks = df.select("v").toPandas()["v"].sort_values().reset_index(drop=True)
    r = c.sketched_percentiles(df, "v", ["k"]).first()
    for p in c.PERCENTILES:
        assert abs((ranks <= r[f"p{p}"]).mean() - p / 100) < 0.03


def test_histograms(spark):
    df = spark.createDataFrame([(0.0, 1), (0.1, 1), (0.999, 1), (1.0, None)], "x double, y int")
    got = {(r["measure"], r["bin"]): (r["lo"], r["n"]) for r in c.histograms(df, ["x", "y"]).collect()}
    assert [got["x", i][1] for i in range(10)] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2] and got["x", 3][0] == 0.3
    assert got["y", 0] == (1.0, 3) and sum(got["y", i][1] for i in range(10)) == 3
    assert c.histograms(df.limit(0), ["x"]).count() == 0


def test_candidates_of_all_postings_count(spark):
    jobs, matches = spark.createDataFrame([(i,) for i in range(5)], "id long"), spark.createDataFrame([(0,)] * 9 + [(1,)] * 2, "job_id long")
    r = c.candidates_per_job(jobs, matches).first()
    assert (r["n"], r["mean"], r["lo"], r["hi"], r["without"], r["capped"], r["p50"], r["p75"]) == (5, 2.2, 0, 9, 3, 1, 0.0, 2.0)


def test_the_same_sample_on_any_partitioning(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    a = {tuple(r) for r in c.bottom_k(df.repartition(1), "s", "id", 7, "x").collect()}
    assert a == {tuple(r) for r in c.bottom_k(df.repartition(13), "s", "id", 7, "x").collect()} and len(a) == 21
    assert a != {tuple(r) for r in c.bottom_k(df, "s", "id", 7, "y").collect()}
    plan = c.bottom_k(df.repartition(13), "s", "id", 7, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one of them before the shuffle


def test_audit_by_hand(spark):
    samples = spark.createDataFrame([("g", i) for i in range(10)] + [("none", 99)], "stratum string, job_id long")
    labels = spark.createDataFrame([(i, i < 2) for i in range(8)] + [(8, None)], "job_id long, wrong boolean")
    got = {r["stratum"]: tuple(r)[1:] for r in c.audit(samples, labels, 0.2).collect()}
    assert got["g"][:4] == (10, 8, 2, 0.25) and got["g"][6] is True
    assert abs(got["g"][4] - 0.071490) < 1e-4 and abs(got["g"][5] - 0.590720) < 1e-4
    assert got["none"] == (1, 0, 0, 0.0, None, None, False)


HEALTH = "source string, status string, failures long, escalations long"
JOBS = "ats_source string, status string, remote_scope string, detected_at timestamp"


def broken(spark, health, jobs):
    j = spark.createDataFrame(jobs, JOBS)
    m = b.source_metrics(spark.createDataFrame(health, HEALTH), j, NOW).unionByName(b.corpus_metrics(j))
    rows = b.broken_rules(m, b.rules(spark))
    return {(r["source"], r["tier"], r["action"]) for r in rows.collect()}, {r["source"]: (r["severity"], r["tiers"]) for r in b.dominant(rows).collect()}


def waiting(source, n):
    return [(source, "provisional", None, AT - dt.timedelta(hours=2))] * n


def live(n, scope):
    return [("x", "active", scope, AT)] * n


@pytest.mark.parametrize(
    "health, jobs, want",
    [
        (("s", "ok", 2, 2), live(1, "global"), set()),
        (("s", "ok", 3, 0), live(1, "global"), {("s", 1, "pause_source_15min")}),
        (("s", "ok", 4, 1), live(1, "global"), {("s", 1, "pause_source_1hr")}),
        (("s", "ok", 0, 3), live(1, "global"), {("s", 5, "ban_source_24hr")}),
        (("s", "banned", 9, 9), live(1, "global"), set()),
        (("s", "ok", 0, 0), live(85, "global") + waiting("s", 15), set()),
        (("s", "ok", 0, 0), live(84, "global") + waiting("s", 16), {("s", 2, "rate_reduce_50")}),
        (("s", "ok", 0, 0), live(75, "global") + waiting("s", 25), {("s", 2, "rate_reduce_50")}),
        (("s", "ok", 0, 0), live(74, "global") + waiting("s", 26), {("s", 2, "rate_reduce_90")}),
        (("s", "ok", 0, 0), live(69, "global") + waiting("s", 31), {("s", 2, "pause_source_until_clear")}),
        (("s", "ok", 0, 0), live(60, "global") + [("s", "provisional", None, AT)] * 40, set()),
        (("s", "ok", 0, 0), live(70, "global") + live(30, "undetermined"), {(None, 3, "force_reclassify")}),
        (("s", "ok", 0, 0), live(15, "global") + live(85, "country_fenced"), set()),
        (("s", "ok", 0, 0), live(14, "global") + live(86, "country_fenced"), {(None, 4, "halt_non_global_ingestion")}),
        (("s", "ok", 0, 0), live(3, "onsite"), set()),
    ],
)
def test_breaker_tiers_by_hand(spark, health, jobs, want):
    assert broken(spark, [health], jobs)[0] == want


def test_the_worst_severity_dominates(spark):
    got = broken(spark, [("s", "ok", 3, 4), ("t", "ok", 0, 0)], live(74, "global") + waiting("t", 26))[1]
    assert got == {"s": ("hard_pause", [1, 5]), "t": ("rate_reduction", [2])}


def test_a_day_written_again_is_replaced(spark, tmp_path):
    day = lambda d, n: spark.createDataFrame([(dt.date(2026, 1, d), n)], "snapshot_date date, n long")
    for d, n in ((1, 10), (2, 20), (1, 11), (1, 12)):
        write_snapshot(day(d, n), f"{tmp_path}/s")
    assert {(r["snapshot_date"].day, r["n"]) for r in read_snapshots(spark, f"{tmp_path}/s").collect()} == {(1, 12), (2, 20)}
