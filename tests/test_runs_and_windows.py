import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchflow.operators import runs as r
from matchflow.operators import windows as w
from matchflow.plans.queries_streaming import in_order
from matchflow.streaming import streams as st

T0 = dt.datetime(2024, 3, 1, 22, 0)
LOG = "source string, created_at timestamp, id long, status string, error_message string"


def a_log(seed, n=400, hours=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        failed = rng.random() < 0.45
        why = rng.choice(["Zod validation failed: x", "timeout", None]) if failed else None
        at = T0 + dt.timedelta(seconds=rng.randrange(hours * 3600))
        rows.append((rng.choice("aaaab"), at, i, "failure" if failed else rng.choice(["success", "partial"]), why))
    return rows


def brute_states(rows, start=0):
    now, top, n = start, 0, 0
    for bad in rows:
        now, n = (now + 1, n + 1) if bad else (0, n)
        top = max(top, now if bad else 0)
    return now, top


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "year"])
def test_slices_merge_to_the_whole_log(spark, unit):
    rows = a_log(1) + [("n", None, 1, "failure", None), ("n", T0, 0, "failure", None), ("n", T0, 2, "success", None), ("n", None, 0, None, None)]
    log = spark.createDataFrame(rows, LOG).select("source", F.col("created_at").alias("at"), "id", (F.col("status") == "failure").alias("bad"), F.col("id").cast("string").alias("d"))
    got = {x["key"]: x for x in r.merge_slices(r.fold_slices(log, "source", unit, F.col("d"))).collect()}
    for key in "abn":
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or T0, x[2]))
        bad = [x[3] == "failure" for x in mine]
        x = got[key]
        assert (x["consecutive_failures"], x["longest"]) == brute_states(bad)
        assert (x["runs"], x["failed"], x["last"]) == (len(mine), sum(bad), str(mine[-1][2]))
        assert x["last_good"] == str([m[2] for m, b in zip(mine, bad) if not b][-1])


def test_a_run_brought_along_goes_on_only_at_the_head(spark):
    log = spark.createDataFrame([("a", T0, 1, True), ("b", T0, 1, False), ("b", T0, 2, True)], "source string, at timestamp, id long, bad boolean")
    slices = r.fold_slices(log, "source").withColumn("before", F.lit(4))
    assert {x["key"]: (x["consecutive_failures"], x["longest"]) for x in r.merge_slices(slices, F.col("before")).collect()} == {"a": (5, 5), "b": (1, 1)}


@pytest.mark.parametrize(
    "codes, before, want",
    [
        ([200], 2, ("healthy", 0, True)),
        ([(200, False)], 2, ("degraded", 0, True)),
        ([429], 0, ("rate_limited", 1, True)),
        ([403], 0, ("blocked", 1, True)),
        ([404], 0, ("dead", 1, True)),
        ([500], 0, ("error", 1, True)),
        ([None], 0, ("error", 1, True)),
        ([429], 2, ("dead", 3, False)),
        ([500, 500, 500, 200], 0, ("healthy", 0, False)),
        ([500, 500, 200, 500], 0, ("error", 1, True)),
        ([200], 5, ("healthy", 0, True)),
        ([], 2, ("old", 2, True)),
    ],
)
def test_company_polls_by_hand(spark, codes, before, want):
    rows = []
    for i, c in enumerate(codes):
        code, valid = c if isinstance(c, tuple) else (c, True)
        rows.append((7, i, T0 + dt.timedelta(hours=i), code, valid, None, None, f"e{i}"))
    polls = spark.createDataFrame(rows, "company_id long, id long, polled_at timestamp, status_code int, valid boolean, newest timestamp, jobs int, error string")
    companies = spark.createDataFrame([(7, "old", before, True, None, None)], "id long, health string, consecutive_failures int, polling_enabled boolean, last_polled_at timestamp, last_job_posted_at timestamp")
    x = r.fold_company_polls(companies, polls).first()
    assert (x["health"], x["consecutive_failures"], x["polling_enabled"]) == want
    good = [i for i, c in enumerate(codes) if c == 200 or isinstance(c, tuple)]
    assert x["last_job_posted_at"] == (T0 + dt.timedelta(hours=good[-1]) if good else None)
    assert x["active_job_count"] == (0 if good else None)
    assert x["last_error"] == (f"e{len(codes) - 1}" if codes and want[1] else None)


def test_streamed_states_are_the_same_for_any_cut(spark):
    log = spark.createDataFrame(a_log(3, 300), LOG)
    runs = log.select("source", F.col("created_at").alias("at"), "id", (F.col("status") == "failure").alias("bad"))
    want = {x["key"]: (x["consecutive_failures"], x["longest"], x["runs"]) for x in r.merge_slices(r.fold_slices(runs, "source")).collect()}
    for cuts, files in ((1, 3), (4, 2)):
        got = st.stream_run_states(in_order(runs, "at", cuts, files), "source")
        assert {x["key"]: (x["consecutive_failures"], x["longest"], x["runs"]) for x in got.collect()} == want


def test_streamed_states_are_merged_in_one_aggregation(spark):
    """Batches that cut an hour are merged in their order, as the states of a live stream are, without a Python call a key."""
    log = spark.createDataFrame(a_log(4, 200, 3), LOG)
    runs = log.select("source", F.col("created_at").alias("at"), "id", (F.col("status") == "failure").alias("bad"))
    detail = F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))
    live = st.stream_run_states(in_order(runs, "at", 5, 2), "source", detail=detail, live=True)
    once = st.stream_run_states(in_order(runs, "at", 5, 2), "source", detail=detail)
    assert once.columns == live.columns and sorted(once.collect()) == sorted(live.collect())
    assert spark.read.parquet(*once.inputFiles()).columns == ["key", "slice", "n", "failed", "head", "tail", "top", "whole", "last", "last_good"]


def test_a_batch_that_runs_again_counts_once():
    import pandas as pd

    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    fold = st.RunFold()
    fold.state = State()
    columns = ["key", "slice", "n", "failed", "head", "tail", "top", "whole", "last", "last_good", "batch"]
    one = pd.DataFrame([("a", 2, 3, 2, 1, 1, 1, False, "x", "y", 0), ("a", 1, 2, 2, 2, 2, 2, True, "w", None, 0)], columns=columns)
    first = next(fold.handleInputRows(("a",), iter([one]), None))
    again = next(fold.handleInputRows(("a",), iter([one]), None))
    assert first.equals(again)
    assert first.iloc[0].tolist() == ["a", 5, 4, 1, 3, "x", "y"]


def test_rolling_runs_are_brute_force(spark):
    rows = a_log(5, 300, 30) + [("a", None, 999, "failure", None)]
    got = w.rolling_runs(spark.createDataFrame(rows, LOG), {"3h": 3, "24h": 24}, ["source"]).collect()
    hour = lambda t: t.replace(minute=0, second=0, microsecond=0)
    dated = [x for x in rows if x[1]]
    assert {(x["source"], x["pane"]) for x in got} == {(x[0], hour(x[1])) for x in dated}
    for x in got:
        for name, n in (("3h", 3), ("24h", 24)):
            mine = [y for y in dated if y[0] == x["source"] and x["pane"] - dt.timedelta(hours=n - 1) <= hour(y[1]) <= x["pane"]]
            assert (x[f"runs_{name}"], x[f"failed_{name}"]) == (len(mine), sum(y[3] == "failure" for y in mine))


def test_spikes_go_over_midnight(spark):
    rows = a_log(6, 500, 12)
    got = {(x["pane"], x["runs"], x["invalid"]) for x in w.validation_spikes(spark.createDataFrame(rows, LOG), share=0.1).collect()}
    minute = lambda t: t.replace(second=0, microsecond=0)
    want = set()
    for pane in {minute(x[1]) for x in rows}:
        mine = [x for x in rows if pane - dt.timedelta(minutes=59) <= minute(x[1]) <= pane]
        bad = sum(x[3] == "failure" and "Zod validation failed" in (x[4] or "") for x in mine)
        if len(mine) >= 5 and bad / len(mine) >= 0.1:
            want.add((pane, len(mine), bad))
    assert got == want and any(p.hour == 0 and p.minute < 50 for p, _, _ in want)


@pytest.mark.parametrize("n, bad, action", [(4, 4, "wait"), (5, 1, "open"), (6, 1, "resolve"), (0, 0, "wait")])
def test_alert_by_hand(spark, n, bad, action):
    rows = [("a", T0, i, "failure" if i < bad else "success", "Zod validation failed" if i < bad else None) for i in range(n)]
    old = [("a", T0 - dt.timedelta(hours=1, seconds=1), i, "failure", "Zod validation failed") for i in range(9)]
    log = spark.createDataFrame(rows + old, LOG)
    x = w.validation_alert(log, str(T0)).first()
    assert (x["runs"], x["invalid"], x["action"]) == (n, bad, action)
