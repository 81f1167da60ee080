"""Structured Streaming forms of the operators. Sources are folders of landed files; every stream can run to the end of
what is there (``availableNow``) or keep running. State and sinks live under the cluster's shared folder."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from matchflow.functions import exprs as X
from matchflow.operators import filters
from matchflow.operators.routing import route_candidates
from matchflow.operators.runs import failed_poll, fold_slices, merge_slices, poll_detail, poll_states
from matchflow.operators.scratch import stored, work_folder  # noqa: F401
from matchflow.sources.discovery import ats_of


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a Parquet folder, and read that."""
    at = work_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    else:  # rows that replace earlier ones of their key carry the number of their batch
        writer.foreachBatch(lambda df, n: put(df, f"{at}/out", n)).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{at}/out")


def put(df: DataFrame, folder: str, n: int) -> None:
    """Batch ``n`` as the partition of its number: a batch that is run again after a failure replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={n}")


def stream_career_domains(messages: DataFrame, dns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Career sub-domains in certificate messages (ts, value: JSON), once each within the delay, with the system that
    their DNS record points to. ``dns`` is a static table of (name, value)."""
    schema = "message_type string, data struct<leaf_cert:struct<all_domains:array<string>>>"
    m = messages.select("ts", F.from_json("value", schema).alias("m")).filter("m.message_type = 'certificate_update'")
    d = m.select("ts", F.explode("m.data.leaf_cert.all_domains").alias("domain")).select("ts", F.lower(F.trim("domain")).alias("domain"))
    once = filters.filter_career_domains(d).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["domain"])
    known = dns.select(F.lower("name").alias("domain"), ats_of(F.lower("value")).alias("ats")).filter("ats IS NOT NULL")
    return once.join(known, "domain").select("domain", "ats", F.element_at(F.split("domain", "[.]"), -2).alias("company"))


def stream_ingest(postings: DataFrame, sink: Callable[[DataFrame, int], None], counters: Callable[[DataFrame, int], None], at: str) -> None:
    """Each batch of postings through the filters into ``sink``; one row of counters a batch into ``counters``. Both take
    the batch's number, by which they must replace what an earlier run of the batch has left."""

    def batch(df: DataFrame, n: int) -> None:
        flagged = filters.with_qa_flag(filters.with_natsec_flag(filters.with_country_fence(filters.with_is_active(df))))
        title = F.col("title").rlike(X.any_word(filters.C.ENGINEERING_TERMS, plural=True))
        clean = F.col("fence").isNull() & ~F.col("natsec") & ~F.col("qa") & F.col("active")
        tested = flagged.withColumn("engineering", title).withColumn("kept", title & clean).persist()
        sink(tested.filter("kept").select(*df.columns), n)
        counters(tested.agg(F.count(F.lit(1)).alias("processed"), F.count_if("kept").alias("inserted"), F.count_if(~F.col("engineering")).alias("off_title")), n)
        tested.unpersist()

    postings.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


class RunFold(StatefulProcessor):
    """State of a key: its runs of failures so far. A batch brings a row for each slice of the key's log, in any order;
    slices of a batch that was merged before (it ran again after a failure) are left out."""

    STATE = "batch long, runs long, failed long, now long, longest long, last string, last_good string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runs", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, runs, failed, now, longest, last, good = self.state.get() if self.state.exists() else (-1, 0, 0, 0, 0, None, None)
        slices = [r for frame in rows for r in frame.itertuples(index=False) if r.batch > seen]
        for r in sorted(slices, key=lambda r: (r.batch, r.slice)):
            seen, runs, failed = int(r.batch), runs + int(r.n), failed + int(r.failed)
            longest = max(longest, int(r.top), now + int(r.head) if r.head else 0)
            now = now + int(r.head) if r.whole else int(r.tail)
            last = r.last
            good = r.last_good if isinstance(r.last_good, str) else good
        self.state.update((seen, runs, failed, now, longest, last, good))
        yield pd.DataFrame({"key": [key[0]], "runs": [runs], "failed": [failed], "consecutive_failures": [now], "longest": [longest], "last": [last], "last_good": [good]})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_run_states(runs: DataFrame, key: str, unit: str = "hour", detail: Column | None = None, live: bool = False) -> DataFrame:
    """(key, runs, failed, consecutive_failures, longest, last, last_good): the newest state of each key of a run log
    (key, at, id, bad) that comes in its order, however it is cut into batches.

    A stream folds each batch by key and slice, where a hot key's slices are worked on by many tasks, and writes the batch's
    few rows, replacing those of an earlier try. They are merged by key in one aggregation; with ``live`` a second stream
    merges them into the state of each key instead, which Python visits one by one.
    """
    spark, at = runs.sparkSession, work_folder(runs.sparkSession)
    kind = runs.schema[key].dataType.simpleString()
    folded = f"{at}/slices"
    runs.writeStream.foreachBatch(lambda df, n: put(fold_slices(df, key, unit, detail), folded, n)).option("checkpointLocation", f"{at}/fold").trigger(availableNow=True).start().awaitTermination()
    schema = f"key {kind}, slice timestamp, n long, failed long, head long, tail long, top long, whole boolean, last string, last_good string, batch long"
    if not live:  # a batch may cut a slice, so that batches come before slices in their order
        return merge_slices(spark.read.schema(schema).parquet(folded).withColumn("slice", F.struct("batch", "slice")))
    merged = spark.readStream.schema(schema).parquet(folded).groupBy("key")
    out = f"key {kind}, runs long, failed long, consecutive_failures long, longest long, last string, last_good string"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # keyed state variables need this store
    try:
        states = drain(merged.transformWithStateInPandas(RunFold(), out, "Update", "None"), "update")
    finally:
        spark.conf.set(name, before)
    columns = [c for c in states.columns if c != "batch"]
    newest = states.groupBy("key").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return newest.select("s.*")


def stream_source_health(log: DataFrame) -> DataFrame:
    """Health of each source as its log comes in: 5 failures in a row disable it for good, 3 degrade it."""
    runs = log.select("source", F.col("created_at").alias("at"), "id", (F.col("status") == "failure").alias("bad"))
    s = stream_run_states(runs, "source")
    health = F.when(F.col("longest") >= 5, "disabled").when(F.col("consecutive_failures") >= 3, "degraded").otherwise("healthy")
    return s.select(F.col("key").alias("source"), "consecutive_failures", "longest", health.alias("health"))


def stream_company_health(polls: DataFrame) -> DataFrame:
    """State of each polled company as its polls come in, from nothing; see ``runs.poll_states``."""
    runs = polls.withColumns({"at": F.col("polled_at"), "bad": failed_poll()})
    return poll_states(stream_run_states(runs, "company_id", "day", poll_detail()))


def run_panes(log: DataFrame, delay: str, pane: str = "1 hour") -> DataFrame:
    """(window, source, runs, failed): runs and failures of each source and pane, given out once the watermark has passed it."""
    w = log.withWatermark("created_at", delay).groupBy(F.window("created_at", pane), "source")
    return w.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failure").alias("failed"))


def stream_run_counters(log: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Runs and failures by source and window; a window is given out once the watermark has passed it."""
    return run_panes(log, delay, window).select(F.col("window.start").alias("start"), "source", "runs", "failed")


def stream_rolling_counters(log: DataFrame, width: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Runs and failures of each source in the ``width`` up to each full hour (or other ``slide``), once the watermark has
    passed it.

    Windows are chained: a run is counted in its hour alone, and hours, not runs, are handed to the windows they lie in.
    An hour is copied width / slide times, which Spark writes out as code: some dozens, not hundreds."""
    hours = run_panes(log, delay)
    w = hours.groupBy(F.window(F.window_time("window"), width, slide), "source").agg(F.sum("runs").alias("runs"), F.sum("failed").alias("failed"))
    return w.select(F.col("window.end").alias("end"), "source", "runs", "failed")


class _RowsSeen(StreamingQueryListener):
    """Adds up the rows that a query has read."""

    def __init__(self) -> None:
        self.rows, self.ended = 0, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def stream_late_runs(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row: runs seen, those in hours given out, those in hours still open (read from the state), and late ones, which
    no counter has: runs of an hour that the watermark had passed when the batch before theirs began."""
    spark, at = log.sparkSession, work_folder(log.sparkSession)
    seen = _RowsSeen()
    spark.streams.addListener(seen)
    try:
        out = run_panes(log, delay).select("runs").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        seen.ended.wait(60)
    finally:
        spark.streams.removeListener(seen)
    closed = spark.read.schema("runs long").parquet(f"{at}/out").agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("closed"))
    pending = spark.read.format("statestore").load(f"{at}/state").agg(F.coalesce(F.sum("value.count"), F.lit(0)).alias("open"))
    total = F.lit(seen.rows).cast("long")
    return closed.crossJoin(pending).select(total.alias("seen"), "closed", "open", (total - F.col("closed") - F.col("open")).alias("late"))  # one row each


def stream_match(postings: DataFrame, personas: DataFrame, at: str) -> DataFrame:
    """Each batch of new postings routed against the persona table; a posting's top k is complete within its batch."""

    def batch(df: DataFrame, n: int) -> None:
        put(route_candidates(df, personas, strict=False), f"{at}/out", n)

    postings.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return postings.sparkSession.read.parquet(f"{at}/out")
