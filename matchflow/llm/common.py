"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (any store that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables, as ``spark.checkpoint.dir`` names it.

    Without that setting, a temporary folder serves a session on one machine (tests); on a cluster it is an error, as
    executors don't see one another's disks. An application's tables lie under its own id, to be removed when it ends.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.gettempdir()}/{sc.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a reliable checkpoint in the shared folder: a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: smaller than a checkpoint for many rows."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each: memory stays bounded on long texts."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = batch.num_rows if size <= max_bytes else max(1, batch.num_rows * max_bytes // size)
        for at in range(0, batch.num_rows, max(1, step)):
            yield batch.slice(at, step)


def map_text(
    df: DataFrame, columns: list[str], text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``fn`` over Arrow batches of the chosen columns only (the scan reads no others); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
