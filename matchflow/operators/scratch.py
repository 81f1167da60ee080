"""Tables and streams' files under the shared folder of a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared one that ``spark.checkpoint.dir`` names; only on one machine a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir()}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own under the shared one, and read back."""
    at = work_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
