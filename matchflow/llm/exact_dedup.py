"""Exact deduplication by tree-merged digest runs (DataFrame operations only).

Every input partition is one run of digests. Runs then meet in binomial rounds: in a round, each run whose number is odd
hands its rows to the one before it, and the two are merged to a run that is sorted by digest and has one row for each:
the aggregate of a struct is Spark's sort aggregation, before the exchange and after it. So n runs are one after log2(n)
rounds, a hot digest shrinks to a row for each run before it moves on, and no task ever sees a whole group of copies. The
last round merges by digest alone. A larger ``fan_in`` merges more runs at once, in fewer rounds.
The identity of a text is its SHA-256, its length and a second, independent 64-bit hash; all three must agree, at every
level, for rows to merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import stored, table

KEY = ["sha", "alt", "n_bytes"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_tag, sha, alt, n_bytes) of every row; a null text counts as the empty text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.monotonically_increasing_id().alias("row_tag"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.xxhash64(text).alias("alt"),
        F.octet_length(text).alias("n_bytes"),
    )


def tree_merge(digests_df: DataFrame, keep: str = "max", fan_in: int = 2) -> DataFrame:
    """One row for each distinct text: the survivor and the size of its group. ``digests_df`` is a stored table."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    # the survivor among equal ids is the row with the smallest tag, whichever end of the ids is kept
    tag: Column = -F.col("row_tag") if keep == "max" else F.col("row_tag")
    best = F.max if keep == "max" else F.min
    run = F.shiftright("row_tag", 33)  # the upper bits number the input partition
    runs = 1 + (digests_df.agg(F.max(run)).first()[0] or 0)
    level = digests_df.select(
        *KEY,
        run.alias("run"),
        F.struct(F.col("id").isNotNull().alias("has_id") if keep == "max" else F.col("id").isNull().alias("has_id"), "id", tag.alias("tag")).alias("best"),
        F.lit(1).cast("long").alias("n"),
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        by = [*KEY, "run"] if runs > 1 else KEY
        level = level.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy(*by).agg(best("best").alias("best"), F.sum("n").alias("n"))
    if "run" in level.columns:
        level = level.groupBy(*KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
    return level.select(
        *KEY, F.col("best.id").alias("keep_id"), F.abs(F.col("best.tag")).alias("keep_tag"), F.col("n").alias("group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    * Null text equals the empty text. Null ids count as group members and survive only where the whole group has none.
    * Repeated rows (same id and text) all count; exactly one of them is ``kept``.
    * An empty table gives an empty result; further columns of ``docs`` are ignored, whatever their names.

    The digests are written once to the shared folder (about 70 bytes a row), so that row tags are the same for the merge
    and for the join back, also after an executor was lost.
    """
    d = stored(digests(docs, id_col, text_col))
    groups = tree_merge(d, keep)
    # both sides are shuffled by the digest alone, as plain join inputs: AQE splits a hot digest's rows over tasks
    return d.join(groups, KEY, "inner").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row_tag") == F.col("keep_tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row_tag",
    )


def keep_one_of_each(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that survive, with their own columns; of repeated survivors (same id and text) one stays.

    Texts travel where the dropped rows are too many to be sent to every task, as rows of a table have no other name.
    """
    pair = lambda df: df.select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_sha"))
    verdict = stored(exact_dedup(docs, keep=keep).select("doc_id", "text_sha256", "kept"))
    repeated = verdict.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1 AND kept")
    gone, again = pair(verdict.filter("NOT kept")), pair(repeated)
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    same = lambda other: docs["doc_id"].eqNullSafe(other["other_id"]) & (sha == other["other_sha"])
    out = docs.join(gone, same(gone), "left_anti")  # a repeated survivor is in ``gone`` too
    if again.isEmpty():
        return out
    name = "sha"
    while name in docs.columns:
        name += "_"
    tagged = docs.join(again, same(again), "left_semi").withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256))
    return out.unionByName(tagged.dropDuplicates(["doc_id", name]).drop(name))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max").drop("row_tag")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
