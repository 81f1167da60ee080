"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors are cut into chunks of rows and blocks of columns; a shard is the matrix of one block of one chunk. In a round,
a shard's task works out exact squared distances of its columns to the slices of all centroids. The partial matrices of
a chunk are added up by key, and the smallest sum names the cluster of each vector. These labels meet the shards again;
each adds up its own columns by cluster, and each block of columns makes its own slice of the new centroids from the sums.
Only slices (centroids x dimensions in all) are known to the driver and sent to tasks; labels and distances are not.

All arithmetic is on integers and exact, so that results do not depend on how rows are partitioned or in which order
partial sums are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow.llm.common import stored, table

#: Columns of a shard; places of a chunk's matrix of partial distances (8 bytes each).
BLOCK, PLACES = 16, 1 << 15
#: Components beyond this are an error: squared distances over 1,024 dimensions would not fit into a long.
LARGEST = 1 << 25

Slices = dict[int, np.ndarray]  # by block: centroids x columns


def distances(x: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``slice_``. Small numbers go through floating-point
    products, which are exact below 2**53."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(slice_).max(initial=0)))
    if largest**2 * x.shape[1] * 4 < 1 << 53:
        a, b = x.astype(float), slice_.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return ((x[:, None, :] - slice_[None, :, :]) ** 2).sum(axis=2)


def shards(vectors: DataFrame, dim: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, block, n, x) and (chunk, ids) of (id, v): no shuffle, chunks are cut from each input partition."""
    blocks = -(-dim // BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                found = [np.ascontiguousarray(x[:, b * BLOCK : (b + 1) * BLOCK]).astype("<i4").tobytes() for b in range(blocks)]
                yield pa.record_batch([pa.array([part.column(0)], pa.list_(part.column(0).type)), pa.array([found], pa.list_(pa.binary()))], names=["ids", "x"])

    kind = vectors.schema["id"].dataType.simpleString()
    chunks = vectors.mapInArrow(cut, f"ids array<{kind}>, x array<binary>").withColumn("chunk", F.monotonically_increasing_id())
    chunks = stored(chunks)
    return chunks.select("chunk", F.size("ids").alias("n"), F.posexplode("x").alias("block", "x")), chunks.select("chunk", "ids")


def assigned(parts: DataFrame, slices: Slices) -> DataFrame:
    """(chunk, labels, distances): partial distances of the shards, added up by chunk, and the nearest centroid of each
    vector, the smallest number of equally near ones. Labels are int32 and distances int64, in the order of the rows."""
    k = len(next(iter(slices.values())))
    sent = parts.sparkSession.sparkContext.broadcast(slices)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, block, x in zip(*(c.to_pylist() for c in batch.columns)):
                d = distances(np.frombuffer(x, "<i4").astype(np.int64).reshape(n, -1), sent.value[block])
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([d.astype("<i8").tobytes()], pa.binary())], names=["chunk", "d"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            d = total.reshape(-1, k)
            label = d.argmin(axis=1)
            found = label.astype("<i4").tobytes(), d[np.arange(len(d)), label].astype("<i8").tobytes()
            return pa.record_batch([pa.array([at], pa.int64()), *(pa.array([b], pa.binary()) for b in found)], names=["chunk", "labels", "distances"])

        for batch in batches:
            for chunk, d in zip(*(c.to_pylist() for c in batch.columns)):
                d = np.frombuffer(d, "<i8")
                if chunk != at:
                    if at is not None:
                        yield out()
                    at, total = chunk, d.copy()
                else:
                    total += d
        if at is not None:
            yield out()

    sums = parts.select("chunk", "n", "block", "x").mapInArrow(partial, "chunk long, d binary")
    return sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(nearest, "chunk long, labels binary, distances binary")


def moved(parts: DataFrame, labels: DataFrame, slices: Slices) -> Slices:
    """The slices after each block has replaced every non-empty centroid by the floor of its vectors' mean."""
    k = len(next(iter(slices.values())))
    width = {b: s.shape[1] for b, s in slices.items()}

    def merged(x: bytes, other: bytes) -> bytes:
        return (np.frombuffer(x, "<i8") + np.frombuffer(other, "<i8")).tobytes()

    def add_up(totals: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.binary())], names=["block", "sums"])

    def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, bytes] = {}
        for batch in batches:
            for n, block, x, label in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, "<i4").astype(np.int64).reshape(n, -1)
                sums = np.zeros((k, width[block] + 1), np.int64)
                at = np.frombuffer(label, "<i4")
                np.add.at(sums, at, np.hstack([x, np.ones((n, 1), np.int64)]))
                totals[block] = merged(totals[block], sums.tobytes()) if block in totals else sums.tobytes()
        yield from add_up(totals)

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, bytes] = {}
        for batch in batches:
            for block, sums in zip(*(c.to_pylist() for c in batch.columns)):
                totals[block] = merged(totals[block], sums) if block in totals else sums
        new = {}
        for block, sums in totals.items():
            s = np.frombuffer(sums, "<i8").reshape(k, -1)
            n = s[:, -1:]
            new[block] = np.where(n > 0, s[:, :-1] // np.maximum(n, 1), slices[block]).astype("<i8").tobytes()
        yield from add_up(new)

    kind = "block int, sums binary"
    sums = parts.join(labels, "chunk").select("n", "block", "x", "labels").mapInArrow(of_shards, kind)
    rows = sums.repartition("block").mapInArrow(of_blocks, kind).collect()  # one for each block
    return slices | {r["block"]: np.frombuffer(r["sums"], "<i8").reshape(k, -1) for r in rows}


def lloyd(vectors: DataFrame, starts: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of ``vectors`` (id, v array<int>, all as long as a row of ``starts``) after ``rounds``
    moves of the centroids and a last assignment, and the centroids.

    * Equally near centroids: the smaller number. An empty centroid stays where it is.
    * Rows that repeat an id, or have none, are vectors like others. An empty table, or no starts, gives an empty result.
    * Memory: a task holds a few chunks' matrices; each shuffle has rows x centroids x blocks partial distances.
    """
    k, dim = starts.shape
    kind = vectors.schema["id"].dataType
    if not k or not dim:
        schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema), starts
    parts, ids = shards(vectors, dim, max(1, PLACES // k))
    slices: Slices = {b: starts[:, b * BLOCK : (b + 1) * BLOCK] for b in range(-(-dim // BLOCK))}
    for _ in range(rounds):
        slices = moved(parts, assigned(parts, slices), slices)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, "<i4"), (2, "<i8")))
                yield pa.record_batch([batch.column(0)[i].values, *(pa.array(f) for f in found)], names=["id", "cluster", "distance"])

    joined = ids.join(assigned(parts, slices), "chunk").select("ids", "labels", "distances")
    out = joined.mapInArrow(unpacked, f"id {kind.simpleString()}, cluster int, distance long")
    return out, np.hstack([slices[b] for b in sorted(slices)])


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<int>): floor(scale * x) of the vectors with exactly ``dim`` components, none null or non-finite.

    A component beyond ``LARGEST`` ends the run with an error that names it.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def number(x: Column) -> Column:
        y = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x * F.lit(float(scale))) <= LARGEST, y.cast("int")).otherwise(F.raise_error(F.format_string("component %s is too large to cluster", x)).cast("int"))

    kept = vectors.filter(v.isNotNull() & (F.size(v) == dim) & whole)
    return kept.select(F.col(f"`{id_col}`").alias("id"), F.transform(v, number).alias("v"))


def first_by_hash(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256 after ``prefix``; ties by the vector, null ids last."""
    h = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


def centroid_clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """``lloyd`` over the quantised vectors of a table, from the k first by hash; with fewer vectors, so many centroids.
    Further columns of ``vectors`` are ignored, whatever their names."""
    kept = quantised(vectors, dim, scale, id_col, vec_col)
    return lloyd(kept, first_by_hash(kept, k, f"{seed}:"), rounds)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    labels = stored(found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame(list(enumerate(sha)), "cluster int, centroid_sha256 string")
    by_cluster = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    clusters = F.broadcast(by_cluster.join(known, "cluster").crossJoin(total))  # a row for each of at most k clusters
    return labels.join(clusters, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 5, k: int = 40) -> str:
    """Lloyd's rounds written out; floor division, as DuckDB's // goes towards zero."""
    near = """SELECT id, c AS cluster, d AS distance FROM (SELECT v.id, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{0} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1"""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('2:' || CAST(id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"""m{i} AS MATERIALIZED (SELECT c, list(CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END ORDER BY i) AS x FROM
              (SELECT a.cluster AS c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN v USING (id), generate_series(1, 64) g(i) GROUP BY ALL) GROUP BY c)""",
            f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c))",
        ]
    steps.append(f"f AS MATERIALIZED ({near.format(rounds)})")
    return f"""WITH {', '.join(steps)} SELECT id AS vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
      (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.c = f.cluster"""


OP12_SQL = _sql()
