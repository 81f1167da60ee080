"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into smallest Euclidean distance by one more component (vectors are padded to the
longest norm, queries are scaled to it), which p-stable hashing handles: a table projects a vector on ``m`` Gaussian
directions and cuts each into slots of equal width; the slots' numbers name its bucket. A query visits buckets in the
order of their estimated success probability: for a neighbour at the query's own k-th distance, as a sample shows it,
the chance of a slot is a difference of two normal distribution values and that of a bucket their product. Visits end
when the visited buckets' chances add up to the table's share of the wanted recall; there is no cap on a bucket's size.
All candidates of all tables are ranked by their exact inner product on the original vectors.

Buckets are split into blocks of bounded size, so that a bucket that holds a third of all rows is many blocks. Query
blocks meet candidate blocks of their bucket, and only the best of each query in a task go on. Of rows with one and the
same vector only the smallest ids can be among a query's nearest, so that the others leave the candidates beforehand.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.llm.common import stored, table

#: The fit looks at no more than this many rows, and asks no more than this many of them as queries.
SAMPLE_ROWS, SAMPLE_QUERIES = 4_096, 128
TABLES, RECALL, WIDTH, MAX_DIRECTIONS, MEAN_PROBES = 2, 0.93, 0.5, 12, 24
BLOCK_ROWS, QUERY_ROWS, KEEP_ROWS = 4_096, 512, 200_000


@dataclass
class Index:
    """What hashing needs: directions (tables, m, dim + 1), offsets, slot width, longest norm and a sample, in units of
    2**exponent, in which the longest norm is at most 1."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    longest: float
    sample: np.ndarray
    rank: int
    share: float
    exponent: int

    def slots(self, padded: np.ndarray) -> np.ndarray:
        """(rows, tables, m) positions in slot widths; their floors are the slots."""
        return (np.einsum("nd,tmd->ntm", padded, self.directions) + self.offsets) / self.width

    def pad(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries scaled to the longest norm, without padding: order by inner product stays as it is."""
        q = scaled(q)[0]
        norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return np.hstack([q * (self.longest / norm), np.zeros((len(q), 1))])

    def radius(self, asked: np.ndarray) -> np.ndarray:
        """Distance to the neighbour in the sample whose rank matches the wanted one in the whole table."""
        if not len(self.sample):
            return np.full(len(asked), self.longest)
        inner = asked @ self.sample.T
        at = min(self.rank, inner.shape[1] - 1)
        best = -np.partition(-inner, at, axis=1)[:, at]
        return np.sqrt(np.maximum(1e-12, 2 * self.longest**2 - 2 * best))

    def probes(self, position: np.ndarray, radius: float, limit: int | None = None) -> list[tuple[int, ...]]:
        """Buckets of one table in the order of their chances, until these add up to the table's share."""
        reach = math.ceil(4 * radius / self.width) + 1
        choices = []
        for x in position:
            home = math.floor(x)
            scale = radius / self.width * math.sqrt(2)
            edge = [math.erf((home + j - x) / scale) for j in range(-reach, reach + 2)]
            chance = [((b - a) / 2, home + j) for j, a, b in zip(range(-reach, reach + 1), edge, edge[1:])]
            choices.append(sorted((c for c in chance if c[0] > 0), reverse=True))
        first = (0,) * len(choices)
        queue = [(-math.prod(c[0][0] for c in choices), first)]
        seen, out, total = {first}, [], 0.0
        while queue and total < self.share and (limit is None or len(out) < limit):
            minus, at = heapq.heappop(queue)
            total -= minus
            out.append(tuple(c[i][1] for c, i in zip(choices, at)))
            for d, i in enumerate(at):
                if i + 1 < len(choices[d]):
                    to = (*at[:d], i + 1, *at[d + 1 :])
                    if to not in seen:
                        seen.add(to)
                        queue_item = minus / choices[d][i][0] * choices[d][i + 1][0]
                        heapq.heappush(queue, (queue_item, to))
        return out


def bucket_key(t: int, slots: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of slot numbers of table ``t``. Two buckets that share one only share candidates."""
    key = np.full(len(slots), t + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(slots.shape[1]):
        key = (key ^ slots[:, i].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by powers of two so that their largest component is between 1/2 and 1, and the exponents: nothing is
    rounded, and sums of products neither overflow nor vanish, however large or small the rows are."""
    e = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.ldexp(x, -e[:, None]), e


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, log_norm) of the rows that take part: id and vector not null, all components finite, not all zero.

    The norm is summed up relative to the largest component so far, and given by its logarithm to base 2."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    state = lambda most, total: F.struct(most.alias("most"), total.alias("total"))

    def step(s, x):
        a = F.abs(x)
        up, down = s["most"] / a, a / s["most"]
        return F.when(a > s["most"], state(a, 1 + s["total"] * up * up)).when(a > 0, state(s["most"], s["total"] + down * down)).otherwise(s)

    norm = F.aggregate("v", state(F.lit(0.0), F.lit(0.0)), step, lambda s: F.log2(s["most"]) + F.log2(s["total"]) / 2)
    return rows.withColumn("log_norm", norm)


def fit(rows: DataFrame, dim: int, n: int, log_norm: float, k: int, seed: int = 7) -> Index:
    """Directions drawn by ``seed``, and as many to a table as the sample bears: the most, up to what the row count
    calls for, at which its queries visit ``MEAN_PROBES`` buckets or fewer on average. ``log_norm`` is the longest one's."""
    exponent = math.ceil(log_norm)
    longest = 2.0 ** (log_norm - exponent)
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = int(min(1.0, 1.2 * SAMPLE_ROWS / max(1, n)) * (1 << 30))  # some more than needed; the first by hash are taken
    picked = rows.filter(at < share).orderBy(at, "id", "v").limit(SAMPLE_ROWS).select("v").toArrow()
    sample = np.ldexp(np.array(picked["v"].to_pylist(), float).reshape(-1, dim), -exponent)
    rng = np.random.default_rng(seed)
    wanted = int(np.clip(round(math.log(max(n, 1000) / 1000, 4)), 1, MAX_DIRECTIONS))
    gaussian = rng.standard_normal((TABLES, wanted, dim + 1))
    offsets = rng.random((TABLES, wanted))
    index = Index(gaussian, offsets, WIDTH * longest, longest, sample, 0, 1 - (1 - RECALL) ** (1 / TABLES), exponent)
    index.offsets = offsets * index.width
    index.rank = max(1, math.ceil(k * len(sample) / max(1, n)))  # place 0 is the query itself, if it is in the sample
    asked = index.ask(sample[np.abs(sample).max(axis=1, initial=0) > 0][:SAMPLE_QUERIES])
    index.sample = index.pad(sample)
    for m in range(wanted, 0, -1):
        index.directions, index.offsets = gaussian[:, :m], offsets[:, :m] * index.width
        if m == 1 or not len(asked):
            break
        at, r = index.slots(asked), index.radius(asked)
        visits = [len(index.probes(at[i, 0], r[i], 4 * MEAN_PROBES)) for i in range(len(asked))]
        if np.mean(visits) <= MEAN_PROBES:
            break
    return index


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: largest score, ties to the smaller id, each id once with its best score."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    once = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    rank = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
    return query[rank < k], ids[rank < k], score[rank < k]


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of a block for each query, without the query's own row.

    A matrix product finds them up to rounding; scores are row sums, so that equal vectors have equal ones anywhere.
    """
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    (block, block_e), (queries, query_e) = scaled(block[order]), scaled(queries)
    most = block_e.max(initial=-1100)
    units = np.ldexp(1.0, block_e - most)  # of the rows, relative to the largest one's
    with np.errstate(over="ignore"):  # a product too large for a double is infinite
        rough = np.ldexp((queries @ block.T) * units, query_e[:, None] + most)
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    by_id = rough if len(first) == len(ids) else np.maximum.reduceat(rough, first, axis=1)
    least = np.full(len(queries), -np.inf)
    if by_id.shape[1] > k:
        least = np.partition(by_id, by_id.shape[1] - k, axis=1)[:, by_id.shape[1] - k]
        error = 1e-12 * len(block[0]) * np.sqrt((queries**2).sum(axis=1) * ((block * units[:, None]) ** 2).sum(axis=1).max())
        with np.errstate(over="ignore"):
            least = np.where(np.isinf(least), least, least - np.ldexp(error, query_e + most))
    q, i = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
    with np.errstate(over="ignore"):
        score = np.ldexp((block[i] * queries[q]).sum(axis=1), block_e[i] + query_e[q])
    return top(query_ids[q], ids[i], score, k)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` picks, among all other rows.

    * Rows with a null id or vector, a null or non-finite component, or only zeros take no part; nor do vectors of
      another length than the most frequent one (ties to the longer), with which they have no inner product: a warning
      tells how many there are.
    * Norms may be as large or small as doubles are. A product beyond them is infinite, and infinite ones are ties.
    * Ties go to the smaller id. Rows that repeat an id count once, with their best score. Fewer candidates than k are
      all returned. An empty table, or one without queries, gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("log_norm").alias("log_norm"))
    by_size = sizes.agg(F.max(F.struct("n", "dim", "log_norm")).alias("most"), F.sum("n").alias("all")).first()
    head = by_size["most"]
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if by_size["all"] > head["n"]:
        warnings.warn(f"{by_size['all'] - head['n']} vectors have another length than {head['dim']} and take no part", stacklevel=2)
    rows = rows.filter(F.size("v") == head["dim"])
    shared = spark.sparkContext.broadcast(fit(rows, head["dim"], head["n"], head["log_norm"], k))

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = np.ldexp(np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1), -index.exponent)
            at = np.floor(index.slots(index.pad(x)))
            for t in range(at.shape[1]):
                yield pa.record_batch([pa.array(bucket_key(t, at[:, t])), batch.column(0), batch.column(1)], names=["key", "id", "v"])

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                q = index.ask(np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1))
                at, radius = index.slots(q), index.radius(q)
                keys, who = [], []
                for i in range(part.num_rows):
                    for t in range(at.shape[1]):
                        found = bucket_key(t, np.array(index.probes(at[i, t], radius[i])))
                        keys.append(found)
                        who.append(np.full(len(found), i))
                who = pa.array(np.concatenate(who))
                yield pa.record_batch([pa.array(np.concatenate(keys)), part.column(0).take(who), part.column(1).take(who)], names=["key", "id", "v"])

    schema = "key long, id long, v array<double>"
    once = rows.select(F.col("id").cast("long").alias("id"), "v").distinct()
    alike = W.partitionBy("v").orderBy("id")
    candidates = once.withColumn("of_vector", F.row_number().over(alike)).filter(F.col("of_vector") <= k + 1).select("id", "v")
    hashed = candidates.mapInArrow(hash_rows, schema)
    probed = once.filter(is_query(F.col("id"))).mapInArrow(probe_rows, schema)

    def in_blocks(df: DataFrame, size: int) -> DataFrame:
        """One row for each block of about ``size`` rows of a key; ids and vectors as arrays."""
        df = stored(df)
        many = df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
        dealt = df.join(many, "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
        return dealt.groupBy("key", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("key", "rows")

    met = in_blocks(hashed, BLOCK_ROWS).withColumnRenamed("rows", "c").join(in_blocks(probed, QUERY_ROWS).withColumnRenamed("rows", "q"), "key")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        unpack = lambda rows: (rows.field("id").to_numpy(), rows.field("v").flatten().to_numpy().reshape(len(rows), -1))
        for batch in batches:
            for n in range(batch.num_rows):
                found = best_of(*unpack(batch.column("q")[n].values), *unpack(batch.column("c")[n].values), k)
                kept = [np.concatenate(x) for x in zip(kept, found)]
                if len(kept[0]) > KEEP_ROWS:
                    kept = list(top(*kept, k))
                if len(kept[0]) > KEEP_ROWS:
                    yield pa.record_batch(list(map(pa.array, kept)), names=["query_id", "vec_id", "score"])
                    kept = [x[:0] for x in kept]
        yield pa.record_batch(list(map(pa.array, top(*kept, k))), names=["query_id", "vec_id", "score"])

    found = met.select("c", "q").mapInArrow(rank, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)
