"""Benchmark decontamination by winnowing.

A fingerprint is a hash of k consecutive words that is the smallest in some window of w such hashes. Any w + k - 1 shared
words hold a shared fingerprint, so with w + k - 1 = n every shared span of n words is found from its fingerprints.
Benchmark items and documents are winnowed alike; items of fewer than n words are matched whole, by k and w of their own.

The benchmark's fingerprints also set bits in a map of fixed size, which the documents' tasks are sent: a fingerprint
whose bit is not set is dropped before it travels. The others are joined with the benchmark's and carry the words around
them; hits are extended to the windows of n words that contain them, which are compared as words, not as hashes.
A benchmark that fills the map makes it pass more, and never lose any.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.llm.common import map_text, stored, table

WINDOW = 10
MAX_WORDS = 150_000
#: Bits of the map of fingerprints: 1 MB, in parts of 4 KB as ``bitmap_construct_agg`` makes them.
BITS, PART = 23, 15
#: What is not a word character (ASCII digits and letters, and everything beyond ASCII) becomes a blank, A-Z becomes a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@functools.lru_cache(maxsize=MAX_WORDS)
def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram_size(n: int) -> int:
    """Words in a fingerprint of spans of ``n`` words: half of them, so that neither k nor w is small."""
    return -(-n // 2)


def winnow(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of a text of these word hashes, for shared spans of ``n`` words: of each
    window of w k-grams the smallest; equal ones are all kept."""
    k = gram_size(n)
    w = n - k + 1
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    m = len(hashes) - k + 1
    gram = np.zeros(m, np.uint64)
    for i in range(k):
        gram = (gram ^ hashes[i : i + m]) * _MIX1
        gram ^= gram >> np.uint64(31)
    gram = (gram ^ np.uint64(n)) * _MIX2
    gram ^= gram >> np.uint64(29)
    low = gram[: m - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, gram[i : i + m - w + 1], out=low)
    # a gram is the smallest of some window that has it, if the largest of these windows' smallest is itself
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    top = padded[:m].copy()
    for i in range(1, w):
        np.maximum(top, padded[i : i + m], out=top)
    at = np.flatnonzero(gram == top)
    return at, gram[at]


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, ws), np.uint64, len(ws))


def items_words(items: DataFrame, n: int) -> DataFrame:
    """(item_id, size, windows, prints) of (item_id, text): the size of the item's windows (n, or all its words if fewer;
    0 without words), its distinct windows as words joined by blanks, and its fingerprints."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, windows, prints = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            ws = words(text)
            size = min(n, len(ws))
            sizes.append(size)
            windows.append(list(dict.fromkeys(b" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1))) if size else [])
            prints.append(np.unique(winnow(_hashes(ws), size)[1]).view(np.int64).tolist() if size else [])
        of = pa.array(windows, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), of, pa.array(prints, pa.list_(pa.int64()))], names=["item_id", "size", "windows", "prints"])

    kind = items.schema["item_id"].dataType.simpleString()
    return map_text(items, ["item_id", "text"], "text", run, f"item_id {kind}, size int, windows array<string>, prints array<bigint>")


def bit_map(prints: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bytes of a map of 2**bits bits, those of the upper bits of the hashes set. At most 2**(bits - 15) rows of 4 KB
    come to the driver."""
    place = F.shiftrightunsigned("print", 64 - bits)
    part = prints.select(F.shiftright(place, PART).alias("part"), place.bitwiseAND((1 << PART) - 1).alias("bit"))
    rows = part.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in rows:
        got = np.frombuffer(bytes(r["map"]), np.uint8)
        out[r["part"] << PART - 3 : (r["part"] << PART - 3) + len(got)] = got
    return out


def winnowed(docs: DataFrame, sizes: list[int], known: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, hits) of (doc_id, text): of the fingerprints whose bit is set in ``known``, size, hash, the place
    of the first of the words around, and these words: all that a window of ``size`` words with the fingerprint can hold."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    shape = pa.struct([("size", pa.int32()), ("print", pa.int64()), ("start", pa.int64()), ("around", pa.list_(pa.string()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit_of = sent.value
        n_words, hits = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            ws = words(text)
            n_words.append(len(ws))
            of, found = _hashes(ws), []
            for size in sizes:
                at, h = winnow(of, size)
                place = h >> np.uint64(64 - bits)
                here = np.flatnonzero(bit_of[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                k = gram_size(size)
                for p, x in zip(at[here].tolist(), h[here].view(np.int64).tolist()):
                    first = max(0, p + k - size)
                    found.append({"size": size, "print": x, "start": first, "around": ws[first : p + size]})
            hits.append(found)
        return pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(shape))], names=["doc_id", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs, ["doc_id", "text"], "text", run, f"doc_id {kind}, n_words long, hits array<struct<size:int,print:long,start:long,around:array<string>>>")


def covered(spans: DataFrame, key: str) -> DataFrame:
    """Words that the spans (key, start, size) of a key cover together. A key's spans are those of one document."""
    w = W.partitionBy(key).orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.col("start") + F.col("size") - F.greatest("start", F.coalesce(before, F.lit(0)))
    return spans.withColumn("new", F.greatest(new, F.lit(0))).groupBy(key).agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit (words in an occurrence of a window of ``n`` item words),
    n_items, item_ids (those with occurring windows, as strings, sorted).

    * Words are runs of ASCII letters (in either case), digits and characters beyond ASCII. An item of fewer than ``n``
      words, but not none, is one window. Null, empty and wordless texts have no words: no hits, an empty list.
    * Items that repeat an id count once; one without an id hits words, but is not listed. Rows that repeat a document's
      id, or have none, each give their own row. Further columns are ignored.
    * An empty table of documents gives an empty result; without items nothing is hit.

    Only fingerprints that the map passes are shuffled. Copies of a passage meet each distinct window of the benchmark
    once, however many items have it, before documents and items are paired for the list.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bench = stored(items_words(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")), n).filter("size > 0"))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # n of them at most
    prints = bench.select("size", F.explode("prints").alias("print")).distinct()
    found = stored(winnowed(docs, sizes, bit_map(prints)).withColumn("row", F.monotonically_increasing_id()))
    hits = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(prints, ["size", "print"], "left_semi")
    # extend: every window that contains the fingerprint, compared by its words
    offset = F.explode(F.sequence(F.lit(0), F.size("around") - F.col("size")))
    windows = hits.select("row", "size", "start", "around", offset.alias("i"))
    window = F.array_join(F.slice("around", F.col("i") + 1, F.col("size")), " ")
    windows = windows.select("row", "size", (F.col("start") + F.col("i")).alias("start"), window.alias("window")).distinct()
    of_items = bench.select("item_id", "size", F.explode("windows").alias("window"))
    real = stored(windows.join(of_items.select("size", "window").distinct(), ["size", "window"], "left_semi"))
    pairs = real.select("row", "size", "window").distinct().join(of_items.filter("item_id IS NOT NULL"), ["size", "window"]).select("row", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = pairs.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    out = found.select("row", "doc_id", "n_words").join(covered(real, "row"), "row", "left").join(listed, "row", "left")
    none: Column = F.array().cast("array<string>")
    return out.select(F.col("doc_id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha, (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "list_transform(generate_series(1, len(w) - least({0}, len(w)) + 1), lambda i: array_to_string(w[i:i + least({0}, len(w)) - 1], ' '))"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, len(w) AS n, least({WINDOW}, len(w)) AS size, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, size, unnest({_GRAMS.format(WINDOW)}) AS g FROM b),
s AS (SELECT DISTINCT size FROM b),
p AS (SELECT r, size, unnest(generate_series(1, len(w) - size + 1)) AS i, w FROM d JOIN s ON len(w) >= size),
h AS MATERIALIZED (SELECT r, size, i, g FROM (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM p) WHERE (size, g) IN (SELECT (size, g) FROM bw)),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS x FROM h) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h JOIN bw USING (size, g)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)
"""
