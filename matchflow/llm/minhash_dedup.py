"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

The sketch of a set has ``t`` coordinates, one for each bin. In round i = 0 .. t-1 every element is thrown into the bin
that round's hash names, with value i plus a fraction; a bin keeps its smallest value, so that the first round to reach
it decides. Bins still empty then take, in rounds t .. 2t-1, the smallest value over all elements of a round of their
own, so that every coordinate is filled. Two sets agree on a coordinate with probability equal to their similarity, with
the concentration of independent throws, yet a large set needs only a few rounds.

Coordinates are cut into bands; documents that share a band are candidates. Candidate links are confirmed on the full
sets of shingles. A bucket is never expanded into all its pairs. Its members are first compared with its smallest one,
which settles nearly all of a group of copies. A bucket that holds several components afterwards belongs to the cell of
the one that has most of its members. In each cell the other components' sets, in blocks of bounded size, meet the
stream of all its sets; common shingles are counted through an inverted index, and only links come out, which are
confirmed on the texts again. As each such bucket belongs to one cell, every candidate pair of two components meets.
Pairs within one component are never compared, as they can't change the result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import map_text, slices, stored, table
from matchflow.llm.components import connected_components

#: 40 bands of 6 rows: a pair at similarity 0.8 is missed with probability (1 - 0.8**6)**40, about 5 in a million.
BANDS, ROWS = 40, 6
#: Shingles in a block of a cell's outsiders and in a slice of its other sets; every set counts ``SET_COST`` more.
LEFT, RIGHT, SET_COST = 1 << 18, 1 << 19, 256
MAX_WORDS = 150_000
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; ``bytes`` methods know only ASCII letters and white space."""
    return (text or "").encode().lower().split()


@functools.lru_cache(maxsize=MAX_WORDS)
def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(ws: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence as one."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash, ws), np.uint64, len(ws))
    k = min(k, len(ws))
    n = len(ws) - k + 1
    out = mix(h[:n] + np.uint64(k))
    for i in range(1, k):
        out = mix(out * _MIX1 + h[i : i + n])
    return np.unique(out)


def shingle_set(ws: list[bytes], k: int) -> set:
    """The shingles themselves."""
    if not ws:
        return set()
    k = min(k, len(ws))
    return set(zip(*[ws[i:] for i in range(k)]))


def fast_sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates (round and fraction in one integer) of a set of 64-bit hashes, which must not be empty."""
    filled, sketch = np.zeros(t, bool), np.zeros(t, np.uint64)
    at = 0
    while at < t and not filled.all():
        block = min(t - at, max(1, -(-6 * t // len(elements)) if at == 0 else -(-12 * t // len(elements))))
        rounds = np.arange(at, at + block, dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _MIX1)
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        keys = np.sort(((bins << np.uint64(42)) | (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        of = (keys >> np.uint64(42)).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        new = first[~filled[of[first]]]
        sketch[of[new]] = keys[new] & np.uint64((1 << 42) - 1)
        filled[of[new]] = True
        at += block
    for b in np.flatnonzero(~filled):
        h = mix(elements + np.array([t + b + 1], np.uint64) * _MIX1)
        sketch[b] = (np.uint64(t + int(b)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = sketch.reshape(bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _MIX1)
    for i in range(rows):
        key = mix(key * _MIX1 + parts[:, i])
    return key.view(np.int64)


def sketch_documents(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tag, n_shingles, set_key, bands) of (doc_id, tag, text); set_key names the set, null and no bands if it is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, bands_of = [], [], []
        for text in batch.column(2).to_pylist():
            hashes = shingle_hashes(words(text), k)
            n.append(len(hashes))
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            bands_of.append(band_keys(fast_sketch(hashes, bands * rows), bands, rows) if len(hashes) else None)
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands_of, pa.list_(pa.int64()))],
            names=["doc_id", "tag", "n_shingles", "set_key", "bands"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tag long, n_shingles long, set_key binary, bands array<bigint>"
    return map_text(docs, ["doc_id", "tag", "text"], "text", run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (longs, a and b first) whose full sets meet 100 * intersection >= percent * union.

    ``texts`` has (node, text).
    """
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select(*pairs.columns, "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for batch in batches:
            keep, n = [], batch.num_columns
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:  # rows come sorted by a, as the join leaves them
                    last, of_last = a, shingle_set(words(batch.column(n - 2)[i].as_py()), k)
                other = shingle_set(words(batch.column(n - 1)[i].as_py()), k)
                common = len(of_last & other)
                if 100 * common >= percent * (len(of_last) + len(other) - common):
                    keep.append(i)
            yield batch.select(range(n - 2)).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in pairs.columns))


class Block:
    """Sets of a cell's outsiders, indexed by shingle; the cell's other sets are held against it one by one."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray]], percent: int) -> None:
        self.nodes, self.components = [s[0] for s in sets], [s[1] for s in sets]
        self.sizes = np.array([len(s[2]) for s in sets])
        values, owner = np.concatenate([s[2] for s in sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.percent = values[order], owner[order], percent
        self.found: set[tuple[int, int]] = set()

    def links(self, node: int, component: int, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(outsider, node, their components): one link for each outsider and component that it isn't in."""
        lo, hi = np.searchsorted(self.values, hashes, "left"), np.searchsorted(self.values, hashes, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.nodes))
        for i in np.flatnonzero(100 * common >= self.percent * (self.sizes + len(hashes) - common)).tolist():
            if self.components[i] != component and (i, component) not in self.found:
                self.found.add((i, component))
                yield self.nodes[i], node, self.components[i], component


def links_in_cells(cells: DataFrame, texts: DataFrame, k: int, percent: int, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """Links (a, b, ca, cb) of nodes and their components. ``cells`` has (cell, node, component, n, is_left): in each
    cell, left ones meet all of other components. Blocks are cut by shingles, so that a worker holds one block of left
    sets and a batch of others, however large a cell or its sets."""
    cost = F.col("n") + SET_COST
    sizes = cells.groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("is_left"), cost)) / left).alias("lefts"), F.ceil(F.sum(cost) / right).alias("rights")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_hashes(words(t), k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    sets = texts.join(cells.select("node").distinct(), "node").select("node", "text").mapInArrow(hashed, "node long, hashes binary")
    mixed = F.xxhash64("node")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = cells.drop("n").join(sizes.filter("lefts > 0"), "cell")
    lefts = placed.filter("is_left").withColumn("l", F.pmod(mixed, F.col("lefts"))).withColumn("r", all_of("rights"))
    rights = placed.withColumn("r", F.pmod(mixed, F.col("rights"))).withColumn("l", all_of("lefts")).withColumn("is_left", F.lit(False))
    dealt = lefts.unionByName(rights).join(sets, "node")
    rows = dealt.repartition("cell", "l", "r").sortWithinPartitions("cell", "l", "r", F.desc("is_left"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, block = None, [], None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            cell, l, r, is_left, node, component = (batch.column(i).to_pylist() for i in range(6))
            for i in range(batch.num_rows):
                if (cell[i], l[i], r[i]) != at:
                    at, waiting, block = (cell[i], l[i], r[i]), [], None
                mine = node[i], component[i], np.frombuffer(batch.column(6)[i].as_py(), np.uint64)
                if is_left[i]:
                    waiting.append(mine)
                elif waiting:
                    block = block or Block(waiting, percent)
                    out += block.links(*mine)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], names=["a", "b", "ca", "cb"])

    found = rows.select("cell", "l", "r", "is_left", "node", "component", "hashes").mapInArrow(compare, "a long, b long, ca long, cb long")
    return confirm(found, texts, k, percent)


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept, tag (a hash of the text).

    * A null, empty or all-white text has an empty set and is linked with nothing. One with fewer than ``k`` words has
      its whole sequence as its one shingle.
    * component_id is the smallest id that links reach; ties and copies have one result. A null id stands alone.
    * Rows that repeat an id are told apart by their texts: each has the component of its own text. Rows that repeat
      both get the same answer. Further columns are ignored.
    * An empty table gives an empty result.

    Copies (equal sets) collapse to one node before anything is compared. Texts are shuffled once, to pick those of
    nodes that share a bucket with another one.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tag"), F.col(f"`{text_col}`").alias("text"))
    sketches = stored(sketch_documents(docs, k, bands, rows))
    known = sketches.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "tag", F.col("n_shingles").alias("n"), "bands")).alias("s")).select("set_key", "s.*")
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()))  # written once: the numbers stay
    band_rows = sets.select(F.explode("bands").alias("key"), "node", "n")
    smallest = F.min(F.struct(F.col("node").alias("p"), F.col("n").alias("pn"))).alias("s")
    shared = band_rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), smallest).filter("c > 1").select("key", "s.*")
    members = stored(band_rows.join(shared, "key"))
    involved = sets.join(members.select("node").distinct(), "node").select("doc_id", "tag", "node")
    texts = stored(docs.join(involved, ["doc_id", "tag"]).select("node", "text").dropDuplicates(["node"]))

    # first, everything against the smallest of its bucket, where sets of such sizes can be similar enough
    alike = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent
    pairs = members.filter((F.col("node") != F.col("p")) & alike).select(F.col("p").alias("a"), F.col("node").alias("b")).distinct()
    labels = connected_components(confirm(pairs, texts, k, percent))

    # then, buckets in which several components are left
    placed = stored(members.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    in_key = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    ruling = in_key.groupBy("key").agg(F.max(F.struct("c", F.col("component").alias("cell"))).alias("m"), F.count(F.lit(1)).alias("apart"))
    ruling = ruling.filter("apart > 1").select("key", "m.cell")
    drawn = placed.join(ruling, "key").select("cell", "node", "component", "n", (F.col("component") != F.col("cell")).alias("is_left"))
    links = links_in_cells(stored(drawn.distinct()), texts, k, percent)
    merged = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    # a node's component, by its number and then by the smallest id
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    rooted = labels.unionByName(merged.select(F.col("component").alias("node"), "component")).distinct().join(merged, "component", "left")
    rooted = rooted.select("node", F.coalesce("root", "component").alias("root"))
    of_node = sets.select("set_key", "doc_id", "node").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of_node.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = of_node.join(named, "root").select("set_key", "component_id")
    out = sketches.select("doc_id", "tag", "n_shingles", "set_key").join(of_set, "set_key", "left")
    # a row without a set, or without an id, is its own component
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tag")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies of a document with a smaller id.

    Of rows that repeat the smallest id of a group with different texts, all stay; options as in ``near_duplicates``.
    """
    gone = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), "tag").distinct()
    here = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["tag"])
    return docs.join(gone, here, "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).drop("tag")
