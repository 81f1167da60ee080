"""The best personas of each kind of posting: blocks of kinds against blocks of personas, by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.functions import constants as C

ROWS = 8192  # of a block at most, on average
SLICE = 1024  # kinds worked on at once
WORDS = 1024  # tags worked on at once
SCALE = 1e9  # scores are compared by nine digits


def entries(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Length of each list (-1: null), and the row and value of each entry."""
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, np.repeat(np.arange(len(size)), np.maximum(size, 0)), lists.flatten()


def incidence(lists: pa.ListArray, words: pa.Array) -> np.ndarray:
    """How often each row's list has each of the words."""
    size, row, value = entries(lists)
    at = pc.index_in(value, words)
    cells = row[at.is_valid().to_numpy(zero_copy_only=False)] * len(words) + at.drop_null().to_numpy()
    return np.bincount(cells, minlength=len(size) * len(words)).reshape(len(size), len(words)).astype(np.float32)


def shared(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """For each row of ``a`` and of ``b`` the number of common entries (repeats count)."""
    words = pc.unique(a.flatten()).drop_null()
    words = words.filter(pc.is_in(words, pc.unique(b.flatten())))
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(words), WORDS):
        some = words.slice(i, WORDS)
        out += incidence(a, some) @ incidence(b, some).T
    return out


def matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows filled up with zeros, their lengths (-1: null, or with a null component) and their norms."""
    size, row, value = entries(vectors)
    first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out = np.zeros((len(size), width))
    out[row, np.arange(len(row)) - first[row]] = pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
    size[row[value.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, size, np.sqrt(np.einsum("ij,ij->i", out, out))


def best_of_block(kinds: pa.Table, personas: pa.Table, k: int, min_overlap: int, max_distance: float, strict: bool) -> pa.Table:
    """(kind, persona_id, applicant_id, overlap, distance, points): the best ``k`` of a block of personas for each of a block
    of kinds. Tags decide first, then the distances of the pairs that are left; ties by persona."""
    personas = personas.take(pc.sort_indices(personas["persona_id"]))
    found = []
    width = max([pc.max(pc.list_value_length(t["vector"])).as_py() or 0 for t in (kinds, personas)])
    b = {c: personas[c].combine_chunks() for c in personas.column_names}
    p, p_size, p_norm = matrix(b["vector"], width)
    for at in range(0, kinds.num_rows if personas.num_rows else 0, SLICE):
        a = {c: kinds[c].slice(at, SLICE).combine_chunks() for c in kinds.column_names}
        overlap = shared(a["have"], b["wants"])
        fits = overlap >= min_overlap
        if strict:
            fits &= (shared(a["have"], b["marks"]) > 0) & (shared(a["lists"], b["bars"]) == 0) & (shared(a["lacks"], b["needs"]) == 0)
        v, size, norm = matrix(a["vector"], width)
        row, col = np.nonzero(fits)
        with np.errstate(all="ignore"):
            norms = norm[row] * p_norm[col]
            known = (size[row] == p_size[col]) & (size[row] >= 0) & (norms != 0)
            distance = np.where(known, 1 - (v @ p.T)[row, col] / norms, 1.0)
            near = distance < max_distance
        row, col, distance = row[near], col[near], distance[near]
        n = overlap[row, col].astype(np.int64)
        score = C.TAG_WEIGHT * (1 - np.exp(-0.4 * np.minimum(n, 5))) + C.VECTOR_WEIGHT * (1 - distance)
        points = np.rint(score * SCALE).astype(np.int64)
        order = np.lexsort((col, -points, row))
        sorted_rows = row[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]
        to = pa.array(col[order])
        found.append([a["kind"].take(pa.array(row[order])), b["persona_id"].take(to), b["applicant_id"].take(to), pa.array(n[order]), pa.array(distance[order]), pa.array(points[order])])
    names = ["kind", "persona_id", "applicant_id", "overlap", "distance", "points"]
    if not found:
        kinds, personas = kinds.slice(0, 0), personas.slice(0, 0)
        found = [[kinds["kind"].combine_chunks(), personas["persona_id"].combine_chunks(), personas["applicant_id"].combine_chunks(), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())]]
    return pa.concat_tables([pa.table(columns, names) for columns in found])


def best_personas(kinds: DataFrame, personas: DataFrame, k: int, min_overlap: int, max_distance: float, strict: bool) -> DataFrame:
    """(kind, persona_id, applicant_id, overlap, distance, rank): the best ``k`` of all personas for each kind.

    ``kinds`` (kind, have, lists, lacks, vector) and ``personas`` (persona_id, applicant_id, wants, marks, bars, needs, vector)
    are cut into blocks by hash, and each block of one meets each of the other in a task, which gives ``k`` rows a kind; the
    last window sees those alone. What is sent is each side once for every block of the other, never a pair.
    """
    cores = personas.sparkSession.sparkContext.defaultParallelism
    n, m = kinds.count(), personas.count()
    across = max(1, -(-m // ROWS))
    down = max(1, -(-n // ROWS), min(-(-n // 256), -(-2 * cores // across)))
    block = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = kinds.withColumn("a", block("kind", down)).withColumn("b", every(across))
    b = personas.withColumn("b", block("persona_id", across)).withColumn("a", every(down))
    kind_of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"kind {kind_of(kinds, 'kind')}, persona_id {kind_of(personas, 'persona_id')}, applicant_id {kind_of(personas, 'applicant_id')}, overlap long, distance double, points long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left.drop_columns(["a", "b"]), right.drop_columns(["a", "b"]), k, min_overlap, max_distance, strict)

    found = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(run, schema)
    best = W.partitionBy("kind").orderBy(F.desc("points"), "persona_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("points")
