"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run of length >= max(min_words, 2 * period) holds each of its words twice at least. So a word that occurs once in a
segment of a text is in no run of the segment and splits it; what it leaves are shorter segments, in which further words
occur once. This is repeated until no segment changes; those shorter than a run go. Text without repeats is gone after
a few rounds, so that the lag scan sees little of it.

A surviving segment is scanned at every lag q up to half its length for stretches of max(min_words - q, q) or more words
that equal the word q further on. Any such stretch holds three neighbours of a grid of a third of that step, and these
are tried first, with points between them: grids of all lags together have about 3 * n * ln(n) points. Only where they
agree words are compared one by one. Lags that are a multiple of the period of a run found around them are left out, as
they can only find that run again. Documents are scanned together, a batch of bounded size at a time.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import map_text, table

MIN_WORDS = 12
#: Grid points tried at once, and points tried between the ends of three neighbours.
POINTS, BETWEEN = 1 << 20, 9


def split_segments(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The segments [lo, hi) of ``words`` (numbers) split at words that occur once in them, again and again, until all
    words of each occur twice; those shorter than ``min_words`` are left out. Only segments that changed are split again."""
    done_lo, done_hi = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    keep = hi - lo >= min_words
    lo, hi = lo[keep], hi[keep]
    span = np.int64(words.max()) + 1 if len(words) else 1
    while len(lo):
        n = hi - lo
        of = np.repeat(np.arange(len(lo)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        key = of * span + words[at]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        single = ~(np.append(same, False) | np.append(False, same))
        cut = np.zeros(len(key), bool)
        cut[order] = single
        changed = np.bincount(of, cut, len(lo)) > 0
        done_lo.append(lo[~changed])
        done_hi.append(hi[~changed])
        # pieces of the changed ones: a piece starts at a kept word that follows a cut one or the segment's start
        here = ~cut & changed[of]
        first = here & np.append(True, ~here[:-1] | (of[1:] != of[:-1]))
        last = here & np.append(~here[1:] | (of[1:] != of[:-1]), True)
        lo, hi = at[first], at[last] + 1
        keep = hi - lo >= min_words
        lo, hi = lo[keep], hi[keep]
    return np.concatenate(done_lo), np.concatenate(done_hi)


def _reach(words: np.ndarray, i: int, q: int, end: int, step: int) -> int:
    """The last place from ``i`` in direction ``step``, short of ``end``, up to which words equal those ``q`` further on."""
    chunk = 16
    while i != end:
        n = min(chunk, abs(end - i))
        a, b = (i, i + n) if step > 0 else (i - n, i)
        wrong = np.flatnonzero(words[a:b] != words[a + q : b + q])
        if len(wrong):
            return a + int(wrong[0]) if step > 0 else a + int(wrong[-1]) + 1
        i, chunk = (b if step > 0 else a), chunk * 4
    return end


def _agreeing(words: np.ndarray, lo: np.ndarray, m: np.ndarray, q: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, lag, place, place): per row of segment and lag, where three neighbours of its grid and points between agree,
    as ranges of neighbours in a row."""
    points = (m - q - 1) // s + 1
    row = np.repeat(np.arange(len(q)), points)
    j = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
    at, lag = lo[row] + j * s[row], q[row]
    hit = words[at] == words[at + lag]
    three = hit[:-2] & hit[1:-1] & hit[2:] & (row[:-2] == row[2:])
    c = np.flatnonzero(three)
    for k in range(1, BETWEEN + 1):
        p = at[c] + 2 * s[row[c]] * k // (BETWEEN + 1)
        c = c[words[p] == words[p + lag[c]]]
    if not len(c):
        return
    start = np.flatnonzero(np.append(True, (np.diff(c) > 1) | (row[c][1:] != row[c][:-1])))
    stop = np.append(start[1:], len(c)) - 1
    for a, b in zip(c[start].tolist(), c[stop].tolist()):
        yield int(row[a]), int(lag[a]), int(at[a]), int(at[b + 2])


def scan_lags(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) within the segments, by start, then length."""
    found: dict[tuple[int, int], int] = {}
    start_of, end_of, period_of = (np.zeros(len(words), np.int64) for _ in range(3))  # of one run at each word
    low = 1
    while len(lo):
        keep = hi - lo >= max(min_words, 2 * low)
        lo, hi = lo[keep], hi[keep]
        m = hi - lo
        lags = np.minimum(m // 2, 2 * low - 1) - low + 1
        seg = np.repeat(np.arange(len(lo)), lags)
        q = low + np.arange(lags.sum()) - np.repeat(np.cumsum(lags) - lags, lags)
        least = np.maximum(min_words - q, q)
        s = np.maximum(1, least // 3)
        size = np.cumsum((m[seg] - q - 1) // s + 1)
        cuts = [0, *np.flatnonzero(np.diff(size // POINTS)) + 1, len(q)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            of = seg[a:b]
            for r, lag, p0, p1 in _agreeing(words, lo[of], m[of], q[a:b], s[a:b]):
                # inside one known run whose period divides the lag, and then it is the same run
                if period_of[p0] and lag % period_of[p0] == 0 and start_of[p0] <= p0 and p1 + lag < end_of[p0]:
                    continue
                seg_lo, seg_hi, need = int(lo[of[r]]), int(hi[of[r]]), max(min_words - lag, lag)
                left = _reach(words, p0, lag, seg_lo, -1)
                right = _reach(words, p1, lag, seg_hi - lag, 1)
                wrong = np.flatnonzero(words[left:right] != words[left + lag : right + lag]) + left
                for x, y in zip([left, *(wrong + 1).tolist()], [*wrong.tolist(), right]):
                    if y - x >= need and found.get((x, y + lag), lag) >= lag:
                        found[x, y + lag] = lag
                        inner = slice(x, y + lag)
                        start_of[inner], end_of[inner], period_of[inner] = x, y + lag, lag
        low *= 2
    return sorted((x, y - x, p) for (x, y), p in found.items())


def _batch(texts: list[bytes | None], min_words: int) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text: number of words, runs by start and period, and the text without repeats."""
    number = defaultdict(itertools.count().__next__)
    all_words = [(t or b"").split() for t in texts]
    n = np.array([len(w) for w in all_words], np.int64)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(all_words)), np.int64, int(n.sum()))
    ends = np.cumsum(n)
    base = ends - n
    lo, hi = split_segments(ids, base, ends, min_words)
    order = np.argsort(lo)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in scan_lags(ids, lo[order], hi[order], min_words):
        d = int(np.searchsorted(ends, start, "right"))
        runs[d].append((start - int(base[d]), length, period))
    kept = []
    for w, of_text in zip(all_words, runs):
        of_text.sort(key=lambda r: (r[0], r[2]))
        if of_text:
            gone = np.zeros(len(w) + 1, np.int64)
            for start, length, period in of_text:
                gone[start + period] += 1
                gone[start + length] -= 1
            w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        kept.append(b" ".join(w))
    return n.tolist(), runs, kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each input row: id, n_words, runs array<struct<start, length, period>> by start, then period, and
    collapsed: the words that no run contains after its first period, joined by one space.

    * Words are what stands between ASCII white space, case and punctuation as they are. A run is a stretch of words
      whose smallest period is ``period``, at least ``min_words`` and twice its period long, that can be extended on
      neither side. Runs may overlap; each is listed.
    * A null, empty or white text has no words, no runs and an empty ``collapsed``.
    * Rows that repeat an id, or a text, or have a null id, each give their own row. Further columns are ignored.
    * An empty table gives an empty result. A text of any length is worked on as a whole; time is about n * log(n) in its
      words, and up to n * n for a text made so that each round of splitting takes a word or two.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, runs, kept = _batch(batch.column(1).cast(pa.binary()).to_pylist(), min_words)
        shape = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in of] for of in runs], pa.list_(shape))
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_text(docs, [id_col, text_col], text_col, run, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the end of every tenth text (by the id's CRC) made periodic."""
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    chosen = d.withColumn("words", F.when(F.col("h") % 10 == 0, split)).withColumn("n", F.size("words"))
    a = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    p = a.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return p.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run with the greatest length; ties: the smallest start, then the smallest period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest(F.col("runs")).alias("best"), listed.alias("lines"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
