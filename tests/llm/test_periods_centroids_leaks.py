import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, prose, save

from matchflow.llm import centroids as c
from matchflow.llm import decontamination as d
from matchflow.llm import periodic_runs as p

EMPTY = hashlib.sha256(b"").hexdigest()
VECTORS = "vec_id long, embedding array<float>, label int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs


def all_runs(w):
    """Every lag, every stretch; of equal stretches the smallest lag is the period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def by_start(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(texts):
    return p._batch([t.encode() for t in texts], 12)[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=70), min_size=1, max_size=4))
def test_runs_of_few_words(texts):
    assert runs_of([" ".join(t) for t in texts]) == [by_start(all_runs(t)) for t in texts]


def test_runs_of_planted_repeats():
    rng = random.Random(4)
    texts = []
    for i in range(60):
        block = prose(rng, rng.randint(1, 60), 80)
        texts.append(prose(rng, rng.randint(0, 80)) + block * rng.randint(2, 6) + block[: rng.randrange(len(block))] + prose(rng, rng.randint(0, 80)) + block * 2)
    fib = ["a"], ["a", "b"]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    texts += [fib[1], ["a"] * 3000, ["a", "b"] * 900 + ["c"] + ["a", "b"] * 900]
    found = runs_of([" ".join(t) for t in texts])
    assert found == [by_start(all_runs(t)) for t in texts]
    assert any(len(f) > 1 for f in found)


@pytest.mark.parametrize("words, runs", [("a b c d e f " * 2, [(0, 12, 6)]), ("a b c d e " * 2, []), ("x " * 11, []), ("x " * 12, [(0, 12, 1)]), ("q " + "a b c d e f g " * 2, [(1, 14, 7)])])
def test_runs_at_the_border_of_the_rule(words, runs):
    assert runs_of([words]) == [runs]


def test_splitting_leaves_only_words_that_repeat():
    w = np.array([1, 2, 3, *[7, 8] * 8, 4, 5, 1, 2, *[9] * 5, 3])
    lo, hi = p.split_segments(w, np.array([0]), np.array([len(w)]))
    assert list(zip(lo.tolist(), hi.tolist())) == [(3, 19)]
    # words that occur twice in the text, but once in what splitting leaves, go in a later round
    w = np.array([*range(30), 99, *range(29, -1, -1)])
    assert len(p.split_segments(w, np.array([0]), np.array([len(w)]))[0]) == 0


def brute_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
    runs = by_start(all_runs(w))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *most, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_of_runs_is_brute_force(spark, tmp_path, awkward):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 150), rng.choice([3, 40, 3000]))
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(text + (text[:20] * 3 if i % 3 == 0 else [])), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS).unionByName(awkward.filter("doc_id IS NULL OR doc_id NOT IN (7, 8)").select(*DOCS.replace(" long", "").replace(" string", "").split(", ")))
    sf = save(spark, tmp_path, documents=docs)
    got = p.op11_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted((brute_op11(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] > 0 for r in found) >= 5


def test_awkward_texts_have_runs(awkward, nothing):
    got = p.periodic_runs(awkward.withColumnRenamed("doc_id", "my id"), id_col="my id")
    rows = got.collect()
    assert len(rows) == awkward.count() and got.columns == ["my id", "n_words", "runs", "collapsed"]
    assert p.periodic_runs(nothing).count() == 0
    by_id = {r[0]: r for r in rows}
    assert by_id[1][1:] == (0, [], "") and by_id[3][1:] == (0, [], "") and by_id[4][1:] == (1, [], "one") and by_id[7]["n_words"] == 60_000


# --- centroids


def plain_lloyd(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted((sha(f"2:{i}"), v) for i, v in kept if i is not None) + sorted((("", v) for i, v in kept if i is None))
    centers = [v for _, v in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(v):
        ds = [far(v, m) for m in centers]
        return ds.index(min(ds)), min(ds)

    for _ in range(rounds):
        to = [near(v)[0] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), t in zip(kept, to) if t == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    of = [sum(x for _, t, x in last if t == j) for j in range(len(centers))]
    return [(i, t, x, of[t], sum(of), sha(",".join(map(str, centers[t])))) for i, t, x in last]


def test_query_of_clusters_is_plain_lloyd(spark, tmp_path):
    rng = np.random.default_rng(3)
    mean = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in np.float32(mean[i % 6] + rng.normal(size=64) * 0.6)], 0) for i in range(180)]
    rows += [(500, rows[0][1], 1), (500, rows[0][1], 1), (501, rows[0][1], 2), (None, rows[7][1], 0), (502, None, 0), (503, [], 0), (504, [0.5] * 63, 0), (505, [0.5] * 65, 0)]
    rows += [(506, [None, *[0.5] * 63], 0), (507, [float("nan"), *[0.5] * 63], 0), (508, [float("inf"), *[0.5] * 63], 0), (509, [0.0] * 64, 0), (510, [-0.001] * 64, 0)]
    sf = save(spark, tmp_path, embeddings=spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS v", "3 AS cluster", "4 AS chunk"))
    got = sorted(map(tuple, c.op12_centroid_clusters(spark, sf).collect()), key=str)
    assert got == sorted(plain_lloyd([r[:2] for r in rows]), key=str)
    assert len(got) == 180 + 4 + 2


def test_clusters_without_rows(spark, tmp_path):
    sf = save(spark, tmp_path, embeddings=spark.createDataFrame([], VECTORS))
    assert c.op12_centroid_clusters(spark, sf).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    found, centers = c.centroid_clusters(few, k=5, dim=2)
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, 0, 0), (2, 0, 0)] and centers.tolist() == [[256, 512], [256, 512]]


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="too large to cluster"):
        c.centroid_clusters(spark.createDataFrame([(1, [1e30] * 2, 0)], VECTORS), dim=2)


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for big in (300, c.LARGEST):
        x, s = rng.integers(-big, big, (50, 17)), rng.integers(-big, big, (9, 17))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in s] for u in x]
        assert c.distances(x, s).tolist() == want


def test_dimensions_are_cut_into_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-200, 200, (300, 37))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<int>").repartition(3)
    found, centers = c.lloyd(df, x[:7], 3)
    want = x[:7]
    for _ in range(3):
        to = ((x[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([x[to == j].sum(axis=0) // (to == j).sum() if (to == j).any() else want[j] for j in range(7)])
    assert centers.tolist() == want.tolist()
    last = ((x[:, None] - want[None]) ** 2).sum(axis=2)
    assert {r["id"]: (r["cluster"], r["distance"]) for r in found.collect()} == {i: (int(v.argmin()), int(v.min())) for i, v in enumerate(last)}


# --- decontamination


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = fold(text)
        for i in range(len(w) - min(n, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, named = fold(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    named |= windows[tuple(w[i : i + size])]
        ids = sorted(str(x) for x in named if x is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def leak_tables(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 30]), 400))) for i in range(40)] + [(40, None), (41, ""), (42, "?!"), (None, " ".join(prose(rng, 30))), (3, "another text of the third item that has enough words to be found"), (44, "Ärger über 12 ÄPFEL x")]
    rows = []
    for i in range(150):
        w = prose(rng, rng.randint(0, 120), 400)
        if i % 3 == 0:
            item = fold(rng.choice(items)[1]) or ["x"]
            cut = item[rng.randrange(len(item)) :] if i % 2 else item[: rng.randint(1, len(item))]
            at = rng.randint(0, len(w))
            w = w[:at] + cut + w[at:]
        rows.append((i, rng.choice([" ", "-", ", ", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    return rows + [(1, rows[0][1]), (200, "ärger über 12 Äpfel X"), (201, "Ärger Über 12 ÄPFEL x"), (202, items[-3][1] * 2)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_query_of_leaks_is_brute_force(spark, tmp_path, awkward, seed):
    rows, items = leak_tables(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward.select("doc_id", "text")).selectExpr("*", "'x' AS n_words", "1 AS row", "2 AS window")
    sf = save(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS size", "8 AS print"))
    got = d.op13_decontamination(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain_hits([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[-1] for w in want) > 30 and sum(w[3] > 1 for w in want) > 5


def test_leaks_of_empty_tables(spark, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, d.contamination(docs, items).collect())) == [(1, 2, 0, 0, []), (2, 0, 0, 0, [])]
    assert d.contamination(nothing, docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(1, 12))
def test_any_shared_span_shares_a_fingerprint(text, n):
    h = d._hashes([w.encode() for w in text])
    all_at, all_h = d.winnow(h, n)
    for i in range(len(text) - n + 1):
        inside = set(d.winnow(h[i : i + n], n)[1].tolist())
        assert inside & set(all_h[(all_at >= i) & (all_at <= i + n - d.gram_size(n))].tolist())


def test_a_full_map_loses_nothing(spark):
    rows, items = leak_tables(5)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ones = np.full(1 << d.BITS - 3, 255, np.uint8)
    few = d.winnowed(docs, [10], d.bit_map(spark.createDataFrame([], "print long")))
    many = d.winnowed(docs, [10], ones)
    assert all(not r["hits"] for r in few.collect()) and sum(len(r["hits"]) for r in many.collect()) > 1000
    a = sorted(map(tuple, d.contamination(docs, bench).collect()), key=str)
    keep = d.bit_map
    try:
        d.bit_map = lambda prints: ones
        assert sorted(map(tuple, d.contamination(docs, bench).collect()), key=str) == a
    finally:
        d.bit_map = keep
