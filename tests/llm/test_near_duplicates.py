import random

import numpy as np
import pytest
from llm_helpers import DOCS, prose, save

from matchflow.llm import components as c
from matchflow.llm import minhash_dedup as m
from matchflow.llm import substring_dedup as x


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(80)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5)],
    }[shape]
    got = {r["node"]: r["component"] for r in c.connected_components(spark.createDataFrame(links + [(None, 1)], "a long, b long")).collect()}
    assert got == classes({n for link in links for n in link}, links)
    assert c.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40, 600, 5000])
def test_sketch_is_full_and_estimates(n):
    h = np.unique(np.random.default_rng(n).integers(0, 2**62, 3 * n).astype(np.uint64))
    a, b = h[: 2 * n], h[n:]
    agree = (m.fast_sketch(a, 240) == m.fast_sketch(b, 240)).mean()
    real = len(np.intersect1d(a, b)) / len(h)
    assert abs(agree - real) < 0.15
    assert (m.fast_sketch(a, 240) > 0).all() and (m.fast_sketch(a, 240) == m.fast_sketch(a.copy(), 240)).all()


def near_rows():
    rng = random.Random(11)
    rows = []
    for size, copies, edits in ((150, 60, 12), (400, 20, 30), (30, 10, 2)):
        base = prose(rng, size)
        for _ in range(copies):  # mutual similarity is often below the threshold, to the base it is about there
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(size)] = rng.choice(["new", "other", *prose(rng, 1)])
            rows.append(" ".join(words))
    rows += [" ".join(prose(rng, rng.randint(1, 80))) for _ in range(80)] + [rows[3].upper().replace(" ", "\n")] * 3
    rng.shuffle(rows)
    return [(10 + i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_brute_force(spark, k):
    rows = near_rows() + [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (4, "ONE", "en", "s", 3), (5, " \t", "en", "s", 2)]
    sets = {r[0]: m.shingle_set(m.words(r[1]), k) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = m.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want) - (50 if k == 2 else 10)  # there are groups to find


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing, tmp_path):
    got = m.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[8]["component_id"] == 7 and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"] and by[1]["n_shingles"] == 0
    assert m.near_duplicates(nothing).count() == 0
    at = save(spark, tmp_path, documents=awkward.select("doc_id", "text"))
    assert m.op8_minhash_dedup(spark, at).count() == awkward.count()


def test_a_large_group_of_near_copies_meets_in_blocks(spark):
    rng = random.Random(4)
    base, rows = prose(rng, 120), []
    for i in range(1200):  # nearly every copy is within the limit of some other, most pairs are not
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(120)] = prose(rng, 1)[0]
        rows.append((i, " ".join(words), "en", "s", 1))
    sets = {r[0]: m.shingle_set(m.words(r[1]), 2) for r in rows}
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) < 0.7 * 600 * 1200
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(spark.createDataFrame(rows, DOCS), k=2).collect()}
    assert got == classes(sets, links)


def test_cells_do_not_depend_on_block_sizes(spark):
    rows = [r for r in near_rows() if r[1]]
    cells = spark.createDataFrame([(0, r[0], r[0], len(m.shingle_set(m.words(r[1]), 2)), r[0] != 10) for r in rows], "cell long, node long, component long, n long, is_left boolean")
    texts = spark.createDataFrame([r[:2] for r in rows], "node long, text string")
    sets = {r[0]: m.shingle_set(m.words(r[1]), 2) for r in rows}
    want = {(a, b) for a in sets for b in sets if a != b and a != 10 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for left, right in ((m.LEFT, m.RIGHT), (3000, 5000)):
        assert {(r["a"], r["b"]) for r in m.links_in_cells(cells, texts, 2, 80, left, right).collect()} == want


def test_rows_that_repeat_an_id_keep_their_own_texts(spark):
    rng = random.Random(8)
    one, other = " ".join(prose(rng, 60)), " ".join(prose(rng, 60))
    rows = [(1, one, None, None, None), (2, one + " end", None, None, None), (2, other, None, None, None), (2, other, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS tag", "1 AS gone_id", "2 AS set_key")
    assert [(r["doc_id"], r["text"], r["tag"]) for r in m.keep_one_of_each(docs).orderBy("doc_id").collect()] == [(1, one, "x"), (2, other, "x"), (2, other, "x")]


def test_chains_follow_both_orders():
    pos, spos = np.array([0, 10, 20, 30, 12]), np.array([5, 15, 25, 35, 90])
    assert x.chains(pos, spos)[0] == [0, 1, 2, 3]
    far = x.chains(np.array([0, 500]), np.array([0, 900]))
    assert sorted(map(tuple, far)) == [(0,), (1,)]


def test_chain_scores_are_optimal():
    rng = random.Random(5)
    link = lambda pos, spos, i, j: x.K - x.GAP_COST * (pos[j] - pos[i] + spos[j] - spos[i])
    for _ in range(100):
        pos, spos = np.array([[rng.randrange(60) for _ in range(15)] for _ in range(2)])
        best = {}
        for j in sorted(range(15), key=lambda i: (pos[i], spos[i])):  # brute force: over all predecessors
            best[j] = max([x.K] + [best[i] + link(pos, spos, i, j) for i in best if pos[i] < pos[j] and spos[i] < spos[j]])
        chain = x.chains(pos, spos)[0]
        assert all(pos[i] < pos[j] and spos[i] < spos[j] for i, j in zip(chain, chain[1:]))
        assert x.K + sum(link(pos, spos, i, j) for i, j in zip(chain, chain[1:])) == max(best.values())


def passage_rows():
    rng = random.Random(2)
    passage = prose(rng, 70)
    rows = [(i, " ".join(prose(rng, rng.randint(60, 150), 50_000)), "en", "s", 1) for i in range(40)]
    planted = {}
    for i in range(0, 40, 4):
        words, p = rows[i][1].split(), list(passage)
        for _ in range(i % 3):
            p[rng.randrange(len(p))] = "changed"
        if i % 8 == 4:
            del p[35]
        at = rng.randrange(len(words))
        planted[i] = (at, at + len(p))
        rows[i] = (i, " ".join(words[:at] + p + words[at:]), "en", "s", 1)
    return rows, planted


def test_planted_passages_are_found(spark, tmp_path):
    rows, planted = passage_rows()
    found = {}
    for r in x.op3_substring_dedup(spark, save(spark, tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
        assert r["identity"] >= 0.8 and r["n_words"] >= 50
    assert set(found) == set(planted)
    for i, (start, end) in planted.items():
        assert any(abs(s - start) <= 4 and abs(e - end) <= 4 for s, e in found[i]), (i, planted[i], found[i])


@pytest.mark.parametrize("gap", [31, 60, 100])
def test_passages_apart_are_each_found(spark, gap):
    rng = random.Random(gap)
    first, second = prose(rng, 60, 10**6), prose(rng, 60, 10**6)
    texts = [prose(rng, 40, 10**6) + first + prose(rng, gap, 10**6) + second + prose(rng, 40, 10**6) for _ in range(2)]
    found = x.repeated_passages(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()
    want = [(40, 100), (100 + gap, 160 + gap)]
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_start"], r["other_end"]) for r in found) == [(i, *w, *w) for i in (0, 1) for w in want]


@pytest.mark.parametrize("kind", ["alone", "reversed", "twice"])
def test_passages_made_of_earlier_lines_are_found(spark, kind):
    rng = random.Random(3)
    words = lambda n: prose(rng, n, 10**6)
    texts, want = [], set()
    for _ in range(12):
        lines = [words(40) for _ in range(3)]
        early = [line + after[:7] for line, after in zip(lines, [*lines[1:], []])]  # every window of eight words, too short for a passage
        b = len(texts)
        if kind == "alone":
            texts += [words(50) + line + words(50) for line in early]
        elif kind == "reversed":
            texts += [sum((words(90) + line for line in reversed(early)), []) + words(50)]
        else:  # the first document has the passage, and its lines before it
            texts += [sum((line + words(300) for line in reversed(early)), []) + sum(lines, []) + words(50)]
        c = len(texts)
        texts += [words(30) + sum(lines, []) + words(30) for _ in range(2)]
        want |= {(c, b), (c + 1, b)} if kind == "twice" else {(c, c + 1), (c + 1, c)}
    found = x.repeated_passages(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()
    assert want <= {(r["doc_id"], r["other_id"]) for r in found if (r["start_word"], r["end_word"]) == (30, 150)}


def test_passages_are_followed_to_their_ends(spark):
    rng = random.Random(6)
    words = lambda n: prose(rng, n, 10**6)
    long = words(1000)
    rows = [(0, long[:700]), (1, words(30) + long + words(30)), (2, words(50) + long)]  # all but 300 words have their seeds in the first
    found = x.repeated_passages(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], DOCS)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found if r["other_id"] == 0} == {(1, 30, 730), (2, 50, 750)}
    assert {(r["start_word"], r["end_word"]) for r in found if (r["doc_id"], r["other_id"]) == (2, 1)} == {(50, 1050)}


def test_copies_of_halves_do_not_hide_a_passage(spark):
    rng = random.Random(9)
    words = lambda n: prose(rng, n, 10**6)
    p = words(90)
    texts = [words(40) + p[:49] + words(40), words(40) + p[41:] + words(40), words(40) + p + words(40), words(60) + p + words(40)]
    found = x.repeated_passages(spark.createDataFrame([(i + 1, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found if r["other_id"] in (3, 4)} >= {(3, 40, 130), (4, 60, 150)}


def test_winnowing_matches_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 5, 6, 20, 21, 22, 37, 200):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        at, value = x.seeds(h, 6, 16)
        every = x.seeds(h, 6, 1)[1].view(np.uint64)  # each place is its own window
        m = len(every)
        want = {i + int(every[i : i + 16].argmin()) for i in range(max(1, m - 15))} if m else set()
        assert set(at.tolist()) == want and (value.view(np.uint64) == every[at]).all()


@pytest.mark.parametrize("changed, least", [(0.0, 1.0), (0.05, 0.97), (0.1, 0.9)])
def test_recall_of_edited_passages(spark, changed, least):
    """Each pair alone: every passage of at least the limits is known, so that recall is exact."""
    rng = random.Random(int(100 * changed))
    words = lambda n: prose(rng, n, 10**6)
    rows, want = [], []
    for i in range(60):
        p = words(100)
        q = [w if rng.random() >= changed else words(1)[0] for w in p]
        rows += [(2 * i, words(30) + p + words(30)), (2 * i + 1, words(50) + q + words(20))]
        want.append((2 * i + 1, 50, 150))
    found = {}
    for r in x.repeated_passages(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], DOCS)).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    hits = sum(any(min(e, f) - max(s, t) >= 80 for s, e in found.get(i, ())) for i, t, f in want)
    assert hits >= least * len(want)
    assert all(50 - 8 <= s and e <= 150 + 8 for i, t, f in want for s, e in found.get(i, ()))


def test_words_between_changes_count_as_equal():
    a = np.arange(40)
    b = a.copy()
    b[[9, 11, 13, 15]] = -1
    assert sum(n for *_, n in x.align(a, b, [(0, 0), (20, 20)])[0]) == 35  # a step over three words passes one by


def test_equal_words_are_counted_as_one_by_one():
    r = random.Random(5)
    for n in (0, 1, 7, 8, 9, 40, 41, 200, 3000):
        for _ in range(20):
            a = [r.randrange(3) for _ in range(n + 5)]
            b = a[2 : 2 + n] + [9] * 4
            for _ in range(r.choice([0, 1, 3]) if n else 0):
                b[r.randrange(n)] = 7
            want = next((m for m in range(n) if a[2 + m] != b[m]), n)
            assert x.equal_words(a, b, 2, 0, n) == want


def test_a_walk_keeps_to_its_part_on_either_side():
    a = list(range(100))
    runs, end_a, end_b = x.walk(a, a, 10, 30, 10, 60)
    assert runs == [(10, 10, 20)] and end_a and not end_b
    b = a[:20] + [-1] + a[20:]
    assert x.align(a, b, [(5, 5)], turned=(a[::-1], b[::-1])) == x.align(a, b, [(5, 5)]) == ([(0, 0, 20), (20, 21, 80)], False)


def test_passages_of_an_alignment_match_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        runs, i, j = [], 0, 0
        for _ in range(rng.randint(1, 9)):
            i, j, n = i + rng.randint(1, 12), j + rng.randint(1, 12), rng.randint(1, 40)
            runs.append((i, j, n))
            i, j = i + n, j + n
        good = set()  # (first run, last run)
        for l in range(len(runs)):
            for r in range(l, len(runs)):
                sides = [runs[r][c] + runs[r][2] - runs[l][c] for c in (0, 1)]
                if min(sides) >= 50 and sum(n for *_, n in runs[l : r + 1]) >= 0.8 * max(sides):
                    good.add((l, r))
        got = []
        for s, e, t, f, equal in x.passages(runs):
            l, r = [a for a, _, _ in runs].index(s), [a + n for a, _, n in runs].index(e)
            assert (t, f, equal) == (runs[l][1], runs[r][1] + runs[r][2], sum(n for *_, n in runs[l : r + 1]))
            got.append((l, r))
        assert set(got) <= good
        assert {k for l, r in got for k in range(l, r + 1)} == {k for l, r in good for k in range(l, r + 1)}


def test_passages_of_awkward_rows(awkward, nothing):
    got = x.repeated_passages(awkward).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(7, 8), (8, 7)}
    assert all((r["start_word"], r["end_word"]) == (0, 60_000) for r in got)
    assert x.repeated_passages(nothing).count() == 0
