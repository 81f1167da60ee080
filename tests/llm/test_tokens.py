import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_helpers import save
from tokenizers import Tokenizer

from matchflow.llm import byte_bpe as b
from matchflow.llm import packing as p
from matchflow.llm import token_counts as t

ALPHABET = "aeiou thns'’\n\t\x1c\x1e\x85\xa0　éüßΣςİıẞ1２3四五,.!?-_/@#😀<|endoftext|> ́é Å ﬁ Ω​﻿quickTHEing"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += [s + "<|endoftext|>" + s[:9] + "<|startoftext|>" for s in out[:200]] + ["", " ", "\n\n", "ab" * 500, "  a \n b  ", "a\n \nb"]
    return out + [c * rng.randint(2, 400) for c in ("a", "th", "1", "-=", "\n ", "hello")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(t.WORD_BPE)


@pytest.mark.parametrize("chunk", [1, 3, 7, 16_384])
def test_transducer_counts_as_the_library(texts, library, monkeypatch, chunk):
    monkeypatch.setattr(t, "CHUNK", chunk)
    c = t.TextCounter(t.WORD_BPE)
    for s in texts[:: 1 if chunk > 100 else 4]:
        assert c.count(s) == len(library.encode(s, add_special_tokens=False).ids), repr(s)


def test_transducer_survives_small_tables(texts, library, monkeypatch):
    monkeypatch.setattr(t, "MAX_STATES", 50)
    monkeypatch.setattr(t, "MAX_WORDS", 20)
    c = t.TextCounter(t.WORD_BPE)
    assert [c.count(s) for s in texts[:200]] == [len(library.encode(s, add_special_tokens=False).ids) for s in texts[:200]]


def test_chunk_maps_are_a_monoid():
    c = t.TextCounter(t.WORD_BPE)
    maps = [c.chunk_map(s) for s in ("the qui", "ck", "br own fo", "", "x ", " y")]
    left = right = maps[0]
    for m in maps[1:]:
        left = c.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = c.compose(m, right)
    assert left == right == c.scan(maps)[-1]


def test_token_counts_of_awkward_rows(awkward, nothing, library):
    got = sorted(map(tuple, t.token_counts(awkward).collect()), key=str)
    want = []
    for r in awkward.collect():
        s = r["text"] or ""
        n = len(library.encode(s, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(s.encode()), n, n > 2048))
    assert got == sorted(want, key=str) and t.token_counts(nothing).count() == 0


def test_byte_bpe_is_tiktoken(texts):
    c = b.codec(b.BYTE_BPE)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.rank, special_tokens={})
    for s in texts:
        ids = c.encode(s)
        assert ids == own.encode_ordinary(s), repr(s)
        assert c.decode(ids) == s.encode()


def test_join_is_the_encoding_of_both():
    c, rng = b.codec(b.BYTE_BPE), random.Random(2)
    for _ in range(500):
        raw = bytes(rng.choice(b"abcethnio \xc3\xa9\xff") for _ in range(rng.randint(2, 40)))
        cut = rng.randint(0, len(raw))
        assert c.join(c.encode_bytes(raw[:cut]), c.encode_bytes(raw[cut:])) == c.merge(raw) == c.encode_bytes(raw)


def test_round_trip_of_awkward_rows(awkward, nothing):
    want = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in awkward.collect()}
    got = b.round_trip(awkward).collect()
    assert {(r["doc_id"], r["decoded_sha256"]) for r in got} == want and len(got) == awkward.count()
    decoded = b.decode_texts(b.encode_texts(awkward.select("doc_id", "text")))
    assert {hashlib.sha256(bytes(r["raw"])).hexdigest() for r in decoded.collect()} == {h for _, h in want}
    assert b.round_trip(nothing).count() == 0


def test_ids_for_packing_are_the_library_s(texts, library):
    for s, raw in zip(texts, p.IdEncoder(p.WORD_BPE).batch(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_placement_fills_windows():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 5000)
    sequence, offset = p.place(lengths, 100)
    used = np.zeros((sequence.max() + 1, 100), int)
    for s, o, n in zip(sequence, offset, lengths):
        used[s, o : o + n] += 1
    assert used.max() == 1
    fill = used.sum(axis=1)
    assert all(used[s, : fill[s]].all() for s in range(len(used)))  # gapless from 0
    # what stays open is about the square root of the items, in windows: the share falls as items grow
    def waste(n):
        fill = np.bincount(p.place(lengths[:n], 100)[0], lengths[:n]).astype(int)
        return (100 - fill[fill & (fill - 1) != 0]).sum() / lengths[:n].sum()

    assert waste(5000) < 0.7 * waste(1250) and waste(5000) < 0.03
    assert p.place(np.empty(0, np.int64), 100)[0].size == 0


def test_placement_is_sum_of_squares():
    lengths, window = np.random.default_rng(3).integers(1, 12, 60), 12
    fills, at = [], []
    partly = [level for level in range(1, window) if level & (level - 1)]  # one filled to a power of two needs no padding
    for n in lengths.tolist():  # brute force over levels
        count = np.bincount([f for f in fills if f < window], minlength=window + 1)
        options = []
        for level in [0] + [h for h in range(1, window) if count[h]]:
            if level + n <= window:
                c = count.copy()
                c[level] -= level > 0
                c[level + n] += level + n < window
                options.append(((c[partly] ** 2).sum(), -level))
        level = -min(options)[1]
        at.append(level)
        fills.append(level + n) if not level else fills.__setitem__(fills.index(level), level + n)
    assert p.place(lengths, window)[1].tolist() == at


def check_pieces(rows, docs, library, window=4096):
    want = [library.encode(text or "", add_special_tokens=False).ids + [2] for _, text in docs]
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for (doc, _), ids in zip(docs, want):
        mine = sorted(pieces[doc], key=lambda r: r["start"])
        times = sum(1 for d, _ in docs if d == doc)
        if times > 1:
            continue
        assert [r["start"] for r in mine] == list(range(0, len(ids), window))
        for r in mine:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_packing_of_awkward_rows(awkward, nothing, library):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_pieces(p.pack_documents(awkward).collect(), docs, library)
    assert p.pack_documents(nothing).count() == 0


def test_packing_in_many_groups(spark, library):
    df = spark.range(300).selectExpr("id AS doc_id", "repeat('some words ', cast(id * 7 AS int)) AS text")
    rows = p.pack(p.cut_documents(df), group_rows=50).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()], library)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 3


def test_queries_run(spark, tmp_path, awkward):
    at = save(spark, tmp_path, documents=awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    n = awkward.count()
    assert t.op2_token_counts(spark, at).count() == b.op7_byte_bpe(spark, at).count() == n
    assert p.op10_packing(spark, at).agg({"length": "sum"}).first()[0] > n
