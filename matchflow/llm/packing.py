"""Packing of token sequences by sum-of-squares online placement.

A document's ids are cut into whole windows, which fill a sequence each, and a rest. Rests are placed one after another:
of all fill levels that have an open window (and the empty one), a rest goes to the level that leaves the smallest sum
of squared counts of partly filled windows. A window filled to a power of two needs no padding, so that such levels
count nothing. The counts live in an array indexed by fill level, so that a placement is a few vector operations over
``window`` numbers. Rests are dealt over groups by a hash; each group packs by itself, which
leaves a bounded number of open windows a group.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from itertools import accumulate, chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import map_text, stored, table
from matchflow.llm.token_counts import split_words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Distinct words and stretches between white space that a worker remembers; the longest stretch remembered.
MAX_WORDS, MAX_STRETCHES, LONG_WORD = 200_000, 350_000, 64
#: The first ones seen are remembered, frequent ones among them, until this share of a slice is new.
STALE = 0.3


class IdEncoder:
    """Ids of whole texts as the library gives them, as little-endian 32-bit bytes.

    The vocabulary's pattern never crosses white space and drops it, and its normaliser works within such stretches, so
    that a text's ids are those of its stretches one after another, and a stretch's those of its words. The library
    encodes new words, many in one call: every word ends with the one token of its that has the word-end mark. Stretches
    with special strings, and any case where words and marks differ in number, go to it as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        mark, vocab = spec["model"]["end_of_word_suffix"], self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def parts(self, raw: str) -> list[str] | None:
        """The words of a stretch; None if the library must see the stretch itself."""
        low = raw.lower() if raw.isascii() else unicodedata.normalize("NFC", raw).lower()
        if low.isalpha() and low.isascii():
            return [low]
        if "<|" in raw or "Σ" in raw or not low.isascii() and unicodedata.normalize("NFC", low).lower() != low:
            return None
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return [low[:-1], low[-1]]
        return self.pattern.findall(low)

    def lowered(self, text: str) -> str:
        """The text as the normaliser leaves it, where that is safe to do beforehand: fewer different stretches."""
        if "<|" in text or "Σ" in text:
            return text
        if text.isascii():
            return text.lower()
        low = unicodedata.normalize("NFC", text).lower()
        return low if unicodedata.is_normalized("NFC", low) and low.lower() == low else text

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of stretches that aren't remembered."""
        parts = {m: self.parts(m) for m in missing}
        known = self.words
        new = list({w for ws in parts.values() if ws for w in ws if w not in known})
        coded: dict[str, bytes] = {}
        if new:
            ids = self.ids(" ".join(new))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(new):
                return {m: self.ids(m).tobytes() for m in missing}
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            coded = {w: raw[i:j] for w, i, j in zip(new, [0, *at], at)}
        get = known.get
        got = {m: self.ids(m).tobytes() if ws is None else b"".join([get(w) or coded[w] for w in ws]) for m, ws in parts.items()}
        self.words.update((w, b) for w, b in islice(coded.items(), max(0, MAX_WORDS - len(known))) if len(w) <= LONG_WORD)
        return got

    def batch(self, texts: list[str]) -> list[bytes]:
        texts = list(map(self.lowered, texts))
        split = [split_words(t) or [t] for t in texts]
        stretches = list(chain.from_iterable(split))
        coded = list(map(self.known.get, stretches))
        missing = [i for i, b in enumerate(coded) if b is None]
        if missing:
            if len(self.known) >= MAX_STRETCHES and len(missing) > STALE * len(stretches):
                self.known.clear()  # what is remembered no longer fits the texts: another language, say
                self.words.clear()
            got = self.learn({stretches[i] for i in missing})
            for i in missing:
                coded[i] = got[stretches[i]]
            self.known.update((m, b) for m, b in islice(got.items(), max(0, MAX_STRETCHES - len(self.known))) if len(m) <= LONG_WORD)
        ends = list(accumulate(map(len, split)))
        return [b"".join(coded[i:j]) for i, j in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def cut_documents(
    docs: DataFrame, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole windows first, then the rest; every id in one piece."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        end, ids = np.array([end_id], "<u4").tobytes(), batch.column(0).to_pylist()
        for doc, raw in zip(ids, encoder(path).batch([t or "" for t in batch.column(1).to_pylist()])):
            raw += end
            n = len(raw) // 4
            for start in range(0, n, window):
                piece = raw[4 * start : 4 * (start + window)]
                out.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), [batch.column(0).type] + [pa.int64()] * 4)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return map_text(docs, [id_col, text_col], text_col, run, schema)


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of pieces placed in the given order; lengths are 1 to ``window``.

    Ties go to the fuller level; among windows of one level, to the one that reached it last.
    """
    count = np.zeros(window + 1, np.int64)  # open windows by fill level; a full one has left the array
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    gain, blocked = np.ones(window + 1, np.int64), np.iinfo(np.int64).max
    whole = (np.arange(window + 1) & (np.arange(window + 1) - 1)) == 0  # 0 and the powers of two
    whole[window] = True
    gain[whole] = 0
    cost = np.full(window + 1, blocked)  # of taking a window away from a level; blocked while it has none
    cost[0] = 0
    for i, size in enumerate(lengths.tolist()):
        if size == window:
            sequence[i], offset[i] = made, 0
            made += 1
            continue
        # gain[h]: what one more window at level h adds to the sum of squares
        top = window - size
        delta = cost[: top + 1] + np.where(cost[: top + 1] == blocked, 0, gain[size : window + 1])
        level = top - int(np.argmin(delta[::-1]))
        if level:
            bin_ = open_at[level].pop()
            count[level] -= 1
            c = count[level]
            cost[level] = blocked if not c else 0 if whole[level] else 1 - 2 * c
            gain[level] = 0 if whole[level] else 2 * c + 1
        else:
            bin_, made = made, made + 1
        sequence[i], offset[i] = bin_, level
        to = level + size
        if to < window:
            open_at[to].append(bin_)
            count[to] += 1
            c = count[to]
            cost[to], gain[to] = (0, 0) if whole[to] else (1 - 2 * c, 2 * c + 1)
    return sequence, offset


def pack(pieces: DataFrame, window: int = 4096, group_rows: int = 50_000) -> DataFrame:
    """Add sequence_id and offset. Groups hold about ``group_rows`` pieces, dealt by a hash of the piece and its row.

    ``pieces`` is a stored table: its rows are numbered, so that repeated rows are dealt over all groups. Within a group pieces are placed in the order of that hash, which spreads long and short ones; full windows take a
    sequence each. Sequence ids are unique over the table: the group's number times 2**32 plus the group's own count.
    An empty table gives an empty result.
    """
    n_groups = max(1, -(-pieces.count() // group_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mixed", "doc_id", "start"], kind="stable", ignore_index=True)
        sequence, offset = place(pdf["length"].to_numpy(), window)
        pdf["sequence_id"], pdf["offset"] = sequence + (int(key[0]) << 32), offset
        return pdf.drop(columns=["mixed", "part"])

    mixed = F.xxhash64("doc_id", "start", "length", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("mixed", mixed).withColumn("part", F.pmod(F.col("mixed"), F.lit(n_groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("part").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, window: int = 4096, end_id: int = 2, path: str = WORD_BPE) -> DataFrame:
    """One row for each piece of each document, with its place.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; further columns are
    ignored. The pieces (some 60 bytes each, no ids) are written once to the shared folder, as the number of
    groups comes from their count and texts should be encoded only once.
    """
    return pack(stored(cut_documents(docs, window, end_id, path=path)), window)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
