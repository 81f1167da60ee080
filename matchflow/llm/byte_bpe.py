"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings form a monoid: two encoded neighbours join into the encoding of their concatenation. ``join`` keeps both
sides if their border pair is one that BPE leaves apart; otherwise it re-encodes a window around the border, growing it
until the pairs at both ends of the window are again such pairs. A sequence all of whose adjacent pairs BPE leaves apart
is the encoding of its bytes, so the tokens outside the window are then proved stable. ``encode`` halves its input down
to short leaves and joins up the tree; ``decode`` concatenates bytes up the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from matchflow.llm.common import map_text, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes in a leaf of the tree; remembered pieces, matches, short merges and pairs in a worker; the longest piece remembered.
LEAF, MAX_PIECES, MAX_MATCHES, MAX_SHORT, LONG_PIECE = 6, 500_000, 600_000, 300_000, 64


class ByteBpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.spelling = {r: b for b, r in self.rank.items()}
        self.digits = {r: b" %d" % r for r in self.spelling}
        self.pattern = regex.compile(pattern)
        self.short: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.known: dict[str, list[int]] = {}
        self.matches: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Plain BPE of a short string: the lowest-ranked adjacent pair first, leftmost among equals."""
        got = self.short.get(raw)
        if got is not None:
            return got
        parts, none = [raw[i : i + 1] for i in range(len(raw))], len(self.rank)
        rank = self.rank.get
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        got = [self.rank[p] for p in parts]
        if len(raw) <= 16:
            if len(self.short) >= MAX_SHORT:
                self.short.clear()
            self.short[raw] = got
        return got

    def meet(self, a: int, b: int) -> list[int]:
        """What BPE makes of the two tokens' bytes: the two themselves if it leaves them apart."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= MAX_SHORT:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.spelling[a] + self.spelling[b])
        return got

    def apart(self, a: int, b: int) -> bool:
        return self.meet(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of left's bytes followed by right's."""
        if not left or not right:
            return left + right
        window = self.meet(left[-1], right[0])
        if len(window) == 2 and window[0] == left[-1]:
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            if (i == 0 or self.apart(left[i - 1], window[0])) and (j == len(right) or self.apart(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(map(self.spelling.__getitem__, left[i:] + right[:j])))

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The tree reduction over one match of the pattern (level by level, so that depth never overflows a stack)."""
        if len(raw) <= LEAF:
            return self.merge(raw)
        if len(raw) <= 2 * LEAF:
            half = len(raw) // 2
            return self.join(self.merge(raw[:half]), self.merge(raw[half:]))
        level = [self.merge(raw[i : i + LEAF]) for i in range(0, len(raw), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def match(self, text: str) -> list[int]:
        """Ids of one match of the pattern."""
        ids = self.matches.get(text)
        if ids is None:
            ids = self.encode_bytes(text.encode())
            if len(self.matches) >= MAX_MATCHES:
                self.matches.clear()
            if len(text) <= LONG_PIECE:
                self.matches[text] = ids
        return ids

    def piece(self, text: str) -> list[int]:
        """Ids of a stretch that starts and ends on borders of the pattern."""
        got = self.known.get(text)
        if got is None:
            word = text[1:] if text[:1] == " " else text
            if word.isalpha():
                got = self.match(text)
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                got = self.match(text[:-1]) + self.match(word[-1])
            else:
                got = [i for m in self.pattern.findall(text) for i in self.match(m)]
            if len(self.known) >= MAX_PIECES:
                self.known.clear()
            if len(text) <= LONG_PIECE:
                self.known[text] = got
        return got

    def pieces(self, text: str) -> list[str]:
        """Cut before every space that stands between two characters that are not white space. No match of the pattern
        crosses such a place and none looks behind itself, so that each piece can be encoded by itself."""
        if _RUN.search(text):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]

    def encode(self, text: str) -> list[int]:
        known, piece = self.known.get, self.piece
        return list(chain.from_iterable([known(p) or piece(p) for p in self.pieces(text)]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree; ``bytes.join`` does all levels at once."""
        return b"".join(map(self.spelling.__getitem__, ids))


_RUN = re.compile(r"\s\s|[^\S ] | [^\S ]")  # white space beside white space
_CUT = re.compile(r"(?<=\S)(?= \S)")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids array<int>) of every row's whole text; null and empty texts have no ids. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, [id_col, text_col], text_col, run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode_texts(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id, raw binary): the bytes that the ids stand for; null ids give null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        raw = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_text(encoded, [id_col, ids_col], ids_col, run, f"doc_id {kind}, raw binary").withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode what was encoded, in one pass.

    Null and empty texts have 0 tokens and the digests of nothing. Repeated rows, null ids and further columns change
    nothing; an empty table gives an empty result. A long match without borders is encoded by the tree, in time about
    linear in its length.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, encoded, decoded = codec(path), [], [], []
        for t in batch.column(1).to_pylist():
            ids = c.encode(t or "")
            n.append(len(ids))
            encoded.append(hashlib.sha256(b"".join(map(c.digits.__getitem__, ids))[1:]).hexdigest())
            decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_text(docs, [id_col, text_col], text_col, run, schema).withColumnRenamed("doc_id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
