"""Secret scanning: fixed patterns and assignment-aware lexing.

The fixed patterns (``assign``, ``access``, ``hex``) find secrets by shape. The lexer (``literal``) finds assignments in
source and configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``NAME=x``, ``<name>x</name>``), keeps
the constants that a text has defined so far, works out right-hand sides that concatenate literals and names, and scores
every literal that reaches a name by how sensitive the name is and how random the value looks. Values are never spelled
out: a constant is a summary (length, character counts, first characters) and a node that refers to its operands, so
that time and memory are linear in the text whatever constants refer to.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import map_text, slices, table


def _either_case(word: str) -> str:
    """ASCII letters in either case; ``re.IGNORECASE`` would also match a few letters outside ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run is found whole, so that short ones can be passed over at once
KINDS = ("assign", "access", "hex", "literal")

#: How telling a part of a name is. A name's score is its most telling part's.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "signature": 0.5, "private": 0.5, "key": 0.5,
}
MIN_SCORE, MIN_LENGTH = 0.35, 8

#: A name, then an operator. Names and blanks are taken whole and only where they begin, so that time is linear.
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)[\"']?[\x20\t]*+(?::=|=>|=(?!=)|:(?!/))[\x20\t]*+")
#: A quoted literal or a bare one; a bare one ends before the next operator, but for the padding of base 64.
_TERM = re.compile(r"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|((?:[^\s\"'`,;#{}()\[\]<>+&|=:]|:(?=/))++={0,2})")
_PLUS = re.compile(r"[\x20\t]*+\+[\x20\t]*+")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*+)>([^<>]++)</\1>")  # a value can't cross a tag, so that time stays linear
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NOT_SECRET = re.compile(r"(?i)^(?:true|false|null|none|undefined|changeme|example|placeholder|your[_-].*|x+|\*+|\.+|[$%]\{?.*|https?://.*)$")

#: Characters of a value that its summary keeps; lengths beyond which counts are scaled down (only proportions matter).
HEAD, LARGE = 64, 1e12


class Value:
    """A value's length, character counts and first characters, and where its literals stand."""

    def __init__(self, literal: str, span: tuple[int, int] | None) -> None:
        self.length, self.literal, self.head = float(len(literal)), literal, literal[:HEAD]
        self.span, self.parts, self.judged = span, (), False

    @functools.cached_property
    def counts(self) -> Counter:
        return Counter(c if c < "\x80" else "\x80" for c in self.literal)

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        """The concatenation of values."""
        out = cls("", None)
        for p in parts:
            out.length += p.length
            out.counts.update(p.counts)
            out.head = out.head if len(out.head) == HEAD else (out.head + p.head)[:HEAD]
        if out.length > LARGE:
            scale = LARGE / 2 / out.length
            out.length, out.counts = out.length * scale, Counter({c: n * scale for c, n in out.counts.items()})
        out.parts = tuple({id(p): p for p in parts}.values())
        return out


def name_score(name: str) -> float:
    """0 to 1: the most telling part; 'api' and 'access' lift a 'key' to full score."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p) or max((v for w, v in SENSITIVE.items() if len(w) > 4 and p.endswith(w)), default=0.0) for p in parts), default=0.0)
    pairs = set(zip(parts, parts[1:]))
    return 1.0 if pairs & {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key")} else best


def value_score(value: Value) -> float:
    """0 to 1: entropy a character against that of a random token, lowered for short or wordlike values.

    Characters outside ASCII count as one.
    """
    n, counts = value.length, value.counts
    if n < MIN_LENGTH or counts[" "] or _NOT_SECRET.match(value.head) or len(counts) == 1 and value.head[0] in "xX*.":
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values() if k)
    kinds = {"digit" if c.isdigit() else "letter" if c.isalpha() or c == "\x80" else "other" for c in counts}
    return min(1.0, entropy / 3.5) * (1.0 if len(kinds) > 1 else 0.5)


def _value(text: str, at: int, known: dict[str, Value]) -> Value | None:
    """The value that begins at ``at``: literals and known names, joined by '+'."""
    parts: list[Value] = []
    while m := _TERM.match(text, at):
        kind = m.lastindex
        parts.append(known[m[3]] if kind == 3 and m[3] in known else Value(m[kind], m.span(kind)))
        plus = _PLUS.match(text, m.end())
        if not plus:
            break
        at = plus.end()
    return parts[0] if len(parts) == 1 else Value.joined(parts) if parts else None


def assignments(text: str) -> list[tuple[str, float, int, int]]:
    """(name, score, start, end) of every literal that reaches a sensitive name, each span once, with its best score."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    known: dict[str, Value] = {}
    judged: list[tuple[float, str, Value]] = []
    score_of = functools.cache(name_score)
    for m in _ASSIGNED.finditer(text):
        name = m[1].lstrip("0123456789.-")
        value = name and _value(text, m.end(), known)
        if value:
            known[name] = value
            judged.append((score_of(name), name, value))
    for m in _TAG.finditer(text) if "</" in text else ():
        judged.append((score_of(m[1]), m[1], Value(m[2], m.span(2))))
    scored = [(s, name, v) for n, name, v in judged if n and (s := n * value_score(v)) >= MIN_SCORE]
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for score, name, value in sorted(scored, key=lambda x: -x[0]):  # best first: each value is walked once
        queue = [value]
        while queue:
            v = queue.pop()
            if v.judged:
                continue
            v.judged = True
            queue += v.parts
            if v.span:
                found.setdefault(v.span, (name, score))
    return [(name, score, *span) for span, (name, score) in sorted(found.items())]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost matches that do not overlap, kind by kind, short ones dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(fixed-pattern spans, all spans), by start, then kind."""
    base = base_spans(text)
    more = [(start, end, "literal") for _, _, start, end in assignments(text)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>) of every row; code points, end exclusive.

    Null and empty texts have no spans; repeated rows are scanned as often as they occur; further columns are ignored;
    an empty table gives an empty result. Whole texts, no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1).to_pylist():
            rows.append([{"kind": k, "start": a, "end": b, "base": k != "literal"} for a, b, k in scan_text(t or "")[1]])
        return pa.record_batch([batch.column(0), pa.array(rows, kind_of_spans)], names=["doc_id", "spans"])

    kind_of_spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return map_text(docs, [id_col, text_col], text_col, run, schema).withColumnRenamed("doc_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark`` (overlapping spans by one); all else unchanged.

    Null texts stay null. Every row is kept.
    """

    def run(batches):
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else _redacted(t, mark) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, mark: str) -> str:
    out, at = [], 0
    for start, end, _ in scan_text(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
