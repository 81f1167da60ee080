"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The vocabulary's merges are compiled, as texts need them, into a deterministic transducer over the bytes of a word (the
last byte of a word is a symbol of its own). A state holds every place where the token being read may have begun:
(node in the token trie, last token before that place, tokens before that place). The token that ends a prefix is the
only one that may follow its predecessor, so every transition emits a fixed number of tokens. Counts are kept relative
to the smallest, which keeps the states finite; what falls below it is what the transition emits.

A text is cut into chunks. White space resets the transducer, so that what a chunk does to the state in which it is
entered is told by the open words at its ends: the head ends the word that is open, the tail leads to the state in which
the chunk is left, and the tokens between are a constant. Such chunk maps compose associatively (where a tail and a head
meet, the transducer runs over the word that they make up); a parallel prefix scan of log2 rounds yields every prefix's
map, the last of which is the text's. A chunk without white space is its own head: its state map isn't tabulated for
all states, which are too many, but worked out for the one state that turns out to be entered.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from matchflow.llm.common import map_text, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Transducer states and remembered words a worker keeps; when full, the table starts anew (as lazy automata do).
MAX_STATES, MAX_WORDS = 200_000, 600_000
CHUNK = 16_384
FINAL = 256  # added to the last byte of a word


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def symbols(token: str, alphabet: dict[str, int], end: str) -> tuple[int, ...]:
    """A token of the vocabulary as transducer symbols."""
    if not token.endswith(end):
        return tuple(alphabet[c] for c in token)
    body = [alphabet[c] for c in token[: -len(end)]]
    return (*body[:-1], body[-1] + FINAL)


class Transducer:
    """Bytes of a word in, number of tokens out. Built from merges alone; tables fill as words are read."""

    def __init__(self, model: dict) -> None:
        alphabet, end = byte_alphabet(), model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        singles = [(s,) for s in range(2 * FINAL)]
        self.spelling = singles + [symbols(a + b, alphabet, end) for a, b in merges]
        ids = {s: i for i, s in enumerate(self.spelling)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for order, (a, b) in enumerate(merges):
            pair = ids[symbols(a, alphabet, end)], ids[symbols(b, alphabet, end)]
            self.rank.setdefault(pair, (order, ids[self.spelling[len(singles) + order]]))
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, spelled in enumerate(self.spelling):
            node = 0
            for s in spelled:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][s]
            self.token[node] = i if self.token[node] < 0 else self.token[node]
        self.follows = functools.lru_cache(maxsize=500_000)(self._follows)
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.ends: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, spelled: tuple[int, ...]) -> list[int]:
        """Plain BPE: again and again the earliest-learned pair, leftmost first."""
        ids = list(spelled)
        while len(ids) > 1:
            pairs = list(zip(ids, ids[1:]))
            best = min((r for r in map(self.rank.get, pairs) if r), default=None)
            if best is None:
                break
            i = next(i for i, p in enumerate(pairs) if self.rank.get(p) == best)
            ids[i : i + 2] = [best[1]]
        return ids

    def _follows(self, before: int, token: int) -> bool:
        """Whether ``token`` can come right after ``before`` (-1: at a word's start) in what the merges yield."""
        if before < 0:
            return self.merge(self.spelling[token]) == [token]
        return self.merge(self.spelling[before] + self.spelling[token]) == [before, token]

    def _last(self, state: tuple, symbol: int) -> tuple[int, int, list]:
        """The token that ends here, the tokens up to it, and the starts that live on."""
        token, count, alive = -1, 0, []
        for node, last, n in state:
            to = self.child[node].get(symbol)
            if to is None:
                continue
            if self.token[to] >= 0 and token < 0 and self.follows(last, self.token[to]):
                token, count = self.token[to], n + 1
            if self.child[to]:
                alive.append((to, last, n))
        return token, count, alive

    def _move(self, at: int, symbol: int) -> tuple[int, int]:
        token, count, alive = self._last(self.states[at], symbol)
        alive.append((0, token, count))
        base = min(n for _, _, n in alive)
        key = tuple((node, last, n - base) for node, last, n in alive)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.ends.append({})
        self.moves[at][symbol] = to, base
        return to, base

    def _end(self, at: int, symbol: int) -> tuple[int, int]:
        """(tokens, last token) when a word ends with this symbol."""
        token, n, _ = self._last(self.states[at], symbol)
        self.ends[at][symbol] = n, token
        return n, token

    def count(self, word: bytes) -> int:
        """Tokens of one word: the sum of what its transitions emit."""
        if len(self.states) > MAX_STATES:
            self.clear()
        at = total = 0
        moves = self.moves
        for symbol in word[:-1]:
            step = moves[at].get(symbol) or self._move(at, symbol)
            at = step[0]
            total += step[1]
        return total + (self.ends[at].get(word[-1] + FINAL) or self._end(at, word[-1] + FINAL))[0]


class TextCounter:
    """The library's whole chain for one vocabulary file: special strings, normaliser, word pattern, transducer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.transducer = Transducer(spec["model"])
        self.known: dict[str, int] = {}

    def fragment(self, raw: str) -> int:
        """Tokens of a stretch without white space: one composite transition of the transducer, remembered."""
        n = self.known.get(raw)
        if n is None:
            n = len(self.special.findall(raw)) if "<|" in raw else 0
            for part in self.special.split(raw) if n else (raw,):
                # lower-casing is by single characters, as the library does it (a final sigma is not special)
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                n += sum(self.transducer.count(w.encode()) for w in self.word.findall(low))
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            if len(raw) <= 64:
                self.known[raw] = n
        return n

    def chunk_map(self, chunk: str) -> tuple[str, bool, int, str]:
        """(head, resets, inner, tail): entered in any state, the head ends the open word, ``inner`` tokens follow, and
        the state left is the one that ``tail`` leads to. A chunk without white space is one open word (resets=False)."""
        words = split_words(chunk)
        if words is None:
            return chunk, False, 0, ""
        known, head, tail = self.known, words[0], words[-1]
        inner = words[1:-1]
        counts = list(map(known.get, inner))
        total = sum(self.fragment(w) if n is None else n for w, n in zip(inner, counts)) if None in counts else sum(counts)
        return head, True, total, tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two adjoining chunks; associative."""
        if not a[1]:
            return (a[0] + b[0], *b[1:])
        if not b[1]:
            return *a[:3], a[3] + b[0]
        return a[0], True, a[2] + self.fragment(a[3] + b[0]) + b[2], b[3]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan of chunk maps: in round r every map takes in the one 2^r places before it."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)] or [("", False, 0, "")]
        head, _, inner, tail = self.scan(maps)[-1]
        return self.fragment(head) + inner + self.fragment(tail)


_SPACE = regex.compile(r"[\t-\r \x85\p{White_Space}]+")
_ODD = regex.compile(r"[\x1c-\x1f]")


def split_words(chunk: str) -> list[str] | None:
    """The chunk cut at white space, with an empty string at either end that is white space; None if it has none.

    ``str.split`` is many times faster than a pattern, but also cuts at U+001C to U+001F, which are not white space
    to the library; such chunks take the pattern.
    """
    if _ODD.search(chunk):
        words = _SPACE.split(chunk)
        return words if len(words) > 1 else None
    words = chunk.split()
    if not words:
        return ["", ""] if chunk else None
    if len(words) == 1 and len(words[0]) == len(chunk):
        return None
    if chunk[0].isspace():
        words.insert(0, "")
    if chunk[-1].isspace():
        words.append("")
    return words


@functools.lru_cache(maxsize=4)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, whole texts; no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, null ids and further columns change nothing; an
    empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        count = counter(path).count
        n = [count(t) for t in texts]
        return pa.record_batch(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_text(docs, [id_col, text_col], text_col, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
