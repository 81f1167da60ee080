"""Main text of web pages: one pass over the markup with a stack of open elements, without building a document."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as C

MIN_CHARS = 200
#: JavaScript's white space.
SPACE = "[\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_SPACES = re.compile(SPACE)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SELECTOR = re.compile(r'\[(\w+)(\*?=)"(.*)"\]')
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style iframe textarea title".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_INLINE = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
#: tag -> the open elements that it ends, and those beyond which it does not look.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"}),
}


_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|(\w+));")


def whole_references(text: str) -> str:
    """Text with the character references read that end in a semicolon; others stay as they are."""
    return _REFERENCE.sub(lambda m: entities.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)


def squeezed(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


@dataclass(slots=True)
class Element:
    """An element's place among the pieces of text, and sums of what stood before it, later of what it holds."""

    tag: str
    start: int
    raw: int
    solid: int
    words: int
    dropped: bool = False
    end: int = -1
    children: int = 0
    carries: bool = False  # its text goes on with a word that began before it
    ended: bool = False  # by an end tag of its own

    @property
    def squeezed(self) -> int:
        """Characters of its text after white space is collapsed and trimmed."""
        return self.solid + max(0, self.words + self.carries - 1)

    def density(self, size: int) -> float:
        return size / self.children if self.children else size


@dataclass
class Blocks:
    """What one pass finds: the text in pieces, all divisions, and the first element of each wanted container."""

    drop: frozenset[str]
    wanted: list[str]
    strict: bool = False
    pieces: list[str] = field(default_factory=list)
    divs: list[Element] = field(default_factory=list)
    first: dict[str, Element] = field(default_factory=dict)
    raw: int = 0
    solid: int = 0
    words: int = 0

    def text(self, e: Element | None = None) -> str:
        return "".join(self.pieces if e is None else self.pieces[e.start : e.end])

    def counts(self, e: Element | None) -> bool:
        """Whether an element was found and, if ``strict``, ended."""
        return e is not None and (e.ended or not self.strict)

    def _matches(self, selector: str, tag: str, attributes: dict[str, str]) -> bool:
        if selector.startswith("."):
            return selector[1:] in attributes.get("class", "").split()
        if selector.startswith("["):
            name, how, value = _SELECTOR.match(selector).groups()
            return attributes.get(name) == value if how == "=" else value in attributes.get(name, "")
        return selector == tag

    def read(self, page: str) -> Blocks:
        stack: list[Element] = []
        fresh: list[Element] = []  # opened since the last text
        dropping, open_p, in_word, at, n = 0, 0, False, 0, len(page)

        def close(count: int) -> None:
            nonlocal dropping, open_p
            for _ in range(count):
                e = stack.pop()
                e.end, e.raw, e.solid, e.words = len(self.pieces), self.raw - e.raw, self.solid - e.solid, self.words - e.words
                dropping -= e.dropped
                open_p -= e.tag == "p"

        def end_of(tags: set[str], border: set[str]) -> None:
            for back, e in enumerate(reversed(stack)):
                if e.tag in tags:
                    return close(back + 1)
                if e.tag in border:
                    return None

        def say(text: str, decode: bool = True) -> None:
            nonlocal in_word
            if dropping or not text:
                return
            text = (whole_references if self.strict else entities.unescape)(text) if decode and "&" in text else text
            parts = _SPACES.split(text)
            words = sum(map(bool, parts))
            goes_on = in_word and parts[0] != ""
            for e in fresh:
                e.carries = goes_on
            fresh.clear()
            self.pieces.append(text)
            self.raw += len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2
            self.solid += sum(len(p) if p.isascii() else len(p.encode("utf-16-le", "surrogatepass")) // 2 for p in parts)
            self.words += words - goes_on
            in_word = parts[-1] != ""

        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                say(page[at:])
                break
            say(page[at:lt])
            if page.startswith("<!--", lt):
                at = page.find("-->", lt + 4) + 3
                if at < 3:
                    break
                continue
            if page[lt + 1 : lt + 2] in ("!", "?"):
                at = page.find(">", lt) + 1
                if not at:
                    break
                continue
            name = _NAME.match(page, lt)
            if not name:
                say("<")
                at = lt + 1
                continue
            rest = _REST.match(page, name.end())
            if not rest:  # the page ends inside a tag
                break
            at, tag = rest.end(), name[1].lower()
            if page[lt + 1] == "/":
                for back, e in enumerate(reversed(stack)):
                    if e.tag == tag:
                        if tag in _INLINE and any(x.tag not in _INLINE for x in stack[len(stack) - back :]):
                            break
                        e.ended = True
                        close(back + 1)
                        break
                    if e.dropped:
                        break
                continue
            if tag in _CLOSES_P and open_p:
                end_of({"p"}, {"button", "td", "th", "object"})
            if tag in _ENDS:
                end_of(*_ENDS[tag])
            dropped = tag in self.drop
            if stack and not dropped:
                stack[-1].children += 1
            if tag in _VOID:
                continue
            e = Element(tag, len(self.pieces), self.raw, self.solid, self.words, dropped)
            stack.append(e)
            dropping += dropped
            open_p += tag == "p"
            if not dropping:
                fresh.append(e)
                if tag == "div":
                    self.divs.append(e)
                if len(self.first) < len(self.wanted):
                    attributes = {a[0].lower(): next((x for x in a[1:] if x), "") for a in _ATTRIBUTE.findall(page, name.end(), at)}
                    for selector in self.wanted:
                        if selector not in self.first and self._matches(selector, tag, attributes):
                            self.first[selector] = e
            if tag in _RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                say(page[at:stop], tag in ("textarea", "title"))
                at = stop
        close(len(stack))
        return self


def _densest(b: Blocks, size_of: str) -> Element | None:
    """The first division with the most text for each child, of those with ``MIN_CHARS`` characters."""
    best, score = None, 0.0
    for e in b.divs:
        size = getattr(e, size_of)
        if size >= MIN_CHARS and b.counts(e) and e.density(size) > score:
            best, score = e, e.density(size)
    return best


def main_content(page: str | None, strict: bool = False) -> str:
    """Text of the first container, in order of priority, with more than ``MIN_CHARS`` characters; else of the densest
    division; else of the whole page. What has no tags is text already. Pages are read as browsers do; if ``strict``, only
    what is written whole counts: containers with an end tag, references with a semicolon."""
    if not page:
        return ""
    tag = re.search("<[a-zA-Z]", page)
    if not tag or ">" not in page[tag.end() :]:
        return squeezed(page)
    b = Blocks(frozenset(C.BOILERPLATE_TAGS), C.MAIN_CONTAINERS, strict).read(page)
    for selector in C.MAIN_CONTAINERS:
        e = b.first.get(selector)
        if b.counts(e) and e.raw > MIN_CHARS:
            return squeezed(b.text(e))
    e = _densest(b, "raw")
    return squeezed(b.text(e if e and e.raw > MIN_CHARS else None))


def probe_content(page: str | None, strict: bool = False) -> str:
    """Text of the longest of a page's containers; if it has fewer than ``MIN_CHARS`` characters, of the densest division,
    and if there is none, of the body. ``strict`` as in ``main_content``; a page cut off within its body then has no text."""
    if not page or not page.strip():
        return ""
    b = Blocks(frozenset(C.PROBE_BOILERPLATE_TAGS), [*C.PROBE_CONTAINERS, "body", "head"], strict).read(page)
    best = None
    for selector in C.PROBE_CONTAINERS:
        e = b.first.get(selector)
        if b.counts(e) and e.squeezed > (best.squeezed if best else 0):
            best = e
    if best is None or best.squeezed < MIN_CHARS:
        best = _densest(b, "squeezed") or best
    if best is None or best.squeezed < MIN_CHARS:
        head, body = b.first.get("head"), b.first.get("body")
        if strict:
            return squeezed(b.text(body)) if b.counts(body) else ""
        return squeezed(b.text(body) if body else b.text()[len(b.text(head)) :] if head and head.start == 0 else b.text())
    return squeezed(b.text(best))


def _texts(pages: DataFrame, read: Callable[[str | None], str], kind: str) -> DataFrame:
    """``pages`` with the page in its last column replaced by its text; a few pages of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                text = pa.array([read(p) for p in part.columns[-1].to_pylist()], pa.string())
                yield pa.record_batch([*part.columns[:-1], text], names=[*part.schema.names[:-1], "text"])

    return pages.mapInArrow(run, f"{kind}, text string")


def extract_main_content(pages: DataFrame, strict: bool = False) -> DataFrame:
    """(page_id, text) of (page_id, html) by ``main_content``; a row for each page, empty text for a null or empty page."""
    return _texts(pages.select("page_id", "html"), partial(main_content, strict=strict), f"page_id {pages.schema['page_id'].dataType.simpleString()}")


def extract_page_text(pages: DataFrame, min_chars: int = MIN_CHARS, strict: bool = False) -> DataFrame:
    """(page_id, text, mail, has_job_title, n_chars, n_words) of pages (page_id, html) with at least ``min_chars`` of text by
    ``probe_content``: the first mail address linked (none, if it is an example's), and whether the text names a job."""
    mail = F.regexp_extract("html", "(?i)mailto:([^\"'>\\s]+)", 1)
    mail = F.when((mail != "") & ~F.contains(mail, F.lit("example.com")), mail).alias("mail")
    out = _texts(pages.select("page_id", mail, "html"), partial(probe_content, strict=strict), f"page_id {pages.schema['page_id'].dataType.simpleString()}, mail string")
    titled = F.lit(False)
    for pattern in C.JOB_TITLE_PATTERNS:
        titled |= F.col("text").rlike("(?i)(?<![A-Za-z0-9_])" + pattern + "(?![A-Za-z0-9_])")
    out = out.filter(F.length("text") >= min_chars)
    return out.select("page_id", "text", "mail", titled.alias("has_job_title"), F.length("text").alias("n_chars"), F.size(F.split("text", " ")).alias("n_words"))
