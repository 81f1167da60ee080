"""Column expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

import functools
import re
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchflow.functions import constants as C


def any_word(terms: list[str], plural: bool = False) -> str:
    """A case-insensitive pattern for any of the terms between characters that aren't letters or digits."""
    return "(?i)(^|[^a-z0-9])(" + "|".join(map(re.escape, terms)) + ")" + ("s?" if plural else "") + "([^a-z0-9]|$)"


def any_part(terms: list[str]) -> str:
    return "(?i)(" + "|".join(map(re.escape, terms)) + ")"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def whole_terms(terms: list[str]) -> str:
    """A pattern for any of the terms between word boundaries, in either letter case."""
    return "(?i)" + "|".join(rf"\b{re.escape(t)}\b" for t in terms)


def needed(pattern: str) -> list[str]:
    """Lower-case strings of which the lower-case form of any match holds one, the longest that the pattern shows; empty if it
    shows none."""

    def of(items) -> frozenset[str]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is ops.LITERAL:
                run += chr(value).lower()
                continue
            found.append(frozenset([run] if run else []))
            run = ""
            if op is ops.SUBPATTERN:
                found.append(of(value[3]))
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
            elif op is ops.BRANCH:
                parts = [of(x) for x in value[1]]
                found.append(frozenset().union(*parts) if all(parts) else frozenset())
        return max(found, key=lambda s: (min(map(len, s), default=0), -len(s)))

    return sorted(of(parser.parse(pattern)))


def said(text: Column, low: Column, pattern: str) -> Column:
    """Whether a text matches; the pattern is tried only where ``low``, the text in lower case, holds a string it needs."""
    words = needed(pattern)
    return functools.reduce(Column.__or__, [low.contains(w) for w in words]) & text.rlike(pattern) if words else text.rlike(pattern)


def values_named(text: Column, value_of: dict[str, str]) -> Column:
    """Values of the names that a lower-case text holds between characters that aren't a-z. Names inside other names count,
    as they are looked for at every position."""
    by_letter: dict[str, list[str]] = {}  # so that a position tries the names of its letter alone
    for n in sorted(value_of, key=lambda n: (-len(n), n)):
        by_letter.setdefault(n[0], []).append(re.escape(n[1:]))
    names = "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in by_letter.items())
    found = F.regexp_extract_all(text, F.lit(f"(?<![a-z])(?=({names})(?![a-z]))"), F.lit(1))
    values = F.create_map(*[F.lit(x) for kv in value_of.items() for x in kv])
    return F.array_distinct(F.transform(found, lambda n: values[n]))


def countries_named(text: Column) -> Column:
    """Codes of the countries that a lower-case location names, in the table's order."""
    codes = {name: code for code, names in C.LOCATION_COUNTRIES.items() for name in names}
    return F.array_intersect(strings(list(C.LOCATION_COUNTRIES)), values_named(text, codes))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; 1 for null, empty, zero or unequal vectors."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot / norms).otherwise(1.0)


def effective_tags(required: Column, extracted: Column) -> Column:
    """The required tags, if there are any, else the extracted ones."""
    return F.when(F.size(F.coalesce(required, no_strings())) > 0, required).otherwise(extracted)


def overlap_count(must_have: Column, tags: Column) -> Column:
    """How many elements of ``must_have`` (repeats count) are among ``tags``."""
    return F.size(F.filter(must_have, lambda t: F.array_contains(tags, t)))


def composite(overlap: Column, distance: Column) -> Column:
    """Routing score: saturating tag overlap and closeness of vectors."""
    return C.TAG_WEIGHT * (1 - F.exp(-0.4 * F.least(overlap, F.lit(5)))) + C.VECTOR_WEIGHT * (1 - distance)


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage rounded half up; null for nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits))


def true_(flag: Column) -> Column:
    """A flag of three states, taken as false where unknown."""
    return F.coalesce(flag, F.lit(False))


def canonical_name(name: Column) -> Column:
    """Lower case without a legal form, a generic last word, punctuation and blanks."""
    out = F.lower(F.trim(name))
    out = F.regexp_replace(out, r"[ ,]+(inc|llc|ltd|gmbh|corp|corporation|limited|co)\.?$", "")
    out = F.regexp_replace(out, r" (labs|technologies|technology|software|group|holdings|solutions)$", "")
    return F.regexp_replace(out, r"[,. ]", "")


def text_hash(company: Column, title: Column, location: Column) -> Column:
    def tidy(c: Column) -> Column:
        low = F.trim(F.lower(F.coalesce(c, F.lit(""))))
        return F.when(low.contains("  "), F.regexp_replace(low, " +", " ")).otherwise(low)

    return F.sha2(F.concat_ws("|", tidy(company), tidy(title), tidy(location)), 256)


def to_usd(amount: Column, currency: Column) -> Column:
    """Dollars at fixed rates (no currency: dollars); null for unknown currencies and implausibly low amounts."""
    rates = F.create_map(*[x for k, v in C.USD_RATES.items() for x in (F.lit(k), F.lit(float(v)))])
    usd = amount * rates[F.upper(F.coalesce(currency, F.lit("USD")))]
    return F.when(usd >= C.PAY_FLOOR_USD, usd)
