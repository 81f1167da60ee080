"""Operators over tag arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X

FAMILY_TAGS = C.STACK_FAMILIES
#: Lower-case labels and the tags they stand for.
LABEL_TAGS = {label.lower(): t for t, label, _, _ in C.TAG_REGISTRY}
DEFINING_TAGS = [t for t, _, kind, _ in C.TAG_REGISTRY if kind == "persona_defining"]


def label_pattern() -> str:
    """Any label, longest first, from a word's beginning to where no word goes on (the end may be a sign, as in C++)."""
    ends = lambda label: r"\b" if re.match(r"\w", label[-1]) else r"\B"
    quoted = lambda label: re.sub(r"([.+#/&()])", r"[\1]", label)
    labels = "|".join(quoted(label) + ends(label) for label in sorted(LABEL_TAGS, key=lambda label: -len(label)))
    return rf"\b(?:{labels})"  # the boundary comes first: inside words no label is tried


def tags_in(text: Column) -> Column:
    """Tags whose labels a text names, in the order of their first mention."""
    tag_of = F.create_map(*[F.lit(x) for kv in LABEL_TAGS.items() for x in kv])
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(label_pattern()), 0), lambda x: tag_of[x]))


def scan_tags(df: DataFrame, text: str) -> DataFrame:
    """``tags``: the registry's tags whose labels the text names, sorted; matches don't overlap, longer labels go first."""
    return df.withColumn("tags", F.array_sort(tags_in(F.coalesce(F.col(text), F.lit("")))))


def canonical(tag: Column) -> Column:
    """The tag that a spelling stands for, by label, then by variant; else the spelling itself in lower case."""
    known = F.create_map(*[F.lit(x) for kv in (C.TAG_VARIANTS | LABEL_TAGS).items() for x in kv])
    low = F.lower(F.trim(tag))
    return F.coalesce(known[low], low)


def normalize_tags(df: DataFrame, tags: str) -> DataFrame:
    """The array as tags: each entry by its label, else by a variant, else by the labels that it names; without repeats,
    entries that stand for nothing dropped, sorted."""
    known = F.create_map(*[F.lit(x) for kv in (C.TAG_VARIANTS | LABEL_TAGS).items() for x in kv])

    def of(t: Column) -> Column:
        low = F.lower(F.trim(t))
        return F.when(known[low].isNotNull(), F.array(known[low])).otherwise(tags_in(F.coalesce(low, F.lit(""))))

    return df.withColumn(tags, F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(tags, X.no_strings()), of)))))


def normalize_postings(df: DataFrame, min_chars: int = C.MIN_TEXT_CHARS) -> DataFrame:
    """``outcome``: title_only (too short a text), normalized (a tag that can define a persona) or no_tags."""
    outcome = (
        F.when(F.length(F.coalesce("normalized_text", F.lit(""))) < min_chars, "title_only")
        .when(F.arrays_overlap("extracted_tags", X.strings(DEFINING_TAGS)), "normalized")
        .otherwise("no_tags")
    )
    return df.withColumn("outcome", outcome)


def family_counts(tags: Column) -> list[tuple[str, Column]]:
    return [(f, F.size(F.array_intersect(tags, X.strings(v)))) for f, v in FAMILY_TAGS.items()]


def ranked_families(tags: Column) -> Column:
    counts = [(f, n) for f, n in family_counts(tags) if f != "qa"]
    return F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(f).alias("family")) for i, (f, n) in enumerate(counts)])


def main_family(tags: Column) -> Column:
    """The family with most tags, the first of equals; null without any."""
    best = F.array_max(ranked_families(tags))
    return F.when(best["n"] > 0, best["family"])


def with_stack_family(df: DataFrame, tags: str) -> DataFrame:
    """``family``: the family with most tags (the first of equals, quality assurance aside) and ``families``: all."""
    ranked = ranked_families(F.col(tags))
    return df.withColumn("family", main_family(F.col(tags))).withColumn("families", F.transform(F.filter(ranked, lambda s: s["n"] > 0), lambda s: s["family"]))


def stack_disjoint(persona_tags: Column, job_tags: Column) -> Column:
    """Whether the posting lacks every tag of some family that the persona has tags of."""
    lacking = [F.arrays_overlap(persona_tags, X.strings(v)) & ~F.arrays_overlap(job_tags, X.strings(v)) for f, v in FAMILY_TAGS.items() if f != "qa"]
    out = lacking[0]
    for x in lacking[1:]:
        out = out | x
    return out


def stack_overlap(a: Column, b: Column) -> Column:
    """Common tags that aren't mere tooling."""
    noise = X.strings(C.PROCESS_NOISE_TAGS)
    return F.size(F.array_intersect(F.array_except(a, noise), F.array_except(b, noise)))


def tag_experience(history: DataFrame, as_of: str) -> DataFrame:
    """Years by applicant and tag: overlapping jobs merged, an open end is ``as_of``, inverted ranges dropped."""
    spans = (
        history.select("applicant_id", F.explode("canonical_skills_detected").alias("tag"), F.col("start_date").alias("s"), F.coalesce("end_date", F.lit(as_of).cast("date")).alias("e"))
        .filter("e >= s")
    )
    w = W.partitionBy("applicant_id", "tag").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("applicant_id", "tag", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    days = merged.groupBy("applicant_id", "tag").agg(F.sum(F.datediff("e", "s")).alias("days"))
    return days.withColumn("years", F.round(F.col("days") / 365.25, 1))


def personas_to_reembed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Personas whose must-have tags were added to or taken from."""
    both = old.select("id", F.col("must_have_tags").alias("was")).join(new.select("id", F.col("must_have_tags").alias("now")), "id")
    changed = F.concat(F.array_except("was", "now"), F.array_except("now", "was"))
    return both.withColumn("changed", F.array_sort(changed)).filter(F.size("changed") > 0).select("id", "changed")
