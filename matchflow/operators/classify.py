"""Classification of postings by native patterns: workplace, employment, seniority, experience, remote scope."""

from __future__ import annotations

import re

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X
from matchflow.operators.filters import is_specific

def with_workplace_type(df: DataFrame) -> DataFrame:
    """From the location, else from the text; hybrid before remote before on-site."""
    place, text = F.lower(F.coalesce("location_name", F.lit(""))), F.lower(F.coalesce("normalized_text", F.lit("")))
    by = lambda c: F.when(c.rlike("hybrid"), "hybrid").when(c.rlike("(remote|anywhere)"), "remote").when(c.rlike("(on-?site|in office)"), "on-site")
    return df.withColumn("inferred_workplace", F.coalesce("workplace_type", by(place), by(text)))


def with_employment_type(df: DataFrame) -> DataFrame:
    t = F.regexp_replace(F.lower(F.trim("employment_type")), "[ _-]", "")
    out = F.when(t.rlike("(fulltime|permanent|uop)"), "full_time").when(t.rlike("parttime"), "part_time").when(t.rlike("(contract|b2b|freelance|zlecenie)"), "contract").when(t.rlike("intern"), "internship").when(t.rlike("temp"), "temporary")
    return df.withColumn("employment", out)


def title_region() -> Column:
    """The region that the title names after a dash, first of the table; null without one."""
    tail, out = F.regexp_extract("title", r"\s[-–—]\s+(.+)$", 1), F
    for pattern, region in C.TITLE_REGIONS:
        out = out.when(tail.rlike(f"(?i){pattern}"), region)
    return out.otherwise(None)


def with_title_region(df: DataFrame) -> DataFrame:
    return df.withColumn("title_region", title_region())


def with_experience_range(df: DataFrame) -> DataFrame:
    """Least and most years asked for: 'a-b years' gives both, 'a+ years' the least alone."""
    text = F.lower(F.coalesce("normalized_text", F.lit("")))
    number = lambda g, p: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    pair = r"([0-9]{1,2}) ?(?:-|to) ?([0-9]{1,2}) ?(?:\+ ?)?years"
    return df.withColumn("years_min", F.coalesce(number(1, pair), number(1, r"([0-9]{1,2}) ?\+? ?years"))).withColumn("years_max", number(2, pair))


def utc_span(text: Column) -> Column:
    """Hours between the two UTC offsets of a range; null without one."""
    p = r"utc ?([+-][0-9]{1,2}) ?(?:to|-|and) ?utc ?([+-][0-9]{1,2})"
    n = lambda g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    return F.abs(n(2) - n(1))


def with_utc_span(df: DataFrame) -> DataFrame:
    span = utc_span(F.lower("normalized_text"))
    return df.withColumn("span", span).withColumn("span_scope", F.when(span <= 8, "region_fenced").when(span > 8, "global"))


def fired_probes(text: Column, low: Column) -> Column:
    """(name, weight) of the probes of a region fence that fire: one of weight 2 or two of weight 1 make a fence. ``low``: the
    text in lower case."""
    return F.array_compact(F.array(*[F.when(X.said(text, low, f"(?i){p}"), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, p, w in C.REGION_PROBES]))


def with_multi_probe(df: DataFrame) -> DataFrame:
    """``probes`` that fire and whether they fence a region."""
    text = F.coalesce("normalized_text", F.lit(""))
    staged = df.withColumn("_low", F.lower(text)).withColumn("_fired", fired_probes(text, F.col("_low")))
    total = F.aggregate("_fired", F.lit(0), lambda s, x: s + x["weight"])
    return staged.withColumn("probes", F.array_join(F.transform("_fired", lambda x: x["name"]), ",")).withColumn("region_fence", total >= 2).drop("_fired", "_low")


def fence_of(names: list[str]) -> str:
    """'X only', 'must be based in X', 'right to work in X', 'authorized to work in X', for any name of a country."""
    x = "(?:" + "|".join(names) + ")"
    ways = [rf"{x}\s+only", rf"must\s+(?:be\s+)?(?:based|located|reside|live)\s+in\s+(?:the\s+)?{x}", rf"right\s+to\s+work\s+(?:in|for)\s+(?:the\s+)?{x}", rf"authorized\s+to\s+work\s+in\s+(?:the\s+)?{x}"]
    return r"\b(?:" + "|".join(ways) + r")\b"


#: (pattern, country) of all strong wording of a country fence.
COUNTRY_FENCES = C.COUNTRY_SIGNALS + [(fence_of(names), code) for names, code in C.FENCING_COUNTRIES]


def with_scope_signals(df: DataFrame, column: str = "normalized_text") -> DataFrame:
    """What a text says on scope: ``always_global``, ``global_high``, ``country_high`` (its countries in ``fence_countries``,
    sorted), ``fence_regions``, ``medium`` (scopes, sorted) and ``negatives`` (reasons)."""
    text, low = F.coalesce(column, F.lit("")), F.col("_low")
    any_of = lambda ps: functools.reduce(Column.__or__, [X.said(text, low, "(?i)" + p) for p in ps])
    hits = lambda pairs, flag="(?i)": F.array_compact(F.array(*[F.when(X.said(text, low, flag + p), F.lit(n)) for p, n in pairs]))
    fences = hits(COUNTRY_FENCES)
    return (
        df.withColumn("_low", F.lower(text))
        .withColumn("always_global", any_of(C.ALWAYS_GLOBAL))
        .withColumn("global_high", any_of(C.GLOBAL_SIGNALS))
        .withColumn("_fences", fences)
        .withColumn("country_high", F.size("_fences") > 0)
        .withColumn("fence_countries", F.array_sort(F.array_distinct(F.filter("_fences", lambda x: x != ""))))
        .withColumn("fence_regions", F.array_sort(F.array_distinct(hits(C.REGION_SIGNALS))))
        .withColumn("medium", F.array_sort(F.array_distinct(hits(C.MEDIUM_SIGNALS, ""))))
        .withColumn("negatives", hits([(p, n) for p, n, _ in C.NEGATIVE_SIGNALS], ""))
        .drop("_fences", "_low")
    )


def infer_remote_scope(df: DataFrame) -> DataFrame:
    """First pass: workplace, then global, fencing and region wording of location and text, then the location alone."""
    place = F.coalesce("location_name", F.lit(""))
    both, low = F.concat_ws(" ", place, F.coalesce("normalized_text", F.lit(""))), F.lower(place)
    any_of = lambda ps: both.rlike("(?i)" + "|".join(ps))
    scope = (
        F.when(F.col("workplace_type").isin("on-site", "hybrid"), "onsite")
        .when(any_of(C.FIRST_GLOBAL), "global")
        .when(any_of(C.FIRST_FENCED), "country_fenced")
        .when(any_of([p for p, _ in C.REGION_SIGNALS if p.startswith(r"\bremote")]), "region_fenced")
        .when((F.col("workplace_type") == "remote") & low.rlike(r"^\s*remote\s*$"), "global")
        .when((F.size(X.countries_named(low)) > 0) | is_specific(low), "country_fenced")
        .otherwise("unknown")
    )
    return df.withColumn("inferred_scope", scope)


def classify_remote_scope(df: DataFrame) -> DataFrame:
    """The cascade: ``scope``, ``countries`` (sorted; null for none), ``resolved_by`` and ``confidence`` of the first step that decides.

    Workplaces that a source states (but for one source), then the location, then strong wording of the text without the
    location, then the location again, then region probes. Steps are staged columns, so that no single expression grows beyond
    what the code generator compiles."""
    place, work = F.coalesce("location_name", F.lit("")), F.col("workplace_type")
    low, tidy = F.lower(place), F.trim(F.regexp_replace(F.coalesce("normalized_text", F.lit("")), r"\s+", " "))
    quoted = F.regexp_replace(place, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    staged = df.withColumn("_t", F.when(place == "", tidy).otherwise(F.regexp_replace(tidy, F.concat(F.lit("(?iu)"), quoted), F.lit(" "))))
    staged = staged.withColumn("_low", F.lower("_t"))
    text, said = F.col("_t"), functools.partial(X.said, F.col("_t"), F.col("_low"))
    any_of = lambda ps: functools.reduce(Column.__or__, [said("(?i)" + p) for p in ps])
    first = lambda pairs, flag="(?i)": F.coalesce(*[F.when(said(flag + p), F.lit(n)) for p, n in pairs])
    against = lambda kind: functools.reduce(Column.__or__, [said(p) for p, _, k in C.NEGATIVE_SIGNALS if k == kind])
    groups = sum((low.rlike("(^|[^a-z])(" + "|".join(names) + ")($|[^a-z])").cast("int") for names in C.MACRO_REGIONS[1:]), low.rlike("(^|[^a-z])(" + "|".join(C.MACRO_REGIONS[0]) + ")($|[^a-z])").cast("int"))
    staged = staged.withColumns(
        {
            "_open": (work.isNull() | (work == "remote")) & (place != ""), "_groups": groups, "_first": F.get(X.countries_named(low), 0), "_specific": is_specific(low),
            "_anywhere": low.rlike(X.any_part(C.REMOTE_INDICATORS)), "_global": any_of(C.GLOBAL_SIGNALS), "_always": any_of(C.ALWAYS_GLOBAL), "_country": first(COUNTRY_FENCES),
            "_region": first(C.REGION_SIGNALS), "_onsite": work.isNull() & any_of(C.ONSITE_SIGNALS), "_never": against("all_remote"), "_not_global": against("global"),
        }
    )
    span = utc_span(F.col("_low"))
    soft = [F.when(said(p) & (F.lit(scope != "global") | ~F.col("_not_global")), scope) for p, scope in C.MEDIUM_SIGNALS]
    soft += [F.when(span <= 8, "region_fenced").when(~F.col("_not_global"), F.when(span > 8, "global"))]
    hard = F.col("_country").isNotNull() | F.col("_region").isNotNull() | F.col("_onsite") | F.col("_never")
    weights = F.transform(fired_probes(text, F.col("_low")), lambda x: x["weight"])
    staged = staged.withColumn("_says_global", F.col("_global") | (~hard & X.true_(F.coalesce(*soft) == "global"))).withColumn("_weights", weights)
    some = lambda codes: F.when(F.size(codes) > 0, codes)
    members = F.create_map(*[x for r, codes in C.TEXT_REGIONS.items() for x in (F.lit(r), X.strings(sorted(codes)))])
    staged = staged.withColumn("_codes", F.when(F.col("_global") | (F.col("_country") == ""), codes_in(text)))
    named = F.when(F.col("_country") == "", some(F.col("_codes"))).otherwise(F.array("_country"))
    own = F.when(F.col("_first").isNotNull(), F.array("_first"))
    fenced = F.aggregate("_weights", F.lit(0), lambda s, x: s + x) >= 2
    enough, conflict = F.length(text) >= 50, F.col("_global") & F.col("_specific")

    def verdict(scope: str, countries: Column | None = None, by: str = "step1_regex", confidence: Column | float = 0.7) -> Column:
        codes = F.lit(None) if countries is None else countries
        return F.struct(F.lit(scope).alias("scope"), codes.cast("array<string>").alias("countries"), F.lit(by).alias("resolved_by"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    result = (
        F.when(work.isin("on-site", "hybrid") & ~X.true_(F.col("ats_source") == "greenhouse"), verdict("onsite", by="step1_ats_native", confidence=1.0))
        .when(F.col("_open") & (F.col("_groups") >= 3), verdict("global"))
        .when(F.col("_open") & F.col("_anywhere") & F.col("_first").isNotNull(), verdict("country_fenced", own))
        .when(work.isNull() & F.col("_specific"), verdict("onsite"))
        .when(F.col("_global") & F.col("_always"), verdict("global", confidence=1.0))
        .when(F.col("_global") & ~F.col("_specific"), verdict("global", some(F.col("_codes")), confidence=1.0))
        .when(~F.col("_global") & F.col("_country").isNotNull(), verdict("country_fenced", named, confidence=1.0))
        .when(~F.col("_global") & F.col("_region").isNotNull(), verdict("region_fenced", members[F.col("_region")], confidence=1.0))
        .when(~F.col("_global") & (F.col("_onsite") | (F.col("_never") & ~X.true_(work == "remote"))), verdict("onsite", confidence=1.0))
        .when(F.col("_open") & ~F.col("_says_global") & F.col("_specific"), verdict("country_fenced", own))
        .when(enough & fenced, verdict("region_fenced", confidence=F.when(F.array_contains("_weights", 2), 1.0).otherwise(0.7)))
        .when(enough & F.col("_says_global") & ~conflict, verdict("global"))
        .when(~enough, verdict("undetermined", by="hard_fail", confidence=0.0))
        .otherwise(verdict("undetermined", by="deterministic_only_no_signal", confidence=0.0))
    )
    helpers = ["_t", "_low", "_open", "_groups", "_first", "_specific", "_anywhere", "_global", "_always", "_country", "_region", "_onsite", "_never", "_not_global", "_says_global", "_weights", "_codes", "_r"]
    out = staged.withColumn("_r", result)
    return out.withColumns({c: F.col(f"_r.{c}") for c in ("scope", "countries", "resolved_by", "confidence")}).drop(*helpers)


def codes_in(text: Column) -> Column:
    """Codes of the countries that a text names, or that belong to a region it names, sorted."""
    low = F.lower(text)
    members = X.values_named(low, {name: ",".join(codes) for name, codes in C.TEXT_REGIONS.items()})
    return F.array_sort(F.array_union(X.values_named(low, C.COUNTRIES), F.flatten(F.transform(members, lambda x: F.split(x, ",")))))


def extract_countries(df: DataFrame, column: str) -> DataFrame:
    """``countries``: the codes that ``codes_in`` finds; empty for none."""
    return df.withColumn("countries", codes_in(F.coalesce(column, F.lit(""))))


def strip_hq(df: DataFrame, hq: str) -> DataFrame:
    """``stripped``: the text with a blank in place of a company's own location, wherever and however it is written."""
    place = F.col(hq)
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(place, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return df.withColumn("stripped", F.when(F.coalesce(place, F.lit("")) == "", F.col("normalized_text")).otherwise(F.regexp_replace("normalized_text", quoted, F.lit(" "))))


def place_scope() -> Column:
    """Scope by source, workplace and location alone, before any text is read."""
    low = F.lower(F.coalesce("location_name", F.lit("")))
    regions = sum((F.when(low.rlike("(^|[^a-z])(" + "|".join(map(re.escape, names)) + ")($|[^a-z])"), 1).otherwise(0) for names in C.MACRO_REGIONS), F.lit(0))
    remote = low.rlike(X.any_part(C.REMOTE_INDICATORS))
    return (
        F.when((F.col("ats_source") != "greenhouse") & F.col("workplace_type").isin("on-site", "hybrid"), "onsite")
        .when((regions >= 3) | low.rlike("worldwide|anywhere|global|remote - world|remote \\(world"), "global")
        .when(remote & (F.size(X.countries_named(low)) > 0), "country_fenced")
        .when(F.col("workplace_type").isNull() & is_specific(low), "onsite")
        .otherwise("undetermined")
    )


def profile_company_feed(df: DataFrame) -> DataFrame:
    """Web-development postings of a company by ``place_scope``, its addressable yield (global, and half of what is open),
    and whether it has two or more of them. Companies without any have a row, too."""
    web, scope = F.col("title").rlike(X.any_part(C.WEBDEV_TERMS)), place_scope()
    n = {s: F.count_if(web & (scope == s)).alias(name) for s, name in (("global", "global_jobs"), ("country_fenced", "fenced_jobs"), ("onsite", "onsite_jobs"), ("undetermined", "undetermined"))}
    out = df.groupBy("ats_source", "ats_slug").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(web).alias("webdev"), *n.values())
    share = F.when(F.col("webdev") > 0, F.round(F.col("global_jobs") / F.col("webdev"), 6)).otherwise(0.0)
    return out.withColumn("addressable", F.col("global_jobs") + 0.5 * F.col("undetermined")).withColumn("global_share", share).withColumn("passed", F.col("webdev") >= 2)


def evaluate_stack_gate(df: DataFrame) -> DataFrame:
    """Web-development titles by company: how many, what share, and whether there are two or more."""
    hit = F.col("title").rlike(X.any_part(C.WEBDEV_TERMS))
    out = df.groupBy("ats_source", "ats_slug").agg(F.count_if(hit).alias("webdev"), F.count(F.lit(1)).alias("jobs"))
    passes = F.col("webdev") >= 2
    tier = F.when(F.col("webdev") > 2, "active").otherwise("dormant")
    return out.withColumn("share", F.round(F.col("webdev") / F.col("jobs"), 6)).withColumn("passes", passes).withColumn("initial_tier", tier)


def with_title_seniority(df: DataFrame) -> DataFrame:
    t = F.lower("title")
    level = F.when(t.rlike("(junior|associate|entry|intern|trainee)"), "junior").when(t.rlike("(senior|sr[.]|sr )"), "senior").when(t.rlike("(lead|staff|principal|architect|manager|director|head|expert)"), "lead").otherwise("mid")
    return df.withColumn("level", level)


def with_excluded_country(df: DataFrame, excluded: list[str]) -> DataFrame:
    """``excluded``: the first listed country that is excluded, else the location's country if it is, else the first excluded
    one that the location names."""
    bad, place = X.strings(excluded), F.lower(F.coalesce("location_name", F.lit("")))
    staged = df.withColumn("_named", X.countries_named(place))
    listed = F.filter(F.transform("location_countries", F.upper), lambda c: c.isin(excluded))
    first = F.get("_named", 0)
    return staged.withColumn("excluded", F.coalesce(F.get(listed, 0), F.when(first.isin(excluded), first), F.get(F.array_intersect(bad, "_named"), 0))).drop("_named")
