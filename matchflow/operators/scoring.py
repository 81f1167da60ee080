"""Scores of matches and companies, blockers, and what follows from verdicts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X
from matchflow.operators.classify import title_region
from matchflow.operators.filters import is_specific
from matchflow.operators.tags import main_family


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def match_score(df: DataFrame) -> DataFrame:
    """``match_score`` 0 to 100 over a match view: similarity, overlap, workplace, place, seniority and company, less
    blocked tags, coverage gap and tags off the focus. Unknown inputs are neutral."""
    none = lambda c: F.size(F.coalesce(c, X.no_strings())) == 0
    wants = lambda x: F.array_contains("assignment_types", x)
    title = F.lower("title")
    workplace = (
        F.when(F.col("workplace_type").isNull() | none("assignment_types"), 0.5)
        .when(F.array_contains("assignment_types", F.col("workplace_type")), 1.0)
        .when((F.col("workplace_type") == "hybrid") & (wants("remote") | wants("remote_local")), 0.5)
        .when((F.col("workplace_type") == "remote") & wants("hybrid"), 0.5)
        .when((F.col("workplace_type") == "on-site") & wants("hybrid"), 0.5)
        .otherwise(0.0)
    )
    place = F.lower(F.coalesce("location_name", F.lit("")))
    named = {"US": "(united states|u[.]s[.]|usa| america)", "CA": "canada", "DE": "germany", "RS": "serbia"}
    own = F.lit(False)
    for code, words in named.items():
        own = own | ((F.col("country") == code) & place.rlike(words))
    location = (
        F.when(F.col("country").isNull() | (place == ""), 0.5)
        .when(F.col("remote_scope") == "global", 1.0)
        .when(place.rlike("remote|global|anywhere|worldwide"), F.when(own, 1.0).when(place.rlike("(united states|usa|canada|argentina|germany|serbia)"), 0.2).otherwise(1.0))
        .otherwise(0.5)
    )
    has = lambda *levels: F.when(F.arrays_overlap("seniority_levels", X.strings(list(levels))), 1.0).otherwise(0.0)
    seniority = (
        F.when(none("seniority_levels"), 0.5)
        .when(title.rlike("(junior|associate|entry|intern|trainee)"), has("junior"))
        .when(title.rlike(r"(senior|sr\.|sr )"), has("senior"))
        .when(title.rlike("(lead|staff|principal|architect|manager|director|head|expert)"), has("lead", "staff", "principal"))
        .otherwise(0.5)
    )
    overlap = F.coalesce("overlap_score", F.lit(0))
    company = F.coalesce("quality", F.lit(50)) / 100.0 + F.coalesce("size_score", F.lit(0.0))
    empty = none("extracted_tags")
    blocked = F.when(none("blocklist_tags") | empty, 0.0).when(F.arrays_overlap("blocklist_tags", "extracted_tags"), 1.0).otherwise(0.0)
    gap = F.when(none("must_have_tags") | empty, 0.0).when(overlap == 0, 1.0).otherwise(1.0 - overlap / F.least(F.size("must_have_tags"), F.size("extracted_tags")))
    off = F.size(F.array_except(F.array_intersect("extracted_tags", X.strings(C.OFF_FOCUS_TAGS)), F.col("must_have_tags")))
    gains = (
        (1 - F.coalesce(F.col("cosine_distance"), F.lit(1.0))) * 0.25
        + (1 - F.exp(-0.4 * F.least(overlap, F.lit(5)))) * 0.30
        + workplace * 0.12
        + location * 0.08
        + seniority * 0.08
        + company * 0.17
    )
    costs = blocked * 0.10 + gap * 0.10 + F.least(off / 3.0, F.lit(1.0)) * 0.08
    return df.withColumn("match_score", F.bround(F.round(clamp(gains - costs, 0.0, 1.0) * 100, 6), 0))


def company_size_score(companies: DataFrame) -> DataFrame:
    """``raw_score`` by headcount, agency, listing and discovery source; ``size_score`` in [-0.30, 0.30]; ``advised_tier``."""
    n = F.col("employee_count")
    headcount = F.when(n.isNull(), 0).when(n > 5000, -25).when(n >= 1000, -15).when(n >= 250, -5).when(n >= 50, 0).when(n >= 20, 15).otherwise(25)
    origin = F.lit(0)
    for source, points in C.SOURCE_ORIGIN_SCORE.items():
        origin = F.when(F.col("discovery_source") == source, points).otherwise(origin)
    raw = headcount + F.when(F.col("is_agency"), -40).otherwise(0) + F.when(F.col("is_public"), -20).otherwise(0) + origin
    tier = F.when(F.col("is_agency"), "dead").when(raw > 15, "active_hot").when(raw < -20, "dormant")
    return companies.withColumn("raw_score", raw).withColumn("size_score", clamp(raw / 100.0, -0.30, 0.30)).withColumn("advised_tier", tier)


def company_quality(companies: DataFrame, jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Approved share of a company's decided matches in percent, 50 where there are none."""
    decided = matches.filter(F.col("status").isin("approved", "rejected")).select("job_id", "status", "evaluated_at")
    by = (
        decided.join(jobs.select(F.col("id").alias("job_id"), "ats_source", "ats_slug"), "job_id")
        .groupBy("ats_source", "ats_slug")
        .agg(
            F.count_if(F.col("status") == "approved").alias("approved"),
            F.count_if(F.col("status") == "rejected").alias("rejected"),
            F.max(F.when(F.col("status") == "approved", F.col("evaluated_at"))).alias("last_approved_at"),
        )
    )
    out = companies.join(by, ["ats_source", "ats_slug"], "left").fillna(0, ["approved", "rejected"])
    total = F.col("approved") + F.col("rejected")
    return out.withColumn("total", total).withColumn("quality", F.when(total > 0, F.round(100.0 * F.col("approved") / total, 0)).otherwise(50.0))


def fusion_score(companies: DataFrame, sources: DataFrame) -> DataFrame:
    """1 + the number of different sources that have found a company."""
    n = sources.groupBy(F.col("company_id").alias("id")).agg(F.countDistinct("discovery_source").alias("n"))
    return companies.join(n, "id", "left").withColumn("fusion", 1 + F.coalesce("n", F.lit(0))).drop("n")


def with_stack(personas: DataFrame) -> DataFrame:
    """What the title rules read of a persona alone, so that it is worked out before personas meet postings: ``_tags`` (in lower
    case) and ``_family`` (its main stack family)."""
    own = F.coalesce("must_have_tags", X.no_strings())
    return personas.withColumn("_tags", F.transform(own, F.lower)).withColumn("_family", main_family(own))


def title_blockers(pairs: DataFrame) -> DataFrame:
    """``blocker`` and ``blocker_type`` (platform or role_family): the first rule that bars a persona from a title.

    A platform bars personas of another main stack family than its own (all, if it is enterprise software; none, if the
    persona has no family). A role family bars all but personas with certain tags, levels or both kinds of tags. ``pairs`` may
    come with the columns of ``with_stack``.
    """
    title, has = F.coalesce("title", F.lit("")), lambda tags: F.arrays_overlap("_tags", X.strings(tags))
    named = lambda p: X.said(title, F.col("_low"), f"(?i){p}")
    by_platform, by_role = F, F
    for name, pattern, family in C.PLATFORM_PATTERNS:
        barred = F.lit(True) if family == "enterprise" else X.true_(F.col("_family") != family)
        by_platform = by_platform.when(named(pattern) & barred, name)
    for name, pattern, tags in C.ROLE_FAMILY_PATTERNS:
        exempt = has(tags) if tags else F.lit(False)
        if name == "AI Engineer (application)":
            exempt = F.array_contains("_tags", C.PROMPT_TAG) & has(C.JS_SIGNAL_TAGS)
        if name == "Engineering Manager":
            exempt = F.exists(F.coalesce("seniority_levels", X.no_strings()), lambda x: F.lower(x).isin(C.MANAGEMENT_LEVELS))
        by_role = by_role.when(named(pattern) & ~X.true_(exempt), name)
    staged = (pairs if "_family" in pairs.columns else with_stack(pairs)).withColumn("_low", F.lower(title))
    staged = staged.withColumn("_platform", by_platform.otherwise(None)).withColumn("_role", by_role.otherwise(None))
    kind = F.when(F.col("_platform").isNotNull(), "platform").when(F.col("_role").isNotNull(), "role_family")
    return staged.withColumn("blocker", F.coalesce("_platform", "_role")).withColumn("blocker_type", kind).drop("_tags", "_family", "_low", "_platform", "_role")


def with_places(jobs: DataFrame) -> DataFrame:
    """What the hard checks read of a posting alone, so that it is worked out before postings meet applicants: ``_named``
    (countries of the location), ``_tokens`` (its words), ``_listed`` (countries listed, by code or name), ``_listing`` and
    ``_text`` (there are any), ``_specific``, ``_region`` (first broad region), ``_tag`` (region of the title), ``_fence``
    (demand of a work permit), ``_welcome`` (contractors from anywhere), ``_senior``, ``_usd`` (pay) and ``_spread`` (a remote
    location names three places or more; null for one that isn't remote). Patterns of the text are tried only where it holds a
    string that they need."""
    place, text = F.lower(F.coalesce("location_name", F.lit(""))), F.coalesce("normalized_text", F.lit(""))
    listed = F.coalesce("location_countries", X.no_strings())
    said = lambda patterns: functools.reduce(Column.__or__, [X.said(text, F.col("_low"), f"(?i){p}") for p in patterns])
    senior = F.coalesce("title", F.lit("")).rlike(f"(?i){C.SENIOR_TITLE}") | said([C.SENIOR_TEXT])
    staged = jobs.withColumn("_low", F.lower(text)).withColumns({"_fence": said(C.WORK_AUTH_FENCES), "_welcome": said(C.CONTRACTOR_WELCOMES), "_senior": senior}).drop("_low")
    return staged.withColumns(
        {
            "_named": X.countries_named(place),
            "_spread": F.when(place.contains("remote"), F.size(F.filter(F.split(place, "[,/]"), lambda x: F.trim(x) != "")) >= 3),
            "_tokens": F.split(F.upper(place), "[^A-Z]+"),
            "_listed": F.array_union(F.transform(listed, F.upper), X.countries_named(F.lower(F.array_join(listed, " ; ")))),
            "_listing": F.size(listed) > 0,
            "_text": text != "",
            "_specific": is_specific(place),
            "_region": F.coalesce(*[F.when(place.contains(r), r) for r in C.BROAD_REGIONS]),
            "_tag": title_region(),
            "_usd": X.to_usd(F.coalesce("compensation_max", "compensation_min"), F.col("compensation_currency")),
        }
    )


def hard_blockers(pairs: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """``blockers``: every hard reason why an applicant can't have a posting, in the order of the nine checks; ``passes``: there
    is none; ``pattern``: the first, or the title's region where that is among them.

    Unknown countries, locations, pay or years block nothing. A listed country counts as the applicant's if it is its code
    or has its name. ``pairs`` may come with the columns of ``with_places``."""
    df = pairs if "_named" in pairs.columns else with_places(pairs)
    df = df.withColumn("_own", F.upper("country")).withColumn("_us_ok", X.true_(F.arrays_overlap("preferred_compliance", X.strings(C.US_COMPLIANCE))))
    own, place, scope, work = F.col("_own"), F.coalesce("location_name", F.lit("")), F.coalesce("remote_scope", F.lit("")), F.col("workplace_type")
    known = own.isin(list(C.LOCATION_COUNTRIES))
    here = F.array_contains("_named", own) | (~known & F.array_contains("_tokens", own))
    allowed, first, us_ok = F.array_contains("_listed", own), F.get("_named", 0), F.col("_us_ok")
    open_scope, listing, text = scope.isin("unknown", "undetermined"), F.col("_listing"), F.col("_text")
    remote = F.coalesce(work, F.lit("remote")) == "remote"
    friendly = F.lit(False)
    for code, regions in C.FRIENDLY_REGIONS.items():
        friendly = friendly | ((own == code) & F.col("_tag").rlike(X.any_part(regions)))
    bad = F.lit(False)
    for code in excluded or []:
        bad = bad | F.array_contains("_listed", code) | F.array_contains("_named", code) | (F.lit(code not in C.LOCATION_COUNTRIES) & F.array_contains("_tokens", code))
    permit = listing & remote & ~scope.isin("onsite", "global") & ~allowed & text & ~F.col("_welcome")
    by_list = F.when(listing & ~text, ~allowed).when(~listing & F.col("_spread").isNotNull(), (F.col("_spread") & ~here) | ((first != own) & ~((first == "US") & us_ok)))
    elsewhere = (open_scope & F.col("_specific")) | ((scope == "global") & first.isNotNull() & (~listing | ~text))
    members = F.create_map(*[x for r, codes in C.REGION_MEMBERS.items() for x in (F.lit(r), X.strings(codes))])
    onsite = (work == "on-site") | (scope == "onsite")
    at_place = F.when(X.true_(onsite), "explicit_on_site").when((work == "hybrid") & (scope != "global"), "hybrid_foreign_location").when(
        work.isNull() & open_scope & F.col("_specific"), "null_workplace_specific_foreign_location"
    )
    years, most = F.col("years_of_experience"), F.col("experience_max_years")
    checks = [
        F.when(bad, "excluded_country"),
        F.when(F.col("_tag").isNotNull() & own.isNotNull() & ~friendly, "title_region_tag"),
        F.when(permit, F.when(F.col("_fence"), "work_auth_fencing").when(~F.array_contains("_listed", "US"), "country_fenced_non_us")),
        F.when(own.isNotNull() & work.isin("remote", "hybrid") & ~scope.isin("global", "region_fenced", "undetermined", "unknown") & by_list, "location_country_list"),
        F.when((work == "remote") & (place != "") & elsewhere & ~here & ~(F.array_contains("_named", "US") & us_ok), "remote_specific_foreign_location"),
        F.when((place != "") & ~here, at_place),
        F.when(remote & (scope != "global") & ~F.array_contains(members[F.col("_region")], own) & ~((F.col("_region") == "north america") & us_ok), "region_fenced_location"),
        F.when(F.col("_usd") < F.col("expected_comp_min") * 0.7, "compensation_mismatch"),
        F.when(F.col("_senior") & (most < 7) & (years > 10), "inverted_experience_band").when(years > most + 5, "experience_gap"),
    ]
    staged = df.withColumn("blockers", F.array_compact(F.array(*checks)))
    tag = F.array_contains("blockers", "title_region_tag")
    out = staged.withColumn("passes", F.size("blockers") == 0).withColumn("pattern", F.when(tag, "title_region_tag").otherwise(F.get("blockers", 0)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def posting_rejections(pairs: DataFrame) -> DataFrame:
    """A posting is rejected if no applicant passes, for the pattern of the first applicant."""
    by = pairs.groupBy("job_id").agg(F.bool_or("passes").alias("any_pass"), F.min_by("pattern", "user_id").alias("first"))
    return by.select("job_id", (~F.col("any_pass")).alias("rejected"), F.when(~F.col("any_pass"), F.col("first")).alias("pattern"))


def with_rejection_reason(df: DataFrame) -> DataFrame:
    """``reason``: the first kind of reason that the blockers name; ``other`` without any."""
    text, out = F.lower(F.concat_ws(" ", F.coalesce("llm_blockers", X.no_strings()))), F
    for name, words in C.REJECTION_REASONS:
        out = out.when(text.rlike(words), name)
    return df.withColumn("reason", out.otherwise("other"))


def drift_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """``drift`` of known postings: unchanged text, same meaning (cosine distance up to 0.15), drifted, or new."""
    o = old.select("id", F.col("h").alias("old_h"), F.col("v").alias("old_v"))
    both = new.join(o, "id", "left")
    distance = X.cosine_distance(F.col("old_v"), F.col("v"))
    status = F.when(F.col("old_h").isNull(), "new").when(F.col("old_h") == F.col("h"), "unchanged").when(distance > 0.15, "drifted").otherwise("same")
    return both.select("id", status.alias("drift"))


def apply_verdicts(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending matches take their verdict: approved, or rejected with a reason; all others stay."""
    v = verdicts.select(F.col("id").alias("_id"), F.col("verdict"))
    j = with_rejection_reason(matches).join(v, F.col("id") == F.col("_id"), "left")
    now = (F.col("status") == "pending") & F.col("verdict").isNotNull()
    status = F.when(now & (F.col("verdict") == "approved"), "approved").when(now, "rejected").otherwise(F.col("status"))
    return j.select("id", status.alias("new_status"), F.when(now & (F.col("verdict") != "approved"), F.col("reason")).alias("rejection_reason"))


def employer_openness(companies: DataFrame, jobs: DataFrame, matches: DataFrame, personas: DataFrame, as_of: str) -> DataFrame:
    """(id, approved_90d, approved_year, pending_30d, frontend_jobs_90d, new_tier) of polled companies that are not dead:
    decisions for front-end personas and their own front-end postings. One approval within a year makes a company hot."""
    ago = lambda days: F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")
    front = X.strings(C.FRONTEND_TAGS)
    who = personas.filter(F.arrays_overlap("must_have_tags", front)).select(F.col("id").alias("persona_id"))
    of = jobs.select(F.col("id").alias("job_id"), "ats_source", "ats_slug")
    ok, at = F.col("status") == "approved", F.col("evaluated_at")
    m = matches.filter(F.col("status").isin("approved", "pending")).select("job_id", "persona_id", "status", "evaluated_at", "created_at").join(who, "persona_id", "left_semi").join(of, "job_id")
    m = m.groupBy("ats_source", "ats_slug").agg(
        F.count_if(ok & (at > ago(90))).alias("approved_90d"), F.count_if(ok & at.between(ago(365), ago(90))).alias("approved_year"), F.count_if((F.col("status") == "pending") & (F.col("created_at") > ago(30))).alias("pending_30d")
    )
    own = jobs.filter((F.col("detected_at") > ago(90)) & (F.col("status") == "active") & F.arrays_overlap("extracted_tags", front)).groupBy("ats_source", "ats_slug").agg(F.count(F.lit(1)).alias("frontend_jobs_90d"))
    live = companies.filter(F.col("polling_enabled") & (F.col("tier") != "dead")).select("id", "ats_source", "ats_slug", "tier")
    out = live.join(m, ["ats_source", "ats_slug"], "left").join(own, ["ats_source", "ats_slug"], "left").fillna(0, ["approved_90d", "approved_year", "pending_30d", "frontend_jobs_90d"])
    hot = (F.col("approved_90d") > 0) | (F.col("approved_year") > 0)
    return out.select("id", "approved_90d", "approved_year", "pending_30d", "frontend_jobs_90d", F.when(hot, "active_hot").otherwise(F.col("tier")).alias("new_tier"))
