"""Filters and flags over postings, companies and matches. Every one is a narrow, native-expression pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X


def filter_engineering_titles(df: DataFrame) -> DataFrame:
    return df.filter(F.col("title").rlike(X.any_word(C.ENGINEERING_TERMS, plural=True)))


def filter_webdev_titles(df: DataFrame) -> DataFrame:
    return df.filter(F.col("title").rlike(X.any_part(C.WEBDEV_TERMS)))


def country_fence() -> Column:
    """The first kind of fence that title or location shows, in fixed order; null if none does."""
    place, fenced = F.lower(F.trim(F.coalesce("location_name", F.lit("")))), "(?i)" + "|".join(C.FENCES)
    states = lambda p: F.exists(F.regexp_extract_all(place, F.lit(p), F.lit(1)), lambda x: x.isin(C.US_STATES))
    by_wording = F.when(place.rlike(C.FENCING_REGIONS), "location_region").when(states(r"remote\s*,\s*([a-z]{2})\b"), "location_us_state").otherwise("location_country")
    nowhere = place.rlike("remote|anywhere|worldwide|global|distributed|any location")
    return (
        F.when(F.col("title").rlike(fenced), "title_fence")
        .when(place == "", None)
        .when(place.rlike(fenced), by_wording)
        .when(place.rlike(X.any_part(C.REGION_TERMS)), "location_region")
        .when(states(r",\s*([a-z]{2})\b"), "location_us_state")
        .when(place.rlike(X.any_part(C.NAMED_COUNTRIES)) | (place.rlike(r"\bus\b") & (F.length(place) <= 5)), "location_country")
        .when(~nowhere & (place.contains(";") | place.rlike(r"^[a-z].*,\s*[a-z]") | (F.length(place) < 50)), "location_specific_city")
    )


def with_country_fence(df: DataFrame) -> DataFrame:
    return df.withColumn("fence", country_fence())


def is_specific(place: Column) -> Column:
    """A lower-case place that is neither empty nor has a word for anywhere or the name of a broad region in it."""
    return (place != "") & ~place.rlike(X.any_part(C.REMOTE_INDICATORS + C.BROAD_REGIONS))


def with_fence_flag(df: DataFrame) -> DataFrame:
    """The stored flag, or where it is unknown what title and location (any kind of fence) and the text's words on work
    permits say."""
    said = F.coalesce("normalized_text", F.lit("")).rlike("(?i)(?<![a-z0-9_])(" + "|".join(C.PERMIT_PATTERNS) + ")(?<=[a-z0-9_])(?![a-z0-9_])")
    return df.withColumn("fenced", F.coalesce("is_fenced", country_fence().isNotNull() | said))


def with_natsec_flag(df: DataFrame) -> DataFrame:
    """Hard words in title or the text's start (the rule reads 3,000 characters); hints count only with talk of a clearance."""
    staged = df.withColumn("_said", F.concat_ws(" ", "title", F.substring("normalized_text", 1, 3000))).withColumn("_low", F.lower("_said"))
    named = lambda terms: X.said(F.col("_said"), F.col("_low"), X.whole_terms(terms))
    hard, weak = named(C.NATSEC_WORDS), named(C.NATSEC_HINTS) & named(C.CLEARANCE_WORDS)
    return staged.withColumn("natsec", F.coalesce("is_natsec", hard | weak, F.lit(False))).drop("_said", "_low")


def with_qa_flag(df: DataFrame) -> DataFrame:
    qa_title = F.col("title").rlike(X.any_word(C.QA_TITLE_TERMS))
    tags = F.size(F.array_intersect("extracted_tags", X.strings(C.STACK_FAMILIES["qa"])))
    developer = F.col("title").rlike(X.any_word(["developer", "engineer", "programmer"]))
    return df.withColumn("qa", F.coalesce("is_qa", qa_title | ((tags >= 3) & ~developer), F.lit(False)))


def filter_fresh(df: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Published within ``days``; an unknown date is not fresh."""
    return df.filter(F.col("published_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"))


def filter_recent(df: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Like ``filter_fresh``, with the date of detection standing in for an unknown one."""
    return df.filter(F.coalesce("published_at", "detected_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"))


def with_is_active(df: DataFrame, source: str = "ats_source", status: str = "source_status") -> DataFrame:
    """False where a source calls a posting closed; true for sources that list open ones only, for no or unknown words."""
    closed = F.lower(F.trim(status)).isin(C.CLOSED_STATUSES) & ~X.true_(F.col(source).isin(C.OPEN_ONLY_SOURCES))
    return df.withColumn("active", ~X.true_(closed))


def filter_persona_tech(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Short keywords as words, long ones anywhere, in tags, title and text."""
    text = F.concat_ws(" ", "extracted_tags", "title", "normalized_text")
    short, long = [k for k in keywords if len(k) <= 3], [k for k in keywords if len(k) > 3]
    hit = F.lit(False)
    if short:
        hit = hit | text.rlike(X.any_word(short))
    if long:
        hit = hit | text.rlike(X.any_part(long))
    return df.filter(hit)


def search_postings(
    df: DataFrame, text: str | None = None, workplace: list[str] | None = None, scope: str | None = None, employment: str | None = None, min_pay: float | None = None, max_pay: float | None = None,
    min_years: int | None = None, max_years: int | None = None, department: str | None = None, skills: list[str] | None = None, posted_since: str | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Faceted search of active postings: facets not asked for, and unknown pay or experience, pass. With ``limit`` the newest
    first (published, else detected; ties to smaller ids), from ``offset`` on."""
    found = df.filter(F.col("status") == "active")
    when = F.coalesce("published_at", "detected_at")
    if text and text.strip():
        like = f"%{text.strip()}%"
        found = found.filter(F.col("title").ilike(like) | F.col("normalized_text").ilike(like) | F.array_contains("extracted_tags", text))
    for column, value in (("remote_scope", scope), ("employment_type", employment)):
        found = found if value is None else found.filter(F.col(column) == value)
    found = found.filter(F.col("workplace_type").isin(workplace)) if workplace else found
    for column, least, most in (("compensation_min", min_pay, None), ("compensation_max", None, max_pay), ("experience_min_years", min_years, None), ("experience_max_years", None, max_years)):
        found = found if least is None else found.filter(F.col(column).isNull() | (F.col(column) >= least))
        found = found if most is None else found.filter(F.col(column).isNull() | (F.col(column) <= most))
    found = found.filter(F.col("department").ilike(f"%{department}%")) if department else found
    found = found.filter(F.arrays_overlap("extracted_tags", X.strings(skills))) if skills else found
    found = found.filter(when >= F.lit(posted_since).cast("timestamp")) if posted_since else found
    return found if limit is None else found.orderBy(when.desc_nulls_last(), "id").offset(offset).limit(limit)


def filter_servable(df: DataFrame) -> DataFrame:
    """Global postings without a known flag against them."""
    flags = X.true_(F.col("is_fenced")) | X.true_(F.col("is_natsec")) | X.true_(F.col("is_qa"))
    return df.filter((F.col("remote_scope") == "global") & ~flags)


def filter_match_status(df: DataFrame, view: str, as_of: str) -> DataFrame:
    views = {
        "pending": F.col("status").isin("pending", "error"),
        "stale": (F.col("status") == "stale") & (F.col("stale_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL 24 HOURS")),
        "approved": (F.col("status") == "approved") & ~F.col("is_read"),
        "viewed": (F.col("status") == "approved") & F.col("is_read"),
    }
    return df.filter(views[view])


def filter_valid_slugs(df: DataFrame) -> DataFrame:
    """Slugs that can be a company's: 2 to 60 characters, not a number, no word of site navigation, no more than 25
    characters without a separator, and with a vowel if there are but two."""
    slug = F.lower(F.trim("ats_slug"))
    bad = slug.rlike("^[0-9]+$") | slug.isin(C.NAVIGATION_SLUGS) | ((F.length(slug) > 25) & ~slug.rlike("[-_./]")) | ((F.length(slug) <= 2) & ~slug.rlike("[aeiou]"))
    return df.filter(F.length(slug).between(2, 60) & ~bad)


def filter_aggregators(df: DataFrame, slugs: DataFrame, words: list[str]) -> DataFrame:
    """Without blacklisted slugs and names that contain a blacklisted word."""
    out = df.join(slugs.select(F.col("ats_slug")).distinct(), "ats_slug", "left_anti")
    return out.filter(~F.lower("company_name").rlike(X.any_part(words))) if words else out


def filter_career_domains(df: DataFrame, domain: str = "domain") -> DataFrame:
    parts = F.split(F.lower(domain), r"\.")
    return df.filter((F.size(parts) >= 3) & parts[0].isin("careers", "career", "jobs", "job", "work", "talent", "join", "hiring", "apply"))


def with_normalization_action(df: DataFrame) -> DataFrame:
    """What to do with a posting: skip what is done, rejected or aged out; normalise what failed before or is new."""
    action = (
        F.when(F.col("normalized_at").isNotNull(), "skip:processed")
        .when(F.col("status") == "rejected", "skip:rejected")
        .when(F.col("status") == "normalization_failed", "normalize:retry")
        .when(F.col("status").isin("stale", "gone"), "skip:aged_out")
        .otherwise("normalize:new")
    )
    return df.withColumn("action", action)


def select_due_retries(df: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    """The oldest ``n`` retries that are due and not used up."""
    due = df.filter((F.col("next_retry_at") < F.lit(as_of).cast("timestamp")) & (F.col("retry_count") < 3))
    return due.orderBy("next_retry_at", "id").limit(n)


def sample_suspects(df: DataFrame, n: int, seed: str) -> DataFrame:
    """Global postings with a specific location, the ``n`` first by a hash of seed and id: the same on every run."""
    suspect = df.filter((F.col("remote_scope") == "global") & is_specific(F.lower(F.coalesce("location_name", F.lit("")))))
    return suspect.withColumn("draw", F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))).orderBy("draw", "id").limit(n)
