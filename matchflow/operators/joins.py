"""Joins, sorts and top-k reports over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X
from matchflow.operators.names import contained, names_match, normalized_name


def match_view(matches: DataFrame, jobs: DataFrame, personas: DataFrame, applicants: DataFrame) -> DataFrame:
    """A match with its posting, persona and applicant; matches without any of them drop out."""
    j = jobs.select(F.col("id").alias("job_id"), "title", "ats_source", "ats_slug", "location_name", "remote_scope", "workplace_type", "extracted_tags")
    known = [c for c in ("_tags", "_family") if c in personas.columns]  # of ``scoring.with_stack``
    p = personas.select(F.col("id").alias("persona_id"), "must_have_tags", "blocklist_tags", "seniority_levels", *known)
    a = applicants.select(F.col("user_id").alias("applicant_id"), "country", "assignment_types")
    return matches.join(j, "job_id").join(p, "persona_id").join(a, "applicant_id")


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with the tier of their company; of several companies with one key the smallest id counts."""
    c = companies.groupBy("ats_source", "ats_slug").agg(F.min_by("tier", "id").alias("tier"), F.min("id").alias("company_id"))
    return jobs.join(c, ["ats_source", "ats_slug"], "left")


def unmatched_postings(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    routable = jobs.filter((F.col("status") == "active") & (F.col("remote_scope") == "global"))
    return routable.join(matches.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti")


def reprocess_candidates(jobs: DataFrame, personas: DataFrame, matches: DataFrame, n: int = 1000) -> DataFrame:
    """Active postings that share a tag with some persona and have no match yet, the first ``n`` by id."""
    wanted = personas.select(F.explode("must_have_tags").alias("tag")).distinct()
    j = jobs.filter(F.col("status") == "active").select("id", F.explode("extracted_tags").alias("tag"))
    hit = j.join(wanted, "tag", "left_semi").select("id").distinct()
    return hit.join(matches.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti").orderBy("id").limit(n)


def new_company_names(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(c)), " +", " ")
    names = jobs.select(tidy("company_name").alias("name")).distinct()
    return names.join(companies.select(tidy("company_name").alias("name")).distinct(), "name", "left_anti")


def match_existing_companies(new: DataFrame, companies: DataFrame) -> DataFrame:
    """``matched_by``: how a new company is known already: by canonical name, else by root domain. Two equi-joins."""
    names = companies.groupBy(X.canonical_name(F.col("company_name")).alias("_name")).agg(F.min("id").alias("by_name"))
    domains = companies.filter("root_domain IS NOT NULL").groupBy(F.col("root_domain").alias("_domain")).agg(F.min("id").alias("by_domain"))
    out = new.withColumn("_name", X.canonical_name(F.col("company_name"))).join(names, "_name", "left").join(domains, F.col("root_domain") == F.col("_domain"), "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_domain").isNotNull(), "domain")
    return out.select("id", F.coalesce("by_name", "by_domain").alias("known_id"), how.alias("matched_by"))


def match_layoffs(layoffs: DataFrame, companies: DataFrame) -> DataFrame:
    """(layoff_id, id): companies whose normalised name equals or contains a layoff's, or stands in it. Layoffs repeat names
    and come last, so that the pairs of rows are made where they are given out, and not sent. No side is broadcast: names
    are longer than what Spark takes them for by the size of their files."""
    lay = layoffs.select("layoff_id", normalized_name(F.col("company")).alias("l"))
    com = companies.select("id", normalized_name(F.col("company_name")).alias("r"))
    pairs = names_match(lay.select(F.col("l").alias("name")), com.select(F.col("r").alias("name")))
    return pairs.join(com.hint("merge"), "r").select("l", "id").join(lay.hint("merge"), "l").select("layoff_id", "id")


def _names_named(layoffs: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layoffs (layoff_id, needle), companies (id, hay) and the distinct pairs (needle, hay) of which one holds the other."""
    lay = layoffs.select("layoff_id", normalized_name(F.col("company")).alias("needle"))
    both = F.explode(F.array(F.lower("company_name"), F.lower("canonical_name")))
    com = companies.select("id", both.alias("hay")).filter("hay IS NOT NULL").distinct()
    return lay, com, contained(lay.select(F.col("needle").alias("name")), com.select(F.col("hay").alias("name")))


def companies_laid_off(layoffs: DataFrame, companies: DataFrame) -> DataFrame:
    """(id): the companies of ``layoffs_to_demote``, once each, without its pairs."""
    _, com, pairs = _names_named(layoffs, companies)
    return com.join(pairs.select("hay").distinct().hint("merge"), "hay", "left_semi").select("id").distinct()


def layoffs_to_demote(layoffs: DataFrame, companies: DataFrame) -> DataFrame:
    """(layoff_id, id): companies whose own name in lower case (whole, or canonical) contains the normalised name of a
    layoff. The suffixes of the company's name stay, so that this finds other pairs than ``match_layoffs``."""
    lay, com, pairs = _names_named(layoffs, companies)
    return pairs.join(com.hint("merge"), "hay").select("needle", "id").distinct().join(lay.distinct().hint("merge"), "needle").select("layoff_id", "id")


def enrich_company_size(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Headcount and listing from a registry where the row has none. ``registry``: (name, registry_count, registry_public)."""
    out = companies.withColumn("name", X.canonical_name(F.col("company_name"))).join(registry, "name", "left")
    public = F.col("is_public") | X.true_(F.col("registry_public"))
    return out.select("id", F.coalesce("employee_count", "registry_count").alias("employee_count"), public.alias("is_public"))


def matches_to_verify(matches: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    ok = matches.filter((F.col("status") == "approved") & (F.col("evaluated_at") <= F.lit(as_of).cast("timestamp"))).select(F.col("id").alias("match_id"), "job_id")
    return ok.join(jobs.filter(F.col("status").isin("active", "stale")).select(F.col("id").alias("job_id"), "title", "ats_slug"), "job_id")


def route_dedup(routed: DataFrame) -> DataFrame:
    """The best posting of each company, title and persona."""
    w = W.partitionBy("ats_slug", "title", "persona_id").orderBy(F.desc("score"), "job_id")
    return routed.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(C.TIERS))
    for i, t in enumerate(C.TIERS):
        out = F.when(tier == t, i).otherwise(out)
    return out


def sort_postings(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n``: newest, oldest, by salary (unknown last), or by quality (the companies that most sources found first,
    unknown last, then the tier later in its order, unknown last); then the newest, then by id."""
    when = F.coalesce("published_at", "detected_at")
    orders = {
        "newest": [when.desc()],
        "oldest": [when.asc()],
        "salary": [F.col("compensation_max").desc_nulls_last(), when.desc()],
        "quality": [F.col("fusion_score").desc_nulls_last(), F.when(F.col("tier").isNotNull(), tier_rank(F.col("tier"))).desc_nulls_last(), when.desc()] if "tier" in df.columns else [],
    }
    return df.orderBy(*orders[key], F.col("id")).limit(n)


def with_fusion(jobs: DataFrame, companies: DataFrame, found: DataFrame) -> DataFrame:
    """``with_company``, and how many sources have found the company; ``found`` has (company_id, discovery_source)."""
    score = found.groupBy("company_id").agg(F.countDistinct("discovery_source").alias("fusion_score"))
    return with_company(jobs, companies).join(score, "company_id", "left")


def poll_batch(companies: DataFrame, tier: str, n: int) -> DataFrame:
    """The companies of a tier that were polled longest ago, never polled ones first."""
    return companies.filter((F.col("tier") == tier) & F.col("polling_enabled")).orderBy(F.col("last_polled_at").asc_nulls_first(), "id").limit(n)


def dedupe_near_identical(jobs: DataFrame) -> DataFrame:
    """Of postings with equal company, title, department and text start: the most open workplace, then the latest."""
    text = F.substring(F.lower(F.trim("normalized_text")), 1, 2000)
    points = F.when(F.col("workplace_type") == "remote", 100).when(F.col("workplace_type") == "hybrid", 50).otherwise(0)
    w = W.partitionBy("ats_slug", "title", "department", text).orderBy(points.desc(), F.col("published_at").desc_nulls_last(), F.col("id").desc())
    return jobs.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares of the total; the total comes from the few counted groups."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select(key, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def compare_rankings(matches: DataFrame, k: int = 8) -> DataFrame:
    """By posting: how the saturating score reorders personas against a linear one."""
    o, d = F.coalesce("overlap_score", F.lit(0)), F.coalesce(F.col("cosine_distance"), F.lit(1.0))
    linear = F.round(C.TAG_WEIGHT * F.least(o / 5.0, F.lit(1.0)) + C.VECTOR_WEIGHT * (1 - d), 9)
    saturating = F.round(X.composite(o, d), 9)
    rank = lambda s: F.row_number().over(W.partitionBy("job_id").orderBy(s.desc(), "id", "persona_id"))
    r = matches.select("job_id", rank(linear).alias("was"), rank(saturating).alias("now"))
    return r.groupBy("job_id").agg(F.count_if((F.col("was") > k) & (F.col("now") <= k)).alias("entered"), F.count_if((F.col("was") <= k) & (F.col("now") > k)).alias("left_top"), F.count_if(F.col("was") != F.col("now")).alias("moved"))


def resolve_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """A name's key from a known company: by canonical name, else by one of its slug variants."""
    canon = X.canonical_name(F.col("name"))
    first = F.split(F.lower(F.trim("name")), r"[ ,]")[0]
    acronym = F.array_join(F.transform(F.filter(F.split(F.lower(F.trim("name")), "[^a-z0-9]+"), lambda p: p != ""), lambda p: F.substring(p, 1, 1)), "")
    variants = names.select("name", canon.alias("canon"), F.posexplode(F.array_distinct(F.array(canon, first, acronym))).alias("order", "slug"))
    by_name = companies.groupBy(X.canonical_name(F.col("company_name")).alias("canon")).agg(F.min("id").alias("by_name"))
    by_slug = companies.groupBy(F.col("ats_slug").alias("slug")).agg(F.min("id").alias("by_slug"))
    hits = variants.join(by_name, "canon", "left").join(by_slug, "slug", "left").groupBy("name").agg(F.min("by_name").alias("by_name"), F.min_by("by_slug", F.when(F.col("by_slug").isNotNull(), F.col("order"))).alias("by_slug"))
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_slug").isNotNull(), "slug")
    return hits.select("name", F.coalesce("by_name", "by_slug").alias("company_id"), how.alias("resolved_by"))


def orphaned_uploads(uploads: DataFrame, history: DataFrame, as_of: str, days: int) -> DataFrame:
    old = uploads.filter(F.col("uploaded_at") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"))
    return old.join(history.select(F.col("applicant_id").alias("user_id")).distinct(), "user_id", "left_anti")


def sort_matches(matches: DataFrame, key: str = "best_match", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of matches: best_match (score, then newest first), newest or oldest; ties by id."""
    orders = {
        "best_match": [F.desc_nulls_first("match_score"), F.desc_nulls_first("created_at")],
        "newest": [F.desc_nulls_first("created_at")],
        "oldest": [F.asc_nulls_last("created_at")],
    }
    return matches.orderBy(*orders[key], "id").offset(offset).limit(limit)


def top_companies(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("quality"), F.desc("total"), "id").limit(n)


def orphaned_companies(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    return companies.join(jobs.select("ats_source", "ats_slug").distinct(), ["ats_source", "ats_slug"], "left_anti")


def top_errors(log: DataFrame, n: int) -> DataFrame:
    out = log.filter("error_message IS NOT NULL").groupBy("source", "error_message").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen"))
    return out.orderBy(F.desc("n"), "source", "error_message").limit(n)


def source_health_list(health: DataFrame) -> DataFrame:
    order = F.when(F.col("status") == "disabled", 0).when(F.col("status") == "degraded", 1).otherwise(2)
    return health.withColumn("place", F.row_number().over(W.partitionBy("status").orderBy(F.desc("consecutive_failures"), "source_name"))).withColumn("group", order)
