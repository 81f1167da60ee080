"""Employers and postings found in bulk corpora: crawls, logs, comments, feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import exprs as X

# fixed values: hosts of applicant-tracking systems and their labels
ATS_HOSTS = {"greenhouse.io": "greenhouse", "lever.co": "lever", "ashbyhq.com": "ashby", "smartrecruiters.com": "smartrecruiters", "workable.com": "workable", "recruitee.com": "recruitee"}
INFRA_LABELS = ["www", "api", "mail", "cdn", "static", "staging", "dev", "test", "app"]
NOISE_PREFIX = "^(www|careers|jobs|apply|boards|blog)[.]"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+(/[^?#]*)", 1)


def ats_of(host: Column) -> Column:
    """The system that a host belongs to (itself or a sub-domain); null for others."""
    out = F.lit(None).cast("string")
    for suffix, label in ATS_HOSTS.items():
        out = F.when((host == suffix) | host.endswith("." + suffix), label).otherwise(out)
    return out


def root_domain(host: Column) -> Column:
    """The last two labels without a leading www, careers and the like; null for systems' own hosts and bare names."""
    bare = F.regexp_replace(host, NOISE_PREFIX, "")
    return F.when(ats_of(host).isNull() & bare.contains("."), F.substring_index(bare, ".", -2))


def ats_slug(url: Column) -> Column:
    """The employer's key: first path part, or the label before the system's host."""
    host = host_of(url)
    first = F.regexp_extract(path_of(url), "^/([A-Za-z0-9_-]+)", 1)
    label = F.substring_index(host, ".", 1)
    shared = label.isin("boards", "jobs", "apply", "www", "careers", "api")
    return F.nullif(F.lower(F.when(shared | (host == F.substring_index(host, ".", -2)), first).otherwise(label)), F.lit(""))


def scan_crawl_technologies(pages: DataFrame, frameworks: list[str], systems: list[str]) -> DataFrame:
    """Root pages that use both a web framework and a system; of several systems the first in order labels the page."""
    ats = F.get(F.filter(X.strings(systems), lambda s: F.array_contains("technologies", s)), 0)
    return pages.filter(F.arrays_overlap("technologies", X.strings(frameworks)) & F.arrays_overlap("technologies", X.strings(systems))).select("root_page", ats.alias("ats")).distinct()


def crawl_months(spark: SparkSession, as_of: str, n: int) -> DataFrame:
    """The first days of the last ``n`` months, the current one included."""
    month = F.trunc(F.lit(as_of).cast("date"), "month")
    return spark.range(1).select(F.explode(F.sequence(F.add_months(month, 1 - n), month, F.expr("INTERVAL 1 MONTH"))).alias("month"))


def scan_dns_cnames(records: DataFrame) -> DataFrame:
    """Domains whose CNAME is a system's host, and the label of the company."""
    ats = ats_of(F.lower(F.regexp_replace("value", "[.]$", "")))
    parts = F.split(F.lower("name"), "[.]")
    found = records.filter(F.lower("type") == "cname").select(F.lower("name").alias("domain"), ats.alias("ats"), F.element_at(parts, -2).alias("company"))
    return found.filter("ats IS NOT NULL").distinct()


def scan_certificates(df: DataFrame) -> DataFrame:
    """(ats, slug) pairs from certificate names: wildcards, bare hosts and infrastructure labels dropped."""
    names = df.select(F.explode(F.split("name_value", "\n")).alias("name")).select(F.lower(F.trim("name")).alias("name")).filter(~F.col("name").startswith("*"))
    slug = F.substring_index("name", ".", 1)
    return names.select(ats_of(F.col("name")).alias("ats"), slug.alias("slug"), F.size(F.split("name", "[.]")).alias("k")).filter((F.col("k") >= 3) & F.col("ats").isNotNull() & ~F.col("slug").isin(INFRA_LABELS)).select("ats", "slug").distinct()


def scan_url_archive(df: DataFrame) -> DataFrame:
    """(ats, slug) pairs of archived URLs."""
    url = F.col("original")
    return df.select(ats_of(host_of(url)).alias("ats"), ats_slug(url).alias("slug")).filter("ats IS NOT NULL AND slug IS NOT NULL").distinct()


def urls_in(text: Column) -> Column:
    decoded = text
    for entity, char in (("&#x2F;", "/"), ("&amp;", "&"), ("&quot;", '"')):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.regexp_extract_all(decoded, F.lit(r"(https?://[^\s\"'<>()]+)"), 1)


def mine_comment_urls(comments: DataFrame) -> DataFrame:
    """URLs in comments as (kind, key): a system and its slug, or a custom host; the first comment of each."""
    u = comments.select("id", F.explode(urls_in(F.col("text"))).alias("url"))
    host = host_of(F.col("url"))
    u = u.select("id", F.coalesce(ats_of(host), F.lit("custom")).alias("kind"), F.when(ats_of(host).isNotNull(), ats_slug(F.col("url"))).otherwise(root_domain(host)).alias("key"))
    return u.filter("key IS NOT NULL").groupBy("kind", "key").agg(F.min("id").alias("first_id"))


def harvest_links(pages: DataFrame) -> DataFrame:
    """Links of a page by kind: a system's, another site's, or the site's own."""
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"href=\"([^\"]+)\""), 1)).alias("link"))
    host = host_of(F.col("link"))
    kind = F.when(ats_of(host).isNotNull(), "ats").when((host == "") | (host == host_of(F.col("url"))), "own").otherwise("other")
    return links.groupBy("page_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("link").alias("different"))


def harvest_portfolio_companies(pages: DataFrame, known_hosts: list[str]) -> DataFrame:
    """External anchors with a text of 2 to 100 characters, one for each page and host."""
    pattern = r"<a [^>]*href=\"(https?://[^\"]+)\"[^>]*>([^<]{2,100})</a>"
    urls, texts = (F.regexp_extract_all("html", F.lit(pattern), g) for g in (1, 2))
    a = pages.select("page_id", "url", F.explode(F.arrays_zip(urls.alias("u"), texts.alias("t"))).alias("a"))
    host = host_of(F.col("a.u"))
    a = a.select("page_id", host.alias("host"), F.trim("a.t").alias("name"), host_of(F.col("url")).alias("own"))
    a = a.filter((F.col("host") != F.col("own")) & ~F.col("host").isin(known_hosts) & ~F.lower("name").isin("read more", "website", "learn more", "apply"))
    return a.groupBy("page_id", "host").agg(F.min("name").alias("name"))


def extract_funding_signals(items: DataFrame) -> DataFrame:
    """Headlines about funding: company, stage, and a headcount guessed from the stage."""
    title = F.lower("title")
    stage = F.when(title.rlike("pre-seed"), "pre-seed").when(title.rlike("seed"), "seed").when(title.rlike("series a"), "a").when(title.rlike("series b"), "b").when(title.rlike("series [c-f]"), "late").when(title.rlike("(ipo|goes public)"), "public")
    guess = F.when(F.col("stage") == "pre-seed", 5).when(F.col("stage") == "seed", 15).when(F.col("stage") == "a", 40).when(F.col("stage") == "b", 120).when(F.col("stage") == "late", 400)
    company = F.regexp_extract("title", r"^((?:[A-Z][A-Za-z0-9]*\s?)+?)\s(?:raises|secures|closes|lands|goes)", 1)
    out = items.filter(title.rlike("(raises|secures|closes|lands|goes public)")).select("id", F.nullif(company, F.lit("")).alias("company"), stage.alias("stage"))
    return out.withColumn("headcount", guess).withColumn("is_public", F.coalesce(F.col("stage") == "public", F.lit(False))).withColumn("is_startup", F.coalesce(F.col("headcount") < 50, F.lit(False)))


def harvest_orgs(events: DataFrame, excluded: list[str], as_of: str, days: int = 7) -> DataFrame:
    """Organisations (the part of a package name between @ and /) with a recent event, without excluded ones."""
    org = F.nullif(F.regexp_extract("name", "^@([^/]+)/", 1), F.lit(""))
    recent = events.select(org.alias("org"), "ts").filter(F.col("org").isNotNull() & ~F.col("org").isin(excluded)).groupBy("org").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return recent.filter(F.col("last") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS"))


def extract_jsonld_postings(pages: DataFrame) -> DataFrame:
    """``JobPosting`` objects in a page's JSON-LD blocks: single, in an array, or inside ``@graph``."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<script type=\"application/ld\+json\">(.*?)</script>"), 1)).alias("block")
    item = "struct<`@type`:string,title:string,description:string,url:string>"
    b = pages.select("page_id", block)
    many, graph, one = F.from_json("block", f"array<{item}>"), F.from_json("block", f"struct<`@graph`:array<{item}>>"), F.from_json("block", item)
    items = F.when(F.ltrim("block").startswith("["), many).when(graph["@graph"].isNotNull(), graph["@graph"]).otherwise(F.array(one))
    p = b.select("page_id", F.explode(items).alias("i"))
    return p.filter((F.col("i.`@type`") == "JobPosting") & F.col("i.title").isNotNull() & F.col("i.description").isNotNull()).select("page_id", "i.title", "i.description", "i.url")


def find_feed_links(pages: DataFrame) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit(r"<link[^>]*type=\"application/(?:rss|atom)\+xml\"[^>]*href=\"([^\"]+)\""), 1)).alias("feed")
    return pages.select("page_id", links).distinct()


def stage_provisional(seeds: DataFrame, jobs: DataFrame, cap: int = 15_000, first: Column | None = None) -> DataFrame:
    """Page postings as provisional rows, unless the URL is a posting already; of several texts of a URL the ``first`` by an
    order of the seeds, without one (and of equals) the one with the smallest hash."""
    rows = seeds.select(F.sha2("url", 256).alias("id"), F.sha2("text", 256).alias("text_hash"), F.substring("text", 1, cap).alias("raw"), "url", (F.lit(0) if first is None else first).alias("at"))
    rows = rows.groupBy("url").agg(F.min(F.struct("at", "text_hash", "raw", "id")).alias("row")).select("row.id", "row.text_hash", "row.raw", "url")
    return rows.join(jobs.select("id"), "id", "left_anti")


def write_snapshot(metrics: DataFrame, path: str) -> None:
    """Metrics (snapshot_date and others) as the partitions of their days: a day that is written again is replaced, and
    days that ``metrics`` lacks stay."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
