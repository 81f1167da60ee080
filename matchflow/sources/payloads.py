"""Landed payloads of applicant-tracking systems and job boards, as one table of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import exprs as X

COMMON = ["external_job_id", "title", "location_name", "workplace_type", "url", "published_at"]
#: source -> (payload schema, path to the array of postings, {common column: expression over one posting ``j``}).
ATS_SHAPES: dict[str, tuple[str, str, dict[str, str]]] = {
    "greenhouse": (
        "jobs array<struct<id:bigint,title:string,location:struct<name:string>,absolute_url:string,content:string,first_published:string>>", "jobs",
        {"external_job_id": "CAST(j.id AS STRING)", "title": "j.title", "location_name": "j.location.name", "url": "j.absolute_url", "published_at": "j.first_published"},
    ),
    "lever": (
        "array<struct<id:string,text:string,categories:struct<location:string,commitment:string>,hostedUrl:string,workplaceType:string,createdAt:bigint>>", "",
        {"external_job_id": "j.id", "title": "j.text", "location_name": "j.categories.location", "workplace_type": "j.workplaceType", "url": "j.hostedUrl", "published_at": "date_format(timestamp_millis(j.createdAt), 'yyyy-MM-dd')"},
    ),
    "ashby": (
        "jobs array<struct<id:string,title:string,location:string,jobUrl:string,workplaceType:string,isRemote:string,publishedAt:string,isListed:boolean>>", "jobs",
        {"external_job_id": "j.id", "title": "j.title", "location_name": "j.location", "workplace_type": "coalesce(j.workplaceType, CASE WHEN lower(j.isRemote) = 'true' THEN 'remote' END)", "url": "j.jobUrl", "published_at": "j.publishedAt"},
    ),
    "smartrecruiters": (
        "content array<struct<id:string,name:string,location:struct<city:string,country:string,remote:boolean,hybrid:boolean>,releasedDate:string>>", "content",
        {"external_job_id": "j.id", "title": "j.name", "location_name": "concat_ws(', ', j.location.city, j.location.country)", "workplace_type": "CASE WHEN j.location.remote THEN 'remote' WHEN j.location.hybrid THEN 'hybrid' END", "published_at": "j.releasedDate"},
    ),
    "workable": (
        "jobs array<struct<shortcode:string,title:string,workplace:string,location:struct<city:string,country:string>,url:string,publishedAt:string>>", "jobs",
        {"external_job_id": "j.shortcode", "title": "j.title", "location_name": "concat_ws(', ', j.location.city, j.location.country)", "workplace_type": "j.workplace", "url": "j.url", "published_at": "j.publishedAt"},
    ),
    "recruitee": (
        "offers array<struct<id:bigint,title:string,careers_url:string,remote:boolean,hybrid:boolean,on_site:boolean,published_at:string,status:string>>", "offers",
        {"external_job_id": "CAST(j.id AS STRING)", "title": "j.title", "workplace_type": "CASE WHEN j.remote THEN 'remote' WHEN j.hybrid THEN 'hybrid' WHEN j.on_site THEN 'on-site' END", "url": "j.careers_url", "published_at": "j.published_at"},
    ),
}
BOARD_SHAPES: dict[str, tuple[str, str, dict[str, str]]] = {
    "remoteok": ("array<struct<id:string,position:string,company:string,location:string,tags:array<string>,url:string>>", "", {"external_job_id": "j.id", "title": "j.position", "location_name": "j.location", "url": "j.url"}),
    "remotive": ("jobs array<struct<id:bigint,title:string,company_name:string,candidate_required_location:string,url:string>>", "jobs", {"external_job_id": "CAST(j.id AS STRING)", "title": "j.title", "location_name": "j.candidate_required_location", "url": "j.url"}),
    "arbeitnow": ("data array<struct<slug:string,title:string,company_name:string,location:string,remote:boolean>>", "data", {"external_job_id": "j.slug", "title": "j.title", "location_name": "j.location", "workplace_type": "CASE WHEN j.remote THEN 'remote' END"}),
    "himalayas": ("jobs array<struct<guid:string,title:string,companyName:string,locationRestrictions:array<string>>>", "jobs", {"external_job_id": "j.guid", "title": "j.title", "location_name": "array_join(j.locationRestrictions, '; ')"}),
    "jobicy": ("jobs array<struct<id:bigint,jobTitle:string,companyName:string,jobGeo:string,url:string>>", "jobs", {"external_job_id": "CAST(j.id AS STRING)", "title": "j.jobTitle", "location_name": "j.jobGeo", "url": "j.url"}),
}


def _read(raw: DataFrame, shapes: dict, keys: list[str]) -> DataFrame:
    """Each shape's payloads parsed by its schema, in one pass over ``raw``; a payload that doesn't parse or is of no known source
    gives one row with ``valid`` false."""
    posting = lambda fields: ", ".join(f"'{c}', CAST({fields.get(c, 'NULL')} AS STRING)" for c in COMMON)
    parsed = raw.select(*keys, *[F.from_json(F.when(F.col("source") == s, F.col("payload")), schema).alias(f"_{s}") for s, (schema, _, _) in shapes.items()])
    items = [F.expr(f"transform(_{s}{'.' + path if path else ''}, j -> named_struct({posting(fields)}))") for s, (_, path, fields) in shapes.items()]
    rows = parsed.select(*keys, F.coalesce(*items).alias("_items")).select(*keys, F.col("_items").isNotNull().alias("valid"), F.explode_outer("_items").alias("j"))
    return rows.filter(F.col("j").isNotNull() | ~F.col("valid")).select(*keys, "valid", *[F.col(f"j.{c}").alias(c) for c in COMMON])


def read_ats_payloads(raw: DataFrame) -> DataFrame:
    """Postings of six payload shapes; ``raw`` has source, slug, payload."""
    return _read(raw, ATS_SHAPES, ["source", "slug"])


def read_board_feed(raw: DataFrame) -> DataFrame:
    """Postings of JSON boards; ``raw`` has source, payload."""
    return _read(raw, BOARD_SHAPES, ["source"])


def read_rss_feed(raw: DataFrame) -> DataFrame:
    """Items of RSS payloads (source, payload): title, link and description without markup."""
    item = F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("item")
    field = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), "<[^>]*>", " "))
    return raw.select("source", item).select("source", field("title").alias("title"), field("link").alias("link"), field("description").alias("description"))


def board_scope(restrictions: Column) -> Column:
    """Scope of a list of allowed places: global by word or if empty, one country, or a region."""
    low = F.transform(F.coalesce(restrictions, X.no_strings()), lambda x: F.lower(F.trim(x)))
    anywhere = F.exists(low, lambda x: x.rlike("(worldwide|anywhere|global|world)"))
    return F.when((F.size(low) == 0) | anywhere, "global").when(F.size(low) == 1, "country_fenced").otherwise("region_fenced")


def with_full_text(df: DataFrame, html: str) -> DataFrame:
    """``full_text``: markup stripped, common entities decoded, blanks collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return df.withColumn("full_text", F.trim(F.regexp_replace(text, r"\s+", " ")))
