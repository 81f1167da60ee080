"""Landed payloads of applicant-tracking systems and job boards as one table, by a table of paths for each source.

A payload is parsed once, whatever its source, to a VARIANT; the source names the list of postings in it and, for each
common column, an expression over one posting. ``{path:type}`` in an expression is a value of the posting, null where the
path is missing or of another type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import exprs as X

#: Common columns and their types; a source that has nothing for one gives null.
COLUMNS = {
    "external_job_id": "string", "title": "string", "company_name": "string", "html": "string", "plain": "string", "tags": "array<string>", "apply_url": "string", "job_url": "string",
    "location_name": "string", "places": "array<string>", "workplace_type": "string", "employment_type": "string", "department": "string", "team": "string", "pay_min": "double", "pay_max": "double",
    "pay_currency": "string", "years_min": "int", "years_max": "int", "published_at": "timestamp", "status": "string",
}


def cases(value: str, *known: tuple[str, str]) -> str:
    """The value of the first condition (over ``x``, the value in lower case) that holds."""
    return "CASE " + " ".join(f"WHEN {when.replace('«x»', f'lower({value})')} THEN '{then}'" for when, then in known) + " END"


def labelled(value: str) -> str:
    """Employment by what its label contains."""
    return cases(value, ("contains(«x», 'full')", "full-time"), ("contains(«x», 'part')", "part-time"), ("contains(«x», 'contract')", "contract"), ("contains(«x», 'intern')", "internship"), ("contains(«x», 'permanent')", "full-time"), ("contains(«x», 'temporary')", "contract"))


def board_employment(value: str) -> str:
    """Employment as boards name it; an unknown name stays, in lower case."""
    known = cases(
        value, ("«x» = 'b2b'", "contract"), ("«x» = 'uop' OR contains(«x», 'permanent')", "full-time"), ("contains(«x», 'zlecenie') OR contains(«x», 'mandate') OR «x» = 'uod'", "contract"), ("contains(«x», 'full')", "full-time"),
        ("contains(«x», 'part')", "part-time"), ("contains(«x», 'contract') OR contains(«x», 'freelance')", "contract"), ("contains(«x», 'intern')", "internship"),
    )
    return f"coalesce({known}, nullif(lower({value}), ''))"


def comma(*parts: str) -> str:
    """Parts that are there and not empty, joined by commas."""
    return f"nullif(concat_ws(', ', {', '.join(f"nullif({p}, '')" for p in parts)}), '')"


def positive(value: str, times: int = 1) -> str:
    return f"CASE WHEN {value} > 0 THEN {value} * {times} END"


def day(value: str) -> str:
    return f"try_to_timestamp({value})"


LOW_TAGS = "transform({tags:array<string>}, t -> lower(t))"
YEARS = {"junior": (0, 2), "trainee": (0, 1), "mid": (3, 5), "senior": (5, 8), "expert": (8, 15)}


def years(has: str, end: int, order: dict[str, tuple[int, int]]) -> str:
    return "CASE " + " ".join(f"WHEN {has.replace('«key»', k)} THEN {v[end]}" for k, v in order.items()) + " END"


#: Levels as single words, where a trainee counts as a junior and a lead as an expert.
LEVELS = {"junior": (0, 2), "trainee": (0, 2), "mid": (3, 5), "senior": (5, 8), "expert": (8, 15), "lead": (8, 15)}
OF_LEVEL = "contains(lower(coalesce({experienceLevel.value:string}, {experienceLevel.label:string}, {experienceLevel})), '«key»')"
OF_SENIORITY = "exists({seniority:array<string>}, s -> contains(lower(s), '«key»'))"
WORKPLACE = "coalesce({workplaceType.value:string}, {workplaceType.label:string}, {workplaceType})"
PRIMARY = "coalesce(get(filter({locations:array<variant>}, l -> try_variant_get(l, '$.is_primary', 'boolean')), 0), get({locations:array<variant>}, 0))"


@dataclass(frozen=True)
class Feed:
    """Where a source's postings are, its columns, and which postings count."""

    items: str
    columns: dict[str, str]
    keep: str = "true"


SYSTEMS: dict[str, Feed] = {
    "greenhouse": Feed(
        "$.jobs",
        {
            "external_job_id": "{id}", "title": "{title}", "company_name": "nullif({company_name}, '')", "html": "{content}", "job_url": "nullif({absolute_url}, '')", "location_name": "{location.name}",
            "department": "{departments[0].name}", "published_at": day("{first_published}"),
            "workplace_type": cases("{location.name}", ("contains(«x», 'hybrid')", "hybrid"), ("contains(«x», 'remote')", "remote"), ("«x» RLIKE 'on-?site|in-?office'", "on-site")),
        },
    ),
    "lever": Feed(
        "$",
        {
            "external_job_id": "{id}", "title": "{text}", "plain": "nullif({descriptionPlain}, '')", "job_url": "nullif({hostedUrl}, '')", "apply_url": "nullif({applyUrl}, '')", "location_name": "{categories.location}",
            # sections of the text stand after it, each as its heading and its content
            "html": "concat_ws(' ', CASE WHEN coalesce({descriptionPlain}, '') = '' THEN {description} END, array_join(transform({lists:array<variant>}, l -> concat_ws(' ', try_variant_get(l, '$.text', 'string'), try_variant_get(l, '$.content', 'string'))), ' '))",
            "department": "{categories.department}", "team": "{categories.team}", "published_at": "timestamp_millis({createdAt:bigint})", "employment_type": labelled("{categories.commitment}"),
            "pay_min": "{salaryRange.min:double}", "pay_max": "{salaryRange.max:double}", "pay_currency": "{salaryRange.currency}",
            "workplace_type": cases("{workplaceType}", ("«x» = 'remote'", "remote"), ("«x» = 'hybrid'", "hybrid"), ("«x» IN ('on-site', 'onsite')", "on-site")),
        },
    ),
    "ashby": Feed(
        "$.jobs",
        {
            "external_job_id": "{id}", "title": "{title}", "plain": "nullif({descriptionPlain}, '')", "html": "CASE WHEN coalesce({descriptionPlain}, '') = '' THEN {descriptionHtml} END", "job_url": "nullif({jobUrl}, '')",
            "apply_url": "nullif({applyUrl}, '')", "location_name": "{location}", "department": "{department}", "team": "{team}", "published_at": day("{publishedAt}"),
            "employment_type": "CASE {employmentType} WHEN 'FullTime' THEN 'full-time' WHEN 'PartTime' THEN 'part-time' WHEN 'Contract' THEN 'contract' WHEN 'Intern' THEN 'internship' WHEN 'Temporary' THEN 'contract' END",
            "workplace_type": "CASE {workplaceType} WHEN 'Remote' THEN 'remote' WHEN 'Hybrid' THEN 'hybrid' WHEN 'OnSite' THEN 'on-site' ELSE CASE WHEN {isRemote} = 'true' THEN 'remote' END END",
            "pay_min": "{compensation.min:double}", "pay_max": "{compensation.max:double}", "pay_currency": "{compensation.currency}", "status": "CASE WHEN {isListed:boolean} = false THEN 'unlisted' END",
        },
    ),
    "smartrecruiters": Feed(
        "$.content",
        {
            "external_job_id": "{id}", "title": "{name}", "company_name": "nullif({company.name}, '')", "job_url": "nullif({postingUrl}, '')", "location_name": comma("{location.city}", "{location.region}", "{location.country}"),
            "html": "nullif(concat_ws(' ', {jobAd.sections.jobDescription.text}, {jobAd.sections.qualifications.text}, {jobAd.sections.companyDescription.text}, {jobAd.sections.additionalInformation.text}), '')",
            # a list entry without sections is described by what else it says
            "plain": "CASE WHEN {jobAd.sections:variant} IS NULL THEN " + comma(
                "concat({department.label}, ' department')", "{typeOfEmployment.label}",
                "CASE WHEN {location.remote:boolean} THEN 'Remote' ELSE " + comma("{location.city}", "CASE WHEN {location.city} <> '' THEN {location.country} END") + " END", "concat('at ', {company.name})",
            ) + " END",
            "workplace_type": "CASE WHEN {location.hybrid:boolean} THEN 'hybrid' WHEN {location.remote:boolean} THEN 'remote' END", "department": "{department.label}", "employment_type": labelled("{typeOfEmployment.label}"),
            "published_at": day("{releasedDate}"), "status": "{status}",
        },
    ),
    "workable": Feed(
        "$.jobs",
        {
            "external_job_id": "{shortcode}", "title": "{title}", "company_name": "nullif({companyName}, '')", "html": "{description}", "job_url": "nullif({url}, '')", "apply_url": "nullif({applyUrl}, '')",
            "location_name": comma("{location.city}", "{location.region}", "{location.country}"), "department": "{department}", "employment_type": labelled("{employmentType}"), "published_at": day("{publishedAt}"),
            "workplace_type": cases("{workplace}", ("«x» = 'remote'", "remote"), ("«x» = 'hybrid'", "hybrid"), ("«x» IN ('on_site', 'onsite')", "on-site")),
        },
    ),
    "recruitee": Feed(
        "$.offers",
        {
            "external_job_id": "{id}", "title": "{title}", "company_name": "nullif({company_name}, '')", "plain": "nullif(trim(concat_ws(' ', {description}, {requirements})), '')", "job_url": "nullif({careers_url}, '')",
            "apply_url": "nullif({careers_apply_url}, '')", "location_name": comma("{locations[0].city}", "{locations[0].country}"), "department": "{department}", "published_at": day("{published_at}"), "status": "{status}",
            "employment_type": cases("{employment_type_code}", ("contains(«x», 'fulltime')", "full-time"), ("contains(«x», 'parttime')", "part-time"), ("contains(«x», 'contract')", "contract"), ("contains(«x», 'intern')", "internship"), ("contains(«x», 'temporary')", "contract")),
            "workplace_type": "CASE WHEN {remote:boolean} THEN 'remote' WHEN {hybrid:boolean} THEN 'hybrid' WHEN {on_site:boolean} THEN 'on-site' END",
        },
    ),
}
REMOTE = "'remote'"
BOARDS: dict[str, Feed] = {
    "remoteok": Feed(
        "$",
        {
            "external_job_id": "coalesce({id}, {slug}, '')", "title": "{position}", "company_name": "{company}", "html": "{description}", "tags": LOW_TAGS, "apply_url": "coalesce({apply_url}, {url})", "job_url": "coalesce({apply_url}, {url})",
            "location_name": "{location}", "workplace_type": REMOTE, "pay_min": positive("{salary_min:double}"), "pay_max": positive("{salary_max:double}"), "pay_currency": "coalesce({salary_currency}, 'USD')", "published_at": day("{date}"),
        },
        "{position} IS NOT NULL",  # the first element is a legal notice
    ),
    "remotive": Feed(
        "$.jobs",
        {
            "external_job_id": "coalesce({id}, '')", "title": "coalesce({title}, '')", "company_name": "{company_name}", "html": "{description}", "tags": LOW_TAGS, "apply_url": "{url}", "job_url": "{url}",
            "location_name": "{candidate_required_location}", "workplace_type": REMOTE, "employment_type": board_employment("{job_type}"), "published_at": day("{publication_date}"),
        },
    ),
    "arbeitnow": Feed(
        "$.data",
        {
            "external_job_id": "coalesce({slug}, '')", "title": "coalesce({title}, '')", "company_name": "{company_name}", "html": "{description}", "tags": LOW_TAGS, "apply_url": "{url}", "job_url": "{url}", "location_name": "{location}",
            "workplace_type": "CASE WHEN {remote:boolean} THEN 'remote' END", "employment_type": board_employment("{job_types[0]}"), "published_at": day("{created_at}"),
        },
    ),
    "himalayas": Feed(
        "$.jobs",
        {
            "external_job_id": "coalesce({jobSlug}, concat({companySlug}, '-', {title}))", "title": "coalesce({title}, '')", "company_name": "{companyName}", "plain": "coalesce({excerpt}, {description})", "tags": LOW_TAGS,
            "apply_url": "concat('https://himalayas.app/jobs/', {jobSlug})", "job_url": "concat('https://himalayas.app/jobs/', {jobSlug})", "location_name": "array_join({locationRestrictions:array<string>}, ', ')",
            "places": "{locationRestrictions:array<string>}", "workplace_type": REMOTE, "employment_type": board_employment("{employmentType}"), "pay_min": "{minSalary:double}", "pay_max": "{maxSalary:double}",
            "pay_currency": "coalesce({salaryCurrency}, 'USD')", "published_at": day("{pubDate}"),
        },
    ),
    "jobicy": Feed(
        "$.jobs",
        {
            "external_job_id": "{id}", "title": "{jobTitle}", "company_name": "{companyName}", "html": "coalesce({jobDescription}, {jobExcerpt})", "apply_url": "{url}", "job_url": "{url}", "location_name": "nullif(trim({jobGeo}), '')",
            "workplace_type": REMOTE, "employment_type": board_employment("{jobType[0]}"), "pay_min": "{salaryMin:double}", "pay_max": "{salaryMax:double}", "pay_currency": "{salaryCurrency}", "published_at": day("{pubDate}"),
        },
        "{id} <> '0' AND {jobTitle} <> ''",
    ),
    "justjoin": Feed(
        "$.data",
        {
            "external_job_id": "coalesce({guid}, {slug})", "title": "coalesce({title}, '')", "company_name": "{companyName}", "html": "{body}", "apply_url": "{applyUrl}", "job_url": "concat('https://justjoin.it/job-offer/', nullif({slug}, ''))",
            "tags": "array_distinct(filter(transform(concat(coalesce({requiredSkills:array<string>}, array()), coalesce({niceToHaveSkills:array<string>}, array())), t -> lower(trim(t))), t -> t <> ''))",
            "location_name": comma("{city}", "{countryCode}"), "places": "CASE WHEN {countryCode} <> '' THEN array(upper({countryCode})) END",
            "workplace_type": cases(WORKPLACE, ("«x» = 'remote'", "remote"), ("«x» = 'hybrid'", "hybrid"), ("«x» = 'office'", "on-site")), "employment_type": board_employment("{employmentTypes[0].type}"),
            "pay_min": positive("{employmentTypes[0].from:double}", 12), "pay_max": positive("{employmentTypes[0].to:double}", 12), "pay_currency": "upper({employmentTypes[0].currency})",
            "years_min": years(OF_LEVEL, 0, LEVELS), "years_max": years(OF_LEVEL, 1, LEVELS), "published_at": day("{publishedAt}"),
        },
    ),
    "nofluffjobs": Feed(
        "$.postings",
        {
            "external_job_id": "coalesce({id}, '')", "title": "coalesce({title}, '')", "company_name": "{name}", "apply_url": "concat('https://nofluffjobs.com/job/', nullif({url}, ''))", "job_url": "concat('https://nofluffjobs.com/job/', nullif({url}, ''))",
            "tags": "array_distinct(array_compact(concat(array(nullif(lower({technology}), '')), coalesce(transform(filter({tiles.values:array<variant>}, t -> try_variant_get(t, '$.type', 'string') = 'requirement'), t -> nullif(lower(try_variant_get(t, '$.value', 'string')), '')), array()))))",
            # the list has no text: it is told from its fields
            "plain": "concat_ws('. ', nullif(trim(concat(coalesce({title}, ''), ' at ', coalesce({name}, ''))), ''), concat('Technology: ', nullif({technology}, '')), concat('Category: ', nullif({category}, '')), concat('Seniority: ', nullif(array_join({seniority:array<string>}, ', '), '')), "
            "concat('Required skills: ', nullif(array_join(transform(filter({tiles.values:array<variant>}, t -> try_variant_get(t, '$.type', 'string') = 'requirement'), t -> try_variant_get(t, '$.value', 'string')), ', '), '')))",
            "location_name": "nullif(array_join(filter(transform({location.places:array<variant>}, p -> concat_ws(', ', nullif(try_variant_get(p, '$.city', 'string'), ''), nullif(try_variant_get(p, '$.country.name', 'string'), ''))), p -> p <> ''), ' / '), '')",
            "places": "transform({location.places:array<variant>}, p -> concat(coalesce(upper(try_variant_get(p, '$.country.code', 'string')), ''), '|', coalesce(try_variant_get(p, '$.country.name', 'string'), '')))",
            "workplace_type": REMOTE, "employment_type": board_employment("{salary.type}"), "pay_min": positive("{salary.from:double}", 12), "pay_max": positive("{salary.to:double}", 12), "pay_currency": "upper({salary.currency})",
            "years_min": years(OF_SENIORITY, 0, YEARS), "years_max": years(OF_SENIORITY, 1, YEARS), "published_at": "timestamp_millis(nullif({posted:bigint}, 0))",
        },
        "{location.fullyRemote:boolean}",
    ),
    "workingnomads": Feed(
        "$.hits.hits",
        {
            "external_job_id": "coalesce({_source.id}, {_source.slug}, {_source.external_id}, '')", "title": "coalesce({_source.title}, '')", "company_name": "{_source.company}", "html": "{_source.description}",
            "tags": LOW_TAGS.replace("{tags", "{_source.tags"), "apply_url": "{_source.apply_url}", "job_url": "{_source.apply_url}", "workplace_type": REMOTE, "employment_type": board_employment("{_source.position_type}"),
            "location_name": "coalesce(" + comma("{_source.locations[0].city}", "{_source.locations[0].state}", "{_source.locations[0].country}") + ", {_source.locations[0].continent}, CASE WHEN NOT startswith({_source.locations[0]}, '{') THEN {_source.locations[0]} END, nullif(concat_ws(' — ', nullif({_source.location_base}, ''), nullif({_source.location_extra}, '')), ''))",
            "places": "filter({_source.locations:array<string>}, l -> NOT startswith(l, '{'))", "pay_max": "{_source.annual_salary_usd:double}", "pay_currency": "'USD'", "published_at": day("{_source.pub_date}"),
        },
        "{_source:variant} IS NOT NULL AND NOT coalesce({_source.expired:boolean}, false)",
    ),
    "fourdayweek": Feed(
        "$.jobs",
        {
            "external_job_id": "coalesce({id}, {slug}, '')", "title": "coalesce({title}, '')", "company_name": "coalesce({company_name}, {company.name})", "html": "{description}", "apply_url": "{url}", "job_url": "{url}",
            "tags": "CASE WHEN size({stack:array<variant>}) > 0 THEN filter(transform({stack:array<variant>}, s -> lower(coalesce(try_variant_get(s, '$.slug', 'string'), try_variant_get(s, '$.name', 'string'), ''))), t -> t <> '') ELSE transform({tags:array<string>}, t -> lower(t)) END",
            "location_name": f"coalesce(nullif({{location}}, ''), nullif(concat_ws(', ', nullif(try_variant_get({PRIMARY}, '$.city', 'string'), ''), nullif(try_variant_get({PRIMARY}, '$.state', 'string'), ''), nullif(try_variant_get({PRIMARY}, '$.country', 'string'), '')), ''), try_variant_get({PRIMARY}, '$.continent', 'string'))",
            "places": "CASE WHEN {company.hires_worldwide:boolean} THEN array('worldwide') END",
            "workplace_type": "coalesce(" + cases("{work_arrangement}", ("«x» = 'remote'", "remote"), ("«x» = 'hybrid'", "hybrid"), ("contains(«x», 'on-site') OR contains(«x», 'office')", "on-site")) + ", CASE WHEN {remote:boolean} THEN 'remote' END)",
            "employment_type": board_employment("coalesce({job_type}, {schedule_type})"), "pay_min": "coalesce({salary_lower:double}, {salary_min:double})", "pay_max": "coalesce({salary_upper:double}, {salary_max:double})",
            "pay_currency": "coalesce({salary_currency}, {currency})", "published_at": "coalesce(timestamp_seconds(nullif({posted:bigint}, 0)), " + day("{posted_date}") + ")",
        },
        "NOT coalesce({is_expired:boolean}, false)",
    ),
}
FEEDS = SYSTEMS | BOARDS


def over(expression: str, item: str = "j") -> str:
    """Spark SQL of an expression with ``{path:type}`` values."""
    return re.sub(r"\{([\w.\[\]-]+)(?::([\w<>]+))?\}", lambda m: f"try_variant_get({item}, '$.{m[1]}', '{m[2] or 'string'}')", expression)


def read_feeds(raw: DataFrame, feeds: dict[str, Feed] = FEEDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Postings (source, keys, fault, common columns) of landed payloads (source, keys, payload), in one pass.

    A payload of no known source, one that is not JSON, and one without the source's list of postings give a row with
    ``fault`` and no more; postings that do not count in their source (notices, expired ones) give none."""
    by_path: dict[str, list[str]] = {}
    for s, f in feeds.items():
        by_path.setdefault(f.items, []).append(s)
    of_path = " ".join(f"WHEN source IN ({', '.join(map(repr, ss))}) THEN try_variant_get(p, '{path}', 'array<variant>')" for path, ss in by_path.items())
    known = F.coalesce(F.col("source").isin(list(feeds)), F.lit(False))
    parsed = once(raw.select("source", *keys, "payload"), F.expr("try_parse_json(payload)").alias("p"))
    items = once(parsed, F.when(known, F.expr(f"CASE {of_path} END")).alias("items"))
    fault = F.when(~known, "unknown source").when(F.col("p").isNull(), "not JSON").when(F.col("items").isNull(), "no postings")
    j = items.select("source", *keys, fault.alias("fault"), F.explode_outer("items").alias("j"))
    by_keep: dict[str, list[str]] = {}
    for s, f in feeds.items():
        by_keep.setdefault(f.keep, []).append(s)
    keep = " ".join(f"WHEN source IN ({', '.join(map(repr, ss))}) THEN {over(k)}" for k, ss in by_keep.items())
    counted = F.coalesce(F.expr(f"CASE {keep} END"), F.lit(False))
    j = j.filter(F.col("fault").isNotNull() | (F.col("j").isNotNull() & counted))

    def column(name: str, kind: str) -> Column:
        branches = " ".join(f"WHEN '{s}' THEN {over(f.columns[name])}" for s, f in feeds.items() if name in f.columns)
        return F.expr(f"CAST(CASE source {branches} END AS {kind})" if branches else f"CAST(NULL AS {kind})").alias(name)

    columns = [column(c, t) for c, t in COLUMNS.items()]
    for few in range(0, len(columns), AT_ONCE):
        j = once(j, *columns[few : few + AT_ONCE])
    return j.select("source", *keys, "fault", *COLUMNS)


#: Common columns whose expressions, with a branch for each source, are compiled together.
AT_ONCE = 3


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns that are worked out once, here, however often they are used: what is generated is
    neither copied into later expressions nor compiled into one method with them."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def feed_faults(raw: DataFrame, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """Payloads of each source that gave no postings, by fault."""
    return read_feeds(raw, feeds).filter("fault IS NOT NULL").groupBy("source", "fault").agg(F.count(F.lit(1)).alias("n"))


BLANKS = " \t\n\x0b\f\r"


def stripped(html: Column) -> Column:
    """Text of markup: blocks become lines, other tags blanks; entities decoded."""
    return _tidied(_untagged(html))


def _untagged(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br)\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def _tidied(text: Column) -> Column:
    """One blank for blanks and tabs in a row, two line ends at most in a row, no space at either end."""
    out = F.regexp_replace(F.regexp_replace(text, "\t[ \t]*| [ \t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(out, F.lit(BLANKS))


def with_full_text(postings: DataFrame) -> DataFrame:
    """``description`` (plain text, then stripped markup) and ``full_text``: title and description. What is used more than once
    is a column of its own, so that the markup is gone through once."""
    staged = postings.withColumn("_told", _tidied(_untagged(F.col("html"))))
    staged = staged.withColumn("_text", F.trim(F.concat_ws(" ", "plain", F.when(F.col("_told") != "", F.col("_told")))))
    text = F.col("_text")
    told = (F.col("source") == "smartrecruiters") & F.col("html").isNull()  # a list entry is told by its fields
    full = F.when(told, F.concat_ws(", ", "title", "plain")).otherwise(F.trim(F.concat_ws(" ", "title", text)))
    return staged.withColumn("full_text", full).withColumn("description", F.when(told, "").otherwise(text)).drop("_told", "_text")


def _names(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


WORLD, REGIONS = ["world", "anywhere", "global"], ["emea", "apac", "latam", "americas", "europe", "africa", "north america", "asia"]


def with_board_scope(postings: DataFrame) -> DataFrame:
    """``remote_scope`` and ``location_countries`` of boards' postings, from what each board says of places.

    A country is told by its names in ``exprs.countries_named``; of several in one place the first in its table counts."""
    low = F.lower(F.coalesce("location_name", F.lit("")))
    places = F.coalesce("places", X.no_strings())
    low_places = F.transform(places, F.lower)
    country = F.get(X.countries_named(low), F.lit(0))
    of_places = F.array_distinct(F.array_compact(F.transform(places, lambda p: F.get(X.countries_named(F.lower(p)), F.lit(0)))))
    # a place of nofluffjobs is its code and its name
    code = lambda p: F.split_part(p, F.lit("|"), F.lit(1))
    name = lambda p: F.lower(F.split_part(p, F.lit("|"), F.lit(2)))
    coded = F.array_distinct(F.array_compact(F.transform(places, lambda p: F.when(F.length(code(p)) == 2, code(p)).otherwise(F.get(X.countries_named(name(p)), F.lit(0))))))
    text = F.lower(F.concat_ws(" ", "title", "plain"))
    result = lambda scope, countries=None: F.struct(F.lit(scope).alias("scope"), (F.lit(None).cast("array<string>") if countries is None else countries).alias("countries"))
    by_count = lambda c: F.when(F.size(c) == 1, result("country_fenced", c)).otherwise(result("region_fenced", c))
    free = F.when((F.trim(low) == "") | _names(low, WORLD), result("global")).otherwise(result("country_fenced"))
    source = F.col("source")
    scope = (
        F.when(source == "remoteok", F.when((F.trim(low) == "") | _names(low, ["worldwide", "anywhere", "global"]), result("global")).when(_names(low, REGIONS), result("region_fenced")).when(country.isNotNull(), result("country_fenced", F.array(country))).otherwise(result("global")))
        .when(source.isin("remotive", "weworkremotely"), free)
        .when(source == "arbeitnow", F.when(F.col("workplace_type") == "remote", result("global")).otherwise(result("unknown")))
        .when(source == "jobicy", F.when(F.trim(low).rlike("^(worldwide|anywhere|global|remote|)$"), result("global")).otherwise(result("country_fenced")))
        .when(
            source == "himalayas",
            F.when(F.exists(low_places, lambda p: _names(p, WORLD)), result("global")).when(F.size(of_places) > 0, by_count(of_places)).when(F.size(places) > 0, by_count(places))
            .when(_names(text, ["worldwide", "anywhere in the world", "work from anywhere"]), result("global")).when(_names(text, ["latin america", "latam", "emea", "apac", "americas", "europe", "africa", "asia"]), result("region_fenced")).otherwise(result("global")),
        )
        .when(source == "justjoin", F.when(F.size(places) > 0, result("country_fenced", places)).otherwise(result("global")))
        .when(
            source == "nofluffjobs",
            F.when((F.size(places) == 0) | F.exists(places, lambda p: _names(name(p), WORLD)), result("global")).when(F.size(coded) == 0, result("country_fenced", X.strings(["PL"]))).otherwise(by_count(coded)),
        )
        .when(source == "workingnomads", F.when(F.exists(low_places, lambda p: _names(p, [*WORLD, "remote"])), result("global")).otherwise(free))
        .when(source == "fourdayweek", F.when(F.size(places) > 0, result("global")).when(~F.col("workplace_type").eqNullSafe(F.lit("remote")), result("unknown")).otherwise(free))
    )
    return postings.withColumn("_scope", scope).withColumn("remote_scope", F.col("_scope.scope")).withColumn("location_countries", F.col("_scope.countries")).drop("_scope")


def read_rss_board(raw: DataFrame) -> DataFrame:
    """Postings of an RSS board (source, payload) in the common columns: "company: title", region, type, link, date."""
    item = F.explode(F.regexp_extract_all("payload", F.lit("(?is)<item>(.*?)</item>"), F.lit(1))).alias("item")
    field = lambda tag: F.trim(F.regexp_extract("item", f"(?is)<{tag}>(.*?)</{tag}>", 1))
    html = field("description")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    title, link = field("title"), F.nullif(field("link"), F.lit(""))
    split = F.contains(title, F.lit(":"))
    out = raw.select("source", item).select(
        "source",
        F.element_at(F.split(F.regexp_replace(link, "/+$", ""), "/"), -1).alias("external_job_id"),
        F.trim(F.when(split, F.regexp_extract(title, "(?s)^[^:]*:(.*)$", 1)).otherwise(title)).alias("title"),
        F.nullif(F.trim(F.when(split, F.regexp_extract(title, "^([^:]*):", 1))), F.lit("")).alias("company_name"),
        html.alias("html"),
        link.alias("apply_url"),
        link.alias("job_url"),
        F.nullif(field("region"), F.lit("")).alias("location_name"),
        F.lit("remote").alias("workplace_type"),
        field("type").alias("_type"),
        F.try_to_timestamp(F.regexp_extract(field("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss")).alias("published_at"),
    )
    return out.withColumn("employment_type", F.expr(board_employment("_type"))).drop("_type")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Tables of postings with different columns as one: a column that a table lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
