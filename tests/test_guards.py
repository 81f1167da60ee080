"""Patterns that are tried only where a text holds a string they need."""

import pytest
from pyspark.sql import functions as F

from matchflow.functions import constants as C
from matchflow.functions import exprs as X
from matchflow.operators import classify as cls
from matchflow.operators import filters as flt
from matchflow.operators import scoring as sco

PATTERNS = [
    *["(?i)" + p for p, _ in cls.COUNTRY_FENCES + C.REGION_SIGNALS], *[p for p, _ in C.MEDIUM_SIGNALS], *[p for p, _, _ in C.NEGATIVE_SIGNALS], *["(?i)" + p for _, p, _ in C.REGION_PROBES],
    *["(?i)" + p for p in C.GLOBAL_SIGNALS + C.ALWAYS_GLOBAL + C.ONSITE_SIGNALS], *["(?i)" + p for _, p, _ in C.PLATFORM_PATTERNS + C.ROLE_FAMILY_PATTERNS],
]
TEXTS = [
    "CANADA ONLY", "U.S. only, e-verify", "W2 only", "Must reside in the UK", "must be based in South Korea", "right to work for the EU", "Right to work in New Zealand", "authorized to work in INDIA", "remote – EMEA", "Remote: us", "remote-ca",
    "Based in New York only", "100 % remote", "On Site role", "in-office required", "must be in Austin, Texas", "UTC-3 to UTC+3", "time zone is cet", "Americas hours", "EUROPE TIMEZONE", "core hours overlap", "salary 5 PLN", "overlap of 4 hour",
    "Global, remote", "operate in 12 countries", "No location restriction", "Sr .NET dev", "C# and ASP.NET", "wp developer", "PL/SQL", "Dynamics 365", "dynamics crm", "Software Engineer in Test", "VP of Engineering", "DEV OPS", "İstanbul only", "ſite only Korea only", "", "nothing of it",
]


@pytest.mark.parametrize("pattern, words", [(r"(?i)\bcanada\s+only", ["canada"]), (r"a?b*\d", []), ("X(?:ab|cde)+", ["ab", "cde"]), ("(?:abc|d)e?(?:fgh|ijk)", ["fgh", "ijk"]), ("ab|[c-e]", [])])
def test_needed(pattern, words):
    assert X.needed(pattern) == words


def test_said_is_a_match(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("low", F.lower("t"))
    pairs = [(X.said(F.col("t"), F.col("low"), p), F.col("t").rlike(p)) for p in PATTERNS]
    assert any(X.needed(p) for p in PATTERNS)
    got = df.select("t", F.array(*[a for a, _ in pairs]).alias("a"), F.array(*[b for _, b in pairs]).alias("b")).collect()
    assert {r.t: r.a for r in got} == {r.t: r.b for r in got}
    assert sum(map(any, (r.a for r in got))) > 30


def test_families_are_worked_out_by_persona(spark):
    personas = spark.createDataFrame([(1, ["React", "vue"], [], ["lead"]), (2, ["django"], [], None), (3, None, [], None)], "id long, must_have_tags array<string>, blocklist_tags array<string>, seniority_levels array<string>")
    pairs = personas.crossJoin(spark.createDataFrame([(t,) for t in ("Drupal Developer", "Tech Lead", "SAP dev", None)], "title string"))
    plain = sco.title_blockers(pairs).select("id", "title", "blocker", "blocker_type").collect()
    ahead = sco.title_blockers(sco.with_stack(personas).crossJoin(pairs.select("title").distinct())).select("id", "title", "blocker", "blocker_type").collect()
    assert sorted(map(str, plain)) == sorted(map(str, ahead))
    assert {r.title for r in plain if r.blocker} == {"Drupal Developer", "Tech Lead", "SAP dev"}


def test_landed_files_are_enough_for_all_cores(spark):
    from matchflow.plans.queries_streaming import landed
    from matchflow.streaming import streams as st

    batches = []
    at = st.work_folder(spark)
    flow = landed(spark.range(1000).repartition(4), 6).withColumn("file", F.input_file_name())
    flow.writeStream.foreachBatch(lambda df, n: batches.append(df.agg(F.count("id"), F.countDistinct("file")).first())).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 3 and sum(n for n, _ in batches) == 1000
    assert {files for _, files in batches} == {spark.sparkContext.defaultParallelism}


def test_words_of_national_security(spark):
    texts = ["Top Secret", "TS/SCI clearance", "itars", "navyblue", "E-Verify", "e-verify and export controlled", "Fort Meade", "u.s. citizen", "", None]
    df = spark.createDataFrame([("Dev", t, None) for t in texts], "title string, normalized_text string, is_natsec boolean")
    text = F.concat_ws(" ", "title", "normalized_text")
    tried = lambda terms: text.rlike(X.whole_terms(terms))
    got = flt.with_natsec_flag(df).withColumn("want", tried(C.NATSEC_WORDS) | (tried(C.NATSEC_HINTS) & tried(C.CLEARANCE_WORDS))).collect()
    assert [r.natsec for r in got] == [r.want for r in got]
    assert {r.natsec for r in got} == {True, False} and "_low" not in got[0].asDict()


def test_board_postings_know_vectors_by_a_flag(spark):
    from matchflow.operators import upserts

    current = spark.createDataFrame([("a", "b", "1", "t", "global", True), ("a", "b", "2", "t", "global", False)], "ats_source string, ats_slug string, external_job_id string, title string, remote_scope string, embedded boolean")
    incoming = spark.createDataFrame([], "ats_source string, ats_slug string, external_job_id string, title string, published_at timestamp, remote_scope string, embedded boolean")
    got = upserts.upsert_board_postings(current, incoming, "1998-01-01 00:00:00")
    assert {(r.external_job_id, r.embedded) for r in got.collect()} == {("1", True), ("2", False)}
