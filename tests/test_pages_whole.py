"""Pages cut off, references without a semicolon, and URLs that repeat, as the queries' SQL takes them."""

from pyspark.sql import functions as F

from matchflow.sources import discovery, pages

LONG = "words " * 50


def test_references_without_a_semicolon_stay_if_strict():
    page = f"<article>{LONG}R&ampD &lt;b&gt; &#39;&eacute;&nosuch; &amp;lt;</article>"
    assert pages.main_content(page, strict=True).endswith("R&ampD <b> 'é&nosuch; &lt;")
    assert pages.main_content(page).endswith("R&D <b> 'é&nosuch; &lt;")


def test_what_is_not_ended_does_not_count_if_strict():
    cut = f"<html><body><p>menu</p><article>{LONG}"
    assert pages.probe_content(cut, strict=True) == "" and pages.probe_content(cut) == LONG.strip()
    assert pages.probe_content(cut + "</body>", strict=True) == "menu" + LONG.strip()
    assert pages.main_content(f"<div>menu</div><div>{LONG}", strict=True) == "menu" + LONG.strip()


def test_first_text_of_a_url_by_the_order_of_seeds(spark):
    seeds = spark.createDataFrame([(i, "u", t) for i, t in enumerate("dcab")], "n int, url string, text string")
    for order, text in ((F.col("n"), "d"), (-F.col("n"), "b"), (None, None)):
        got = discovery.stage_provisional(seeds, spark.createDataFrame([], "id string"), first=order).collect()
        assert len(got) == 1 and got[0].raw == (text or min("dcab", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()))
