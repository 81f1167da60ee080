"""Joins of names by containment, without comparing every name with every other one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchflow.functions import exprs as X

#: Characters of an index key, by the shortest name that it serves: names of 2 are keys themselves.
KEY_SIZES = (2, 3, 6)
MIN_NAME = 2
#: Pieces are told apart by so many slots before they are sent: a bounded table, which lets all pass when it is full.
SLOTS = 1 << 17


def normalized_name(name: Column) -> Column:
    """Lower case without legal forms, "company" and "the" (anywhere, as whole words), dots, commas, quotes and slashes."""
    out = F.regexp_replace(F.lower(name), r"(?<![a-z0-9_])(inc|llc|ltd|corp|corporation|co|company|the)(?![a-z0-9_])\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[.,'/]", ""), r"\s+", " "))


def grams(name: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a name; none of a shorter one."""
    last = F.length(name) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(name, i, F.lit(size)))))


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): the distinct names of ``needles`` (name) that stand in one of ``hays`` (name), anywhere, character by
    character. Names of fewer than two characters, and null ones, take no part on either side.

    Each name of the first side is indexed once, by the rarest of its pieces of 6 characters (3, if it has fewer than 6; a
    name of 2 by itself) among the names of the second side; these are taken apart into all their pieces of the sizes in
    use. Both sides meet in an equi-join on the piece and are verified. A piece that many names share is the key of such
    names only as have nothing rarer, and these names do have that many candidates. Pieces travel once for each distinct
    name, however many rows have it.

    Only the slots of pieces, which are bounded, are broadcast. Spark takes a name that is exploded into its pieces for one
    row, and so would broadcast whole indexes; the other joins are asked to merge.
    """
    tidy = lambda df: df.filter(F.length("name") >= MIN_NAME).select("name").distinct()
    name, slot = F.col("name"), F.pmod(F.xxhash64("piece"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = lambda df: F.broadcast(df.select(slot).distinct().withColumn("seen", F.lit(True)))
    own_pieces = F.lit(None)
    for size in KEY_SIZES:
        own_pieces = F.when(F.length(name) >= size, grams(name, size)).otherwise(own_pieces)
    # a piece's length tells its size apart, so that all sizes share one index
    index = tidy(hays).select("name", F.explode(F.concat(*[F.coalesce(grams(name, size), X.no_strings()) for size in KEY_SIZES])).alias("piece"))
    asked = tidy(needles).select("name", F.explode(own_pieces).alias("piece"))
    # a name with a piece that no name of the other side has is contained in none of them: most go by their slots, unsent
    known = asked.select("name", slot).join(slots(index), "slot", "left").groupBy("name").agg(F.every(F.col("seen").isNotNull()).alias("known"))
    asked = known.filter("known").select("name", F.explode(own_pieces).alias("piece"))
    index = index.select("name", "piece", slot).join(slots(asked), "slot", "left_semi").drop("slot")  # others are no key: most, if the first side is small
    count = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = asked.join(count.hint("merge"), "piece", "left").groupBy("name")
    key = own.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("k")).filter("k.n > 0")
    hit = key.select(name.alias("needle"), "k.piece").join(index.withColumnRenamed("name", "hay").hint("merge"), "piece")
    return hit.filter(F.contains("hay", "needle")).select("needle", "hay")  # a name has one key, another a piece once: no repeats


def names_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): distinct pairs of names (name) of the two sides that are equal or of which one contains the other."""
    a = contained(left, right).select(F.col("needle").alias("l"), F.col("hay").alias("r"))
    b = contained(right, left).select(F.col("hay").alias("l"), F.col("needle").alias("r"))
    return a.unionAll(b.filter(F.length("l") > F.length("r")))  # equal ones come from the first side


def layoff_names(feeds: DataFrame, xml: str) -> DataFrame:
    """The distinct company names (name) in the titles of news feeds: what stands before a dash, "lays off" or "layoffs"."""
    items = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit("(?is)<item>.*?</item>"), F.lit(0))).alias("item"))
    title = F.trim(F.regexp_extract("item", r"(?is)<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>", 1))
    for entity, plain in (("&#x27;", "'"), ("&amp;", "&"), ("&#39;", "'")):
        title = F.replace(title, F.lit(entity), F.lit(plain))
    name = F.split(title, r"\s+[-–]\s+")[0]
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\s+lays\s+off.*$", ""), r"(?i)\s+layoffs?$", ""))
    return items.select(name.alias("name")).filter(F.length("name") > 1).distinct()
