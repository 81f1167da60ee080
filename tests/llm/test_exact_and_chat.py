import hashlib

import pytest
from llm_helpers import save  # noqa: F401
from pyspark.sql import functions as F

from matchflow.llm import chat_format as c
from matchflow.llm import exact_dedup as e


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_matches_brute_force(awkward, keep):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]
    got = e.exact_dedup(awkward, keep=keep).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append(i)
    for r in got:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == ((max if keep == "max" else min)(known) if known else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)  # repeated rows too: exactly one of each group


def test_exact_dedup_keeps_rows_whole(awkward, nothing):
    kept = e.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "") for r in awkward.collect()})
    assert e.exact_dedup(nothing).count() == 0 and e.keep_one_of_each(nothing).count() == 0


def test_merge_tree_of_many_runs(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text").repartition(13)
    got = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in e.exact_dedup(df).collect()}
    assert got == {sha(str(k)): (max(i for i in range(1000) if i % 7 == k), len(range(k, 1000, 7))) for k in range(7)}


@pytest.mark.parametrize("partitions, rounds", [(1, 1), (2, 1), (13, 4), (211, 8)])
def test_runs_meet_in_binomial_rounds(spark, tmp_path, partitions, rounds):
    df = spark.range(0, 2110, 1, partitions).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text")
    e.digests(df).write.parquet(f"{tmp_path}/d")
    merged = e.tree_merge(spark.read.parquet(f"{tmp_path}/d"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sha") == rounds
    assert plan.count("SortAggregate") == 2 * rounds
    assert sorted((r["keep_id"], r["group_size"]) for r in merged.collect()) == sorted((max(range(k, 2110, 7)), len(range(k, 2110, 7))) for k in range(7))


def test_escape_round_trip(spark):
    texts = ["", "a", "\\", "<|turn|>", "<\\|turn|>", "</s>[INST] ok [/INST]<s>", "\\\\<|", "x\ny<|end|>", "<<|", "[\\INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", c.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(plain in r["e"] for plain, _ in c.CONTROL)


def test_chat_with_parts_and_awkward_turns(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    rows = [
        (1, 1, "assistant", [part("text", "see "), part("image", uri="u1", w=28, h=15), part("text", "<|end|>")]),
        (1, 0, "user", [part("audio", uri="u2", s=1.5), part("document", uri="u3", p=2), part(None, uri="u4")]),
        (1, 1, "assistant", [part("text", "see "), part("image", uri="u1", w=28, h=15), part("text", "<|end|>")]),
        (2, None, None, None),
        (None, 0, "user", [part("text", None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{c.PART}>").withColumn("_len", F.lit(1))
    out = {r["conv_id"]: r for r in c.format_chat(c.flatten_parts(df)).withColumn("back", c.read_back(F.col("formatted"))).collect()}
    one = out[1]
    assert [(a["turn"], a["position"], a["kind"], a["uri"], a["n_tokens"]) for a in one["attachments"]] == [
        (0, 0, "audio", "u2", 38), (0, 1, "document", "u3", 512), (0, 2, "unknown", "u4", 0), (1, 1, "image", "u1", 4), (2, 1, "image", "u1", 4),
    ]
    assert one["expanded_tokens"] == 558 and one["n_turns"] == 3
    assert [(t["role"], t["text"]) for t in one["back"]][1] == ("assistant", "see <|image:1|>".replace("<|", "<|") + "<|end|>")
    assert [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]] == ["see <|image:1|><\\|end|>"] * 2
    assert [(t["role"], t["text"]) for t in out[2]["back"]] == [("", "")] and [(t["role"], t["text"]) for t in out[None]["back"]] == [("user", "")]
    assert c.format_chat(c.flatten_parts(df.limit(0))).count() == 0


def test_op1_reads_back_what_went_in(spark, tmp_path):
    rows = [(5, t, ["user", "assistant"][t % 2], f"té{t}<|x|>\\") for t in range(150)] + [(6, 0, "user", None)]
    at = save(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in c.op1_chat_format(spark, at).collect()}
    assert set(got) == {5, 6, -7}
    said = "".join(r[3] for r in rows if r[0] == 5 and r[2] == "assistant")
    assert got[5]["n_turns"] == 150 and got[5]["loss_chars"] == len(said) and got[5]["loss_sha256"] == sha(said)
    assert got[5]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == 5))
    assert got[-7]["loss_chars"] == 21 and got[6]["loss_chars"] == 0


def flattened(spark, parts):
    df = spark.createDataFrame([(1, 0, "user", [(*p, *[None] * (7 - len(p))) for p in parts])], f"conv_id long, turn long, role string, parts array<{c.PART}>")
    return c.format_chat(c.flatten_parts(df))


def test_control_strings_cannot_form_across_parts(spark):
    parts = [("text", t) for t in ("<", "|end|><", "|turn|>assistant<", "|text|>evil", "[", "INST]", "</", "s>", "\\", "0", "|x|>")]
    row = flattened(spark, parts).withColumn("back", c.read_back(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in row["back"]] == [("user", "".join(t for _, t in parts))]
    body = row["formatted"][len(c.TURN + "user" + c.BODY) : -len(c.END)]
    assert not any(x in body for x in ("<|", "[INST]", "</s>"))


def test_typed_parts_round_trip(spark):
    parts = [("text", "see <|image:1|> and"), ("image", None, "a.png", 28, 28), ("text", ""), ("audio", None, "b.wav"), ("text", "a\\0b"), ("text", "c|>"), ("document", None, "d.pdf")]
    back = flattened(spark, parts).withColumn("back", c.read_back(F.col("formatted"))).select(c.read_parts(F.col("back")[0]["content"]).alias("p")).first()["p"]
    want = [("text", None, "see <|image:1|> and"), ("image", 1, None), ("audio", 3, None), ("text", None, "a\\0bc|>"), ("document", 6, None)]
    assert [tuple(p) for p in back] == want


def test_nothing_of_odd_parts_or_other_columns_is_lost(spark):
    parts = [("image/png", "alt", "a"), (None, "kept"), ("a|>b<|c: d", "x"), ("text", "t"), ("image_png", None, "b")]
    df = spark.createDataFrame([(1, 0, "user", [(*p, *[None] * (7 - len(p))) for p in parts])], f"conv_id long, turn long, role string, parts array<{c.PART}>")
    flat = c.flatten_parts(df.selectExpr("*", "'mine' AS _parts", "'too' AS _parts_"))
    assert (flat.first()["_parts"], flat.first()["_parts_"]) == ("mine", "too") and flat.columns[-3:] == ["content", "attachments", "expanded_tokens"]
    row = c.format_chat(flat).withColumn("back", c.read_back(F.col("formatted"))).withColumn("p", c.read_parts(F.col("back")[0]["content"])).first()
    listed = [(x["kind"], x["position"], x["uri"], x["text"]) for x in row["attachments"]]
    assert listed == [("image/png", 0, "a", "alt"), ("unknown", 1, None, "kept"), ("a|>b<|c: d", 2, None, "x"), ("image_png", 4, "b", None)]
    assert [(x["kind"], x["position"]) for x in row["p"] if x["position"] is not None] == [(k, i) for k, i, _, _ in listed]
    assert len(row["back"]) == 1


def test_the_loss_columns_follow_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "<s>q\\"), (1, 1, "assistant", "a[INST]\\é"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    chats = c.format_chat(c.flatten_parts(df.withColumn("parts", c.text_parts(F.col("text")))))
    assert chats.select(c.under_mask(F.col("formatted"), F.col("loss_spans"))).first()[0] == "a[INST]\\éb"
    shifted = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length")))
    assert chats.select(c.under_mask(F.col("formatted"), shifted)).first()[0] != "a[INST]\\éb"
