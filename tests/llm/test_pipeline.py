"""The pipeline against a brute-force version of its stages."""

import random

import numpy as np
from llm_helpers import DOCS, prose, save
from tokenizers import Tokenizer

import corpus_pipeline
from matchflow.llm import language_id, minhash_dedup, secret_scan
from matchflow.llm.packing import WORD_BPE


def documents(spark):
    rng = random.Random(21)
    rows, i = [], 0
    for _ in range(25):
        base = prose(rng, 80)
        for copies in range(rng.choice([1, 1, 2, 3])):
            words = list(base)
            for _ in range(copies):  # near copies
                words[rng.randrange(80)] = "edited"
            rows.append((i, " ".join(words), "en", "s", None))
            i += 1
    rows += [(i + k, rows[k][1], None, "s", 5) for k in range(6)]  # exact copies
    rows += [(500, None, "en", "s", 0), (501, "12345 !!", "en", "s", 8), (502, rows[0][1] + ' token = "a8f5f167f44f4964e6c998de"', "en", None, 1)]
    rows += [(503, "und hier ist ein kurzer deutscher text mit wörtern " * 4, "de", "s", 9), (504, "", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def brute(rows, model):
    kept = [r for r in rows if language_id.predict(model, [r["text"] or ""])[0][0] != "und" and language_id.predict(model, [r["text"]])[1][0] >= 0.5]
    last = {}
    for r in kept:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    kept = [r for r in kept if last[r["text"]] == r["doc_id"]]
    sets = {r["doc_id"]: minhash_dedup.shingle_set(minhash_dedup.words(r["text"]), 5) for r in kept}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {r["doc_id"]: secret_scan._redacted(r["text"], "[REDACTED]") for r in kept if find(r["doc_id"]) == r["doc_id"]}


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = documents(spark)
    at = save(spark, tmp_path, documents=docs)
    want = brute(docs.collect(), language_id.train(spark.read.parquet(f"{at}/documents.parquet")))
    library = Tokenizer.from_file(WORD_BPE)
    rows = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"] for r in rows} == set(want) and 5 < len(want) < docs.count() - 10
    for r in rows:
        ids = library.encode(want[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["doc_tokens"] == len(ids) and np.isclose(r["length"], min(4096, len(ids) - r["start"]))


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark).withColumnRenamed("doc_id", "doc_id")
    at = save(spark, tmp_path, documents=docs)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), DOCS)
    assert docs.filter("text LIKE '%a8f5f167%'").count() == 0 and docs.filter("length(text) <> n_chars").count() == 0


def test_empty_corpus(spark, tmp_path):
    at = save(spark, tmp_path, documents=documents(spark).limit(0))
    assert corpus_pipeline.run(spark, at).count() == 0
