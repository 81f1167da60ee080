"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 characters of the lower-cased text, hashed into ``buckets``) by language on a sample of
labelled rows; the counts are summed by Spark and smoothed into a matrix of log-probabilities, whose size depends on the
languages and buckets alone and which is broadcast. Scoring gathers a text's n-grams from the matrix and adds them up,
many texts in one numpy call.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm.common import map_text, slices, table

UNKNOWN = "und"
BLOCK = 1 << 17  # code points scored in one numpy call


def held_out(id_col: Column) -> Column:
    """A quarter of the documents, by id: never used in training. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(codes: np.ndarray, buckets: int) -> np.ndarray:
    """(len(codes) - 2, 3) buckets of the 1-, 2- and 3-grams that start at each place but the last two."""
    c = codes.astype(np.uint64)
    one = c[:-2] * np.uint64(0x9E3779B97F4A7C15)
    two = (one ^ c[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
    three = (two ^ c[2:]) * np.uint64(0x94D049BB133111EB)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.stack([one >> shift, two >> shift, three >> shift], axis=1).astype(np.int32)


def blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, code points) of blocks; a text longer than a block comes in several of the same number.

    Every text is lower-cased and followed by two spaces, so that no n-gram reaches into the next one.
    """
    for i, t in enumerate(texts):
        codes = np.frombuffer((t.lower() + "  ").encode("utf-32-le"), "<u4")
        for at in range(0, max(1, len(codes) - 2), BLOCK):
            yield i, codes[at : at + BLOCK + 2]


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # (buckets, languages)
    log_prior: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) joint log-likelihoods."""
        buckets = len(self.log_prob)
        total = np.zeros((len(texts), len(self.langs)))
        group: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if group:
                starts = np.cumsum([0, *[len(g) for g in group[:-1]]])
                sums = np.add.reduceat(self.log_prob[np.concatenate(group)].sum(axis=1), starts, axis=0)
                np.add.at(total, owner, sums)
                group.clear()
                owner.clear()

        size = 0
        for i, codes in blocks(texts):
            if len(codes) > 2:
                group.append(grams(codes, buckets))
                owner.append(i)
                size += len(codes)
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return total + self.log_prior


def train(
    docs: DataFrame, buckets: int = 1 << 15, sample_per_lang: int = 2_000, max_langs: int = 1_000,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Fit on labelled rows that are not held out.

    The sample is bounded: of each language about ``sample_per_lang`` whole documents (all, if it has fewer), picked by a
    hash of the id at a rate worked out from the language's row count, so that it is spread over the table and the same
    on every run. Every label is a language; more than ``max_langs`` of them are an error, as the model's matrix has a
    column for each. The counts reach the driver as one row for each language and bucket in use, a number that does not
    grow with the data.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs, or mend the labels")
    if not sizes:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, sample_per_lang / r["count"]) * (1 << 30))))])
    sample = rows.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < F.coalesce(rate[F.col("lang")], F.lit(0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices([batch], "text"):
                for lang, text in zip(part.column(1).to_pylist(), part.column(0).to_pylist()):
                    into = sums.setdefault(lang, np.zeros(buckets, np.int64))
                    for _, codes in blocks([text]):
                        if len(codes) > 2:
                            into += np.bincount(grams(codes, buckets).ravel(), minlength=buckets)
        for lang, into in sums.items():
            used = np.flatnonzero(into)
            yield pa.record_batch([pa.array([lang] * len(used)), pa.array(used, pa.int32()), pa.array(into[used])], names=["lang", "bucket", "n"])

    summed = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    langs = sorted(r["lang"] for r in sizes)
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.full((buckets, len(langs)), 0.5)
    if got.num_rows:
        counts[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    n = np.array([next(r["count"] for r in sizes if r["lang"] == lang) for lang in langs], float)
    return Model(langs, np.log(counts / counts.sum(axis=0)), np.log(n / n.sum()))


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Languages and posterior probabilities; ``und`` and 0 for texts without a letter."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model.langs and texts:
        joint = model.score(texts)
        best = joint.argmax(axis=1)
        posterior = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
        for i, t in enumerate(texts):
            if any(map(str.isalpha, t)):
                lang[i], score[i] = model.langs[best[i]], float(posterior[i])
    return lang, score


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the likeliest language and its posterior probability.

    ``und`` with score 0 if the text is null or has no letter, or if the model has learned no language. Ties go to the
    language first by name. Repeated rows are scored alike; further columns are ignored; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(shared.value, [t or "" for t in batch.column(1).to_pylist()])
        return pa.record_batch([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_text(docs, [id_col, text_col], text_col, run, f"doc_id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", id_col)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified with a posterior of ``min_score`` or more, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            lang, score = predict(shared.value, [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
            yield batch.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score)]))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
