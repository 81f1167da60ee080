"""Helpers of the training-data operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"wo{rng.randrange(vocabulary):x}rd" for _ in range(n)]


def save(spark, tmp_path, **tables):
    """Write tables where a query looks for them."""
    for name, df in tables.items():
        df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
