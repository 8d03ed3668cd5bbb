"""Services that a library may use, as pluggable functions.

There is no network here: each service is a function that callers pass in, and
every operator has a result for the case that it gives no answer.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Embeds a batch of texts; rows are vectors.
Embedder = Callable[[list[str]], np.ndarray]
#: Completes a prompt; "" is no answer.
Completer = Callable[[str], str]


def vocabulary_embedder(words: list[str]) -> Embedder:
    """Counts of fixed words: deterministic, for tests and offline use."""

    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(w) for w in words] for t in texts], dtype=np.float32).reshape(len(texts), len(words))

    return embed


def embed(column: Column, load: Callable[[], Embedder]) -> Column:
    """Vectors of texts; the model is loaded once per worker, texts come in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return run(column)


def complete(column: Column, load: Callable[[], Completer], attempts: int = 3, delay: float = 2.0) -> Column:
    """Completions of prompts; "" where all attempts, each after a longer delay, fail or answer nothing."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(prompt: str | None) -> str:
            for nth in range(attempts):
                if nth:
                    time.sleep(delay * nth)
                try:
                    return model(prompt or "") or ""
                except Exception as e:  # noqa: BLE001  clients raise errors of their own; no answer is an answer
                    log.warning("completion failed (attempt %d of %d): %s", nth + 1, attempts, e)
            return ""

        for prompts in batches:
            yield prompts.map(one)

    return run(column)


def json_in(answer: Column, schema: str) -> Column:
    """The outermost JSON object of an answer, in whatever prose or fences it comes; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def look_up(books: DataFrame, *services: DataFrame) -> DataFrame:
    """Metadata by ISBN from tables of several services (isbn, title, publisher); the first that has a value gives it."""
    out = books.withColumn("_isbn", F.translate("isbn", "- ", ""))
    for i, s in enumerate(services):
        out = out.join(s.select(F.col("isbn").alias("_isbn"), F.col("title").alias(f"_t{i}"), F.col("publisher").alias(f"_p{i}")), "_isbn", "left")
    pick = lambda p: F.coalesce(*(F.col(f"_{p}{i}") for i in range(len(services))))
    return out.select("id", pick("t").alias("title"), pick("p").alias("publisher"))
