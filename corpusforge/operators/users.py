"""Places for a user's own functions: encoders, pair scorers; and the one text form that Spark lacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text as text_forms


def encoded(documents: DataFrame, key: str, title: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 32, chars: int = 2000, prefix: str = "") -> DataFrame:
    """(key, vector) of ``prefix``, title and the first ``chars`` characters of each text; ``encode`` gets ``batch`` texts at once."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            made = [v for i in range(0, len(texts), batch) for v in encode(list(texts[i : i + batch]))]
            yield pd.Series(made, index=texts.index)

    joined = F.concat(F.lit(prefix), F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars))
    return documents.select(key, run(joined).alias("vector"))


def pair_scored(pairs: DataFrame, query: str, text: str, score: Callable[[str, str], float]) -> DataFrame:
    """The pairs with a user's score of query and text."""

    @F.pandas_udf("double")
    def run(asked: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([float(score(q, t)) for q, t in zip(asked, texts, strict=True)], dtype=float)

    return pairs.withColumn("score", run(query, text))


def compatible(rows: DataFrame, column: str) -> DataFrame:
    """A text column in compatibility form (NFKC), in one pass over the rows."""
    return rows.withColumn(column, text_forms.compatible(F.col(column)))


def letter_counts(texts: list[str]) -> list[list[float]]:
    return [[t.count("a") / 100, t.count("e") / 100] for t in texts]


def length_ratio(query: str, text: str) -> float:
    return min(len(query), len(text)) / max(len(query), len(text), 1)
