"""Embeddings: a deterministic built-in embedder, dimension fitting, pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deterministic(content: Column, dims: int = 16) -> Column:
    """The first bytes of the content's SHA-256, each over 255."""
    digest = F.sha2(content.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def fit(vector: Column, dims: int) -> Column:
    """Cut or padded with zeros to a dimension."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), dims)), 1, dims)


def embed_with(chunks: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16, dims: int | None = None) -> DataFrame:
    """chunks with embedding from a model that each task makes once and asks for so many texts at a time; vectors are fitted to ``dims`` if given."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for part in parts:
            texts = part.tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])])

    vector = F.pandas_udf(run, "array<double>")("content")
    out = chunks.withColumn("embedding", vector)
    return out if dims is None else out.withColumn("embedding", fit(F.col("embedding"), dims))


def attach(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors by evidence_id; a chunk without one has an empty vector."""
    return chunks.join(vectors.select("evidence_id", "embedding"), "evidence_id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<double>")))
