"""The vector table: documents' vectors as Parquet, and the hook for an encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
ENCODERS: dict[str, Callable[[], Encoder]] = {}


def register_encoder(name: str, load: Callable[[], Encoder]) -> None:
    """load is called once a worker and returns a function from texts to a matrix."""
    ENCODERS[name] = load


def encode(docs: DataFrame, load: Callable[[], Encoder] | str, batch: int = 32) -> DataFrame:
    """docs (doc_id, text) to doc_id, embedding."""
    load = ENCODERS[load] if isinstance(load, str) else load
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for p in parts:
            texts = p["text"].fillna("").tolist()
            own = [np.asarray(model(texts[a : a + batch]), np.float32) for a in range(0, len(texts), batch)]
            yield pd.DataFrame({"doc_id": p["doc_id"], "embedding": [v for m in own for v in m]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, embedding array<float>")


def save_index(vectors: DataFrame, path: str) -> None:
    vectors.select("doc_id", "embedding").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", F.col("embedding").alias("vector"))
