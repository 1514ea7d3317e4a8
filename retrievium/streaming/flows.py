"""The stateless kernels over streams, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import querygen
from ..schemas import schema


def read_documents(spark: SparkSession, path: str, kind: str = "document", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema(kind)).option("maxFilesPerTrigger", files_per_trigger).json(path)


def generate_queries(docs: DataFrame) -> DataFrame:
    """Queries for a stream of documents (doc_id, title, body, source): no state, one projection."""
    return querygen.generate(docs)


def counts_in_windows(events: DataFrame, time: str, key: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def write_json(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
