"""The shared tables as the records that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, retrieve, triplets

#: documents.source ends in a number; it stands for one of these sources.
SOURCES = ["digi24", "mediafax", "ro-text-summarization", "ro-stories", "histnero", "recipes-ro", "commoncrawl", "news"]
TOP = 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, title (the first line), body, source."""
    n = F.coalesce(F.try_to_number(F.regexp_extract("source", r"([0-9]+)$", 1), F.lit("999999")).cast("int"), F.lit(0))
    body = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.trim(F.split_part(body, F.lit("\n"), F.lit(1))).alias("title"), body.alias("body"), F.element_at(T.literals(SOURCES), n % len(SOURCES) + 1).alias("source"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query: the benchmark's items."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))


def vectors(spark: SparkSession, d: str, id_name: str, part: slice | None = None) -> DataFrame:
    v = F.col("embedding") if part is None else F.slice("embedding", part.start + 1, part.stop - part.start)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(id_name), v.alias("vector"))


def neighbours(spark: SparkSession, d: str, k: int, metric: str = "l2", part: slice | None = None) -> DataFrame:
    """Each vector as a query against all others: query_id, doc_id, score, rank."""
    return retrieve.nearest(vectors(spark, d, "query_id", part), vectors(spark, d, "doc_id", part), k, metric, other=True)


def marked(spark: SparkSession, d: str, k: int = 10, part: slice | None = None) -> DataFrame:
    """neighbours with rel: 1 where both have the same label."""
    label = table(spark, d, "embeddings").select("vec_id", "label")
    hits = neighbours(spark, d, k, "l2", part)
    q = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a"))
    c = label.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b"))
    return hits.join(q, "query_id").join(c, "doc_id").withColumn("rel", F.when(F.col("a") == F.col("b"), 1).otherwise(0)).drop("a", "b")


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """query_id, n_relevant: the other vectors of the same label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    return e.join(n, "label").select(F.col("vec_id").alias("query_id"), (F.col("n") - 1).alias("n_relevant"))


def mined(spark: SparkSession, d: str) -> DataFrame:
    return triplets.mine(neighbours(spark, d, TOP), 3)


def with_vectors(spark: SparkSession, d: str, t: DataFrame) -> DataFrame:
    """Triplets with vectors a, p and n."""
    for i, v in (("query_id", "a"), ("positive_doc_id", "p"), ("negative_doc_id", "n")):
        t = t.join(vectors(spark, d, i).withColumnRenamed("vector", v), i)
    return t


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, a, b: each turn with the one before it in its conversation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    return c.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", "a", F.col("text").alias("b"))


def fixed_metrics(spark: SparkSession, d: str, part: slice | None = None) -> DataFrame:
    return evaluate.per_query_fixed_k(marked(spark, d, 10, part), relevant(spark, d))
