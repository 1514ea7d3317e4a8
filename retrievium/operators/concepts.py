"""Concepts of long texts, by counting tokens in a shuffle instead of comparing each with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def top_concepts(docs: DataFrame, n: int = 15, body: str = "body", stop: list[str] = T.CONCEPT_STOP) -> DataFrame:
    """doc_id, concept, times, rank: the n commonest concept tokens of each document; ties go to the one that comes first."""
    toks = docs.select("doc_id", F.posexplode(T.word_tokens(body)).alias("at", "concept")).where(T.is_concept(F.col("concept"), stop))
    counted = toks.groupBy("doc_id", "concept").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("times").desc(), "at"))
    return counted.withColumn("rank", r.cast("long")).where(F.col("rank") <= n).select("doc_id", "concept", "times", "rank")


def concept_arrays(docs: DataFrame, n: int = 15, body: str = "body", stop: list[str] = T.CONCEPT_STOP) -> DataFrame:
    """doc_id, concepts in rank order; documents without any are left out."""
    x = F.array_sort(F.collect_list(F.struct("rank", "concept")))
    return top_concepts(docs, n, body, stop).groupBy("doc_id").agg(x["concept"].alias("concepts"))


def group_overlap(concepts: DataFrame, group: str) -> DataFrame:
    """For each group of documents (doc_id, concept, group): concepts of all of them, of any, and the ratio."""
    n = concepts.groupBy(group).agg(F.count_distinct("doc_id").alias("n_docs"))
    per = concepts.groupBy(group, "concept").agg(F.count_distinct("doc_id").alias("n_with"))
    both = per.join(n, group).groupBy(group, "n_docs").agg(F.count_if(F.col("n_with") == F.col("n_docs")).alias("n_common"), F.count("*").alias("n_all"))
    return both.withColumn("overlap", F.round(F.col("n_common") / F.col("n_all"), 6))
