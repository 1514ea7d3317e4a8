"""Evaluation of ranked lists: relevance marks, metrics for each query, reports and their comparison. One shuffle by query, one by metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R

METRICS = ("ndcg", "mrr", "precision", "recall", "map")


def mark_relevant(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """hits with rel: 1 where (query_id, doc_id) is in qrels, else 0."""
    q = qrels.select("query_id", "doc_id", F.lit(1).alias("is_rel")).distinct()
    return hits.join(q, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("is_rel", F.lit(0))).drop("is_rel")


def usable(rows: DataFrame, *columns: str) -> DataFrame:
    """rows all of whose columns hold text; null, empty and blank ones are left out."""
    for c in columns:
        rows = rows.where(F.trim(c) != "")
    return rows


def lists(hits: DataFrame, *keys: str) -> DataFrame:
    """A row for each query: retrieved_ids and relevances in rank order."""
    x = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.col("rel").cast("int").alias("rel"))))
    return hits.groupBy("query_id", *keys).agg(x.alias("x")).select("query_id", *keys, F.col("x.doc_id").alias("retrieved_ids"), F.col("x.rel").alias("relevances"))


def per_query_fixed_k(hits: DataFrame, n_relevant: DataFrame | None = None, k: int = 10) -> DataFrame:
    """hits (query_id, rank, doc_id, rel): the metrics against an ideal list of k ones; average precision over the hits found."""
    rels = F.col("relevances")
    own = lists(hits)
    total = F.lit(1)
    if n_relevant is not None:
        own, total = own.join(n_relevant, "query_id", "left"), F.coalesce(F.col("n_relevant"), F.lit(0))
    return own.select("query_id", *_rounded(ndcg=R.ndcg_fixed_k(rels, k), mrr=R.reciprocal_rank(rels), precision=R.precision(rels, k), recall=R.recall(rels, total, k), map=R.ap_over_found(rels, k)))


def per_query_truncated(hits: DataFrame, n_relevant: DataFrame, k: int = 10) -> DataFrame:
    """The metrics against an ideal list of the relevant ones; average precision over all that are relevant."""
    rels, n = F.col("relevances"), F.coalesce(F.col("n_relevant"), F.lit(0))
    own = lists(hits).join(n_relevant, "query_id", "left")
    return own.select("query_id", *_rounded(ndcg=R.ndcg_truncated(rels, n, k), mrr=R.reciprocal_rank(rels, k), precision=R.precision(rels, k), recall=R.recall(rels, n, k), map=R.ap_over_relevant(rels, n, k)))


def _rounded(**metrics: Column) -> list[Column]:
    return [F.round(c, 6).alias(name) for name, c in metrics.items()]


def long_form(per_query: DataFrame, *keys: str) -> DataFrame:
    return per_query.unpivot([*keys], list(METRICS), "metric", "value")


def report(per_query: DataFrame) -> DataFrame:
    """metric, mean, median, stdev (of the population), total_queries."""
    v = F.col("value")
    return long_form(per_query).groupBy("metric").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 9).alias("median"), F.round(F.stddev_pop(v), 6).alias("stdev"), F.count("*").alias("total_queries"))


def report_by_model(per_query: DataFrame, key: str = "model") -> DataFrame:
    """key, metric, mean, std, min, max."""
    v = F.col("value")
    return long_form(per_query, key).groupBy(key, "metric").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def improvement(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """Reports joined by metric: baseline, improved, difference and its percentage (0 where the baseline is 0)."""
    a, b = baseline.select("metric", F.col("mean").alias("baseline")), other.select("metric", F.col("mean").alias("improved"))
    diff = F.col("improved") - F.col("baseline")
    return a.join(b, "metric").select("metric", "baseline", "improved", F.round(diff, 6).alias("difference"), F.round(F.when(F.col("baseline") != 0, 100 * diff / F.col("baseline")).otherwise(0.0), 6).alias("percent"))
