"""Triplets: mining, records, gates and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_OVERLAP, MIN_DIVERSITY, MIN_ENTAILMENT = 0.5, 0.3, 0.6


def mine(hits: DataFrame, negatives: int = 3) -> DataFrame:
    """From hits (query_id, rank, doc_id, score): the first is the positive, the next ones negatives. Queries with too few hits are left out."""
    enough = F.count("*").over(Window.partitionBy("query_id"))
    own = hits.withColumn("n_hits", enough).where(F.col("n_hits") >= negatives + 1)
    pos = F.min(F.when(F.col("rank") == 1, F.col("doc_id"))).over(Window.partitionBy("query_id"))
    return own.withColumn("positive_doc_id", pos).where((F.col("rank") > 1) & (F.col("rank") <= negatives + 1)).select("query_id", "positive_doc_id", F.col("doc_id").alias("negative_doc_id"), F.col("score").alias("difficulty"), (F.col("rank") - 1).alias("negative_rank"))


def skipped(hits: DataFrame, queries: DataFrame, negatives: int = 3) -> DataFrame:
    """How many queries mine() leaves out."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").agg(F.count_if(F.coalesce("n", F.lit(0)) < negatives + 1).alias("n_skipped"))


def with_texts(triplets: DataFrame, corpus: DataFrame) -> DataFrame:
    """triplets with title and content of both documents, '' where the corpus lacks one. Of a repeated doc_id the last row by pos counts."""
    one = corpus.groupBy("doc_id").agg(F.max_by(F.struct("title", "content"), "pos").alias("x")) if "pos" in corpus.columns else corpus.select("doc_id", F.struct("title", "content").alias("x"))
    for side in ("positive", "negative"):
        own = one.select(F.col("doc_id").alias(f"{side}_doc_id"), F.col("x.title").alias("t"), F.col("x.content").alias("c"))
        triplets = triplets.join(own, f"{side}_doc_id", "left").withColumns({f"{side}_title": F.coalesce("t", F.lit("")), f"{side}_content": F.coalesce("c", F.lit(""))}).drop("t", "c")
    return triplets


def grouped(triplets: DataFrame, *carry: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """A row for each query: negative_doc_ids in rank order, and with metrics (aggregates by name) a map of them."""
    x = F.array_sort(F.collect_list(F.struct("negative_rank", "negative_doc_id")))
    own = [F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics.values())).alias("metrics")] if metrics else []
    return triplets.groupBy("query_id", "positive_doc_id", *carry).agg(x["negative_doc_id"].alias("negative_doc_ids"), *own)


def hard_negatives(similar: DataFrame, n: int = 5, min_sim: float = 0.5) -> DataFrame:
    """The n most similar candidates (query_id, doc_id, sim, positive_doc_id) of at least min_sim that aren't the positive."""
    own = similar.where((F.col("sim") >= min_sim) & (F.col("doc_id") != F.col("positive_doc_id")))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "doc_id"))
    return own.withColumn("rank", r.cast("long")).where(F.col("rank") <= n)


def training_examples(triplets: DataFrame, anchor: str = "query", positive: str = "positive_content", negative: str = "negative_content") -> DataFrame:
    """anchor, positive, negative; all three must hold text."""
    own = triplets.select(F.col(anchor).alias("anchor"), F.col(positive).alias("positive"), F.col(negative).alias("negative"))
    return own.where("anchor <> '' and positive <> '' and negative <> ''")


def gate_issues(metrics: dict[str, Column], overlap: float = MIN_OVERLAP, diversity: float = MIN_DIVERSITY, entailment: float = MIN_ENTAILMENT) -> Column:
    """Array of issues; a missing metric counts as 0. The triplet is valid if the array is empty."""
    m = {k: F.coalesce(metrics.get(k, F.lit(None).cast("double")), F.lit(0.0)) for k in ("ngram_overlap", "diversity_score", "entailment_score")}
    return F.array_compact(F.array(F.when(m["ngram_overlap"] >= overlap, "High overlap"), F.when(m["diversity_score"] < diversity, "Low diversity"), F.when(m["entailment_score"] < entailment, "Low entailment")))


def gate(triplets: DataFrame, **thresholds: float) -> DataFrame:
    """triplets with issues and is_valid. Rows without any metric have the one issue that they lack them."""
    names = ("ngram_overlap", "diversity_score", "entailment_score")
    have = {k: F.col(k) for k in names if k in triplets.columns}
    none = F.lit(True) if not have else F.forall(F.array(*[c.isNull() for c in have.values()]), lambda x: x)
    issues = F.when(none, F.array(F.lit("Missing metrics"))).otherwise(gate_issues(have, **thresholds))
    return triplets.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def gate_overview(gated: DataFrame) -> DataFrame:
    """total, valid, invalid and pass_rate, 0 where there is no row."""
    n, ok = F.count("*"), F.count_if("is_valid")
    return gated.agg(n.alias("total"), ok.alias("valid"), (n - ok).alias("invalid"), F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("pass_rate"))


def metric_summary(gated: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean, std, min, max over the valid rows that have it."""
    own = gated.where("is_valid").unpivot([], names, "metric", "value").where("value is not null")
    return own.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """key, n; null as unknown."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def structure_errors(query: Column, positive: Column, negatives: Column) -> Column:
    """Errors in the shape of a grouped triplet; none if it is sound."""
    return F.array_compact(F.array(F.when(query.isNull(), "Missing field: query"), F.when(positive.isNull(), "Missing field: positive_doc_id"), F.when(negatives.isNull(), "Missing field: negative_doc_ids"), F.when(F.size(negatives) == 0, "negative_doc_ids cannot be empty")))


def quality_report(triplets: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean, stdev, min, max, n over all rows."""
    own = triplets.unpivot([], names, "metric", "value")
    return own.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("stdev"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
