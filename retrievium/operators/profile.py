"""Profiles and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Edges of the quality histogram: very low, low, medium, high.
QUALITY_EDGES = [x / 10 for x in (0, 3, 5, 7, 10)]


def stats(v: Column, *, percentiles: bool = False) -> list[Column]:
    out = [F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    if percentiles:
        out += [F.round(F.percentile(v, F.lit(q)), 9).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return out


def with_total(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Aggregates for each key and for all, under TOTAL."""
    return df.rollup(key).agg(*aggs, F.grouping_id().alias("g_")).withColumn(key, F.when(F.col("g_") == 1, "TOTAL").otherwise(F.col(key))).drop("g_")


def histogram(df: DataFrame, value: str, edges: list[float], *keys: str) -> DataFrame:
    """Counts in half-open bins [low, high), with percentages of all rows; the top edge itself is in none, and counted as overflow."""
    v, n = F.col(value), F.count(value)
    bins = [F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.count_if((v >= a) & (v < b)).alias("n")) for a, b in zip(edges, edges[1:])]
    one = df.groupBy(*keys).agg(F.array(*bins).alias("b"), n.alias("total"), F.count_if(v >= edges[-1]).alias("overflow"))
    return one.select(*keys, "total", "overflow", F.explode("b").alias("x")).select(*keys, F.col("x.low").alias("low"), F.col("x.high").alias("high"), F.col("x.n").alias("n"), F.round(100 * F.col("x.n") / F.col("total"), 6).alias("percent"), "overflow")


def bands(df: DataFrame, value: str, *keys: str, high: float = 0.5, low: float = 0.3) -> DataFrame:
    """Rows above high, from low to high, and below low."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count_if(v > high).alias("n_high"), F.count_if((v >= low) & (v <= high)).alias("n_medium"), F.count_if(v < low).alias("n_low"))


def use_of(score: Column) -> Column:
    """What a concept overlap is good for."""
    return F.when(score < 0.5, "drop").when(score <= 0.7, "augment").otherwise("high")


def column_profile(df: DataFrame, numeric: list[str], other: list[str] = []) -> DataFrame:
    """column, n, min, max, mean, std, n_distinct: a row for each column, from one pass; numeric columns have statistics, others the number of distinct values."""
    one = df.agg(
        *[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.lit(None).cast("long").alias("n_distinct")).alias(c) for c in numeric],
        *[F.struct(F.count(c).alias("n"), *[F.lit(None).cast("double").alias(x) for x in ("min", "max", "mean", "std")], F.count_distinct(c).alias("n_distinct")).alias(c) for c in other],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in [*numeric, *other]])
    return one.select(F.explode(rows).alias("r")).select("r.column", "r.s.*")


def _provenance(text: str, synthetic: str, real: str) -> Column:
    return F.when(F.col(text).rlike(synthetic), "synthetic").when(F.col(text).rlike(real), "real").otherwise("unknown")


def provenance_examples(df: DataFrame, key: str, text: str, name: str, synthetic: str, real: str, n: int = 2) -> DataFrame:
    """For each key and kind (synthetic, real, unknown): the n least names, in order. Only those leave a task."""
    own = df.select(key, _provenance(text, synthetic, real).alias("kind"), name)
    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy(name))
    return own.withColumn("nth_", nth).where(F.col("nth_") <= n).groupBy(key, "kind").agg(F.array_sort(F.collect_list(name)).alias("examples"))


def distributions(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, metric, n and the statistics with percentiles of each of the named columns, in one pass."""
    own = df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([key], names, "metric", "v_")
    return own.groupBy(key, "metric").agg(F.count("*").alias("n"), *stats(F.col("v_"), percentiles=True))


def placed(groups: DataFrame, by: str, key: str) -> DataFrame:
    """groups (a few rows, one a group) with place: 1 for the greatest by; ties by key."""
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc(), key)).cast("long"))


def provenance(df: DataFrame, key: str, text: str, synthetic: str, real: str) -> DataFrame:
    """For each key: rows that look synthetic, real or neither (regular expressions, the first wins), and the truncated percentage of synthetic ones."""
    kind = _provenance(text, synthetic, real)
    n = df.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(kind == k).alias(name) for k, name in ((x, x) for x in ("synthetic", "real", "unknown"))])
    return n.withColumn("percent_synthetic", F.floor(100 * F.col("synthetic") / F.col("total")).cast("long"))
