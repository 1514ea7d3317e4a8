"""Ranking metrics over an array of relevances (1 or 0) in rank order, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(rels: Column, k: int) -> Column:
    return F.slice(rels, 1, k)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dcg(rels: Column, k: int) -> Column:
    return _sum(F.transform(_top(rels, k), lambda r, i: F.when(r > 0, 1.0 / F.log2(i + 2.0)).otherwise(0.0)))


def ideal_dcg(n: Column) -> Column:
    """Of n relevant documents."""
    return F.when(n > 0, _sum(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)))).otherwise(0.0)


def ndcg_fixed_k(rels: Column, k: int) -> Column:
    """Against an ideal list of k ones, however few are relevant."""
    return dcg(rels, k) / sum(1 / math.log2(i + 1) for i in range(1, k + 1))


def ndcg_truncated(rels: Column, n_relevant: Column, k: int) -> Column:
    """Against an ideal list of the relevant ones, k at most."""
    ideal = ideal_dcg(F.least(n_relevant.cast("int"), F.lit(k)))
    return F.when(ideal > 0, dcg(rels, k) / ideal).otherwise(0.0)


def reciprocal_rank(rels: Column, k: int | None = None) -> Column:
    at = F.array_position(rels if k is None else _top(rels, k), 1)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def hits(rels: Column, k: int) -> Column:
    return F.size(F.filter(_top(rels, k), lambda r: r > 0))


def precision(rels: Column, k: int) -> Column:
    """Over k, also where fewer were retrieved."""
    return hits(rels, k) / k


def recall(rels: Column, n_relevant: Column, k: int) -> Column:
    return F.when(n_relevant > 0, hits(rels, k) / n_relevant).otherwise(0.0)


def _precision_sum(rels: Column, k: int) -> Column:
    top = _top(rels, k)
    return _sum(F.transform(top, lambda r, i: F.when(r > 0, F.size(F.filter(F.slice(top, F.lit(1), i + 1), lambda x: x > 0)) / (i + 1)).otherwise(0.0)))


def ap_over_found(rels: Column, k: int) -> Column:
    return _precision_sum(rels, k) / F.greatest(F.lit(1), hits(rels, k))


def ap_over_relevant(rels: Column, n_relevant: Column, k: int) -> Column:
    return F.when(n_relevant > 0, _precision_sum(rels, k) / n_relevant).otherwise(0.0)
