"""The corpus pipeline: documents through training-data operators, each stage on all that its predecessor kept.

Each stage is written as Parquet to the folder that all executors share and read again, so that a lost executor costs no
more than the tasks it ran, and no later stage recomputes an earlier one. Stages before the last return the columns of
documents; the last returns one row for each packed piece. Cases are those of the operators: a null or empty text has no
letters, so the first stage rejects it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retrievium.llm import common, decontaminate, langid, lines, ordermin, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, trained on this stage's own input, doesn't reject."""
    return langid.keep_accepted(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line only where it first occurs; documents none of whose lines are left go, as there is nothing left of them."""
    return lines.keep_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ordermin.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a span of the benchmark."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in bins of the production capacity."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language ID is trained and near-dedup is a fixed point over alignments: neither has an SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
