"""The retrieval pipeline as one chain: neighbours, triplets, gate, split, evaluation, report. Steps can be left out; results are written between steps.

    python -m retrievium.plans.pipeline --vectors DIR --documents DIR --out DIR [--steps mine,split,evaluate,report]
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluate, retrieve, splits, triplets

STEPS = ("neighbours", "mine", "loss", "split", "evaluate", "report")


@dataclasses.dataclass(frozen=True)
class Config:
    """Thresholds and sizes of a run; steps are done in the order of STEPS."""

    top: int = 20
    negatives: int = 3
    k: int = 10
    metric: str = "l2"
    train: float = 0.7
    val: float = 0.15
    seed: int = 42
    margin: float = 0.5
    group_by_query: bool = True
    steps: tuple[str, ...] = STEPS

    @classmethod
    def from_json(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


def run(spark: SparkSession, vectors: DataFrame, qrels: DataFrame, out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """vectors (doc_id, vector), qrels (query_id, doc_id) to tables in out; each vector is a query against the others."""
    done: dict[str, DataFrame] = {}

    def keep(step: str, make) -> None:
        if step in config.steps:
            make().write.mode("overwrite").parquet(f"{out}/{step}")
            done[step] = spark.read.parquet(f"{out}/{step}")

    def neighbours() -> DataFrame:
        return retrieve.nearest(vectors.withColumnRenamed("doc_id", "query_id"), vectors, config.top, config.metric, other=True)

    def loss() -> DataFrame:
        t = done["mine"]
        for i, v in (("query_id", "a"), ("positive_doc_id", "p"), ("negative_doc_id", "n")):
            t = t.join(vectors.select(F.col("doc_id").alias(i), F.col("vector").alias(v)), i)
        return t.select("query_id", "negative_doc_id", V.margin_loss(F.col("a"), F.col("p"), F.col("n"), config.margin).alias("loss"))

    def split() -> DataFrame:
        options = {"train": config.train, "val": config.val, "seed": config.seed}
        if config.group_by_query:
            return splits.split_grouped(done["mine"], "query_id", **options)
        own = done["mine"].withColumn("id_", F.concat_ws(":", "query_id", "negative_doc_id"))
        return splits.split_rows(own, "id_", **options).drop("id_")

    keep("neighbours", neighbours)
    if "neighbours" not in done:
        done["neighbours"] = spark.read.parquet(f"{out}/neighbours")
    keep("mine", lambda: triplets.mine(done["neighbours"], config.negatives))
    if "mine" not in done and {"loss", "split"} & set(config.steps):
        done["mine"] = spark.read.parquet(f"{out}/mine")
    keep("loss", loss)
    keep("split", split)
    n = qrels.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_relevant"))
    keep("evaluate", lambda: evaluate.per_query_truncated(evaluate.mark_relevant(done["neighbours"].where(F.col("rank") <= config.k), qrels), n, config.k))
    if "report" in config.steps and "evaluate" not in done:
        done["evaluate"] = spark.read.parquet(f"{out}/evaluate")
    keep("report", lambda: evaluate.report(done["evaluate"]))
    return done


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("vectors", "qrels", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    p.add_argument("--steps")
    a = p.parse_args(args)
    config = Config.from_json(a.config) if a.config else Config()
    if a.steps:
        config = dataclasses.replace(config, steps=tuple(a.steps.split(",")))
    spark = SparkSession.builder.getOrCreate()
    done = run(spark, spark.read.parquet(a.vectors), spark.read.parquet(a.qrels), a.out, config)
    if "report" in done:
        done["report"].orderBy("metric").show(truncate=False)


if __name__ == "__main__":
    main()
