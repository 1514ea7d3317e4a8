"""Connected components by alternating large-star and small-star steps; labels are the least node of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b). Each round is a join-free pair of grouped steps, with its lineage cut."""
    now = C.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = None
    while True:
        w = Window.partitionBy("a")
        # large star: each neighbour greater than a goes to the least of a and its neighbours
        large = both(now).withColumn("m", F.least(F.min("b").over(w), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its lesser neighbours go to the least of them
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = C.cut(small)
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if last == (sign["n"], sign["x"]):
            break
        last = (sign["n"], sign["x"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
