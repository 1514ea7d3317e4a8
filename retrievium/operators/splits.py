"""Reproducible splits. Ranks over a whole table are taken in parallel: counts of hash ranges first, then ranks inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..functions import text as T

BUCKETS = 4096


def _bounds(df: DataFrame, key: str, parts: int, each: int = 64) -> list:
    """At most parts - 1 values of key that cut it in about equal ranges, from a sample of about parts * each keys."""
    keys = df.select(F.col(key).alias("k"))
    n = keys.count()
    if parts < 2 or not n:
        return []
    few = keys if n <= parts * each else keys.sample(parts * each / n, seed=1)
    own = [r["k"] for r in few.repartition(1).sortWithinPartitions("k").collect()]  # coalesce(1) would have one task read the whole table
    return [own[len(own) * i // parts] for i in range(1, parts)] if len(own) >= parts else own


def _literal(v: object) -> Column:
    return F.struct(*[_literal(x).alias(n) for n, x in zip(v.__fields__, v)]) if isinstance(v, Row) else F.lit(v)


def range_of(key: Column, bounds: list, kind: DataType) -> Column:
    """How many of the ascending bounds are at most key, by binary search."""
    if not bounds:
        return F.lit(0)
    all_ = F.array(*map(_literal, bounds)).cast(ArrayType(kind))  # folded to one literal

    def own(x: Column) -> Column:
        turns = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = (s["lo"] < s["hi"]) & (F.get(x["b"], mid) <= x["k"])
            return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]

    return T.let(F.struct(key.alias("k"), all_.alias("b")), own)


def dense_positions(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """df with 0, 1, 2, ... in the order of key (unique, not null), without a single-partition window.

    The ranges' bounds are taken from a sample once, here, so that counts and ranks are of the same ranges however often Spark
    plans or repeats a scan. Counts, one row a range, become offsets; then one shuffle brings each range together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType
    own = df.withColumn("part_", range_of(F.col(key), _bounds(df, key, parts), kind))
    return _with_offsets(own, "part_", [key], name).drop("part_")


def _with_offsets(own: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """own with positions in the order of (part, *order). Parts are few: their counts become one literal map."""
    counts = own.groupBy(part).agg(F.count("*").alias("n_")).select(F.col(part).cast("long").alias("p_"), "n_")
    before = F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    offsets = counts.select("p_", F.coalesce(before, F.lit(0)).alias("off_")).agg(F.map_from_entries(F.collect_list(F.struct("p_", "off_"))).alias("m"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return own.withColumn(name, (F.element_at(offsets.scalar(), F.col(part).cast("long")) + local - 1).cast("long"))


def shuffled_positions(df: DataFrame, id_col: str, seed: int, name: str = "pos") -> DataFrame:
    """df with a position in the order of (md5 of seed and id, id); rows are ranked in BUCKETS buckets of the hash, whose counts become offsets."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    own = df.withColumn("h_", h).withColumn("b_", F.conv(F.substring("h_", 1, 3), 16, 10).cast("int"))
    return _with_offsets(own, "b_", ["h_", id_col], name).drop("h_", "b_")


def _total(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("total_")).scalar()


def _label(pos: Column, total: Column, train: float, val: float, cumulative: bool) -> Column:
    a = F.floor(total * train)
    b = F.floor(total * (train + val)) if cumulative else a + F.floor(total * val)
    return F.when(pos < a, "train").when(pos < b, "val").otherwise("test")


def split_rows(df: DataFrame, id_col: str, train: float = 0.7, val: float = 0.15, seed: int = 42, cumulative: bool = False) -> DataFrame:
    """df with split: a seeded order cut at train, then val; the rest is test. cumulative: the second cut is floor(n * (train + val))."""
    own = shuffled_positions(df, id_col, seed, "pos_")
    return own.withColumn("split", _label(F.col("pos_"), _total(df), train, val, cumulative)).drop("pos_")


def split_grouped(df: DataFrame, key: str, **options) -> DataFrame:
    """df with split, all rows of a key in the same one."""
    return df.join(split_rows(df.select(key).distinct(), key, **options), key)


def split_sorted(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """df with split, cut over its sorted distinct keys at floor(n * train) and floor(n * (train + val))."""
    keys = df.select(key).distinct()
    own = dense_positions(keys, key, "pos_")
    return df.join(own.select(key, _label(F.col("pos_"), _total(keys), train, val, True).alias("split")), key)


def split_stats(split: DataFrame) -> DataFrame:
    """split, n, ratio; no row for an empty table."""
    n = split.groupBy("split").agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # three rows


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with batch: size rows each, in the order of key."""
    return dense_positions(df, key, "pos_").withColumn("batch", F.floor(F.col("pos_") / size).cast("long")).drop("pos_")


def first_per_group(df: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("nth", r.cast("long")).where(F.col("nth") <= n)


def template_at(templates: list[str], index: Column) -> Column:
    """The template at index, modulo their number."""
    return F.element_at(T.literals(templates), (F.pmod(index, F.lit(len(templates))) + 1).cast("int"))
