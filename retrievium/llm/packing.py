"""Best-fit packing by exact-complement hashing.

Only the histogram of lengths decides a packing, and it has at most `capacity` rows at any input size. The driver plans
on it: it looks up singles, then pairs, then triples whose lengths sum to exactly the gap a piece leaves, consumes as
many as the availability counts allow, and places what remains by best fit, longest first. The plan is a list of
patterns (lengths in a bin, number of such bins); pieces, ranked within their length, find their slot in it. A length that very many
pieces have is ranked in parallel: pieces of one length are spread over SALTS salts, whose counts
are the salts' first ranks.

Cases: a null or empty text has no token and isn't packed; a text longer than the capacity is cut into full pieces and a
rest; equal lengths are ranked by (salt, doc_id, text hash, piece), so repeated rows get slots of their own; a null doc_id stays
null; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY, SALTS = 2048, 256
OUT = "doc_id long, piece long, start_token long, n_tokens long, bin_id long, bin_offset long"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")), F.lit(0)).cast("long")


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, descending) and how many bins follow each. Every piece counted in hist is in exactly one."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in hist.items():
        left[n] += c
    done: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...]) -> bool:
        need: dict[int, int] = defaultdict(int)
        for x in items:
            need[x] += 1
        times = min(int(left[x]) // m for x, m in need.items())
        if times > 0:
            for x, m in need.items():
                left[x] -= m * times
            done.append((tuple(sorted(items, reverse=True)), times))
        return times > 0

    def pairs(a: tuple[int, ...], gap: int) -> None:
        """Consume pairs that sum to gap beside a, the most even split last."""
        low = np.arange(1, gap // 2 + 1)
        for b in low[(left[low] > 0) & (left[gap - low] > 0)].tolist():
            if left[a[0]] <= 0:
                return
            take((*a, b, gap - b))

    if left[capacity] > 0:
        take((capacity,))
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if left[a] > 0:
            take((a, gap))
        if left[a] > 0 and gap > 1:
            pairs((a,), gap)
        if left[a] > 0 and gap > 2:
            have = (left > 0).astype(np.float64)[: gap + 1]
            size = 1 << (2 * gap + 1).bit_length()
            sums = np.fft.irfft(np.fft.rfft(have, size) ** 2, size)[: gap + 1] > 0.5  # index of pair sums
            for b in range(gap - 2, 0, -1):
                if left[a] <= 0:
                    break
                if left[b] > 0 and sums[gap - b]:
                    pairs((a, b), gap - b)
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for a in range(capacity, 0, -1):
        count = int(left[a])
        while count:
            gap = min((g for g in open_bins if g >= a), default=None)
            if gap is None:
                each = capacity // a
                for m, bins in ((each, count // each), (count % each, 1)):
                    if m and bins:
                        open_bins[capacity - m * a].append(((a,) * m, bins))
                count = 0
                break
            items, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            used = min(bins, count)
            if used < bins:
                open_bins[gap].append((items, bins - used))
            open_bins[gap - a].append(((*items, a), used))
            count -= used
    for g in sorted(open_bins):
        done += open_bins[g]
    return done


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: ranks rank0.. of length n fill bins bin0.., `each` of them per bin from offset0 on."""
    rows, base = [], 0
    ranks: dict[int, int] = defaultdict(int)
    for items, times in patterns:
        at = 0
        for n in dict.fromkeys(items):
            m = items.count(n)
            rows.append((n, ranks[n], base, m, at))
            ranks[n] += m * times
            at += m * n
        base += times
    out = pd.DataFrame(rows, columns=["n", "rank0", "bin0", "each", "offset0"], dtype=np.int64)
    return out.sort_values(["n", "rank0"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start_token, n_tokens, bin_id, bin_offset. No bin holds more than capacity tokens."""
    spark = docs.sparkSession
    C.ship(spark)
    lens = C.cut(docs.select(C.id_key().alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), n_words(F.col("text").cast("string")).alias("n")).where("n > 0"))
    # the salt is that of the row's place in the checkpoint, which stays as it is, so that equal rows are spread as well
    lens = lens.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    pieces = lens.select("doc_id", "row", "salt", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece")).select(
        "doc_id", "row", F.pmod(F.col("salt") + F.col("piece"), F.lit(SALTS)).cast("int").alias("salt"), "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens")
    )
    each = {(r["n_tokens"], r["salt"]): r["count"] for r in pieces.groupBy("n_tokens", "salt").count().collect()}  # at most capacity x SALTS rows
    hist: dict[int, int] = defaultdict(int)
    before = np.zeros((capacity + 1, SALTS), np.int64)
    for (n, salt), count in sorted(each.items()):
        before[n, salt] = hist[n]
        hist[n] += count
    where = runs(plan(hist, capacity))
    key = (where["n"] * (1 << 48) + where["rank0"]).to_numpy()
    tab = {c: where[c].to_numpy() for c in where.columns}

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = p["n_tokens"].to_numpy()
            r = p["r"].to_numpy() + before[n, p["salt"].to_numpy()]
            i = np.searchsorted(key, n * (1 << 48) + r, "right") - 1
            r = r - tab["rank0"][i]
            p["bin_id"] = tab["bin0"][i] + r // tab["each"][i]
            p["bin_offset"] = tab["offset0"][i] + r % tab["each"][i] * n
            yield p[["doc_id", "piece", "start_token", "n_tokens", "bin_id", "bin_offset"]]

    ranked = pieces.withColumn("r", (F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "row", "piece")) - 1).cast("long"))
    return ranked.mapInPandas(place, OUT).withColumn("doc_id", C.id_back("doc_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
