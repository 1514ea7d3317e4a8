"""Exact top-k by inner product over a bit-sliced index.

Each attribute of a block of rows is quantised to BITS bits and kept as bit slices: bitmaps over the block's rows. A
query's weights are quantised to WEIGHT_BITS bits and a sign. The quantised scores of all rows come from adding weighted slices with
bitmap arithmetic (carry-save adders on 64-bit words; a negative weight adds the complement). Going from the most
significant slice of the sum downward finds the k-th best sum. Rows whose exact score can't reach the k-th best, by the
Cauchy-Schwarz bound on both quantisation errors, are left out; the others are resolved with float64 products.

Queries are rows of the table, those whose id QUERY_STEP divides in op6, each against all rows but itself. Scores are rounded to 6 digits; ties
go to the least id. Each block of rows is indexed once, and its index kept as a row of a table in the shared folder; blocks of
queries meet the indexes in tasks of a fixed size, and the best of each are merged. The work is queries x rows.

Cases: rows with a null id, a null or empty vector, or a null, NaN or infinite element are left out; vectors are compared with those of
the same dimension only; of rows that repeat an id, the one of least vector counts; fewer than k rows give fewer hits; an empty table gives
none. Only the id and the vector are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

K, BITS, WEIGHT_BITS = 10, 6, 6
ROW_BLOCK, QUERY_BLOCK, QUERY_STEP = 16384, 1024, 50
OUT = "id long, hit long, score double"


class BitSlicedIndex:
    def __init__(self, x: np.ndarray, bits: int = BITS) -> None:
        self.x = x.astype(np.float64)
        n, self.dim = x.shape
        self.n, self.bits = n, bits
        self.low = float(self.x.min())
        self.step = max((float(self.x.max()) - self.low) / (1 << bits), 1e-300)
        q = np.minimum(((self.x - self.low) / self.step).astype(np.int64), (1 << bits) - 1)
        near = self.low + (q + 0.5) * self.step
        self.error = float(np.sqrt(((self.x - near) ** 2).sum(1)).max())
        self.size = float(np.sqrt((near**2).sum(1)).max())
        self.words = (n + 63) // 64
        grid = np.zeros((self.dim, bits, self.words * 64), np.uint8)
        for j in range(bits):
            grid[:, j, :n] = (q.T >> j) & 1
        packed = np.packbits(grid, axis=2, bitorder="little").view("<u8")
        self.slices = np.concatenate([packed, ~packed])  # (2 dim, bits, words): the second half for negative weights
        self.valid = np.zeros(self.words * 64, np.uint8)
        self.valid[:n] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view("<u8")

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over attributes of |weight| times the value or its complement."""
        at = np.where(weights < 0, np.arange(self.dim) + self.dim, np.arange(self.dim))
        size = np.abs(weights)
        columns: list[list[np.ndarray]] = []
        for i in range(int(size.max(initial=0)).bit_length()):
            own = self.slices[at[(size >> i) & 1 == 1]]
            for j in range(self.bits):
                while len(columns) <= i + j:
                    columns.append([])
                if len(own):
                    columns[i + j].append(own[:, j])
        out, p = [], 0
        while p < len(columns):
            own = np.concatenate(columns[p]) if columns[p] else np.zeros((0, self.words), np.uint64)
            carries = []
            while len(own) > 2:
                m = len(own) // 3
                a, b, c = own[:m], own[m : 2 * m], own[2 * m : 3 * m]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                own = np.concatenate([ab ^ c, own[3 * m :]])
            if len(own) == 2:
                carries.append(own[:1] & own[1:])
                own = own[:1] ^ own[1:]
            if carries:
                if p + 1 == len(columns):
                    columns.append([])
                columns[p + 1] += carries
            out.append(own[0] if len(own) else np.zeros(self.words, np.uint64))
            p += 1
        return out

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice downward."""
        sure, tied, value = np.zeros(self.words, np.uint64), self.valid, 0
        for p in range(len(sums) - 1, -1, -1):
            with_bit = tied & sums[p]
            if int(np.bitwise_count(sure | with_bit).sum()) >= k:
                tied, value = with_bit, value | 1 << p
            else:
                sure, tied = sure | with_bit, tied & ~sums[p]
        return value

    def at_least(self, sums: list[np.ndarray], value: int) -> np.ndarray:
        """Rows whose sum is at least value."""
        above, equal = np.zeros(self.words, np.uint64), self.valid
        for p in range(len(sums) - 1, -1, -1):
            if value >> p & 1:
                equal = equal & sums[p]
            else:
                above = above | (equal & sums[p])
                equal = equal & ~sums[p]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))

    def candidates(self, q: np.ndarray, k: int, weight_bits: int = WEIGHT_BITS) -> np.ndarray:
        """Rows that hold the k best by exact score, and all that tie with the last within rounding."""
        top = float(np.abs(q).max(initial=0))
        if self.n <= k or top == 0:
            return np.arange(self.n)
        unit = top / ((1 << weight_bits) - 1)
        w = np.rint(q / unit).astype(np.int64)
        sums = self.sums(w)
        off = float(np.linalg.norm(q)) * self.error + float(np.linalg.norm(q - w * unit)) * self.size
        band = int(np.ceil((2 * off + 4e-6) / (unit * self.step))) + 1
        value = self.kth(sums, k) - band
        return self.at_least(sums, value) if value > 0 else np.arange(self.n)

    def top(self, q: np.ndarray, own: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rounded scores of the k best rows other than own."""
        c = self.candidates(q, k + 1)
        score = np.round(self.x[c] @ q, 6) + 0.0
        i = ids[c]
        keep = i != own
        score, i = score[keep], i[keep]
        if len(score) > 8 * k:
            few = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, i = score[few], i[few]
        best = np.lexsort((i, -score))[:k]
        return i[best], score[best]


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, query_step: int = 1) -> DataFrame:
    """id, rank, hit, score: the k rows of largest inner product with each row whose id query_step divides."""
    spark = vectors.sparkSession
    C.ship(spark)
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = C.cut(own.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    asked = own.where(F.col("id") % query_step == 0)
    n_rows, n_queries = -(-own.count() // row_block) or 1, -(-asked.count() // query_block) or 1
    spread = lambda col, to: F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias(col)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps((BitSlicedIndex(np.stack(rows["v"].to_numpy())), rows["id"].to_numpy()), protocol=5)
        return pd.DataFrame({"dim": [key[0]], "rb": [key[1]], "blob": [blob]})

    rows = own.select("dim", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int").alias("rb"), "id", "v").repartition(n_rows, "dim", "rb")
    index = C.written(rows.groupBy("dim", "rb").applyInPandas(build, "dim int, rb int, blob binary")).select("dim", "rb", spread("qb", n_queries), "blob")
    queries = asked.select(F.col("dim").alias("dim_q"), spread("rb_q", n_rows), F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int").alias("qb_q"), F.col("id").alias("id_q"), F.col("v").alias("v_q"))

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"id": [], "hit": [], "score": []})
        bits, ids = pickle.loads(index["blob"].iloc[0])
        out = []
        for i, q in zip(queries["id_q"].tolist(), queries["v_q"]):
            hit, score = bits.top(np.asarray(q, np.float64), i, ids, k)
            out.append((np.full(len(hit), i), hit, score))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("id", "hit", "score"))})

    tasks = n_rows * n_queries
    left, right = index.repartition(tasks, "dim", "rb", "qb"), queries.repartition(tasks, "dim_q", "rb_q", "qb_q")
    hits = left.groupBy("dim", "rb", "qb").cogroup(right.groupBy("dim_q", "rb_q", "qb_q")).applyInPandas(run, OUT)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "hit"))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("id", "rank", "hit", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), query_step=QUERY_STEP)


SQL = f"""
WITH s AS (SELECT a.vec_id AS id, b.vec_id AS hit, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a, embeddings b WHERE a.vec_id % {QUERY_STEP} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hit) AS rank FROM s)
SELECT CAST(id AS BIGINT) AS id, CAST(rank AS BIGINT) AS rank, CAST(hit AS BIGINT) AS hit, score FROM r WHERE rank <= {K}
"""
