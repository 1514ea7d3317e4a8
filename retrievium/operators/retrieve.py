"""Retrieval: exact nearest neighbours, BM25 and lexical overlap.

Nearest neighbours: a query side of at most `broadcast_rows` rows goes to the executors as one matrix, and each partition of the corpus keeps
its k best for each query, so the corpus is never shuffled and k rows a query and partition are. A larger query side is cut in blocks; a task holds
one of them and lets the corpus pass by, so what it holds doesn't grow with the corpus and k rows a query come out. Every pair is compared, in
single precision first: only those that its error bound can't rule out are computed in double. BM25 and lexical overlap join on tokens, never on pairs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import ship

BROADCAST_QUERIES = 20_000
BROADCAST_TOKENS = 200_000  # some 50 bytes each
ROW_BLOCK, QUERY_BLOCK = 1_024, 65_536
QUERY_TASKS, LEAST_QUERIES = 24, 1_024  # so many tasks if each has so many queries
POSTINGS_BLOCK, BM25_QUERIES, BM25_GROUPS = 4_000_000, 16_384, 4
HITS = "query_id long, doc_id long, score double, rank long"
HALF_UNIT = 5e-7  # of scores, which have 6 digits


def _matrix(x: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; a null in them is NaN."""
    if not len(x):
        return np.zeros((0, 0))
    size = pc.min_max(pc.list_value_length(x)).as_py()
    if size["min"] != size["max"]:
        raise ValueError("vectors of different dimensions")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), size["max"])


class _Best:
    """The k best rows for each query of those that were added, by (score, id); least score first for l2, else greatest. With other, a query's own id is left out.

    Products are taken in single precision. What exceeds a query's k-th score by more than the error of such a product and the rounding of scores
    isn't among its k best; the rest is computed in double. Where that would be much (vectors far from 0, or many ties), the whole block is.
    """

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, metric: str, other: bool, row_block: int):
        self.k, self.metric, self.other, self.row_block = k, metric, other, row_block
        self.sign, self.center = 1.0 if metric == "l2" else -1.0, 0.0
        self.qid, self.q, self.q2 = self._usable(qid, q)
        if metric == "l2" and len(self.q):  # distances stay the same, and their products small
            self.center = self.q.mean(0)
        self.qid, self.q, self.q2 = self._usable(qid, q)
        self.wide = self._wide(self.q, -2.0 if metric == "l2" else -1.0)
        with np.errstate(over="ignore"):
            self.narrow = self.wide.astype(np.float32)
        self.longest = np.sqrt(self.q2.max(initial=0.0))
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the best so far, by row of q
        self.kth, self.kth_id = np.full(len(self.qid), np.inf), np.full(len(self.qid), np.iinfo(np.int64).max)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _usable(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors in double, of length 1 for cosine, and their squared norms, of those that have a finite one."""
        with np.errstate(all="ignore"):
            x = x.astype(np.float64) - self.center
            n = np.einsum("ij,ij->i", x, x)
            if self.metric == "cosine":
                x = np.where(n[:, None] > 0, x / np.where(n > 0, np.sqrt(n), 1)[:, None], 0 * x)
                n = np.where(np.isfinite(n), np.minimum(n, 1.0), n)
        ok = np.isfinite(n)
        return ids[ok], x[ok], n[ok]

    def _wide(self, x: np.ndarray, by: float) -> np.ndarray:
        return np.concatenate([x * by, np.ones((len(x), 1))], 1) if self.metric == "l2" else x * by

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        ids, x, x2 = self._usable(ids, x)
        for a in range(0, len(ids), self.row_block):
            part = slice(a, a + self.row_block)
            self._add(ids[part], x[part], x2[part])

    def _add(self, ids: np.ndarray, x: np.ndarray, x2: np.ndarray) -> None:
        k, l2 = self.k, self.metric == "l2"
        wide = np.ascontiguousarray((np.concatenate([x, x2[:, None]], 1) if l2 else x).T)
        with np.errstate(over="ignore"):
            narrow = wide.astype(np.float32)
        longest = np.sqrt(x2.max())
        fits = max(self.longest, longest) < 1e18  # else products may be too large for single precision
        order = np.argsort(ids, kind="stable")
        for a in range(0, len(self.qid), 1024):
            part = slice(a, a + 1024)
            size = 2 * np.sqrt(self.q2[part]) * longest + (longest**2 if l2 else 0.0)
            zero = self.q2[part] if l2 else 0.0  # what the products lack of the score
            with np.errstate(all="ignore"):
                error = (len(wide) + 8) * 2.0**-24 * size + 2 * HALF_UNIT
                s = self.narrow[part] @ narrow
                bar = self.kth[part] - zero + error
                if len(ids) > k and not np.isfinite(bar).all():  # the k-th of this block alone is a bar too
                    own = np.where(np.isnan(s), np.float32(np.inf), s)
                    if self.other:
                        self._blank(own, part, ids, order)
                    bar = np.fmin(bar, np.partition(own, k - 1, axis=1)[:, k - 1] + 2 * error)
                bar = np.where(np.isnan(bar), np.inf, bar)
                hit = s <= np.nextafter(bar.astype(np.float32), np.float32(np.inf))[:, None]
                found = np.flatnonzero(hit)
                if len(found) > 2 * k * len(s) and len(found) > s.size // 16 or not fits:
                    self._add_wide(part, ids, wide, order)
                    continue
                i, j = np.divmod(found, s.shape[1])
                for b in range(0, len(i), 65_536):
                    self._take(a + i[b : b + 65_536], ids[j[b : b + 65_536]], self._scores(a + i[b : b + 65_536], x, j[b : b + 65_536]))
        if sum(len(n[0]) for n in self.new) > 2 * k * len(self.qid) or not np.isfinite(self.kth).all():
            self._settle()

    def _blank(self, s: np.ndarray, part: slice, ids: np.ndarray, order: np.ndarray) -> None:
        """Infinity where a row has the query's id."""
        at, end = (np.searchsorted(ids[order], self.qid[part], side) for side in ("left", "right"))
        while len(r := np.flatnonzero(at < end)):
            s[r, order[at[r]]] = np.inf
            at = at + 1

    def _scores(self, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.q[i], x[j]
        if self.metric == "l2":
            a -= b
            return np.einsum("ij,ij->i", a, a)
        return -np.einsum("ij,ij->i", a, b)

    def _add_wide(self, part: slice, ids: np.ndarray, wide: np.ndarray, order: np.ndarray) -> None:
        """A block in double."""
        s = self.wide[part] @ wide
        if self.metric == "l2":
            s = np.maximum(s + self.q2[part][:, None], 0.0)
        s = np.round(s, 6) + 0.0
        s[np.isnan(s)] = np.inf
        if self.other:
            self._blank(s, part, ids, order)
        kth, kth_id = self.kth[part, None], self.kth_id[part, None]
        r, c = np.nonzero((s < kth) | (s == kth) & (ids < kth_id))
        if len(r) > 2 * self.k * len(s):  # the k best of the block are enough
            best = order[np.argsort(s[:, order], axis=1, kind="stable")[:, : self.k]]
            r, c = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
        self._take(part.start + r, ids[c], s[r, c])

    def _take(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keep what comes before the k-th so far."""
        score = np.round(score, 6) + 0.0
        ok = np.isfinite(score) & ((score < self.kth[i]) | (score == self.kth[i]) & (ids < self.kth_id[i]))
        if self.other:
            ok &= ids != self.qid[i]
        self.new.append((i[ok], ids[ok], score[ok]))

    def _settle(self) -> None:
        row, ids, score = (np.concatenate([old, *(n[c] for n in self.new)]) for c, old in enumerate((self.row, self.id, self.score)))
        self.new = []
        order = np.lexsort((ids, score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        last = place == self.k - 1
        self.kth[row[last]], self.kth_id[row[last]] = score[last], ids[last]
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]

    def result(self) -> pa.RecordBatch:
        self._settle()
        place = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        return pa.RecordBatch.from_arrays([pa.array(self.qid[self.row]), pa.array(self.id), pa.array(self.sign * self.score + 0.0), pa.array(place)], ["query_id", "doc_id", "score", "rank"])


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", broadcast_rows: int = BROADCAST_QUERIES, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, other: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest of corpus (doc_id, vector) to each of queries (query_id, vector); with other, of those that don't have its id.

    metric: l2 (squared, ascending), ip or cosine (descending). Scores are rounded to 6 digits, ties go to the least doc_id.
    Rows with null ids, empty vectors or values that aren't finite are left out; a dimension must be the same throughout.
    """
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    single = all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (queries, corpus))
    usable = lambda df, i: df.where(F.col(i).isNotNull() & (F.size("vector") > 0)).select(F.col(i).cast("long").alias(i), F.col("vector").cast("array<float>" if single else "array<double>").alias("vector"))
    queries, corpus = usable(queries, "query_id"), usable(corpus, "doc_id")
    ship(queries.sparkSession)
    n = queries.count()
    if n <= broadcast_rows:
        few = queries.toArrow().combine_chunks()
        qid, q = few["query_id"].to_numpy(), _matrix(few["vector"].combine_chunks())

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(qid):
                best = _Best(qid, q, k, metric, other, row_block)
                for p in parts:
                    if len(p):
                        best.add(p["doc_id"].to_numpy(), _matrix(p["vector"]))
                yield best.result()

        found = corpus.mapInArrow(scan, HITS).drop("rank")
        return ranked(found, k, F.col("score").asc() if metric == "l2" else F.col("score").desc(), "doc_id")
    blocks = max(-(-n // query_block), min(QUERY_TASKS, -(-n // LEAST_QUERIES)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = queries.select(block.alias("block"), F.lit(False).alias("row"), F.col("query_id").alias("id"), "vector")
    right = corpus.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("row"), F.col("doc_id").alias("id"), "vector")

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = [], None
        for p in parts:
            cut = pc.sum(pc.invert(p["row"])).as_py() or 0  # queries come first
            if cut:
                own.append(p.slice(0, cut))
            if cut < len(p) and own:
                if best is None:
                    best = _Best(np.concatenate([o["id"].to_numpy() for o in own]), np.concatenate([_matrix(o["vector"]) for o in own]), k, metric, other, row_block)
                rows = p.slice(cut)
                best.add(rows["id"].to_numpy(), _matrix(rows["vector"]))
        if best is not None:
            yield best.result()

    return left.unionByName(right).repartitionById(blocks, "block").sortWithinPartitions("row").select("row", "id", "vector").mapInArrow(meet, HITS)


def ranked(hits: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    """The first k rows of each group, with rank; the plan cuts each partition's groups to k before the shuffle."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return hits.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def postings(docs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """doc_id, token, tf, dl from docs (doc_id, body); of all tokens, or of those in tokens (token), which the others then never leave their task for."""
    # the length comes out of the generator with each token: a column beside it would be computed for each token anew
    each = T.let(T.ws_tokens("body"), lambda t: F.transform(t, lambda w: F.struct(w.alias("token"), F.size(t).cast("long").alias("dl"))))
    x = docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.token", "x.dl")
    if tokens is not None:
        few = tokens.select("token").distinct()
        x = x.join(F.broadcast(few) if few.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS else few, "token", "left_semi")
    return x.groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n_docs, avgdl; a document without tokens counts."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(T.n_words("body").cast("double")).alias("avgdl"))


def token_idf(docs: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """token, df, idf; a negative idf becomes epsilon times the mean idf of all tokens. Document frequencies are counted in each task before they move."""
    df = docs.select(F.explode(F.array_distinct(T.ws_tokens("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(stats.select("n_docs").scalar() - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("token", "df", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, doc_id, score over pairs that share a token; a token that a query repeats counts as often."""
    stats = corpus_stats(docs)
    asked = queries.select("query_id", F.explode(T.ws_tokens("query")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weighed = asked.join(token_idf(docs, stats, epsilon), "token")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / stats.select("avgdl").scalar()))
    return weighed.join(postings(docs, asked), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, exclude: str | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, postings_block: int = POSTINGS_BLOCK, query_block: int = BM25_QUERIES, groups: int = BM25_GROUPS) -> DataFrame:
    """query_id, doc_id, score, rank: top_with_fill(bm25_scores(...)) for many queries, without a row for each pair that shares a token.

    Documents are packed in inverted blocks of about postings_block tokens, queries in blocks of query_block at most; each block of queries meets each of documents once.
    A task has a block of queries and one of the groups of document blocks, one block at a time, and keeps the k best of each query, so the largest thing that
    is written is the packed documents, once. Tokens are told apart by 64 bits. The time is still that of all pairs: the postings of each token times its queries.
    """
    stats = corpus_stats(docs)
    avgdl = stats.first()["avgdl"] or 1.0
    hashes = F.transform(T.ws_tokens("body"), lambda t: F.xxhash64(t))

    def invert(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for p in parts:
            at = 0
            n = pc.list_value_length(p["tokens"]).to_numpy(zero_copy_only=False)
            while at < len(p):
                end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), postings_block - size, "right")))
                own.append(p.slice(at, end - at))
                size += int(n[at:end].sum())
                at = end
                if size >= postings_block or at < len(p):
                    yield inverted(own)
                    own, size = [], 0
        if own:
            yield inverted(own)

    def inverted(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([p["doc_id"].to_numpy() for p in own])
        dl = np.concatenate([pc.list_value_length(p["tokens"]).to_numpy(zero_copy_only=False) for p in own]).astype(np.int64)
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        tokens, which = np.unique(np.concatenate([p["tokens"].flatten().to_numpy() for p in own]), return_inverse=True)
        pair, tf = np.unique(which * len(ids) + np.repeat(place, dl), return_counts=True)
        start = np.searchsorted(pair, np.arange(len(tokens) + 1) * len(ids))
        dl[place] = dl.copy()
        cols = {"ids": np.sort(ids), "dl": dl, "tokens": tokens, "start": start, "doc": (pair % len(ids)).astype(np.int32), "tf": tf.astype(np.int32)}
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in cols.values()], list(cols))

    blocks = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), hashes.alias("tokens")).mapInArrow(invert, "ids binary, dl binary, tokens binary, start binary, doc binary, tf binary")
    blocks = blocks.repartitionById(groups, F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))

    asked = queries.select("query_id", F.explode(T.ws_tokens("query")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weighed = asked.join(token_idf(docs, stats, epsilon), "token").groupBy("query_id").agg(F.collect_list(F.struct(F.xxhash64("token").alias("t"), (F.col("times") * F.col("idf")).alias("w"))).alias("x"))
    n_blocks = max(-(-queries.count() // query_block), 8)
    each = queries.select(F.col("query_id").cast("long").alias("query_id"), (F.col(exclude) if exclude else F.lit(None)).cast("long").alias("excluded")).join(weighed, "query_id", "left")
    rows = F.collect_list(F.struct("query_id", "excluded", F.coalesce(F.col("x.t"), F.array().cast("array<bigint>")).alias("t"), F.coalesce(F.col("x.w"), F.array().cast("array<double>")).alias("w")))
    asking = each.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block")).agg(rows.alias("q")).repartitionById(n_blocks, "block")

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _BestTexts] = {}
        for p in parts:
            for i, block in enumerate(p["block"].to_pylist()):
                if block not in best:
                    best[block] = _BestTexts(p["q"].slice(i, 1).flatten(), k)
                ids, dl, tokens, start, doc, tf = (np.frombuffer(p[c][i].as_buffer(), t) for c, t in (("ids", np.int64), ("dl", np.int64), ("tokens", np.int64), ("start", np.int64), ("doc", np.int32), ("tf", np.int32)))
                best[block].add(ids, tokens, start, doc, tf * (k1 + 1) / (tf + (k1 * (1 - b + b * dl / avgdl))[doc]))
        for x in best.values():
            yield x.result()

    ship(docs.sparkSession)
    found = blocks.hint("shuffle_replicate_nl").crossJoin(asking.hint("shuffle_replicate_nl")).mapInArrow(meet, "query_id long, doc_id long, score double")
    return ranked(found, k, F.col("score").desc(), "doc_id")


class _BestTexts:
    """The k best documents by (score, id) for each query of a block, over inverted blocks of documents that are added one by one; a score may be 0 or less."""

    def __init__(self, q: pa.StructArray, k: int):
        self.k = k
        self.qid, self.excluded = q.field("query_id").to_pylist(), q.field("excluded").to_pylist()
        t, w = q.field("t"), q.field("w")
        self.size = np.concatenate([[0], np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.token, self.weight = t.flatten().to_numpy(), w.flatten().to_numpy()
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(self.qid)

    def add(self, ids: np.ndarray, tokens: np.ndarray, start: np.ndarray, doc: np.ndarray, part: np.ndarray) -> None:
        """ids ascending; the documents and their parts of the score for tokens[i] are doc[start[i]:start[i + 1]] and part[...]."""
        n, k = len(ids), self.k
        if not n:
            return
        at = np.minimum(np.searchsorted(tokens, self.token), max(len(tokens) - 1, 0))
        there = tokens[at] == self.token if len(tokens) else np.zeros(len(at), bool)
        wide: dict[int, np.ndarray] = {}  # a frequent token as a row over all documents
        for i in np.argsort(start[:-1] - start[1:], kind="stable")[: max(1, 4_000_000 // n)] if len(tokens) else ():
            if (start[i + 1] - start[i]) * 8 < n:
                break
            wide[int(i)] = np.bincount(doc[start[i] : start[i + 1]], part[start[i] : start[i + 1]], n)
        most = {i: x.max() for i, x in wide.items()}
        padded, one = np.full(-(-n // 64) * 64, -np.inf), np.empty(n)
        for r, (qid, excluded) in enumerate(zip(self.qid, self.excluded)):
            own = slice(self.size[r], self.size[r + 1])
            ok = there[own]
            ix, wx = at[own][ok].tolist(), self.weight[own][ok].tolist()
            s = padded[:n]
            few = [(i, w) for i, w in zip(ix, wx) if i not in wide]
            if few:  # the rest is added below
                a, e = start[[i for i, _ in few]].tolist(), start[[i + 1 for i, _ in few]].tolist()
                s[:] = np.bincount(np.concatenate([doc[x:y] for x, y in zip(a, e)]), np.concatenate([part[x:y] * w for x, y, (_, w) in zip(a, e, few)]), n)
            else:
                s[:] = 0.0
            if excluded is not None and (x := int(np.searchsorted(ids, excluded))) < n and ids[x] == excluded:
                s[x : int(np.searchsorted(ids, excluded, "right"))] = -np.inf
            rest = [(i, w) for i, w in zip(ix, wx) if i in wide]
            had_id, had = self.found[r]
            bar = had[-1] - 1e-6 if len(had) == k else -np.inf
            j = np.flatnonzero(s >= bar - sum(max(0.0, w * most[i]) for i, w in rest) - 1e-6)  # what frequent tokens can still lift to the k-th so far
            if len(j) * 4 < n:
                v = s[j]
                for i, w in rest:
                    v += wide[i][j] * w
                j, v = j[v >= bar], v[v >= bar]
            else:
                for i, w in rest:
                    np.multiply(wide[i], w, out=one)
                    s += one
                tops = padded.reshape(-1, 64).max(1)
                if len(tops) > k:  # so many documents have at least the k-th of the maxima
                    bar = max(bar, np.partition(tops, len(tops) - k)[len(tops) - k] - 1e-6)
                j = np.flatnonzero(s >= bar)
                v = s[j]
            j, v = j[np.isfinite(v)], v[np.isfinite(v)]
            score, i = np.concatenate([had, np.round(v, 6) + 0.0]), np.concatenate([had_id, ids[j]])
            order = np.lexsort((i, -score))[:k]
            self.found[r] = i[order], score[order]

    def result(self) -> pa.RecordBatch:
        n = [len(i) for i, _ in self.found]
        cols = [np.repeat(np.array(self.qid, np.int64), n), *(np.concatenate([f[c] for f in self.found] or [np.zeros(0)]) for c in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])


def overlap_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, score: Jaccard of distinct tokens, over pairs that share one."""
    sets = lambda df, i, c: df.select(i, F.array_distinct(T.ws_tokens(c)).alias("t")).select(i, F.size("t").alias(f"n_{i}"), F.explode("t").alias("token"))
    both = sets(queries, "query_id", "query").join(sets(docs, "doc_id", "body"), "token")
    common = both.groupBy("query_id", "doc_id", "n_query_id", "n_doc_id").agg(F.count("*").alias("n"))
    return common.select("query_id", "doc_id", F.round(F.col("n") / (F.col("n_query_id") + F.col("n_doc_id") - F.col("n")), 6).alias("score"))


def top_with_fill(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int, exclude: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best; documents that share no token fill the list at score 0, least doc_id first.

    exclude names a column of queries with a doc_id that is left out of its list. The fill takes the first documents in order, as many as could be needed:
    k, one for the excluded, and one for each document scored below 0 or above it among them.
    """
    q = queries.select("query_id", *([F.col(exclude).alias("excluded")] if exclude else [F.lit(None).cast("long").alias("excluded")]))
    own = scores.join(q, "query_id").where("excluded is null or doc_id <> excluded")
    best = ranked(own.select("query_id", "doc_id", "score"), k, F.col("score").desc(), "doc_id").select("query_id", "doc_id", "score")
    short = q.join(best.where("score > 0").groupBy("query_id").count(), "query_id", "left").where(f"coalesce(count, 0) < {k}").select("query_id", "excluded")
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k + 1)
    # a query with fewer than k scored documents has at most k - 1 of them among the first 2 k + 1
    fill = short.crossJoin(F.broadcast(first)).where("excluded is null or doc_id <> excluded").join(own.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))
    return ranked(best.unionByName(fill), k, F.col("score").desc(), "doc_id")
