"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training windows.

Up to BROADCAST_GRAMS grams and BROADCAST_BYTES bytes of words are broadcast, and texts are looked through where they are; a larger benchmark
is joined with the windows by hash in a shuffle. Hits are compared word by word either way.

Cases: a null or empty text has no window and is clean; rows that share a doc_id, or have none, are told apart by their texts; a benchmark item with fewer than n tokens gives no evidence and
is ignored; repeated documents are each reported; a null doc_id is reported as null; an empty benchmark or an empty
corpus gives no rows. Only doc_id and text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

N = 8
#: Grams that are broadcast at most (about 100 bytes each); a larger benchmark is joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
BROADCAST_BYTES = 1 << 27
SPANS = "doc_id long, row long, span_start long, span_end long, n_grams long"


def _grams(items: DataFrame, n: int) -> DataFrame:
    """Distinct n-grams of the items' tokens: gram (hash), words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for _, texts in C.groups(p["text"]):
                tok = C.tokenize(texts)
                low = [C.fold(C.code_points(t)) for t in texts]
                at = np.flatnonzero(C.inside(tok, n))
                h = C.gram_hashes(tok.hashes, n)[at].view(np.int64)
                if len(at):
                    yield pd.DataFrame({"gram": h, "words": pd.Series([_words(low[tok.doc[i]], tok, i, n) for i in at], dtype=object)})

    return items.select(F.col("text").cast("string")).mapInPandas(run, "gram long, words string").distinct()


def _words(low: np.ndarray, tok: C.Tokens, i: int, n: int) -> str:
    """The normalised text of the window at token i."""
    return " ".join(low[tok.start[j] : tok.end[j]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for j in range(i, i + n))


def _spans(doc: np.ndarray, pos: np.ndarray, n: int) -> pd.DataFrame:
    """Merge hits, sorted by doc and position, into spans of tokens. Spans that touch are one."""
    if not len(pos):
        return pd.DataFrame({"doc": doc, "span_start": pos, "span_end": pos, "n_grams": pos})
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + n)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos)) - 1
    return pd.DataFrame({"doc": doc[at], "span_start": pos[at], "span_end": pos[last] + n, "n_grams": last - at + 1})


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Token spans of docs that are made of benchmark n-grams: doc_id, span_start, span_end (exclusive), n_grams."""
    return _found(docs, benchmark, n, broadcast_grams).drop("row").withColumn("doc_id", C.id_back("doc_id"))


def _found(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The spans with row (text hash); doc_id as a key."""
    ids = docs.select(C.id_key().alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    shared, grams = _known(docs.sparkSession, benchmark, n, broadcast_grams)
    if shared is None:
        return _by_join(ids, grams, n)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _finder(shared.value, n)
        for p in parts:
            for at, texts in C.groups(p["text"]):
                tok, k = find(texts)
                if len(k):
                    out = _spans(tok.doc[k], k - tok.first[tok.doc[k]], n)
                    which = at + out.pop("doc").to_numpy()
                    out.insert(0, "doc_id", p["doc_id"].to_numpy()[which])
                    out.insert(1, "row", p["row"].to_numpy()[which])
                    yield out

    return ids.mapInPandas(run, SPANS)


def _known(spark: SparkSession, benchmark: DataFrame, n: int, broadcast_grams: int) -> tuple[Broadcast | None, DataFrame]:
    """The grams, gram (hash) to words, as a broadcast, or None where they are too many or too long for it; and their table."""
    C.ship(spark)
    grams = C.cut(_grams(benchmark, n))
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    if size["n"] > broadcast_grams or size["bytes"] > BROADCAST_BYTES:
        return None, grams
    known: dict[int, set[str]] = {}
    for r in grams.collect():
        known.setdefault(r["gram"], set()).add(r["words"])
    return spark.sparkContext.broadcast(known), grams


def _finder(grams: dict[int, set[str]], n: int) -> Callable[[list[str]], tuple[C.Tokens, np.ndarray]]:
    """A function from texts to their tokens and the first tokens of their windows that are benchmark grams."""
    sieve = np.zeros(1 << 22, bool)
    sieve[np.fromiter(grams, np.int64, len(grams)).view(np.uint64) >> np.uint64(42)] = True

    def find(texts: list[str]) -> tuple[C.Tokens, np.ndarray]:
        tok = C.tokenize(texts)
        h = C.gram_hashes(tok.hashes, n)
        hit = np.flatnonzero(sieve[h >> np.uint64(42)] & C.inside(tok, n))
        low: dict[int, np.ndarray] = {}
        keep = []
        for i, g in zip(hit.tolist(), h[hit].view(np.int64).tolist()):
            if (words := grams.get(g)) is not None:
                d = int(tok.doc[i])
                if d not in low:
                    low[d] = C.fold(C.code_points(texts[d]))
                if _words(low[d], tok, i, n) in words:
                    keep.append(i)
        return tok, np.array(keep, np.int64)

    return find


def _by_join(ids: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """The same for a benchmark too large to broadcast: the windows' hashes are shuffled, then the words are compared."""
    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at, texts in C.groups(p["text"]):
                tok = C.tokenize(texts)
                i = np.flatnonzero(C.inside(tok, n))
                d = tok.doc[i]
                yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[at + d], "row": p["row"].to_numpy()[at + d], "pos": i - tok.first[d], "gram": C.gram_hashes(tok.hashes, n)[i].view(np.int64)})

    hits = ids.mapInPandas(windows, "doc_id long, row long, pos long, gram long").join(grams, "gram")
    found = hits.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("pos", "words"))).alias("hits"))

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for d, row, text, hits in zip(p["doc_id"].tolist(), p["row"].tolist(), p["text"].tolist(), p["hits"].tolist()):
                tok, low = C.tokenize([text]), C.fold(C.code_points(text))
                pos = np.unique(np.array([x["pos"] for x in hits if _words(low, tok, x["pos"], n) == x["words"]], np.int64))
                out = _spans(np.zeros(len(pos), np.int64), pos, n)
                out["doc"], out["row"] = d, row
                yield out.rename(columns={"doc": "doc_id"})

    return ids.join(found, ["doc_id", "row"]).select("doc_id", "row", "text", "hits").mapInPandas(verify, SPANS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """docs, all columns, without the documents that hold a benchmark span; looked through where they are, if the benchmark can be broadcast."""
    shared, _ = _known(docs.sparkSession, benchmark, n, broadcast_grams)
    if shared is not None:

        @F.pandas_udf("boolean")
        def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = _finder(shared.value, n)
            for p in parts:
                ok = np.ones(len(p), bool)
                for at, texts in C.groups(p):
                    tok, k = find(texts)
                    ok[at + tok.doc[k]] = False
                yield pd.Series(ok)

        return docs.where(clean(F.col("text").cast("string")))
    bad, row = C.fresh(docs, "bad_id"), C.fresh(docs, "bad_text")
    found = _found(docs, benchmark, n, broadcast_grams).select(F.col("doc_id").alias(bad), F.col("row").alias(row)).distinct()
    return docs.join(found, (C.id_key(docs["doc_id"]) == found[bad]) & (F.xxhash64(docs["text"].cast("string")) == found[row]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """docs, all columns, with the spans cut from the texts: from the span's first token to its last one's end."""
    bad, row, cuts = C.fresh(docs, "bad_id"), C.fresh(docs, "bad_text"), C.fresh(docs, "cuts")
    spans = F.array_sort(F.collect_set(F.struct("span_start", "span_end")))
    found = _found(docs, benchmark, n, broadcast_grams).groupBy(F.col("doc_id").alias(bad), F.col("row").alias(row)).agg(spans.alias(cuts))

    @F.pandas_udf("string")
    def without(text: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cuts):
            if isinstance(t, str) and c is not None and len(c):
                tok, left, parts = C.tokenize([t]), 0, []
                for x in c:
                    parts.append(t[left : tok.start[x["span_start"]]])
                    left = tok.end[x["span_end"] - 1]
                t = "".join(parts) + t[left:]
            out.append(t)
        return pd.Series(out, dtype=object)

    j = docs.join(found, (C.id_key(docs["doc_id"]) == found[bad]) & (F.xxhash64(docs["text"].cast("string")) == found[row]), "left")
    return j.withColumn("text", without(F.col("text").cast("string"), F.col(cuts))).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
bt AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(w[i:i+{N - 1}], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - {N} + 2)) AS i FROM bt)),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+{N - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {N} + 2)) AS i FROM toks)),
hit AS (SELECT doc_id, pos FROM dg SEMI JOIN bg USING (g)),
lagged AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {N} THEN 0 ELSE 1 END AS isnew FROM hit),
isl AS (SELECT doc_id, pos, sum(isnew) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM lagged)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(min(pos) AS BIGINT) AS span_start, CAST(max(pos) + {N} AS BIGINT) AS span_end, CAST(count(*) AS BIGINT) AS n_grams
FROM isl GROUP BY doc_id, island
"""
