"""Suffix-array dedup: token spans whose every window of LEAST tokens occurs in another document too.

Shards must hold all places of a repeated passage. They are cut by content: of the K-grams of any window of LEAST tokens
the first one of least hash is its anchor, so equal windows have equal anchors, wherever they are. The text around an
anchor that could hold such a window is a piece. Places of anchors are shuffled once, by anchor, as a few numbers each. A piece that two
documents share is repeated as a whole; a piece of one document, whose anchor other documents have too, must be searched, and
with it one copy of each other piece of that anchor. Only the searched pieces' tokens move, to shards of SHARD symbols, as many as it takes.
Of a shard's pieces only the segments are sorted whose windows have a hash that other documents have too, equal segments once; that
leaves out no repeat, as equal windows have equal hashes. They are sorted by external induced sorting (see suffixes). The anchor, which all its pieces hold, is one symbol there, and the tokens around it are symbols of
12 bits, so windows that share a run of the suffix array are compared again by 32 bits a token. Windows of at least two documents are
marked, and a document's marks merged. So the result is that of one suffix array over the whole corpus.

Cases: null, empty and short texts (under LEAST tokens) have no window; a document's repeats of its own passages don't count;
rows that repeat a (doc_id, text) are one document; rows of equal text and different ids repeat each other as a whole; a null doc_id
takes part and is returned as null; an empty table gives no rows. Only doc_id and text are read. The result has a row for each
span of each document, the first one that holds it included.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .suffixes import SMALL, Space, suffix_array

LEAST, K = 50, 25
MEMORY = 1 << 26  # bytes of an array that a shard keeps in memory; larger ones are in files
SHARD = 1 << 19
PLACES = "d long, doc_id long, row long, pos int, n_left int, n_right int, anchor long, piece long"
SPANS = "doc_id long, span_start long, span_end long"


def anchors(h: np.ndarray, width: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions in h that are the first least value of some `width` values in a row, of those that begin where valid; ascending."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, at, size = h, np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        left, right = slice(0, len(value) - step), slice(step, len(value))
        less = value[right] < value[left]
        value, at = np.where(less, value[right], value[left]), np.where(less, at[right], at[left])
        size += step
    at = at[:n] if valid is None else at[:n][valid]
    return np.unique(at)


def _document(p: pd.DataFrame) -> np.ndarray:
    """64 bits that tell documents, that is (doc_id, text hash), apart."""
    with np.errstate(over="ignore"):
        return C.mix(C.mix(p["doc_id"].to_numpy().view(np.uint64)) + p["row"].to_numpy().view(np.uint64)).view(np.int64)


def _places(ids: DataFrame, least: int, k: int) -> DataFrame:
    """The places of anchors: token pos of a document, n_left tokens before the anchor and n_right after it in its piece, of hash `piece`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            doc_ids, rows, d = p["doc_id"].to_numpy(), p["row"].to_numpy(), _document(p)
            for at, texts in C.groups(p["text"]):
                tok = C.tokenize(texts)
                if len(tok.hashes) < least:
                    continue
                g = C.gram_hashes(tok.hashes, k)
                pos = anchors(g, least - k + 1, C.inside(tok, least))
                doc = tok.doc[pos]
                lo, hi = np.maximum(tok.first[doc], pos - (least - k)), np.minimum(tok.first[doc + 1], pos + least)
                pw, inv = C.powers(len(tok.hashes) + 1)
                total = np.zeros(len(tok.hashes) + 1, np.uint64)
                np.cumsum(tok.hashes * pw[: len(tok.hashes)], out=total[1:])
                piece = C.mix((total[hi] - total[lo]) * inv[lo] + (pos - lo).astype(np.uint64))
                yield pd.DataFrame({"d": d[at + doc], "doc_id": doc_ids[at + doc], "row": rows[at + doc], "pos": (pos - tok.first[doc]).astype(np.int32), "n_left": (pos - lo).astype(np.int32), "n_right": (hi - pos - k).astype(np.int32), "anchor": g[pos].view(np.int64), "piece": piece.view(np.int64)})

    return ids.mapInPandas(run, PLACES)


def _tokens_of(ids: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted with tok: 32-bit hashes of the tokens before and after the anchor."""
    names = ("anchor", "pos", "n_left", "n_right", "d", "open")
    per = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*names)).alias("w"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at, texts in C.groups(p["text"]):
                tok = C.tokenize(texts)
                h = (tok.hashes >> np.uint64(32)).astype(np.uint32)
                own = {c: p[c].iloc[at : at + len(texts)] for c in names}
                doc = np.repeat(np.arange(len(texts)), [len(x) for x in own["pos"]])
                w = {c: np.concatenate(own[c].to_list()) for c in names}
                a = tok.first[doc] + w["pos"]
                w["tok"] = [h[x:y].tobytes() + h[y + k : z].tobytes() for x, y, z in zip((a - w["n_left"]).tolist(), a.tolist(), (a + k + w["n_right"]).tolist())]
                w |= {"doc_id": p["doc_id"].to_numpy()[at + doc], "row": p["row"].to_numpy()[at + doc]}
                yield pd.DataFrame(w)[["anchor", "pos", "n_left", "d", "open", "doc_id", "row", "tok"]]

    columns = [F.col(f"w.{c}").alias(c) for c in names]
    joined = ids.join(per, ["doc_id", "row"]).select("doc_id", "row", "text", *columns)
    return joined.mapInPandas(run, "anchor long, pos int, n_left int, d long, open boolean, doc_id long, row long, tok binary")


def _marks(pieces: pd.DataFrame, least: int, k: int, space: Space, small: int = SMALL) -> pd.DataFrame:
    """doc_id, row, s: windows (first token and end, packed) of open pieces that pieces of at least two documents, or a closed one, hold."""
    width = least - k + 1  # of a window, the anchor being one symbol
    none = pd.DataFrame({"doc_id": [], "row": [], "s": []})
    n_left, d, opened = pieces["n_left"].to_numpy(), pieces["d"].to_numpy(), pieces["open"].to_numpy(bool)
    size = np.array([len(t) // 4 for t in pieces["tok"]]) + 1
    first = np.append(0, np.cumsum(size + 1))
    n = int(first[-1])
    mid = first[:-1] + n_left
    plain = np.ones(n, bool)
    plain[mid] = plain[first[1:] - 1] = False
    full = np.zeros(n, np.uint64)
    full[plain] = np.frombuffer(b"".join(pieces["tok"]), np.uint32)
    text = np.zeros(n, np.int64)  # 0 ends a piece
    text[plain] = (full[plain] >> np.uint64(20)).astype(np.int64) % 4093 + 2
    text[mid] = 1
    full[mid] = C.mix(pieces["anchor"].to_numpy().view(np.uint64))
    window = C.gram_hashes(C.mix(full), width)
    owner = np.repeat(np.arange(len(size)), size + 1)
    start = np.flatnonzero(first[owner + 1] - 1 - np.arange(n) >= width)
    if not len(start):
        return none
    # a window whose hash is of one document alone can be no repeat; from its first to its last other window, a piece is a segment
    order = np.argsort(window[start], kind="stable")
    keep = np.zeros(len(start), bool)
    keep[order] = _repeated(window[start][order], d[owner[start][order]], d[owner[start][order]], opened[owner[start][order]], opened[owner[start][order]])
    start = start[keep]
    if not len(start):
        return none
    who = owner[start]
    b = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    e = np.append(b[1:], len(start)) - 1
    piece, since, length = who[b], start[b], start[e] - start[b] + width
    # two windows cover a segment. Equal ones are sorted once, for all their documents
    _, one, of = np.unique(C.mix(C.mix(window[start[b]] + length.astype(np.uint64)) + window[start[e]]), return_index=True, return_inverse=True)
    members = np.argsort(of, kind="stable")
    at_group = np.searchsorted(of[members], np.arange(len(one) + 1))
    low, high = (f.reduceat(d[piece[members]], at_group[:-1]) for f in (np.minimum, np.maximum))
    all_open, any_open = (f.reduceat(opened[piece[members]], at_group[:-1]) for f in (np.minimum, np.maximum))
    ends = np.append(0, np.cumsum(length[one] + 1))
    group = np.repeat(np.arange(len(one)), length[one] + 1)
    source = since[one][group] + np.arange(ends[-1]) - ends[group]
    text = text[source]
    text[ends[1:] - 1] = 0
    sa, lcp = suffix_array(text, 4096, space, small)
    run = np.cumsum(np.asarray(lcp) < width)
    sa = np.asarray(sa)
    ok = ends[group[sa] + 1] - 1 - sa >= width
    at, run = sa[ok], run[ok]
    w = window[source[at]]
    order = np.lexsort((w, run))  # a run can hold more than one kind of window: bring equal ones together
    at, run, w = at[order], run[order], w[order]
    g = group[at]
    hit = at[_repeated(w, low[g], high[g], all_open[g], any_open[g], run) & any_open[g]]
    if not len(hit):
        return none
    hit.sort()
    g = group[hit]
    b = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (np.diff(hit) > least)))  # windows of a segment that touch are one span
    e = np.append(b[1:], len(hit)) - 1
    # to all documents of each segment
    g, lo, hi = g[b], hit[b] - ends[g[b]], hit[e] - ends[g[b]]
    times = np.diff(at_group)[g]
    span = np.repeat(np.arange(len(g)), times)
    m = members[at_group[g][span] + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)]
    span, m = span[opened[piece[m]]], m[opened[piece[m]]]
    who = piece[m]
    begin = pieces["pos"].to_numpy(np.int64)[who] - n_left[who] + since[m] - first[who]
    return pd.DataFrame({"doc_id": pieces["doc_id"].to_numpy()[who], "row": pieces["row"].to_numpy()[who], "s": (begin + lo[span]) * (1 << 32) + begin + hi[span] + least})


def _repeated(w: np.ndarray, low: np.ndarray, high: np.ndarray, all_open: np.ndarray, any_open: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
    """For windows in an order that brings equal ones (of one run, if given) together: whether at least two documents, or a closed piece, and an open one hold it.

    low and high are the least and greatest document of each. A closed piece stands for at least two documents.
    """
    new = np.append(True, w[1:] != w[:-1])
    if run is not None:
        new[1:] |= run[1:] != run[:-1]
    begin = np.flatnonzero(new)
    many = np.minimum.reduceat(low, begin) != np.maximum.reduceat(high, begin)
    many |= ~np.minimum.reduceat(all_open, begin)
    many &= np.maximum.reduceat(any_open, begin)
    return np.repeat(many, np.diff(np.append(begin, len(w))))


def _scratch(spark: SparkSession) -> str | None:
    """The folder that all executors share, if it is a mounted one; else queues stay in memory."""
    at = urlparse(C.shared_dir(spark))
    return at.path if at.scheme in ("", "file") else None


def repeated_spans(docs: DataFrame, least: int = LEAST, k: int = K, shard: int = SHARD, memory: int = MEMORY, small: int = SMALL) -> DataFrame:
    """doc_id, span_start, span_end (exclusive) in tokens."""
    spark = docs.sparkSession
    C.ship(spark)
    ids = docs.select(C.id_key().alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_piece, of_anchor = Window.partitionBy("anchor", "piece"), Window.partitionBy("anchor")
    places = _places(ids, least, k).repartition(parts, "anchor")  # the one shuffle that both windows use
    places = places.withColumn("single", F.min("d").over(of_piece) == F.max("d").over(of_piece)).withColumn("nth", F.row_number().over(of_piece.orderBy("d", "pos")))
    places = places.withColumn("shared", F.min("d").over(of_anchor) != F.max("d").over(of_anchor)).withColumn("search", F.max("single").over(of_anchor))
    live = C.written(places.where("shared").drop("shared", "piece"))
    packed = F.col("pos").cast("long") * (1 << 32) - F.col("n_left").cast("long") * (1 << 32) + F.col("pos") + k + F.col("n_right")
    whole = live.where(f"not single and n_left + n_right >= {least - k}").select("doc_id", "row", packed.alias("s"))
    search = live.where("search and (single or nth = 1)").withColumnRenamed("single", "open")
    n = -(-search.count() * (2 * (least - k) + 2) // shard) or 1
    folder = _scratch(spark)

    def sort(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(parts)
        own = pd.concat(own, ignore_index=True) if own else pd.DataFrame()
        if not len(own):
            return
        at = os.path.join(folder, f"suffixes-{uuid.uuid4().hex}") if folder else None
        if at:
            os.makedirs(at)
        try:
            yield _marks(own, least, k, Space(at, memory), small)
        finally:
            if at:
                shutil.rmtree(at, ignore_errors=True)

    found = _tokens_of(ids, search, k).repartition(n, "anchor").mapInPandas(sort, "doc_id long, row long, s long")

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for d, s in zip(p["doc_id"].tolist(), p["s"]):
                x = np.sort(np.asarray(s, np.int64))
                lo, top = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
                new = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
                out.append((np.full(len(new), d), lo[new], top[np.append(new[1:], len(x)) - 1]))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("doc_id", "span_start", "span_end"))})

    spans = whole.unionByName(found).groupBy("doc_id", "row").agg(F.collect_set("s").alias("s"))
    return spans.mapInPandas(merge, SPANS).withColumn("doc_id", C.id_back("doc_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(C.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+{LEAST - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LEAST} + 2)) AS i FROM d)),
r AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT DISTINCT doc_id, pos FROM g SEMI JOIN r USING (g)),
n AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {LEAST} THEN 0 ELSE 1 END AS isnew FROM h),
i AS (SELECT doc_id, pos, sum(isnew) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM n)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(min(pos) AS BIGINT) AS span_start, CAST(max(pos) + {LEAST} AS BIGINT) AS span_end
FROM i GROUP BY doc_id, island
"""
