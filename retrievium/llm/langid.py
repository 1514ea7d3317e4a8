"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are its character n-grams (1 to 4 letters, word borders included, digits and signs being borders),
hashed to buckets. The mean of their embeddings goes through a linear layer; embeddings, weights and biases are trained
by stochastic gradient descent. As mean and layer are linear, scoring adds up one precomputed row of class scores per
n-gram: it reads whole texts and never builds features. A temperature fitted on held-out rows calibrates the softmax.
A text is rejected on either of two grounds, each calibrated on held-out rows and windows of them, of which at most `max_rejected` are
to fail it: its probability is low (but no threshold is over one and a half times an even share: below that it is near to a guess), or too many of its
4-grams are in no training row, as in a language that wasn't trained on or in random letters. A softmax can't tell the latter, as it is sure of any
text that is less unlike one class than the others. The share of unknown 4-grams counts UNKNOWN_PRIOR known ones beside the text's own, so that a few
letters aren't judged by it; held-out rows being few, its threshold is twice what they show, at most half way from there to 1, and UNKNOWN_LEAST at least.

Training reads at most `train_rows` labelled rows, those of least hash; it is the only thing with a bound.

Cases: a text without letters (null, empty, digits alone) has no features: language null, confidence 0, rejected. Rows
with null labels are scored but never trained on. With no labelled rows at all everything is rejected; with one
language, that is the answer for any text with letters that isn't rejected as unknown. Equal scores go to the language first by name. Repeated rows
get equal results, row by row. Extra columns are kept in `keep_accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS, DIM, ORDERS = 15, 16, (1, 2, 3, 4)
KNOWN_BITS = 20  # of a hash that says whether a 4-gram is known; its first BITS bits are the bucket
UNKNOWN_PRIOR, UNKNOWN_LEAST = 8, 0.4
TRAIN_ROWS = 2000
MAX_REJECTED = 0.001
_SALT = {n: np.uint32(s) for n, s in zip(ORDERS, (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1))}


def features(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of all n-grams of the texts, and the text that each is of. Of borders in a row, one stays."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 2
    codes = C.fold(C.code_points("".join(f"\n{t}\n" for t in texts)))
    codes[(codes >= 48) & (codes <= 57)] = 0
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    h = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        m = max(0, len(codes) - n + 1)
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :]
        x = (h ^ _SALT[n]) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        ok = doc[:m] == doc[n - 1 :]
        if n == 1:
            ok &= codes != 0
        yield (x[ok] * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits), doc[:m][ok]


def scores(texts: list[str], table: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of table rows over each text's n-grams, divided by their number; that number (0: no letters); and the share of 4-grams that aren't known."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    letters, unknown = None, np.zeros(len(texts))
    for ids, doc in features(texts, KNOWN_BITS):
        n = np.bincount(doc, minlength=len(texts))
        letters = n if letters is None else letters
        at = np.flatnonzero(n)
        if len(at):
            total[at] += np.add.reduceat(table[ids >> np.uint32(KNOWN_BITS - BITS)], np.searchsorted(doc, at), axis=0)
        count += n
    if known is not None:  # of the last order
        unknown = np.bincount(doc[~known[ids]], minlength=len(texts)) / (n + UNKNOWN_PRIOR)
    count[letters == 0] = 0
    return total / np.maximum(count, 1)[:, None], count, unknown


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class LanguageModel:
    """classes, a row of class scores for each bucket, biases, which 4-grams are known, temperature and both rejection thresholds."""

    def __init__(self, classes: list[str], table: np.ndarray, bias: np.ndarray, known: np.ndarray | None = None) -> None:
        self.classes, self.table, self.bias, self.known = classes, table, bias, known
        self.temperature, self.threshold, self.most_unknown = 1.0, 0.0, 1.0

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class index, probability, and whether the text is rejected."""
        if not self.classes:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
        mean, count, unknown = scores(texts, self.table, self.known)
        p = np.round(softmax((mean + self.bias) / self.temperature), 6)
        best = p.argmax(1)
        top = np.where(count > 0, p.max(1), 0.0)
        return best, top, (top < self.threshold) | (unknown > self.most_unknown) | (count == 0)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 1.0, max_rejected: float = MAX_REJECTED, seed: int = 0) -> LanguageModel:
    """Every fifth row is held out. Short windows of the training rows are trained on too, so that short texts are known."""
    classes = sorted(set(labels))
    if not classes:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([classes.index(x) for x in labels])
    held = np.arange(len(texts)) % 5 == 4
    more = [(texts[i], y[i]) for i in np.flatnonzero(~held)]
    for i in np.flatnonzero(~held):
        for size in (24, 80):
            at = int(rng.integers(0, max(1, len(texts[i]) - size)))
            more.append((texts[i][at : at + size], y[i]))
    sparse = []
    for at, own in C.groups([t for t, _ in more]):
        parts = list(features(own))
        ids, doc = np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]).astype(np.int64)
        key, n = np.unique(doc << BITS | ids, return_counts=True)
        first = np.searchsorted(key >> BITS, np.arange(len(own) + 1))
        for k in range(len(own)):
            i, c = key[first[k] : first[k + 1]] & ((1 << BITS) - 1), n[first[k] : first[k + 1]]
            if len(i):
                sparse.append((i, (c / c.sum()).astype(np.float32), more[at + k][1]))
    emb = rng.normal(0, 0.3, (1 << BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    w += rng.normal(0, 0.3, w.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(sparse)):
            ids, c, t = sparse[k]
            mean = c @ emb[ids]
            p = softmax((mean @ w + b)[None])[0]
            p[t] -= 1
            back = w @ p
            w -= step * np.outer(mean, p)
            b -= step * p
            emb[ids] -= step * len(ids) ** 0.5 * c[:, None] * back
    known = np.zeros(1 << KNOWN_BITS, bool)
    for _, own in C.groups([texts[i] for i in np.flatnonzero(~held)]):
        for ids, _ in features(own, KNOWN_BITS):
            pass
        known[ids] = True  # of the last order
    model = LanguageModel(classes, (emb @ w).astype(np.float32), b.astype(np.float64), known)
    own, t = [texts[i] for i in np.flatnonzero(held)], y[held]
    if own:
        mean, count, _ = zip(*(scores(g, model.table) for _, g in C.groups(own)))
        z, ok = np.concatenate(mean) + model.bias, np.concatenate(count) > 0
        z, t = z[ok], t[ok]
        parts = [x[at : at + size] for x in own for size in (24, 80, 400) for at in (int(rng.integers(0, max(1, len(x) - size))),)] + own
        unknown = np.sort(np.concatenate([scores(g, model.table, known)[2] for _, g in C.groups(parts)]))
        most = float(unknown[-1 - int(max_rejected * len(unknown))])
        model.most_unknown = max(UNKNOWN_LEAST, min(2 * most, (1 + most) / 2))
        if len(t):
            grid = np.geomspace(0.02, 20, 61)
            model.temperature = float(min(grid, key=lambda x: -np.log(np.maximum(softmax(z / x)[np.arange(len(t)), t], 1e-12)).mean()))
            p = softmax(z / model.temperature)
            right = np.sort(p.max(1)[p.argmax(1) == t])
            if len(right):
                model.threshold = float(min(right[int(max_rejected * len(right))], 1.5 / len(classes))) - 1e-6
    return model


def fit(docs: DataFrame, label: str = "lang", train_rows: int = TRAIN_ROWS, max_rejected: float = MAX_REJECTED) -> LanguageModel:
    """Train on at most train_rows distinct rows with a label; rows are chosen by hash, so the choice doesn't depend on their order."""
    t, y = F.col("text").cast("string"), F.col(label).cast("string")
    rows = docs.where(y.isNotNull() & t.isNotNull()).select(C.id_key().alias("i"), F.xxhash64(t).alias("h"), y.alias("y"), t.alias("t"))
    keys = C.sampled(rows.select("i", "h", "y").distinct(), train_rows)  # texts move only once their rows are chosen
    own = rows.join(F.broadcast(keys), ["i", "h", "y"]).dropDuplicates(["i", "h", "y"]).orderBy("i", "h", "y").toPandas()
    return train(own["t"].tolist(), own["y"].tolist(), max_rejected=max_rejected)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, predicted, confidence, rejected; one row per row of docs."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 rows of class scores, whatever the corpus

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.classes, None], object)
        for p in parts:
            for at, texts in C.groups(p["text"]):
                best, top, no = m.predict(texts)
                best = np.where(top > 0, best, len(m.classes))
                yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[at : at + len(texts)], "predicted": names[best], "confidence": top, "rejected": no})

    own = docs.select(C.id_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, "doc_id long, predicted string, confidence double, rejected boolean").withColumn("doc_id", C.id_back("doc_id"))


def keep_accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs, all columns, without the rows that the model rejects."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(np.concatenate([~shared.value.predict(t)[2] for _, t in C.groups(p)] or [np.zeros(0, bool)]))

    return docs.where(accepted(F.col("text").cast("string")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
