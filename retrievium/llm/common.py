"""What the training-data operators share: cutting lineage, ids, samples, and a vectorised tokenizer.

Tokens are maximal runs of letters and digits, lower-cased one code point at a time. A token is known by a 64-bit
polynomial hash. Where only that, or less of it, is compared, the operator's docstring says so; decontamination compares words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, remove, scratch, shared_dir, ship, written  # noqa: F401

NO_ID = -(2**63)  # stands for a null doc_id while rows are compared; never returned
CHUNK_CHARS = 1 << 20  # texts are tokenized in groups of about this size, which bounds a worker's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows of df, those of least hash over all columns, in its order; for training, where the bound is a parameter.

    Rows are first cut by a threshold of the hash that some four times as many are below, so that no task, and not the driver,
    gets many more than it needs however large df is.
    """
    h, n = fresh(df, "h"), df.count()
    own = df.withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    if n > 4 * rows + 100:
        own = own.where(F.col(h) < int((4 * rows + 100) / n * 2**64) - 2**63)
    return own.orderBy(h).limit(rows).drop(h)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def id_key(col: str | Column = "doc_id") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def id_back(col: str) -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter or digit, 0 for all else; the last entry is for those beyond the BMP."""
    out = np.zeros(65537, np.uint32)
    for cp in range(65536):
        ch = chr(cp)
        if ch.isalnum():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fold(cp: np.ndarray) -> np.ndarray:
    out = fold_table()[np.minimum(cp, 65536)]
    far = cp > 65535
    if far.any():
        out[far] = cp[far]
    return out


_MULT, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(1 << bits, _MULT), np.full(1 << bits, _INV)
    a[0] = b[0] = 1
    return np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(12, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Tokens(NamedTuple):
    """Tokens of a group of texts, one after the other."""

    hashes: np.ndarray  # uint64
    doc: np.ndarray  # index of the text in the group
    start: np.ndarray  # code-point offsets in the text
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1: where each text's tokens begin


def tokenize(texts: list[str]) -> Tokens:
    """Tokens of texts; a null text must come as ''."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=base[1:])
    codes = fold(code_points("\n".join(texts) + "\n"))
    word = np.zeros(len(codes) + 2, np.int8)
    word[1:-1] = codes != 0
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    pw, inv = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * pw[: len(codes)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inv[start])
    first = np.searchsorted(start, base)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Tokens(hashes, doc, start - base[doc], end - base[doc], first)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k tokens, text borders ignored; len(hashes) - k + 1 of them, or none."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    pw, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * pw[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * inv[: n - k + 1])


def inside(tok: Tokens, k: int) -> np.ndarray:
    """For each window of k tokens, whether it lies in one text."""
    return tok.doc[: max(0, len(tok.doc) - k + 1)] == tok.doc[k - 1 :]


def groups(texts: Iterable[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about that many code points: (index of the first, texts). Null counts as ''."""
    at, size, own = 0, 0, []
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if own and size + len(t) > chars:
            yield at, own
            at, size, own = i, 0, []
        own.append(t)
        size += len(t) + 1
    if own:
        yield at, own
