"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference-count tables.

A line is known by 128 bits of hash, its leading and trailing white space ignored. A shard of the hash space has a stored
cuckoo filter of its lines' fingerprints and the rows of an exact table: hash, number of references. A line whose fingerprint is
not in the filter is certainly new and isn't looked up in the table; any other is settled by the table. Inserting documents adds
references, deleting them takes these away, and a line's last one takes its fingerprint out of the filter, so that inserting documents
and deleting them again leaves the state as it was. References are counted before they are shuffled, so a line that very many documents have
is one row from each task.

Which line stays: the first by (doc_id, text hash, line number). Blank lines always stay. Cases: a null text stays null;
a document all of whose lines occur before keeps its row with text ''; rows that repeat a (doc_id, text) get the
same result, one document's; null doc_ids come first; an empty table stays empty. Extra columns are kept whatever they
are called. Texts are whole: lines are only hashed where they are, and are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from . import common as C

SLOTS, KICKS = 4, 200
PER_SHARD = 1 << 20  # lines, whose filter takes some 5 MB
SPACE = " \t\r\f\x0b"


class CuckooFilter:
    """Batches of 64-bit hashes; 4 slots a bucket, 16-bit fingerprints, partial-key hashing. Doubles by rebuilding from the exact table when full."""

    def __init__(self, capacity: int = 1024) -> None:
        self.mask = (1 << max(4, int(capacity / SLOTS / 0.85)).bit_length()) - 1
        self.table = np.zeros((self.mask + 1, SLOTS), np.uint16)
        self.size = 0
        self.rng = np.random.default_rng(7)

    @staticmethod
    def fingerprints(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (C.mix(h) & np.uint64(self.mask)).astype(np.int64)

    def _other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return at ^ (C.mix(fp.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a = self.fingerprints(h), self._at(h)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[self._other(a, fp)] == fp[:, None]).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """False if it is full; it must then be rebuilt. One entry for each hash, equal fingerprints too."""
        fp, at = self.fingerprints(h), self._at(h)
        self.size += len(h)
        for turn in range(KICKS):
            for side in range(2):
                while len(fp):  # one newcomer a bucket in each pass
                    free = self.table[at] == 0
                    slot = free.argmax(1)
                    first = np.zeros(len(fp), bool)
                    first[np.unique(at, return_index=True)[1]] = True
                    ok = first & free.any(1)
                    self.table[at[ok], slot[ok]] = fp[ok]
                    fp, at = fp[~ok], at[~ok]
                    if not ok.any():
                        break
                if side == 0:
                    at = self._other(at, fp)
            if not len(fp):
                return True
            first = np.unique(at, return_index=True)[1]  # evict one entry of each full bucket
            slot = self.rng.integers(0, SLOTS, len(first))
            out = self.table[at[first], slot].copy()
            self.table[at[first], slot] = fp[first]
            fp[first] = out
            at[first] = self._other(at[first], out)
        return False

    def to_bytes(self) -> bytes:
        return np.array([self.mask, self.size], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        out = cls(0)
        out.mask, out.size = np.frombuffer(blob, np.int64, 2).tolist()
        out.table = np.frombuffer(blob, np.uint16, offset=16).reshape(-1, SLOTS).copy()
        return out

    @classmethod
    def of(cls, h: np.ndarray) -> CuckooFilter:
        """A filter of these hashes with room for as many again."""
        size = max(1024, 2 * len(h))
        while not (out := cls(size)).insert(h):
            size *= 2
        return out

    def delete(self, h: np.ndarray) -> None:
        """Take out one entry for each hash; each must have been inserted."""
        fp, at = self.fingerprints(h), self._at(h)
        self.size -= len(h)
        for side in range(2):
            while len(fp):
                hit = self.table[at] == fp[:, None]
                first = np.zeros(len(fp), bool)
                first[np.unique(at, return_index=True)[1]] = True
                ok = first & hit.any(1)
                if not ok.any():
                    break
                self.table[at[ok], hit.argmax(1)[ok]] = 0
                fp, at = fp[~ok], at[~ok]
            if side == 0:
                at = self._other(at, fp)


def _trimmed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\t\r\f\x0b]", " "))


def line_refs(docs: DataFrame) -> DataFrame:
    """Non-blank lines of docs as (doc_id, row, line, h1, h2); row is the text's hash."""
    t = F.col("text").cast("string")
    own = docs.select(C.id_key().alias("doc_id"), F.xxhash64(t).alias("row"), F.posexplode(F.transform(F.split(t, "\n"), _trimmed)).alias("line", "x")).where("x <> ''")
    return own.select("doc_id", "row", "line", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2"))


def _lines(docs: DataFrame) -> DataFrame:
    """h1, h2, the first reference (doc_id, row, line) and n, their number, of each distinct line of docs. A line's references are counted before they move."""
    first = F.min(F.struct("doc_id", "row", "line")).alias("f")
    return line_refs(docs).groupBy("h1", "h2").agg(first, F.count("*").alias("n")).select("h1", "h2", "f.doc_id", "f.row", "f.line", "n")


def with_lines(docs: DataFrame, keeps: DataFrame, count: str | None = None) -> DataFrame:
    """docs, all columns, with the blank lines and those in keeps (doc_id, row, line) only; count names a column for how many went."""
    did, rid, kept, parts = (C.fresh(docs, k) for k in ("did", "rid", "kept", "parts"))
    own = docs.withColumns({did: C.id_key(), rid: F.xxhash64(F.col("text").cast("string"))})
    per = keeps.groupBy(F.col("doc_id").alias(did), F.col("row").alias(rid)).agg(F.collect_list("line").alias(kept))
    none = F.array().cast("array<int>")

    def left(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(SPACE)) == "", i)), lambda i: i.isNotNull())
        stay = F.array_sort(F.concat(blank, F.coalesce(F.col(kept), none)))
        return let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(s)).alias("gone")))

    text = F.col("text").cast("string")
    j = own.join(per, [did, rid], "left").withColumn(parts, F.when(text.isNotNull(), let(F.split(text, "\n"), left)))
    gone = F.coalesce(F.col(f"{parts}.gone"), F.lit(0)).cast("long")
    out = [F.when(gone > 0, F.col(f"{parts}.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return j.select(*out, *([gone.alias(count)] if count else []))


def dedup_lines(docs: DataFrame, count: str | None = None) -> DataFrame:
    """docs with each line only where it first occurs in the whole table: what an empty store returns for them."""
    return LineStore(docs.sparkSession).insert(docs, count)


def keep_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each line only where it first occurs; n_chars, if there, follows the text. Documents that lose all they had go."""
    gone = C.fresh(docs, "n_gone")
    out = dedup_lines(docs, gone)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.where((F.col(gone) == 0) | (F.trim("text") != "")).drop(gone)


class LineStore:
    """The lines of all documents inserted and not deleted, in tables of the shared folder: refs (h1, h2, refs) and filters (shard, blob).

    A shard's filter is stored and follows insertions and deletions; it is made anew from refs only where it is full. There are shards enough for
    `per_shard` lines in each, so that no task has many more, whatever the size of the store. A row of a document is a reference to each of its lines, repeated
    rows included. Deleting what wasn't inserted, or more often than it was, is a ValueError, and changes nothing.
    """

    def __init__(self, spark: SparkSession, per_shard: int = PER_SHARD) -> None:
        C.ship(spark)
        self.spark, self.per_shard, self.shards = spark, per_shard, 1
        self.refs = spark.createDataFrame([], "h1 long, h2 long, refs long")
        self.filters: DataFrame | None = None

    def _sharded(self, lines: DataFrame) -> DataFrame:
        return lines.withColumn("shard", F.pmod(F.col("h2"), F.lit(self.shards)).cast("int"))

    def _built(self, refs: DataFrame) -> DataFrame:
        """Filters of the shards of refs (h1, shard)."""

        def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [key[0]], "blob": [CuckooFilter.of(p["h1"].to_numpy().view(np.uint64)).to_bytes()]})

        return refs.groupBy("shard").applyInPandas(run, "shard int, blob binary")

    def _maybe(self, lines: DataFrame) -> DataFrame:
        """lines with maybe: whether their shard's filter has them. Where it doesn't, the store doesn't either."""
        columns, schema = lines.columns, lines.withColumn("maybe", F.lit(True)).schema

        def run(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            h = p["h1"].to_numpy().view(np.uint64)
            return p[columns].assign(maybe=CuckooFilter.from_bytes(f["blob"].iloc[0]).contains(h) if len(f) else np.zeros(len(h), bool))

        return self.filters.groupBy("shard").cogroup(self._sharded(lines).groupBy("shard")).applyInPandas(run, schema)

    def _follow(self, changes: DataFrame) -> None:
        """Bring the filters up to changes (h1, h2, more): lines that came (1) or went (-1). refs is up to them already."""
        total = self.refs.count()
        if self.filters is None or total > 2 * self.per_shard * self.shards:
            self.shards = max(1, -(-total // self.per_shard))
            self.filters = C.written(self._built(self._sharded(self.refs)))
            return

        def run(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(p):
                return f
            h, more = p["h1"].to_numpy().view(np.uint64), p["more"].to_numpy()
            own = CuckooFilter.from_bytes(f["blob"].iloc[0]) if len(f) else CuckooFilter()
            own.delete(h[more < 0])
            ok = own.size + (more > 0).sum() <= 0.85 * own.table.size and own.insert(h[more > 0])
            return pd.DataFrame({"shard": p["shard"].iloc[:1], "blob": [own.to_bytes() if ok else None]})

        now = C.written(self.filters.groupBy("shard").cogroup(self._sharded(changes).groupBy("shard")).applyInPandas(run, "shard int, blob binary"))
        full = now.where("blob is null").select("shard")
        self.filters = C.written(now.where("blob is not null").unionByName(self._built(self._sharded(self.refs).join(F.broadcast(full), "shard"))))  # a number a shard

    def insert(self, docs: DataFrame, count: str | None = None) -> DataFrame:
        """Add docs; they come back without the lines that the store or an earlier one of them has."""
        lines = _lines(docs)
        if self.filters is None:
            new = lines = C.written(lines)
            self.refs = lines.select("h1", "h2", F.col("n").alias("refs"))
        else:
            lines = C.written(self._maybe(lines))
            known = lines.where("maybe").join(self.refs.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2")
            new = C.written(lines.join(known, ["h1", "h2"], "left_anti"))
            more = lines.select("h1", "h2", F.col("n").alias("refs"))
            self.refs = C.written(self.refs.unionByName(more).groupBy("h1", "h2").agg(F.sum("refs").alias("refs")))
        self._follow(new.select("h1", "h2", F.lit(1).alias("more")))
        return with_lines(docs, new.select("doc_id", "row", "line"), count)

    def delete(self, docs: DataFrame) -> None:
        """Take docs, inserted before, out again; lines that no other document refers to become new."""
        less = C.written(line_refs(docs).groupBy("h1", "h2").agg(F.count("*").alias("n")).join(self.refs, ["h1", "h2"], "left"))
        bad = less.where("refs is null or refs < n").count()
        if bad:
            raise ValueError(f"{bad} lines have fewer references than are to be deleted")
        gone = less.where("refs = n").select("h1", "h2", F.lit(-1).alias("more"))
        now = self.refs.join(less.select("h1", "h2", "n"), ["h1", "h2"], "left").select("h1", "h2", (F.col("refs") - F.coalesce("n", F.lit(0))).alias("refs"))
        self.refs = C.written(now.where("refs > 0"))
        self._follow(gone)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"), "n_dropped")


SQL = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls[i] AS line, trim(regexp_replace(ls[i], '[\t\r\f\x0b]', ' ', 'g')) AS x, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM a)),
r AS (SELECT doc_id, line, i, x = '' OR row_number() OVER (PARTITION BY x ORDER BY doc_id, i) = 1 AS stays FROM l)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text, CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_dropped
FROM r GROUP BY doc_id
"""
