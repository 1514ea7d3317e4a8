"""Near-duplicate documents by order MinHash, verified by banded alignment.

Each of SKETCHES permutations takes the ELLS least occurrence-labelled k-mers of a text's tokens and hashes them in text
order, so that, unlike MinHash, it feels reordered text: two texts share a sketch with a probability that follows their
edit similarity. Texts that share a sketch are candidates. A candidate pair is a near-duplicate if
1 - (edit distance of the tokens) / (tokens of the longer) >= THRESHOLD, by an alignment in a band that is doubled
until the distance fits in it. Groups are the connected components of such pairs.

Equal token sequences are one node from the start. In each bucket (nodes that share a sketch) all are compared with the
least, its leader; nodes of other components elect the next leader, LEADER_ROUNDS times. Then all members of a bucket,
linked ones included, are compared pair by pair where their components still differ, so that no bucket size is cut off and
no candidate pair is left out but for those that components already join. Before tokens are moved, pairs whose lengths or
token histograms already prove a distance beyond the threshold are dropped, which loses none. So are, before a band is widened, pairs
whose tokens or runs of three tokens prove it.

Cases: null, empty and signs-only texts have no tokens and are in no group; a text shorter than k tokens is one k-mer;
repeated rows are exact copies of each other and in one group; null doc_ids take part and are returned as null; ties are settled by
the least (doc_id, text hash); an empty table gives no rows. Extra columns are kept in `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

K, ELLS, SKETCHES, THRESHOLD = 3, 2, 24, 0.8
HIST = 128
LEADER_ROUNDS = 2
TILE = 4096
BROADCAST_NODES = 1_000_000
TASK_PAIRS = 1024  # alignments of a task, about
COMPARED = 1 << 14  # pairs of histograms at a time


def sketches(tok: C.Tokens, k: int = K, n_sketches: int = SKETCHES) -> np.ndarray:
    """uint64 (texts, n_sketches); rows of texts without tokens are meaningless."""
    n_docs = len(tok.first) - 1
    counts = np.diff(tok.first)
    size = np.maximum(counts - k + 1, np.minimum(counts, 1))  # k-mers of each text
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(size, out=first[1:])
    total = int(first[-1])
    out = np.zeros((n_docs, n_sketches), np.uint64)
    if not total:
        return out
    doc = np.repeat(np.arange(n_docs), size)
    h = np.zeros(total, np.uint64)
    long = counts >= k
    at = tok.first[doc] + np.arange(total) - first[doc]
    g = C.gram_hashes(tok.hashes, k)
    ok = long[doc]
    h[ok] = g[at[ok]]
    for d in np.flatnonzero(~long & (counts > 0)).tolist():
        h[first[d]] = C.gram_hashes(tok.hashes[tok.first[d] : tok.first[d + 1]], int(counts[d]))[0]
    order = np.lexsort((h, doc))  # stable: equal k-mers stay in text order
    sh, sd = h[order], doc[order]
    new = np.ones(total, bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(total), 0))
    occurrence = np.empty(total, np.uint64)
    occurrence[order] = (np.arange(total) - begin).astype(np.uint64)
    h = C.mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15))
    has = np.flatnonzero(size > 0)
    starts, reps = first[:-1][has], size[has]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(n_sketches):
        seed = C.mix(np.array([s + 1], np.uint64))[0]
        v = (h ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
        picks = []
        for _ in range(ELLS):
            low = np.minimum.reduceat(v, starts)
            i = np.flatnonzero(v == np.repeat(low, reps))
            pos = np.full(n_docs, -1, np.int64)
            pos[doc[i[::-1]]] = i[::-1]
            picks.append(pos[has])
            v[pos[has]] = top
        p = np.sort(np.stack(picks), 0)  # back to text order
        acc = np.full(len(has), seed)
        for row in p:
            acc = C.mix(acc + h[row])
        out[has, s] = acc
    return out


def distance(x: np.ndarray, y: np.ndarray, limit: int) -> int:
    """Edit distance of two token sequences, or -1 where it is beyond limit. What they share at both ends is left out first."""
    n = min(len(x), len(y))
    if max(len(x), len(y)) - n > limit:
        return -1
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return max(len(x), len(y)) - n
    head = int(differ[0])
    x, y = x[head:], y[head:]
    n -= head
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    own, other = x[: len(x) - tail], y[: len(y) - tail]
    x, y = own.tolist(), other.tolist()
    if not x or not y:
        return max(len(x), len(y))
    band = 24
    while True:
        k = min(band, limit)
        if abs(len(x) - len(y)) <= k and (d := _band(x, y, k)) <= k:
            return d
        if k == limit or band == 24 and _apart(own, other, limit):
            return -1
        band *= 4


def _apart(x: np.ndarray, y: np.ndarray, limit: int) -> bool:
    """Whether tokens or runs of three prove a distance beyond limit: an edit takes at most q runs of q tokens from either text."""
    for q in (1, 3):
        g = [_runs(t.astype(np.uint64), q) for t in (x, y)]
        kinds, at = np.unique(np.concatenate(g), return_inverse=True)
        more = np.bincount(at[: len(g[0])], minlength=len(kinds)) - np.bincount(at[len(g[0]) :], minlength=len(kinds))
        if max(more.clip(0).sum(), (-more).clip(0).sum()) > q * limit:
            return True
    return False


def _runs(t: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q tokens; where two are equal by chance, the texts only seem nearer."""
    out = t[: max(0, len(t) - q + 1)]
    for j in range(1, q):
        out = C.mix(out) + t[j : len(t) - q + 1 + j]
    return out


def _band(x: list[int], y: list[int], k: int) -> int:
    """Edit distance by bit-parallel dynamic programming on the band |i - j| <= k; exact where at most k, else above it.

    Column j is two integers of 2 k + 1 bits, the places where the distance rises or falls from one row of the band to
    the next; the band moves down a row with each column. What is kept besides is the distance in the band's last row.
    """
    where: dict[int, int] = {}
    bit = 1 << (k + 1)  # row i is at bit i + k, so that the band never begins below bit 0
    for t in x:
        where[t] = where.get(t, 0) | bit
        bit <<= 1
    width = 2 * k + 1
    mask, last = (1 << width) - 1, 1 << (width - 1)
    up, down, d = mask >> k << k, 0, k
    get = where.get
    for j, t in enumerate(y, 1):
        same = get(t, 0) >> j & mask  # rows j - k to j + k
        diagonal = (((same & up) + up) ^ up) | same | down
        over = down | ~(diagonal | up)
        under = diagonal & up
        if not diagonal & last:
            d += 1
        diagonal = (diagonal & mask) >> 1
        up = (under | ~(diagonal | over)) & mask
        down = diagonal & over & mask
    rows = ((1 << (2 * k)) - 1) >> (len(x) - len(y) + k) << (len(x) - len(y) + k)  # below the last row of x
    return d - (up & rows).bit_count() + (down & rows).bit_count()


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row, node (128 bits of the token sequence), keys (sketches); texts with tokens only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at, texts in C.groups(p["text"]):
                tok = C.tokenize(texts)
                has = np.flatnonzero(np.diff(tok.first))
                if not len(has):
                    continue
                keys = sketches(tok)[has].view(np.int64)
                nodes = [_node(tok.hashes[tok.first[d] : tok.first[d + 1]]) for d in has.tolist()]
                yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[at + has], "row": p["row"].to_numpy()[at + has], "node": nodes, "keys": list(keys)})

    own = docs.select(C.id_key().alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    return own.mapInPandas(run, "doc_id long, row long, node binary, keys array<long>")


def _node(h: np.ndarray) -> bytes:
    pw, _ = C.powers(len(h))
    one = C.mix(np.array([(h * pw[: len(h)]).sum(), (C.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * pw[: len(h)]).sum()], np.uint64) + np.uint64(len(h)))
    return one.tobytes()


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, na, nb, ha, hb) that lengths and histograms don't rule out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = np.maximum(p["na"].to_numpy(), p["nb"].to_numpy())
            ha, hb = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(-1, HIST).astype(np.int32) for c in ("ha", "hb"))
            plus = (ha - hb).clip(0).sum(1)
            minus = (hb - ha).clip(0).sum(1)
            ok = (np.maximum(plus, minus) <= (1 - threshold) * n + 1e-9) | (n > 65535)
            yield p.loc[ok, ["a", "b"]]

    near = pairs.where(F.abs(F.col("na") - F.col("nb")) <= (1 - threshold) * F.greatest("na", "nb") + 1e-9)
    return near.mapInPandas(run, "a binary, b binary")


def _met(p: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs (a, b) of p (key, x, y, node, label, part, n, hist) that may be near: of one key and tile, with different labels and, where x <> y, parts.

    Of a tile's most frequent label no two members can be a pair, so only the others are gone through, each against all members of a
    length near its own: a large group that shares its key with a few strangers costs in proportion to its size. All tiles are gone
    through together, as most have a few members.
    """
    p = p.iloc[np.lexsort([p[c].to_numpy() for c in ("n", "y", "x", "key")])]
    n, part, inner = p["n"].to_numpy(), p["part"].to_numpy(), p["x"].to_numpy() == p["y"].to_numpy()
    tile = np.cumsum(np.append(False, np.logical_or.reduce([p[c].to_numpy()[1:] != p[c].to_numpy()[:-1] for c in ("key", "x", "y")])))
    label, kinds = pd.factorize(p["label"])
    both, times = np.unique(tile * len(kinds) + label, return_counts=True)
    order = np.lexsort((times, both // len(kinds)))
    last = np.flatnonzero(np.append(np.diff(both[order] // len(kinds)) > 0, True))
    most = (both[order] % len(kinds))[last][tile]
    h = np.frombuffer(b"".join(p["hist"]), np.uint16).reshape(-1, HIST)
    size = h.sum(1, dtype=np.int64)
    # longer ones are too far by their length alone
    upto = np.searchsorted(tile * (1 << 40) + n, tile * (1 << 40) + np.floor(n / (1 - threshold) + 1e-6).astype(np.int64), "right")
    since = np.searchsorted(upto, np.arange(len(n)), "right")
    few = np.flatnonzero(label != most)
    left, right = [few[:0]], [few[:0]]
    work = np.cumsum((upto - since)[few])
    for few_of in np.split(few, np.flatnonzero(np.diff(work // COMPARED)) + 1):
        times = (upto - since)[few_of]
        i = np.repeat(few_of, times)
        j = since[i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        ok = (label[j] == most[i]) | (j > i) & (label[j] != label[i])
        ok &= inner[i] | (part[j] != part[i])
        i, j = i[ok], j[ok]
        longer = np.maximum(n[i], n[j])
        apart = np.concatenate([np.abs(h[i[c : c + COMPARED]].astype(np.int32) - h[j[c : c + COMPARED]]).sum(1) for c in range(0, len(i) + 1, COMPARED)])
        ok = ((apart + np.abs(size[j] - size[i])) / 2 <= (1 - threshold) * longer + 1e-9) | (longer > 65535)
        left.append(i[ok])
        right.append(j[ok])
    node = p["node"].to_numpy()
    x, y = node[np.concatenate(left)], node[np.concatenate(right)]
    less = np.array([a < b for a, b in zip(x, y)], bool)
    return pd.DataFrame({"a": np.where(less, x, y), "b": np.where(less, y, x)}, dtype=object)


def _within(own: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with one key and different labels in own (key, node, label, n, hist) that lengths and histograms don't rule out.

    They are compared where a key's members meet, so that only what is left moves on; a key of more than TILE members is cut in
    tiles, each of which two parts of its members meet in.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if own := [p for p in parts if len(p)]:
            yield _met(pd.concat(own, ignore_index=True), threshold)

    parts = own.withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("key")) / TILE)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    tiles = parts.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("key", F.least("part", "t").alias("x"), F.greatest("part", "t").alias("y"), "part", "node", "label", "n", "hist")
    # by number, as comparisons are much work for few bytes
    tiles = tiles.repartition(max(12, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4), "key", "x", "y")
    return tiles.mapInPandas(run, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are near-duplicates. Each a's tokens are moved once, each b's once a pair."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        x = np.frombuffer(left["mine"].iloc[0], np.int32)
        others = [np.frombuffer(t, np.int32) for t in right["other"]]
        near = np.array([distance(x, y, int((1 - threshold) * max(len(x), len(y)) + 1e-9)) >= 0 for y in others])
        own = right.loc[near, ["b"]]
        own.insert(0, "a", key[0])
        return own

    # a leader's many partners are split over several groups, so that no task has them all
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts"))
    right = pairs.join(tokens.select(F.col("node").alias("b"), F.col("tok").alias("other")), "b").join(parts.select(F.col("a"), "parts"), "a")
    right = right.select(F.col("a").alias("a_of"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("slot_of"), "b", F.col("other").alias("other"))
    left = tokens.select(F.col("node").alias("x"), F.col("tok").alias("mine")).join(parts.select(F.col("a").alias("x"), F.col("parts").alias("n_parts")), "x")
    left = left.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("slot"), "mine")
    # by number, as alignments are much work for few bytes, by which tasks would else be put together
    n, most = pairs.count(), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-n // TASK_PAIRS), min(most, -(-n * 8 // TASK_PAIRS)))  # a task of a few pairs is mostly its start
    left, right = left.repartition(tasks, "x", "slot"), right.repartition(tasks, "a_of", "slot_of")
    return left.groupBy("x", "slot").cogroup(right.groupBy("a_of", "slot_of")).applyInPandas(run, "a binary, b binary")


def _tokens(docs: DataFrame, nodes: DataFrame, broadcast_nodes: int) -> DataFrame:
    """node, n (tokens), hist (token histogram), tok (int32 token hashes) for nodes (node, doc_id, row), which name one text of docs each.

    Up to broadcast_nodes nodes (about 100 bytes each) go to where the texts are; more of them are joined by a shuffle.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at, texts in C.groups(p["text"]):
                t = C.tokenize(texts)
                h = (t.hashes >> np.uint64(32)).astype(np.uint32)
                hist = np.bincount(t.doc * HIST + (t.hashes >> np.uint64(57)).astype(np.int64), minlength=HIST * len(texts)).reshape(-1, HIST)
                hist = np.minimum(hist, 65535).astype(np.uint16)
                each = range(len(texts))
                yield pd.DataFrame({"node": p["node"].iloc[at : at + len(texts)].to_numpy(), "n": np.diff(t.first), "hist": [hist[d].tobytes() for d in each], "tok": [h[t.first[d] : t.first[d + 1]].tobytes() for d in each]})

    own = docs.select(C.id_key().alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    few = nodes.count() <= broadcast_nodes
    joined = own.join(F.broadcast(nodes) if few else nodes, ["doc_id", "row"]).select("node", "text")
    return joined.mapInPandas(run, "node binary, n long, hist binary, tok binary").dropDuplicates(["node"])


def _grouped(docs: DataFrame, threshold: float, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """doc_id, row (text hash), g (group), first (the group's least doc_id and row), n_docs; ids as keys, a row for each of docs that is in a group."""
    spark = docs.sparkSession
    C.ship(spark)
    sig = C.written(_signatures(docs))
    many = Window.partitionBy("key")
    # copies are in a bucket more than once here; what counts is whether it has two nodes
    shared = sig.select("node", F.explode("keys").alias("key")).withColumn("two", F.min("node").over(many) != F.max("node").over(many)).where("two")
    buckets = C.cut(shared.select("node", "key").distinct())
    least = sig.join(buckets.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("row", F.struct("doc_id", "row")).alias("row"))
    members = C.cut(least)
    tokens = C.written(_tokens(docs, members, broadcast_nodes))
    stats = lambda side, n, h: tokens.select(F.col("node").alias(side), F.col("n").alias(n), F.col("hist").alias(h))
    possible = lambda pairs: _possible(pairs.join(stats("a", "na", "ha"), "a").join(stats("b", "nb", "hb"), "b"), threshold)

    label = members.select("node", F.col("node").alias("label"))
    of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))

    def merged(new: DataFrame) -> DataFrame:
        """label after new pairs (a, b). Only components that they connect are joined: each turn's graph is made of what is still apart."""
        new = new.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        joined = components(new).select(F.col("node").alias("old"), F.col("label").alias("merged"))
        return C.cut(label.join(joined, F.col("label") == F.col("old"), "left").select("node", F.coalesce("merged", "label").alias("label")))

    active, tested = buckets, []
    for _ in range(LEADER_ROUNDS):
        led = active.join(label, "node").withColumn("lead", F.min(F.struct("node", "label")).over(many))
        tested.append(C.cut(possible(led.where("lead.label <> label").select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct())))
        label = merged(_verified(tested[-1], tokens, threshold))
        # the leader has been compared with all; it and what is linked to it step back
        own = active.join(label, "node").withColumn("lead", F.min(F.struct("node", "label")).over(many))
        left = own.where("label <> lead.label").select("node", "key").withColumn("size", F.count("*").over(many)).where("size > 1").drop("size")
        active = C.cut(left)
        if active.isEmpty():
            break
    # those that stepped back have met their leaders alone. Only a bucket's least node, its first leader, has met all others
    own = buckets.join(label, "node").withColumn("least", F.min("node").over(many)).where("node <> least").drop("least")
    own = own.withColumn("two", F.min("label").over(many) != F.max("label").over(many)).where("two").drop("two")
    pairs = _within(own.join(tokens.select("node", "n", "hist"), "node"), threshold)
    for done in tested:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    pairs = C.cut(pairs)
    # one pair of each two components first: most that are near are joined by it, and their other pairs needn't be aligned
    between = Window.partitionBy(F.least("a_label", "b_label"), F.greatest("a_label", "b_label")).orderBy("a", "b")
    first = C.cut(pairs.join(of("a"), "a").join(of("b"), "b").withColumn("nth", F.row_number().over(between)).where("nth = 1").select("a", "b"))
    if not first.isEmpty():
        label = merged(_verified(first, tokens, threshold))
        rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("a_label <> b_label").select("a", "b")
        label = merged(_verified(C.cut(rest), tokens, threshold))
    docs_of = sig.select("doc_id", "row", "node").join(label.withColumnRenamed("label", "g"), "node", "left").select("doc_id", "row", F.coalesce("g", "node").alias("g"))
    group = docs_of.groupBy("g").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n_docs")).where("n_docs > 1")
    return docs_of.join(group, "g")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """doc_id, group_id (least doc_id of its group), n_docs; only documents in a group of at least two rows."""
    found = _grouped(docs, threshold, broadcast_nodes).withColumn("group_id", F.col("first.doc_id"))
    return found.select(C.id_back("doc_id").alias("doc_id"), C.id_back("group_id").alias("group_id"), F.col("n_docs").cast("long").alias("n_docs"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one document of each group: the row of least (doc_id, text hash); of equal rows one stays."""
    i, t, g, f, r = (C.fresh(docs, x) for x in ("dup_id", "dup_text", "dup_group", "dup_first", "dup_rank"))
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    dup = _grouped(docs, threshold).select(F.col("doc_id").alias(i), F.col("row").alias(t), F.col("g").alias(g), first.alias(f)).distinct()
    own = docs.withColumn(r, F.xxhash64(F.col("text").cast("string")))
    joined = own.join(dup, (C.id_key(own["doc_id"]) == F.col(i)) & (F.col(r) == F.col(t)), "left")
    alone = joined.where(F.col(i).isNull()).select(*docs.columns)
    firsts = joined.where(F.col(f)).withColumn(r, F.row_number().over(Window.partitionBy(g).orderBy(t))).where(F.col(r) == 1).select(*docs.columns)
    return alone.unionByName(firsts)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
