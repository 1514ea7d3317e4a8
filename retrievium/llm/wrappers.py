"""HTML extraction by union-free regular-expression inference over same-host pages.

A page becomes a stream of tags (name and class) and text slots. The distinct streams of a host are aligned one after the other,
commonest first, into its wrapper, a regular expression without unions: a run that follows itself in some stream becomes
a repeated group, of any length and wherever else it occurs, and what two streams don't share becomes optional. The place of a text in the wrapper is its slot.
A slot that all pages of the host have, with the same text, is part of the template and is left out; the others are the page's
fields. Pages of equal texts count as one here, pages without a text not at all. Slots that hold long texts on the average over the host (CONTENT_SHARE of the longest such average) make up `text`.

Only distinct streams are aligned, so the work for a host follows the variety of its layouts. Pages are parsed three times, where they are:
for the layouts, for what varies in each slot, and for the result; texts are neither gathered by host nor kept in between.

Cases: a null or empty page has no fields and text ''; a page without a usable URL belongs to host ''; the texts of a host with a single page, or one page
repeated, all stay, as nothing shows them to be template; broken markup is read leniently: a stray `<` is text; scripts, styles and comments are
dropped; repeated rows get a result each, alike; a null page_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CONTENT_SHARE = 0.25
BROADCAST_ROWS = 200_000  # layouts or hosts, some 500 bytes each, that are sent to the pages; more are joined by a shuffle
SHORT = 1024  # signs; up to there a plain search, which is quadratic, is the faster one
TEXT = "#"
_TANDEM = re.compile(r"(.+?)\1+", re.S)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)/?>|[^<]+|<", re.S | re.I)
_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def stream(page: str | None) -> tuple[list[str], list[str]]:
    """Signs (a tag each, TEXT for a text slot) and the slots' texts, unescaped, with white space collapsed."""
    signs: list[str] = []
    texts: list[str] = []
    for m in _TOKEN.finditer(page or ""):
        if m[3]:
            c = _CLASS.search(m[4]) if m[4] and not m[2] else None
            kind = next((g for g in c.groups() if g is not None), "") if c else ""
            signs.append(f"{m[2]}{m[3].lower()}" + ("." + ".".join(kind.split()) if kind.split() else ""))
        elif m[1] or m[0].startswith("<!") or m[0].startswith("<?"):
            continue
        elif signs and signs[-1] == TEXT:
            texts[-1] += m[0]
        elif m[0].strip():
            signs.append(TEXT)
            texts.append(m[0])
    return signs, [" ".join(html.unescape(t).split()) for t in texts]


def _runs(s: str) -> list[tuple[int, int, int]]:
    """Maximal repetitions (start, end, period), of any period, at least two bodies long; of one stretch's periods the least.

    Each repetition of period p has two places p apart at a multiple of p. There are n ln n such pairs; how far they agree to both sides
    is found by bisection over prefix hashes, for all pairs at once.
    """
    n = len(s)
    if n < 2:
        return []
    codes = C.code_points(s).astype(np.uint64)
    pw, inv = C.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(C.mix(codes) * pw[:n], out=total[1:])
    reps = (n - 1) // np.arange(1, n // 2 + 1)
    p = np.repeat(np.arange(1, n // 2 + 1), reps)
    i = (np.arange(len(p)) - np.repeat(np.cumsum(reps) - reps, reps)) * p
    j = i + p
    right, left = _agree(total, inv, i, j, n - j, 1), _agree(total, inv, i, j, i, -1)
    ok = right + left >= p
    best: dict[tuple[int, int], int] = {}
    for a, b, q in zip((i - left)[ok].tolist(), (j + right)[ok].tolist(), p[ok].tolist()):
        best[a, b] = min(q, best.get((a, b), q))
    return [(a, b, q) for (a, b), q in best.items()]


def _agree(total: np.ndarray, inv: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many signs from i and j on (way 1), or before them (way -1), are the same, at most `most` of them."""
    lo, hi = np.zeros(len(i), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        a, b = (i, j) if way == 1 else (i - mid, j - mid)
        same = (total[a + mid] - total[a]) * inv[a] == (total[b + mid] - total[b]) * inv[b]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def _tandems(s: str) -> list[str]:
    """Bodies that follow themselves, from left to right without overlaps, at each place the shortest. Short streams are matched plainly, with the same result."""
    if len(s) <= SHORT:
        return [m[1] for m in _TANDEM.finditer(s)]
    heap = [(a, q, b) for a, b, q in _runs(s)]
    heapq.heapify(heap)
    out, pos = [], 0
    while heap:
        a, q, b = heapq.heappop(heap)
        if a >= pos:
            out.append(s[a : a + q])
            pos = a + (b - a) // q * q
        elif b - pos >= 2 * q:
            heapq.heappush(heap, (pos, q, b))
    return out


def _turned(body: str, signs: dict[str, str]) -> str:
    """The rotation of a repeated body that is an element: from an opening tag to its closing one, if there is such a rotation; else from an opening tag."""
    opening = [i for i, x in enumerate(body) if (s := signs.get(x, TEXT)) != TEXT and not s.startswith("/")]
    for i in opening:
        if signs.get(body[i - 1], TEXT) == "/" + signs[body[i]].split(".")[0]:
            return body[i:] + body[:i]
    return body[opening[0] :] + body[: opening[0]] if opening else body


def _fold(streams: list[str], weights: list[int], signs: dict[str, str]) -> tuple[list[str], dict[str, str]]:
    """Replace repeated runs by group letters, the commonest first, until none is left. Each letter stands for one or more of its body."""
    bodies: dict[str, str] = {}
    now = list(streams)
    found: dict[str, set[str]] = {}
    while True:
        votes: Counter[str] = Counter()
        for s, w in zip(now, weights):
            if s not in found:
                found[s] = {_turned(b, signs) for b in _tandems(s)}
            for b in found[s]:
                votes[b] += w
        if not votes:
            return now, bodies
        best = min(votes, key=lambda b: (-votes[b], len(b), b))
        letter = chr(0xF0000 + len(bodies))
        bodies[letter] = best
        one = re.compile(f"(?:{re.escape(best)})+")
        now = [one.sub(letter, s) for s in now]
        found = {s: found[s] for s in now if s in found}


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as index pairs; of equal ones the earliest in a.

    Rows of the table are integers of a bit for each of b, of which those not set are the steps of the row, so that 64 places cost one operation.
    """
    where: dict[str, int] = {}
    for j, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << j
    mask = (1 << len(b)) - 1
    rows = [mask]  # rows[-1 - i]: of a[i:]
    for x in reversed(a):
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & mask)
    rows.reverse()
    size = lambda i, j: len(b) - j - (rows[i] & ((1 << (len(b) - j)) - 1)).bit_count()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size(i + 1, j) >= size(i, j + 1):
            i += 1
        else:
            j += 1
    return out


class Wrapper:
    """Items in order (a letter each), whether each is optional, and the bodies of group letters."""

    def __init__(self, streams: list[list[str]], weights: list[int]) -> None:
        """From a host's distinct streams and how many pages have each."""
        order = sorted(range(len(streams)), key=lambda i: (-weights[i], streams[i]))
        self.letters = {s: chr(0x100 + k) for k, s in enumerate(sorted({s for x in streams for s in x} | {TEXT}))}
        self.signs = {v: k for k, v in self.letters.items()}
        text = ["".join(self.letters[s] for s in x) for x in streams]
        folded, self.bodies = _fold([text[i] for i in order], [weights[i] for i in order], self.signs)
        self.items: list[str] = list(folded[0]) if folded else []
        self.optional = [False] * len(self.items)
        self.folded = dict(zip(order, folded))
        for s in dict.fromkeys(folded[1:]):
            if s != "".join(self.items):
                self._align(list(s))

    def _align(self, s: list[str]) -> None:
        pairs = _common(self.items, s)
        items: list[str] = []
        optional: list[bool] = []
        i = j = 0
        for a, b in [*pairs, (len(self.items), len(s))]:
            items += self.items[i:a]
            optional += [True] * (a - i)
            items += s[j:b]
            optional += [True] * (b - j)
            if a < len(self.items):
                items.append(self.items[a])
                optional.append(self.optional[a])
            i, j = a + 1, b + 1
        self.items, self.optional = items, optional

    def _sizes(self, letter: str) -> int:
        """How many text slots one pass through an item has."""
        if letter in self.bodies:
            return sum(self._sizes(x) for x in self.bodies[letter])
        return int(self.signs[letter] == TEXT)

    def slots(self, index: int, stream: list[str]) -> list[int]:
        """The slot of each text of a stream that the wrapper was made from."""
        base, at = [], 0
        for x in self.items:
            base.append(at)
            at += self._sizes(x)
        s = self.folded[index]
        where = dict((j, i) for i, j in _common(self.items, list(s)))
        raw = "".join(self.letters[x] for x in stream)
        out: list[int] = []
        pos = 0
        for j, x in enumerate(s):
            pos = self._walk(x, raw, pos, base[where[j]] if j in where else at, out)
        return out

    def _walk(self, letter: str, raw: str, pos: int, base: int, out: list[int]) -> int:
        if letter not in self.bodies:
            if self.signs[letter] == TEXT:
                out.append(base)
            return pos + 1
        m = self._pattern(letter).match(raw, pos)
        end = m.end()
        while pos < end:
            b = base
            for x in self.bodies[letter]:
                pos = self._walk(x, raw, pos, b, out)
                b += self._sizes(x)
        return end

    def _pattern(self, letter: str) -> re.Pattern:
        def expand(x: str) -> str:
            return "(?:" + "".join(map(expand, self.bodies[x])) + ")+" if x in self.bodies else re.escape(x)

        return re.compile(expand(letter))

    def regex(self) -> str:
        """The wrapper to read: <tag>, #text, (...)+ for repeated and (...)? for optional groups."""

        def show(x: str) -> str:
            if x in self.bodies:
                return "(" + "".join(map(show, self.bodies[x])) + ")+"
            return "#text" if self.signs[x] == TEXT else f"<{self.signs[x]}>"

        out, i = [], 0
        while i < len(self.items):
            j = i
            while j < len(self.items) and self.optional[j] == self.optional[i]:
                j += 1
            part = "".join(map(show, self.items[i:j]))
            out.append(f"({part})?" if self.optional[i] else part)
            i = j
        return "".join(out)


SEP = "\x01"


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _own(pages: DataFrame) -> DataFrame:
    return pages.select(C.id_key("page_id").alias("page_id"), _host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))


def _layouts(pages: DataFrame) -> DataFrame:
    """host, signs (joined by SEP), n: the distinct streams, counted where the pages are first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen = Counter((host, SEP.join(stream(h)[0])) for host, h in zip(p["host"], p["html"]))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["host", "signs", "n"])

    return _own(pages).mapInPandas(run, "host string, signs string, n long").groupBy("host", "signs").agg(F.sum("n").alias("n"))


def _streams(pages: DataFrame) -> DataFrame:
    """page_id, host, sign_hash, texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for a in range(0, len(p), 250):  # a few at a time: texts as objects are large
                own = p.iloc[a : a + 250]
                got = [stream(h) for h in own["html"]]
                yield pd.DataFrame({"page_id": own["page_id"], "host": own["host"], "signs": [SEP.join(s) for s, _ in got], "texts": [t for _, t in got]})

    out = _own(pages).mapInPandas(run, "page_id long, host string, signs string, texts array<string>")
    return out.select("page_id", "host", F.xxhash64("signs").alias("sign_hash"), "texts")


def wrappers(layouts: DataFrame) -> DataFrame:
    """From host, signs, n: host, signs, slots (of each text of the stream), wrapper; a row for each distinct stream of a host."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("signs", ignore_index=True)
        own = [s.split(SEP) if s else [] for s in p["signs"]]
        w = Wrapper(own, p["n"].tolist())
        shown = w.regex()
        return pd.DataFrame({"host": key[0], "signs": p["signs"], "slots": [w.slots(i, s) for i, s in enumerate(own)], "wrapper": shown})

    # by number: hosts are few bytes and much work, and would else be put together in few tasks
    n = int(layouts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return layouts.repartition(n, "host").groupBy("host").applyInPandas(run, "host string, signs string, slots array<int>, wrapper string")


def _checked(df: DataFrame, most: int) -> DataFrame:
    """df, cut, marked for broadcast if it has at most so many rows."""
    df = C.cut(df)
    return F.broadcast(df) if df.count() <= most else df


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, text (the content slots, a line each) and fields (slot, text) in page order, template texts left out."""
    C.ship(pages.sparkSession)
    made = wrappers(_layouts(pages))
    slots = _checked(made.select("host", F.xxhash64("signs").alias("sign_hash"), "slots"), broadcast_rows)
    placed = _streams(pages).join(slots, ["host", "sign_hash"])
    each = placed.select("host", F.xxhash64("texts").alias("page"), F.explode(F.arrays_zip("slots", "texts")).alias("x")).select("host", "page", F.col("x.slots").alias("slot"), F.col("x.texts").alias("t"))
    stats = each.groupBy("host", "slot").agg((F.min(F.xxhash64("t")) != F.max(F.xxhash64("t"))).alias("varies"), (F.min("page") == F.max("page")).alias("single"), F.avg(F.length("t")).alias("mean"))
    # a slot is on all pages if all layouts that hold a text have it
    texts = slots.where(F.size("slots") > 0)
    having = texts.select("host", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n_having"))
    n_layouts = texts.groupBy("host").agg(F.count("*").alias("n_layouts"))
    kept = stats.join(having, ["host", "slot"]).join(n_layouts, "host").where("varies or single or n_having < n_layouts")
    kept = kept.groupBy("host").agg(F.collect_list(F.struct("slot", "mean")).alias("s"), F.max("mean").alias("top"))
    kept = kept.select("host", F.transform("s", lambda x: x["slot"]).alias("field_slots"), F.transform(F.filter("s", lambda x: x["mean"] >= F.col("top") * CONTENT_SHARE), lambda x: x["slot"]).alias("text_slots"))
    both = placed.join(_checked(kept, broadcast_rows), "host", "left")
    fields = F.filter(F.arrays_zip(F.col("slots").alias("slot"), F.col("texts").alias("text")), lambda x: F.array_contains("field_slots", x["slot"]))
    both = both.withColumn("fields", F.coalesce(fields, F.array().cast("array<struct<slot:int,text:string>>")))
    text = F.array_join(F.transform(F.filter("fields", lambda x: F.array_contains("text_slots", x["slot"])), lambda x: x["text"]), "\n")
    return both.select(C.id_back("page_id").alias("page_id"), "host", F.coalesce(text, F.lit("")).alias("text"), "fields")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
