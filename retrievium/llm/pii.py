"""Personal data and secrets: a character-level bidirectional LSTM under a CRF, trained in numpy from labelled spans.

Kinds are email, phone, ip, card and secret (keys, tokens and passwords with the name they are given to). The training spans come from a seeded
generator of such strings, and of strings that look like them but aren't (versions, dates, prices, capitals), put into snippets
of CONTEXT characters of at most TRAIN_ROWS documents, words with digits, `@` or `=` taken out, as they could be such data without a label;
that is the only thing with a bound, and what is searched isn't bounded. Tags are B and I of each kind and O; the CRF allows I only after its own kind.

A text is covered by windows of WINDOW characters, STRIDE apart, all of which are read by the network and decoded. A window whose scores prove that no
span can beat its being all O (a bound over what any span could gain) is that without the Viterbi search. Then a document's spans are
reconciled together: pieces of the same kind that a window's edge cut are joined, and of overlapping spans the set of
greatest total weight (sum of the tags' scores over that of O) is kept, by dynamic programming.

Cases: a null or empty text has no span; very long texts are more windows, and one document's work stays in one task; equal weights go to
the span that starts first; repeated rows are reported each; a null doc_id is returned as null; an empty table gives no rows. Only
doc_id and text are read; `redacted` keeps all columns.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "phone", "ip", "card", "secret")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STRIDE, TRAIN_ROWS, CONTEXT = 640, 592, 300, 400
EXAMPLE = 320  # characters of a training example at most, if no length is asked for
GROUP_CHARS = 1 << 22  # of texts that are read together
DATA = re.compile(r"[0-9@=]|[A-Z0-9]{10}")
CHARS, EMBED, HIDDEN = 100, 12, 16
LENGTH = 32  # windows at a text's end are padded by it at least and to a multiple of it, whatever else is decoded with them
SPANS = "doc_id long, span_start long, span_end long, kind string, value string"


def char_ids(cp: np.ndarray) -> np.ndarray:
    """Printable ASCII has ids of its own; other letters and digits share one, white space another, all else a third; 0 is the end of text."""
    out = np.full(len(cp), 97, np.int64)
    low = np.minimum(cp, 65536)
    out[(C.fold_table()[low] != 0) | (cp > 65535)] = 96
    ascii_ = (cp >= 32) & (cp < 127)
    out[ascii_] = cp[ascii_].astype(np.int64) - 31
    out[(cp == 10) | (cp == 9) | (cp == 13)] = 98
    return out


def _pick(rng: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(letters), int(rng.integers(low, high + 1))))


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
BASE32, ALNUM = UPPER + "234567", LOWER + UPPER + DIGITS


def sample_entity(rng: np.random.Generator, kind: str) -> str:
    """An invented string of the kind."""
    d = lambda n: _pick(rng, DIGITS, n, n)
    way = rng.random()
    if kind == "email":
        local = _pick(rng, LOWER, 1, 9) + (str(rng.choice([".", "_", "-", "+"])) + _pick(rng, LOWER + DIGITS, 1, 6) if way < 0.7 else "") + (d(int(rng.integers(1, 4))) if rng.random() < 0.3 else "")
        host = _pick(rng, LOWER, 2, 9) + (d(int(rng.integers(1, 3))) if rng.random() < 0.4 else "") + ("." + str(rng.choice(["example", "mail", "corp", _pick(rng, LOWER, 2, 8)])) if rng.random() < 0.6 else "")
        out = f"{local}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu', 'info'])}"
        return out.upper() if rng.random() < 0.1 else out
    if kind == "phone":
        if way < 0.45:
            return f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}"
        return str(rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.integers(1, 99)} {d(2)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{rng.integers(10, 99)}{d(10)}", f"0{d(3)} {d(6)}"]))
    if kind == "ip":
        return ".".join(str(rng.integers(0, 256 if rng.random() < 0.7 else 20)) for _ in range(4))
    if kind == "card":
        sep = "" if way < 0.7 else str(rng.choice([" ", "-"]))
        return sep.join(d(4) for _ in range(4)) if way < 0.9 else str(rng.choice(["34", "37"])) + d(13)
    if way < 0.3:
        return f"{rng.choice(['password', 'passwd', 'pwd', 'secret', 'api_key', 'apikey'])}={_pick(rng, HEX if rng.random() < 0.7 else ALNUM, 8, 24)}"
    if way < 0.6:
        q = str(rng.choice(['"', "'", '"']))
        return f"{rng.choice(['token', 'secret', 'api_key', 'auth_token', 'token'])} = {q}{_pick(rng, HEX if rng.random() < 0.7 else ALNUM, 20, 44)}{q}"
    if way < 0.9:
        return "AKIA" + _pick(rng, BASE32 if rng.random() < 0.5 else UPPER + DIGITS, 16, 16)
    return str(rng.choice(["sk_live_", "ghp_", "xoxb-"])) + _pick(rng, ALNUM, 24, 36)


def sample_decoy(rng: np.random.Generator) -> str:
    """A string that isn't personal data, though it holds digits, capitals or signs."""
    r = lambda a, b: int(rng.integers(a, b))
    ways = (
        lambda: f"{r(0, 20)}.{r(0, 20)}", lambda: f"Version {r(1, 9)}.{r(0, 9)}", lambda: f"version {r(1, 9)}", lambda: str(r(1900, 2100)), lambda: f"{r(1, 9)},{r(100, 999)}.{r(10, 99)}",
        lambda: f"${r(1, 9999)}", lambda: f"{r(1990, 2030)}-{r(1, 13):02d}-{r(1, 29):02d}", lambda: f"{r(0, 24):02d}:{r(0, 60):02d}", lambda: f"{r(1, 100)}%", lambda: f"{r(1, 30)}th",
        lambda: f"{_pick(rng, LOWER, 1, 3)} = {r(0, 99)}", lambda: f"@{_pick(rng, LOWER, 3, 10)}", lambda: "".join(_pick(rng, UPPER, 2, 14) + str(rng.choice([" ", "!! ", ", "])) for _ in range(3)),
        lambda: f"ISO {r(1000, 9999)}", lambda: f"{_pick(rng, UPPER, 1, 3)}{r(1, 999)}", lambda: f"{r(1, 9)}.{r(0, 20)}.{r(0, 20)}", lambda: str(r(0, 10**6)), lambda: f"{r(1, 29)}/{r(1, 13)}/{r(1990, 2030)}",
        lambda: "=" * r(1, 30), lambda: f"{_pick(rng, LOWER, 2, 8)}={_pick(rng, LOWER, 1, 5)}", lambda: f"[{r(1, 99)}]", lambda: f"({r(1, 999)})", lambda: f"https://{_pick(rng, LOWER, 3, 9)}.org/{_pick(rng, LOWER, 2, 8)}?p={r(1, 99)}",
    )
    return ways[r(0, len(ways))]()


TAILS = ("", "", "", "", "", "", ".", ",", "!", ";", ":", "?", ")", "###", "!!", "%%%", "&&&", "***", "$$$")
PLAIN = "the of und der la de que en ing her menteur les ción thation, erly. Dass. Nous".split()


def examples(snippets: list[str], n: int, seed: int, most: int = EXAMPLE) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n windows with their labelled spans (start, end, kind)."""
    rng = np.random.default_rng(seed)
    words = [s.split() for s in snippets if s.split()] or [PLAIN]
    out = []
    for _ in range(n):
        own = words[int(rng.integers(len(words)))]
        at, text, spans = int(rng.integers(len(own))), "", []
        length = most if rng.random() < 0.65 else int(np.exp(rng.uniform(np.log(10), np.log(most))))  # short texts end in nothing
        upper, near = rng.random() < 0.12, False
        while len(text) < length:
            u = rng.random()
            if u < (0.3 if near else 0.12):  # one seldom comes alone
                near = True
                kind = KINDS[int(rng.integers(len(KINDS)))]
                e = sample_entity(rng, kind)
                text += str(rng.choice(["", "", "", "", "(", "<", '"']))
                if len(text) + len(e) <= length:
                    spans.append((len(text), len(text) + len(e), kind))
                    text += e + str(rng.choice(TAILS)) + str(rng.choice([" ", " ", " ", "\n"]))
                else:
                    text += "\n" * (length - len(text))
            elif u < (0.5 if near else 0.22):
                near = False
                text += sample_decoy(rng) + str(rng.choice(TAILS)) + " "
            else:
                near = False
                w = own[at % len(own)]
                at += 1
                if upper:  # shouting, in words up to very long ones
                    w = "".join((w, *(own[(at + j) % len(own)] for j in range(int(rng.integers(0, 4)))))).upper() + str(rng.choice(["!!", "!!", "", ".", ","]))
                text += w + " "
        text = text[:length]
        out.append((text, [s for s in spans if s[1] <= len(text)]))
    return out


def _soft(x: np.ndarray, a: np.ndarray, out: np.ndarray) -> None:
    """x / (1 + |x|), the squashing of states; a is a buffer."""
    np.abs(x, out=a)
    a += 1
    np.divide(x, a, out=out)


def _slope(gate: np.ndarray) -> np.ndarray:
    return np.where((gate > 0) & (gate < 1), np.float32(0.25), np.float32(0))


class Tagger:
    """Parameters: emb; w, u, b of both directions' gates (input, forget, output, new); out, bias; trans (from, to).

    Gates are x / 4 + 1 / 2 cut to 0..1, states x / (1 + |x|): both cost a few passes, a third of what sigmoid and tanh do.
    """

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"emb": rng.normal(0, 0.5, (CHARS, EMBED)).astype(np.float32), "w": g(2, EMBED, 4 * HIDDEN), "u": g(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32), "out": g(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1
        self.forbidden = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.forbidden[:, 2 + 2 * k] = -1e4
            self.forbidden[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.start = np.zeros(TAGS, np.float32)
        self.start[2::2] = -1e4

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(batch, length) ids to (batch, length, TAGS) scores; keep gets what the backward pass needs."""
        if keep is None:
            return self._read(ids)
        p, (n, m) = self.p, ids.shape
        both = np.stack([ids.T, ids.T[::-1]], 1)  # (m, 2, n)
        pre = np.matmul(p["emb"], p["w"]) + p["b"]  # gate inputs of each character: (2, CHARS, 4 HIDDEN)
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hs = np.empty((m, 2, n, HIDDEN), p["emb"].dtype)
        steps = []
        side = np.arange(2)[:, None]
        for t in range(m):
            z = pre[side, both[t]] + np.matmul(h, p["u"])
            gates, new = np.clip(0.25 * z[..., : 3 * HIDDEN] + 0.5, 0, 1), z[..., 3 * HIDDEN :] / (1 + np.abs(z[..., 3 * HIDDEN :]))
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            steps.append((i, f, o, new, c, h))
            c = f * c + i * new
            h = o * c / (1 + np.abs(c))
            hs[t] = h
            steps[-1] += (c,)
        hid = np.concatenate([hs[:, 0], hs[::-1, 1]], -1).transpose(1, 0, 2)  # (n, m, 2 HIDDEN)
        keep |= {"both": both, "steps": steps, "hid": hid}
        return hid @ p["out"] + p["bias"]

    def _read(self, ids: np.ndarray) -> np.ndarray:
        """The same scores, for reading much: buffers are reused, and the gates' scale is in the parameters."""
        p, (n, m), k = self.p, ids.shape, HIDDEN
        scale, plus = np.repeat(np.array([[0.25, 1], [0.5, 0]], np.float32), [3 * k, k], axis=1)
        pre = ((np.matmul(p["emb"], p["w"]) + p["b"]) * scale + plus).astype(np.float32)
        u = (p["u"] * scale).astype(np.float32)
        at = np.ascontiguousarray(ids.T)
        z, g = np.empty((2, n, 4 * k), np.float32), np.empty((2, n, 4 * k), np.float32)
        c, x, a = np.zeros((2, n, k), np.float32), np.empty((2, n, k), np.float32), np.empty((2, n, k), np.float32)
        hs = np.empty((m + 1, 2, n, k), np.float32)
        hs[m] = 0
        new = z[..., 3 * k :]
        for t in range(m):
            np.matmul(hs[t - 1], u, out=z)
            for s in range(2):
                pre[s].take(at[m - 1 - t if s else t], 0, g[s], "clip")
            z += g
            x[...] = new
            _soft(x, a, x)
            z.clip(0, 1, z)  # the gates' part is what counts; whole, it is one run
            c *= z[..., k : 2 * k]
            x *= z[..., :k]
            c += x
            _soft(c, a, x)
            np.multiply(z[..., 2 * k : 3 * k], x, out=hs[t])
        e = hs[:m, 0] @ p["out"][:k]
        e += hs[m - 1 :: -1, 1] @ p["out"][k:] if m else 0
        e += p["bias"]
        return e.transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch, and its gradients."""
        p, keep, (n, m) = self.p, {}, ids.shape
        e = self.emissions(ids, keep).astype(np.float64)
        trans = (p["trans"] + self.forbidden).astype(np.float64)
        # forward and backward sums as probabilities, scaled anew at each step
        w, top = np.exp(trans), e.max(2)
        x = np.exp(e - top[:, :, None]).transpose(1, 0, 2)
        alpha, beta, scale = np.empty((m, n, TAGS)), np.ones((m, n, TAGS)), np.empty((m, n, 1))
        alpha[0] = x[0] * np.exp(self.start)
        for t in range(m):
            if t:
                np.multiply(alpha[t - 1] @ w, x[t], out=alpha[t])
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(m - 2, -1, -1):
            beta[t] = (x[t + 1] * beta[t + 1] / scale[t + 1]) @ w.T
        z = np.log(scale[:, :, 0]).sum(0) + top.sum(1)
        de = (alpha * beta).transpose(1, 0, 2).copy()
        rows = np.arange(n)[:, None], np.arange(m)[None]
        de[(*rows, tags)] -= 1
        pair = w * (alpha[:-1].reshape(-1, TAGS).T @ (x * beta / scale)[1:].reshape(-1, TAGS))
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        gold = e[(*rows, tags)].sum() + trans[tags[:, :-1], tags[:, 1:]].sum() + self.start[tags[:, 0]].sum()
        de = (de / n).astype(np.float32)
        hid = keep["hid"]
        g = {"trans": (pair / n).astype(np.float32), "bias": de.sum((0, 1)), "out": hid.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)}
        dh_all = (de @ p["out"].T).transpose(1, 0, 2)
        dz = np.empty((m, 2, n, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        ut = p["u"].transpose(0, 2, 1)
        gu = np.zeros_like(p["u"])
        for t in range(m - 1, -1, -1):
            i, f, o, new, c0, h0, c1 = keep["steps"][t]
            dh = dh + np.stack([dh_all[t, :, :HIDDEN], dh_all[m - 1 - t, :, HIDDEN:]])
            tc = c1 / (1 + np.abs(c1))
            dc = dc + dh * o * (1 - np.abs(tc)) ** 2
            dz[t, ..., :HIDDEN] = dc * new * _slope(i)
            dz[t, ..., HIDDEN : 2 * HIDDEN] = dc * c0 * _slope(f)
            dz[t, ..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * _slope(o)
            dz[t, ..., 3 * HIDDEN :] = dc * i * (1 - np.abs(new)) ** 2
            gu += np.matmul(h0.transpose(0, 2, 1), dz[t])
            dh, dc = np.matmul(dz[t], ut), dc * f
        per = np.zeros((2, CHARS, 4 * HIDDEN), np.float32)
        for s in range(2):
            flat = keep["both"][:, s].ravel()
            order = np.argsort(flat, kind="stable")
            k, first = np.unique(flat[order], return_index=True)
            per[s, k] = np.add.reduceat(dz[:, s].reshape(-1, 4 * HIDDEN)[order], first, axis=0)
        g |= {"u": gu, "b": per.sum(1, keepdims=True), "w": np.matmul(p["emb"].T, per), "emb": np.matmul(per, p["w"].transpose(0, 2, 1)).sum(0)}
        return float((z.sum() - gold) / n), g

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, length), and each one's score over that of O."""
        e = self.emissions(ids)
        tags, over = np.zeros(ids.shape, np.int64), np.zeros(ids.shape, np.float32)
        some = np.flatnonzero(self._may_have_spans(e))
        if len(some):
            tags[some] = own = self.viterbi(e := e[some])
            over[some] = np.take_along_axis(e, own[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags, over

    def _may_have_spans(self, e: np.ndarray) -> np.ndarray:
        """False where no path can beat that of O alone: where no span gains anything over O, however it is entered and left."""
        trans = self.p["trans"] + self.forbidden
        plain = trans[0, 0]
        inside = np.array([max(trans[1 + 2 * k, 2 + 2 * k], trans[2 + 2 * k, 2 + 2 * k]) for k in range(len(KINDS))], np.float32)
        x = e.transpose(1, 0, 2)
        begin = x[:, :, 1::2] - x[:, :, :1] + (trans[:, 1::2].max(0) - plain)
        more = x[:, :, 2::2] - x[:, :, :1] + (inside - plain)
        leave = max(0.0, float(trans[1:, 0].max() - plain)) + 1e-3
        # first by a looser bound: the best beginning and all that any following tag could add
        some = np.flatnonzero((begin.max(0) + np.maximum(more, 0).sum(0)).max(1) + leave > 0)
        out = np.zeros(e.shape[0], bool)
        if not len(some):
            return out
        begin, more = begin[:, some], more[:, some]
        best = gain = begin[0]
        for t in range(1, len(begin)):  # gain: of the best span of each kind that has come to t
            gain = np.maximum(begin[t], gain + more[t])
            best = np.maximum(best, gain)
        out[some] = best.max(1) + leave > 0
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The tags of the best path of each row of scores."""
        trans, (n, m) = self.p["trans"] + self.forbidden, e.shape[:2]
        back = np.empty((m, n, TAGS), np.int8)
        best = e[:, 0] + self.start
        to = np.ascontiguousarray(trans.T)
        for t in range(1, m):
            x = best[:, None, :] + to  # (n, to, from)
            back[t] = k = x.argmax(2)
            best = np.take_along_axis(x, k[:, :, None], 2)[:, :, 0] + e[:, t]
        tags = np.empty((n, m), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(m - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


def _batch(own: list[tuple[str, list[tuple[int, int, str]]]], m: int) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((len(own), m), np.int64), np.zeros((len(own), m), np.int64)
    for i, (text, spans) in enumerate(own):
        ids[i, : len(text)] = char_ids(C.code_points(text))
        for a, b, kind in spans:
            k = KINDS.index(kind)
            tags[i, a] = 1 + 2 * k
            tags[i, a + 1 : b] = 2 + 2 * k
    return ids, tags


def train(snippets: list[str], n: int = 3200, epochs: int = 10, rate: float = 0.02, batch: int = 80, seed: int = 0, length: int = 128) -> Tagger:
    """Adam, with a rate that falls to nothing. A model is trained once a process for the same arguments."""
    return _train(tuple(snippets), n, epochs, rate, batch, seed, length)


@functools.lru_cache(4)
def _train(snippets: tuple[str, ...], n: int, epochs: int, rate: float, batch: int, seed: int, length: int) -> Tagger:
    own = examples(list(snippets), n, seed, length)
    ids, tags = _batch(own, length)
    model, rng = Tagger(seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * (n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n - batch + 1, batch):
            pick = order[a : a + batch]
            _, g = model.gradients(ids[pick], tags[pick])
            size = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
            step += 1
            for k, x in g.items():
                x = x * min(1.0, 10 / (size + 1e-9))
                m1[k] += 0.1 * (x - m1[k])
                m2[k] += 0.01 * (x * x - m2[k])
                model.p[k] -= (rate * (1 - step / (total + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, context: int = CONTEXT) -> Tagger:
    """Train on the generator's spans within the first `context` characters of at most train_rows documents, those of least hash of doc_id and these characters."""
    cut = docs.select(C.id_key().alias("doc_id"), F.substring(F.col("text").cast("string"), 1, context).alias("s")).where("s is not null")
    got = [r["s"] for r in C.sampled(cut, train_rows).collect()]
    return train([" ".join(w for w in s.split() if not DATA.search(w)) for s in got])


def reconcile(found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """A document's spans (start, end, kind, weight, cut at the left edge, cut at the right) made one set without overlaps."""
    joined: list[list] = []
    for a, b, k, w, left, right in sorted(found):
        for x in reversed(joined):
            if x[2] == k and a < x[1] and (left or x[5]):
                if b > x[1]:
                    x[1], x[3], x[5] = b, max(x[3], w) * (b - x[0]) / max(x[1] - x[0], b - a), right
                break
        else:
            joined.append([a, b, k, w, left, right])
    spans = sorted({(x[1], x[0], x[2]): x[3] for x in sorted(joined, key=lambda x: x[3])}.items())
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    ends = [s[0][0] for s in spans]
    for i, ((_, start, _), w) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], start, "right"))
        take = best[j][0] + max(w, 1e-6)
        best.append((take, 0, [i, j]) if take > best[i][0] else (best[i][0], 0, [-1, i]))
    out, at = [], len(spans)
    while at:
        i, j = best[at][2]
        if i >= 0:
            out.append((spans[i][0][1], spans[i][0][0], spans[i][0][2]))
        at = j
    return out[::-1]


def find(model: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    codes = [char_ids(C.code_points(t)).astype(np.int8) for t in texts]
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - (WINDOW - STRIDE)), STRIDE) if t else ():
            size = len(t) - s
            by_size.setdefault(WINDOW if size >= WINDOW else (size // LENGTH + 2) * LENGTH, []).append((i, s))
    found: list[list] = [[] for _ in texts]
    for width, todo in sorted(by_size.items()):
        for a in range(0, len(todo), batch):
            own = todo[a : a + batch]
            ids = np.zeros((len(own), width), np.int64)
            for r, (i, s) in enumerate(own):
                x = codes[i][s : s + WINDOW]
                ids[r, : len(x)] = x
            tags, over = model.decode(ids)
            for r in np.flatnonzero((tags > 0).any(1)).tolist():
                i, s = own[r]
                size = min(WINDOW, len(texts[i]) - s)
                g = tags[r, :size]
                for b in np.flatnonzero(g % 2 == 1).tolist():
                    e = b + 1
                    while e < size and g[e] == g[b] + 1:
                        e += 1
                    found[i].append((s + b, s + e, int(g[b] - 1) // 2, float(over[r, b:e].sum()), b == 0 and s > 0, e == WINDOW))
    return [[(a, b, KINDS[k]) for a, b, k in reconcile(f)] for f in found]


def personal_spans(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, span_start, span_end (exclusive, in characters), kind, value."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 20,000 numbers, whatever the corpus

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at, texts in C.groups(p["text"], GROUP_CHARS):
                rows = [(p["doc_id"].iloc[at + i], a, b, k, texts[i][a:b]) for i, spans in enumerate(find(shared.value, texts)) for a, b, k in spans]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "span_start", "span_end", "kind", "value"])

    own = docs.select(C.id_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, SPANS).withColumn("doc_id", C.id_back("doc_id"))


def redacted(docs: DataFrame, model: Tagger) -> DataFrame:
    """docs, all columns, with each span replaced by its kind in brackets."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def without(text: pd.Series) -> pd.Series:
        out = text.astype(object).to_numpy(copy=True)
        for at, texts in C.groups(text, GROUP_CHARS):
            for i, spans in enumerate(find(shared.value, texts)):
                t = texts[i]
                for a, b, k in reversed(spans):
                    t = f"{t[:a]}[{k}]{t[b:]}"
                if spans:
                    out[at + i] = t
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", without(F.col("text").cast("string")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return personal_spans(docs, fit(docs))
