import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievium.llm import repeats as R
from retrievium.llm import suffixes as S

from .conftest import make, prose


def naive(t):
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0] * len(t)
    for k in range(1, len(t)):
        a, b = sa[k - 1], sa[k]
        while max(a, b) + lcp[k] < len(t) and t[a + lcp[k]] == t[b + lcp[k]]:
            lcp[k] += 1
    return sa, lcp


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.sampled_from([6, 10_000]), st.integers(1, 4))
def test_suffix_array(xs, top, times):
    t = [x * (top // 6) for x in xs] * times
    sa, lcp = S.suffix_array(np.array(t, np.int64), top, small=2)
    assert (list(sa), list(lcp)) == naive(t)


def test_queues_on_disk(tmp_path, rng):
    t = rng.integers(0, 20_000, 3000)
    t[2000:2500] = t[:500]
    disk = S.suffix_array(t, 20_000, S.Space(str(tmp_path), 1000), small=64)
    memory = S.suffix_array(t, 20_000)
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(disk, memory)) and int(np.max(disk[1])) == 500


def brute(rows, least):
    at = {}
    toks = {i: t.lower().split() for i, t in rows}
    for i, w in toks.items():
        for p in range(len(w) - least + 1):
            at.setdefault(tuple(w[p : p + least]), set()).add(i)
    out = set()
    for i, w in toks.items():
        own = [p for p in range(len(w) - least + 1) if len(at[tuple(w[p : p + least])]) > 1]
        while own:
            a = e = own.pop(0)
            while own and own[0] <= e + least:
                e = own.pop(0)
            out.add((i, a, e + least))
    return out


def test_against_brute_force(spark, rng):
    common = [prose(rng, n).split() for n in (60, 80, 51, 120, 50, 49)]
    rows = []
    for i in range(60):
        t = prose(rng, int(rng.integers(0, 150))).split()
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(t) + 1))
            c = list(common[int(rng.integers(len(common)))])
            if rng.random() < 0.4:
                c[int(rng.integers(len(c)))] = "other"
            t[at:at] = c
        rows.append((i, " ".join(t)))
    rows += [(60, "na " * 200), (61, "na " * 120 + "end"), (62, " ".join(common[0] * 2))]
    want = brute(rows, R.LEAST)
    for more in ({}, {"shard": 500, "small": 16, "memory": 256}):
        assert {tuple(r) for r in R.repeated_spans(make(spark, rows), **more).collect()} == want


def test_repeat_inside_one_of_two_documents(spark, rng):
    """Both of two documents hold the passage in one context; one of them has it once more, in a context of its own."""
    rows = []
    for i in range(0, 24, 2):
        line, head, mid = (prose(rng, 60) for _ in range(3))
        rows += [(i, f"{head} {line} {mid} {line}"), (i + 1, f"{head} {line} {mid}")]
    want = brute(rows, R.LEAST)
    assert all((i, 180, 240) in want or (i, 0, 240) in want for i in range(0, 24, 2))
    assert {tuple(r) for r in R.repeated_spans(make(spark, rows)).collect()} == want


def test_odd_rows(spark, odd, none):
    got = {tuple(r) for r in R.repeated_spans(odd).collect()}
    assert got == {(5, 0, 30_000), (6, 0, 30_000)}
    assert R.repeated_spans(none).count() == 0


def test_equal_segments_are_sorted_once(rng, monkeypatch):
    """Pieces that share a passage in contexts of their own, and pieces that share their anchor alone: only the passage is sorted."""
    least, k, far = 50, 25, 25
    hashes = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    passage, rows, want = hashes(30), [], set()
    for d in range(400):
        # 15 tokens before the anchor and 15 after it are shared: windows of 50 tokens from 10 to 15 before it
        tok = np.concatenate([hashes(10), passage, hashes(10)]) if d < 300 else hashes(2 * far)
        rows.append((7, 100 + d, far, d, d != 5, d, d, tok.tobytes()))
        if d < 300 and d != 5:
            want.add((d, (100 + d - 15) * (1 << 32) + 100 + d + k + 15))
    pieces = R.pd.DataFrame(rows, columns=["anchor", "pos", "n_left", "d", "open", "doc_id", "row", "tok"])
    sizes, suffix_array = [], R.suffix_array
    monkeypatch.setattr(R, "suffix_array", lambda text, *more: sizes.append(len(text)) or suffix_array(text, *more))
    for small in (16, R.SMALL):
        got = R._marks(pieces, least, k, S.Space(), small)
        assert set(zip(got["doc_id"].tolist(), got["s"].tolist())) == want and len(got) == len(want)
    assert sizes == [32, 32]
    assert not len(R._marks(pieces[300:].reset_index(drop=True), least, k, S.Space()))
