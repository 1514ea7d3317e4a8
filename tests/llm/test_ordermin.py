import numpy as np

from retrievium.llm import ordermin as O

from .conftest import make, prose


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_is_exact_within_the_limit(rng):
    for _ in range(1500):
        a = rng.integers(0, int(rng.choice([2, 5, 50])), int(rng.integers(1, 40)))
        b = list(a)
        for _ in range(int(rng.integers(0, 12))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 50, int(rng.integers(0, 2))).tolist()
        limit, want = int(rng.integers(0, 14)), edit_distance(a.tolist(), b)
        assert O.distance(a, np.array(b, a.dtype), limit) == (want if want <= limit else -1)


def grouped(rows):
    """Brute force: connected components over all pairs."""
    toks = [(i, t.lower().split()) for i, t in rows if t and t.split()]
    parent = list(range(len(toks)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(toks)):
        for y in range(x):
            a, b = toks[x][1], toks[y][1]
            if edit_distance(a, b) <= (1 - O.THRESHOLD) * max(len(a), len(b)) + 1e-9:
                parent[root(x)] = root(y)
    by = {}
    for x, (i, _) in enumerate(toks):
        by.setdefault(root(x), []).append(i)
    return {(i, min(g), len(g)) for g in by.values() if len(g) > 1 for i in g}


def test_against_brute_force(spark, rng):
    rows = []
    for base in range(12):
        text = prose(rng, 60).split()
        for _ in range(int(rng.integers(1, 6))):
            t = list(text)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = "zz%d" % rng.integers(1000)
            rows.append((len(rows), " ".join(t)))
    got = {tuple(r) for r in O.near_duplicates(make(spark, rows)).collect()}
    want = grouped(rows)
    assert got == want  # copies this near share a sketch
    by_join = {tuple(r) for r in O.near_duplicates(make(spark, rows), broadcast_nodes=0).collect()}
    assert by_join == got


def test_copies_far_from_each_other_join_their_original(spark, rng):
    """Each copy is 18% from its original and over 20% from most others, so it joins the group only if it meets the original."""
    rows, want = [], set()
    for _ in range(3):
        text, first = prose(rng, 100).split(), len(rows)
        want |= {(first + i, first, 46) for i in range(46)}
        rows.append((len(rows), " ".join(text)))
        for at in range(0, 90, 2):
            rows.append((len(rows), " ".join(text[:at] + [f"v{len(rows)}x{j}" for j in range(18)] + text[at + 18 :])))
    assert {tuple(r) for r in O.near_duplicates(make(spark, rows)).collect()} == want


def test_order_matters(rng):
    a = prose(rng, 200).split()
    from retrievium.llm import common as C

    same, turned = " ".join(a), " ".join(a[100:] + a[:100])
    s = O.sketches(C.tokenize([same, same, turned]))
    assert (s[0] == s[1]).all() and (s[0] == s[2]).mean() < 0.9


def test_rows_of_one_id_are_told_apart(spark, rng):
    """Null and repeated ids: only the row that is in a group may go, and each group keeps one."""
    a, b = prose(rng, 60), prose(rng, 60)
    others = [prose(rng, 40) for _ in range(6)]
    rows = [(None, a), (4, a), (4, b), (5, b)] + [(None, x) for x in others[:3]] + [(4, x) for x in others[3:]]
    kept = [(r.doc_id, r.text) for r in O.keep_first(make(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (4, b), *rows[4:]], key=str)


def test_odd_rows(spark, odd, none):
    got = {tuple(r) for r in O.near_duplicates(odd).collect()}
    assert {(5, 5, 2), (6, 5, 2), (7, 7, 2)} <= got and not {1, 2, 3, 8} & {g[0] for g in got}
    kept = O.keep_first(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 6 not in ids and ids.count(7) == 1 and {1, 2, 3, 4, 5, 8, 9} <= set(ids) and ids.count(None) == 2
    assert O.near_duplicates(none).count() == 0 and O.keep_first(none).count() == 0


def test_buckets_beyond_a_tile_give_the_same(spark, rng, monkeypatch):
    head = prose(rng, 100).split()
    rows = [(i, " ".join(head + prose(rng, 28).split())) for i in range(40)]  # share sketches, and are mostly too far apart
    rows += [(100 + i, " ".join(head[:at] + [f"u{i}"] * 6 + head[at + 6 :])) for i, at in enumerate(range(0, 90, 9))]
    want = {tuple(r) for r in O.near_duplicates(make(spark, rows)).collect()}
    assert want == grouped(rows)
    monkeypatch.setattr(O, "TILE", 5)
    assert {tuple(r) for r in O.near_duplicates(make(spark, rows)).collect()} == want


def test_pairs_near_the_threshold_share_a_sketch(rng):
    for similarity, least in ((0.80, 0.85), (0.85, 0.95), (0.90, 0.99)):
        hit = 0
        for _ in range(150):
            a = prose(rng, 100).split()
            b = list(a)
            for at in rng.choice(100, round(100 * (1 - similarity)), replace=False):
                b[at] = f"zz{at}"
            s = O.sketches(O.C.tokenize([" ".join(a), " ".join(b)]))
            hit += (s[0] == s[1]).any()
        assert hit >= least * 150, (similarity, hit)


def test_pairs_far_apart_are_told_before_the_band_widens(rng, monkeypatch):
    a = rng.integers(0, 1 << 30, 400)
    b, c = a.copy(), a.copy()
    b[100:190] = rng.integers(0, 1 << 30, 90)  # 22 %
    c[rng.choice(400, 70, replace=False)] = 5
    turned = np.concatenate([a[:100], np.concatenate([a[q : q + 2] for q in range(298, 98, -2)]), a[300:]])  # the same tokens in another order
    bands, band = [], O._band
    monkeypatch.setattr(O, "_band", lambda x, y, k: bands.append(k) or band(x, y, k))
    assert O.distance(a, b, 80) == O.distance(a, turned, 60) == -1 and bands == [24, 24]
    assert O.distance(a, c, 80) == 70
    for _ in range(60):
        few = rng.integers(0, int(rng.choice([3, 30, 1000])), 150)
        other = few.tolist()
        for _ in range(int(rng.integers(20, 60))):
            at = int(rng.integers(0, len(other)))
            other[at : at + int(rng.integers(0, 2))] = rng.integers(0, 1000, int(rng.integers(0, 2))).tolist()
        want = edit_distance(few.tolist(), other)
        assert O.distance(few, np.array(other), 40) == (want if want <= 40 else -1)


def test_strangers_in_a_large_group_meet_all_of_it_once(rng):
    """Of pairs that may be near, those of one tile with different labels, and no others, are found; large tiles of one label cost little."""
    rows = []
    for key in range(40):
        for m in range(int(rng.integers(2, 30))):
            tokens = rng.integers(0, 40, n := int(rng.integers(20, 40)))
            rows.append((key, 0, key % 3 and 1, bytes([key, m]), bytes([int(rng.choice([0, 0, 0, 1, 2]))]), int(rng.integers(2)) if key % 3 else 0, n, np.bincount(tokens, minlength=O.HIST).astype(np.uint16)))
    p = O.pd.DataFrame([(*r[:-1], r[-1].tobytes()) for r in rows], columns=["key", "x", "y", "node", "label", "part", "n", "hist"])
    want = set()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            d, most = a[-1].astype(int) - b[-1], 0.5 * max(a[6], b[6])
            if a[0] == b[0] and a[4] != b[4] and (a[1] == a[2] or a[5] != b[5]) and max(d.clip(0).sum(), (-d).clip(0).sum()) <= most:
                want.add((min(a[3], b[3]), max(a[3], b[3])))
    got = [tuple(r) for r in O._met(p.sample(frac=1, random_state=1), 0.5).itertuples(index=False)]
    assert len(want) > 100 and sorted(got) == sorted(want)
