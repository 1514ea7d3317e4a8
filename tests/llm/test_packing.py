from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievium.llm import packing as K

from .conftest import make


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(hist):
    got = Counter()
    for items, times in K.plan(hist, 30):
        assert sum(items) <= 30 and times > 0
        for x in items:
            got[x] += times
    assert got == Counter(hist)


def test_exact_complements_are_found():
    assert all(sum(items) == 100 for items, _ in K.plan({60: 3, 40: 3, 50: 2, 30: 2, 20: 2, 97: 1, 2: 1, 1: 1}, 100))


def check(docs, rows, capacity):
    got = K.pack(docs, capacity).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r.n_tokens))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and b[-1][1] <= capacity and all(x[1] == y[0] for x, y in zip(b, b[1:]))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    for i, n in Counter({i: len(t.split()) for i, t in rows if t}).items():
        own = sorted(by.get(i, []))
        assert sum(x[1] for x in own) == n and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    return bins


def test_round_trip(spark, rng):
    rows = [(i, " ".join(["w"] * int(n))) for i, n in enumerate(rng.integers(0, 300, 200))]
    bins = check(make(spark, rows), rows, 64)
    assert len(bins) <= 1.05 * -(-sum(len(t.split()) for _, t in rows) // 64) + 1


def test_odd_rows(spark, odd, none):
    got = K.pack(odd).collect()
    assert sum(r.doc_id == 5 for r in got) == -(-30_000 // K.CAPACITY) and sum(r.doc_id == 7 for r in got) == 2
    assert not {1, 2, 3} & {r.doc_id for r in got} and any(r.doc_id is None for r in got)
    assert len({(r.bin_id, r.bin_offset) for r in got}) == len(got)
    assert K.pack(none).count() == 0
