import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievium.llm import lines as L

from .conftest import make


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        keep = []
        for line in (text or "").split("\n"):
            x = line.strip()
            if not x or x not in seen:
                keep.append(line)
            seen.add(x)
        out.append((i, None if text is None else "\n".join(keep)))
    return sorted(out)


def test_against_brute_force(spark, rng):
    rows = [(i, "\n".join(rng.choice([f" line {j}" for j in range(60)] + ["", "  "], int(rng.integers(0, 9))))) for i in range(80)] + [(80, None), (81, "")]
    assert sorted((r.doc_id, r.text) for r in L.dedup_lines(make(spark, rows)).collect()) == brute(rows)


def state(store):
    """The exact table, and the fingerprints of each shard's filter, wherever in their buckets they are."""
    filters = {r.shard: L.CuckooFilter.from_bytes(bytes(r.blob)) for r in store.filters.collect()}
    refs = sorted(map(tuple, store.refs.collect()))
    for h1, h2, n in refs:
        assert n > 0 and filters[h2 % store.shards].contains(np.array([h1], np.int64).view(np.uint64)).all()
    return refs, {k: (f.size, sorted(f.table[f.table > 0].tolist())) for k, f in filters.items() if f.size}


@pytest.mark.parametrize("per_shard", [8, 1 << 20])  # several shards, which grow; one
def test_insert_and_delete_are_inverse(spark, rng, per_shard):
    a = [(i, "\n".join(rng.choice([f"l{j}" for j in range(40)], 5))) for i in range(20)]
    b = [(100 + i, "\n".join(rng.choice([f"l{j}" for j in range(60)], 5))) for i in range(20)]
    store = L.LineStore(spark, per_shard)
    store.insert(make(spark, a))
    before = state(store)
    first = sorted((r.doc_id, r.text) for r in store.insert(make(spark, b)).collect())
    assert first == [r for r in brute(a + b) if r[0] >= 100]
    assert sum(n for *_, n in state(store)[0]) == 200
    store.delete(make(spark, b))
    assert state(store) == before
    assert sorted((r.doc_id, r.text) for r in store.insert(make(spark, b)).collect()) == first
    with pytest.raises(ValueError):
        store.delete(make(spark, [(1, "never seen")]))
    now = state(store)
    with pytest.raises(ValueError):
        store.delete(make(spark, b + b))
    assert state(store) == now
    store.delete(make(spark, a + b))
    assert state(store) == ([], {})
    assert [r.text for r in store.insert(make(spark, [(1, "never seen")])).collect()] == ["never seen"]


def test_full_filters_are_made_anew(spark):
    store = L.LineStore(spark)
    store.insert(make(spark, [(0, "first")]))
    store.insert(make(spark, [(1, "\n".join(f"line {i}" for i in range(3000)))]))
    assert len(state(store)[0]) == 3001
    assert [r.text for r in store.insert(make(spark, [(2, "line 7\nother\nfirst")])).collect()] == ["other"]


def test_odd_rows_in_a_store(spark, odd, none):
    store = L.LineStore(spark)
    assert store.insert(none).count() == 0
    store.insert(odd)
    before = state(store)
    again = store.insert(odd)
    assert again.columns == odd.columns and {(r.doc_id, r.text) for r in again.collect()} >= {(None, None), (None, ""), (4, ""), (2, ""), (3, "   \n\t\n ")}
    store.delete(odd)
    store.delete(none)
    assert state(store) == before


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), min_size=1, max_size=3000, unique=True))
def test_cuckoo_filter(xs):
    h = np.array(xs, np.uint64)
    f = L.CuckooFilter(2 * len(h) + 16)
    assert f.insert(h) and f.contains(h).all()
    f.delete(h)
    assert not f.table.any()


def test_odd_rows(spark, odd, none):
    out = L.dedup_lines(odd, "n_gone_")
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.columns == [*odd.columns, "n_gone_"] and out.count() == 12
    assert (7, "same text here") in got and (6, "") in got and (1, None) in got and (3, "   \n\t\n ") in got
    kept = L.keep_lines(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 5, 7} and 6 not in {r.doc_id for r in kept.collect()}
    assert L.dedup_lines(none).count() == 0
