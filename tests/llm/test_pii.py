import itertools

import numpy as np
import pytest

from retrievium.llm import pii as P

from .conftest import make

PLAIN = ["the quick brown fox jumps over the lazy dog and runs away into the wood", "de la que en los menteur ción thation erly der und die keit lich"]


@pytest.fixture(scope="module")
def model():
    return P.train(PLAIN)


def test_held_out_spans(model):
    own = P.examples(PLAIN, 300, 77)
    got = P.find(model, [t for t, _ in own])
    right = sum(len(set(a) & set(b)) for (_, a), b in zip(own, got))
    assert right >= 0.95 * sum(len(a) for _, a in own) and right >= 0.95 * sum(map(len, got))


def test_gradients_are_slopes():
    m = P.Tagger(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, tags = P._batch(P.examples([], 3, 5, 40), 40)
    _, g = m.gradients(ids, tags)
    rng = np.random.default_rng(3)
    for k, v in m.p.items():
        at = (int(ids[0, 3]), 2) if k == "emb" else (0, 0) if k == "trans" else tuple(rng.integers(0, n) for n in v.shape)
        v0 = v[at]
        v[at] = v0 + 1e-3
        up = m.gradients(ids, tags)[0]
        v[at] = v0 - 1e-3
        down = m.gradients(ids, tags)[0]
        v[at] = v0
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    m = P.Tagger(2)
    m.p["trans"] = rng.normal(0, 1, (P.TAGS, P.TAGS)).astype(np.float32)
    e = rng.normal(0, 2, (20, 4, P.TAGS)).astype(np.float32)
    t = m.p["trans"] + m.forbidden
    paths = np.array(list(itertools.product(range(P.TAGS), repeat=4)))
    for row, got in zip(e, m.viterbi(e)):
        score = m.start[paths[:, 0]] + row[np.arange(4), paths].sum(1) + sum(t[paths[:, j], paths[:, j + 1]] for j in range(3))
        assert (paths[score.argmax()] == got).all()


def test_windows_without_search_are_plain(model):
    """Where the bound says that nothing beats O, the search finds nothing either; and it spares most of plain text."""
    texts = [t for t, _ in P.examples(PLAIN, 60, 5)] + PLAIN * 3
    ids = np.zeros((len(texts), P.WINDOW), np.int64)
    for r, t in enumerate(texts):
        ids[r, : len(t)] = P.char_ids(P.C.code_points(t))[: P.WINDOW]
    e = model.emissions(ids)
    some, tags = model._may_have_spans(e), model.viterbi(e)
    assert not tags[~some].any() and not some[-6:].all()
    slow = np.concatenate([model.emissions(ids[r : r + 1], {}) for r in range(len(ids))])
    assert np.abs(slow - e).max() < 0.01


def test_long_texts_are_read_whole(model):
    text = " ".join(PLAIN * 400) + " mail me@site.example.com or +1 (555) 123-4567 " + " ".join(PLAIN * 400) + " ip 192.0.2.14"
    got = P.find(model, [text, "", "ip 192.0.2.14"])
    assert [text[a:b] for a, b, _ in got[0]] == ["me@site.example.com", "+1 (555) 123-4567", "192.0.2.14"] and got[1] == [] and got[2] == [(3, 13, "ip")]
    assert P.find(model, ["ip 192.0.2.14"])[0] == got[2]  # whatever else is decoded with it


def test_reconcile_is_the_best_of_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        spans = {}
        for _ in range(int(rng.integers(0, 7))):
            a = int(rng.integers(0, 30))
            spans[(a, a + int(rng.integers(1, 12)), int(rng.integers(0, 5)))] = float(rng.integers(1, 9))
        got = P.reconcile([(*k, w, False, False) for k, w in spans.items()])
        best = max(sum(w for k, w in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans.items(), n) if all(x[0][1] <= y[0][0] or y[0][1] <= x[0][0] for x, y in itertools.combinations(c, 2)))
        assert sum(spans[k] for k in got) == best and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_reconcile_joins_and_chooses():
    assert P.reconcile([(90, 160, 4, 50.0, False, True), (96, 170, 4, 55.0, True, False)]) == [(90, 170, 4)]
    assert P.reconcile([(0, 10, 0, 5.0, False, False), (8, 20, 1, 9.0, False, False), (20, 25, 2, 1.0, False, False)]) == [(8, 20, 1), (20, 25, 2)]
    assert P.reconcile([]) == []


def test_odd_rows(spark, odd, none, model):
    assert P.personal_spans(none, model).count() == 0
    assert P.redacted(odd, model).columns == odd.columns and P.redacted(odd, model).count() == 12
    rows = [(None, "ip 10.1.2.3 ok"), (1, "ip 10.1.2.3 ok"), (1, "ip 10.1.2.3 ok"), (2, None), (3, "")]
    got = [(r.doc_id, r.kind, r.value) for r in P.personal_spans(make(spark, rows), model).collect()]
    assert sorted(got, key=str) == sorted([(None, "ip", "10.1.2.3"), (1, "ip", "10.1.2.3"), (1, "ip", "10.1.2.3")], key=str)
    assert P.redacted(make(spark, rows), model).where("doc_id = 1").first().text == "ip [ip] ok"
