import numpy as np

from retrievium.llm import langid as L

from .conftest import make

WORDS = {"en": "the of and to in that is was for with he as his on".split(), "de": "der die und den von zu das mit sich des auf für ist im".split(), "fr": "le de la et les des est une dans que pour qui sur avec".split()}


def corpus(rng, n):
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang], 30)), lang, "s", 0))
    return out


def test_held_out_accuracy_and_rejection(spark, rng):
    model = L.fit(make(spark, corpus(rng, 150)))
    other = corpus(np.random.default_rng(9), 90)
    got = {r.doc_id: r for r in L.identify(make(spark, other), model).collect()}
    assert sum(got[r[0]].predicted == r[2] for r in other) >= 88
    assert sum(got[r[0]].rejected for r in other) <= 2
    junk = L.identify(make(spark, [(1, "12345 !!! 678"), (2, ""), (3, None)]), model).collect()
    assert all(r.rejected and r.predicted is None and r.confidence == 0 for r in junk)


def test_odd_rows(spark, odd, none, rng):
    model = L.fit(odd)  # one language only
    got = L.identify(odd, model).collect()
    assert len(got) == 12 and all(r.predicted in ("en", None) for r in got)
    kept = L.keep_accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in got)
    assert L.identify(none, L.fit(none)).count() == 0
    assert all(r.rejected for r in L.identify(odd, L.fit(none)).collect())


def test_scores_are_the_mean_of_features(rng):
    table = rng.normal(size=(1 << L.BITS, 3)).astype(np.float32)
    for text in ("hello wörld", "a", "ab  cd 12 ef", "x" * 500):
        mean, n, _ = L.scores([text, "other"], table)
        ids = np.concatenate([i[d == 0] for i, d in L.features([text, "other"])])
        assert n[0] == len(ids) and np.allclose(mean[0], table[ids].mean(0), atol=1e-4)


def test_rejects_what_it_was_not_trained_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    known = [r.text for r in docs.collect()]
    assert sum(model.predict([t])[2][0] for t in known) <= 2  # leaves what it knows alone
    rng = np.random.default_rng(3)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), n)) for n in (20, 40, 80, 400) for _ in range(100)]
    assert model.predict(letters)[2].mean() > 0.99
    others = ["Aceasta este o propoziție scrisă în limba română pentru a fi respinsă.", "Tämä on suomenkielinen lause, jota malli ei tunne lainkaan.", "Това е изречение на български език.", "これは日本語の文章です。とても良い天気ですね。"]
    assert model.predict(others)[2].all()


def test_shares_of_unknown_grams_by_brute_force(rng):
    texts = ["hello wörld", "a", "ab  cd 12 ef", "", "x" * 50]
    known = rng.random(1 << L.KNOWN_BITS) < 0.5
    got = L.scores(texts, np.zeros((1 << L.BITS, 1), np.float32), known)[2]
    for i, t in enumerate(texts):
        *_, (ids, _) = L.features([t], L.KNOWN_BITS)
        assert np.isclose(got[i], sum(not known[k] for k in ids) / (len(ids) + L.UNKNOWN_PRIOR))


def test_training_rows_are_bounded_and_told_apart_by_text(spark):
    rows = [(None, f"the of and to number {i}", "en", "s", 0) for i in range(300)] + [(1, "der die und", "de", "s", 0)] * 50
    seen = []
    real, L.train = L.train, lambda texts, labels, **k: seen.append(sorted(zip(texts, labels)))
    try:
        L.fit(make(spark, rows), train_rows=40)
        L.fit(make(spark, rows), train_rows=1000)
    finally:
        L.train = real
    assert len(seen[0]) == 40 == len(set(seen[0])) and len(seen[1]) == 301
