from retrievium.llm import decontaminate as D

from .conftest import make, prose

ITEMS = "item_id long, text string"


def test_both_ways_find_the_same(spark, rng):
    items = [(i, prose(rng, 20)) for i in range(10)] + [(10, "too short"), (11, None), (12, "")]
    bench = spark.createDataFrame(items, ITEMS)
    rows = []
    for i in range(40):
        t = prose(rng, 60).split()
        if i % 3 == 0:
            a = int(rng.integers(0, 10))
            t[20:20] = items[i % 10][1].upper().split()[a : a + 10]
        rows.append((i, ", ".join(t)))
    docs = make(spark, rows)
    few = sorted(map(tuple, D.contaminated_spans(docs, bench).collect()))
    assert few == sorted(map(tuple, D.contaminated_spans(docs, bench, broadcast_grams=3).collect()))
    assert {r[0] for r in few} >= {i for i in range(40) if i % 3 == 0}
    grams = {tuple(t.split()[k : k + D.N]) for _, t in items[:10] for k in range(13)}
    for i, a, e, n in few:
        w = rows[i][1].lower().replace(",", "").split()
        assert n <= e - a - D.N + 1 and tuple(w[a : a + D.N]) in grams and tuple(w[e - D.N : e]) in grams
    clean = D.keep_clean(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {r[0] for r in few}
    assert D.contaminated_spans(D.remove_spans(docs, bench), bench).count() == 0


def test_rows_of_one_id_are_told_apart(spark, rng):
    leak = prose(rng, 20)
    bench = spark.createDataFrame([(1, leak)], ITEMS)
    rows = [(i, t) for i in (None, 4) for t in (f"before {leak}", "clean text", prose(rng, 30))]
    for most in (1000, 3):  # by broadcast, and by shuffle
        kept = {(r.doc_id, r.text) for r in D.keep_clean(make(spark, rows), bench, broadcast_grams=most).collect()}
        assert kept == {r for r in rows if leak not in r[1]}
        cut = {(r.doc_id, r.text) for r in D.remove_spans(make(spark, rows), bench, broadcast_grams=most).collect()}
        assert cut == {(i, t.replace(leak, "")) for i, t in rows}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text here same text here same text here")], ITEMS)
    assert D.contaminated_spans(odd, bench).count() == 0
    assert D.keep_clean(odd, bench).count() == 12 and D.keep_clean(odd, bench).columns == odd.columns
    assert D.contaminated_spans(none, bench).count() == 0 and D.contaminated_spans(odd, spark.createDataFrame([], ITEMS)).count() == 0
    cut = D.remove_spans(odd, bench)
    assert cut.columns == odd.columns and sorted((r.doc_id, r.text) for r in cut.where("doc_id is not null").collect() if r.text) == sorted((r.doc_id, r.text) for r in odd.where("doc_id is not null").collect() if r.text)
