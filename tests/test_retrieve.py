import math

import numpy as np
import pytest

from retrievium.operators import marco, retrieve

V = "query_id long, vector array<float>"


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_nearest_by_broadcast_and_by_tiles(spark, metric):
    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=6).astype(np.float32) for i in range(300)}
    for i in range(10):  # ties
        x[400 + i] = x[i]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], V)
    c = df.withColumnRenamed("query_id", "doc_id")
    want = set()
    for i, a in x.items():
        f = {"l2": lambda b: round(float(((a.astype(float) - b) ** 2).sum()), 6), "ip": lambda b: -round(float(a.astype(float) @ b), 6), "cosine": lambda b: -round(float(a.astype(float) @ b / np.linalg.norm(a.astype(float)) / np.linalg.norm(b.astype(float))), 6)}[metric]
        want |= {(i, r + 1, j) for r, (_, j) in enumerate(sorted((f(b.astype(float)), j) for j, b in x.items())[:7])}
    for more in ({}, {"broadcast_rows": 5, "row_block": 100, "query_block": 70}):
        assert {(r.query_id, r.rank, r.doc_id) for r in retrieve.nearest(df, c, 7, metric, **more).collect()} == want


def test_nearest_of_odd_rows(spark):
    q = spark.createDataFrame([(1, [1.0]), (None, [1.0]), (2, []), (3, None)], V)
    c = q.withColumnRenamed("query_id", "doc_id")
    assert [(r.query_id, r.doc_id) for r in retrieve.nearest(q, c, 3).collect()] == [(1, 1)]
    assert retrieve.nearest(q.limit(0), c, 3).count() == 0 and retrieve.nearest(q, c.limit(0), 3).count() == 0


def bm25(query, docs):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for i, d in docs.items()}


def test_bm25_with_repeated_tokens_and_zero_fill(spark):
    docs = {0: "a b c", 1: "a a d e", 2: "f g", 3: "common a", 4: "x y z", 5: ""}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, body string")
    q = spark.createDataFrame([(0, "d d f", 2), (1, "nothing here", 0), (2, "", None)], "query_id long, query string, own long")
    toks = {i: t.split() for i, t in docs.items()}
    for exclude in (None, "own"):
        got = {}
        for r in retrieve.top_with_fill(retrieve.bm25_scores(q, d), q, d, 4, exclude).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        for row in q.collect():
            s = {i: round(v, 6) for i, v in bm25(row.query.split(), toks).items() if not (exclude and i == row.own)}
            assert got[row.query_id] == sorted(s, key=lambda i: (-s[i], i))[:4]


def test_records(spark):
    docs = spark.createDataFrame([(0, "Ciorba de burta", "Se fierbe burta. Apoi se drege.", "recipes-ro"), (1, "", "ciorba buna de fasole", "x"), (2, None, None, "news")], "doc_id long, title string, body string, source string")
    got = {r.query_id: r for r in marco.records(docs, marco.queries(docs), 3).collect()}
    assert got[0].query == "cum se prepară ciorba de burta?" and got[0].passages.is_selected == [1, 0, 0]
    assert got[0].answers == ["Se fierbe burta."] and got[1].wellFormedAnswers == ["Ciorba buna de fasole."]
    assert got[2].query == "ce este acest document?" and got[2].answers == []


def _by_force(qid, q, ids, x, k, metric, other):
    want = set()
    for a, v in zip(qid, q.astype(float)):
        s = ((x - v) ** 2).sum(1) if metric == "l2" else -(x @ v) if metric == "ip" else -(x @ v) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(v), 1e-300)
        s = np.round(s, 6) + 0.0
        want |= {(int(a), r + 1, int(ids[j])) for r, j in enumerate([j for j in np.lexsort((ids, s)) if not (other and ids[j] == a)][:k])}
    return want


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("kind", ["plain", "far", "ties", "same", "large"])
def test_single_precision_loses_no_neighbour(metric, kind):
    rng = np.random.default_rng(2)
    ids = rng.permutation(5000)[:900]
    x = rng.normal(size=(900, 8))
    x = {"plain": x, "far": x * 0.01 + 1000, "ties": np.round(x), "same": np.ones((900, 8)), "large": x * 1e25}[kind]
    for other in (False, True):
        best = retrieve._Best(ids[:200], x[:200], 7, metric, other, 128)
        for a in range(0, 900, 250):
            best.add(ids[a : a + 250], x[a : a + 250])
        got = best.result().to_pylist()
        assert {(r["query_id"], r["rank"], r["doc_id"]) for r in got} == _by_force(ids[:200], x[:200], ids, x, 7, metric, other)


def test_few_pairs_are_computed_in_double(monkeypatch):
    """Of 2,000 x 4,000 pairs; all of them were ranked once."""
    n = []
    own = retrieve._Best._scores
    monkeypatch.setattr(retrieve._Best, "_scores", lambda self, i, x, j: n.append(len(i)) or own(self, i, x, j))
    x = np.random.default_rng(4).normal(size=(4000, 16)).astype(np.float32)
    best = retrieve._Best(np.arange(2000), x[:2000], 5, "l2", True, 512)
    best.add(np.arange(4000), x)
    assert len(best.result()) == 10_000 and sum(n) < 2000 * 4000 // 50


def test_large_query_side_comes_ranked_out_of_its_tasks(spark):
    """No window over the hits, as many tasks as blocks of queries, own ids left out."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], V)
    hits = retrieve.nearest(df, df.withColumnRenamed("query_id", "doc_id"), 3, "l2", broadcast_rows=5, query_block=20, other=True)
    assert "Window" not in hits._jdf.queryExecution().toString() and hits.rdd.getNumPartitions() == 3
    assert all(r.query_id != r.doc_id and r.score == 0 and r.doc_id % 7 == r.query_id % 7 for r in hits.collect()) and hits.count() == 180


def test_bm25_of_many_queries_equals_that_of_few(spark):
    """In small blocks, with odd rows: repeated tokens, none, unknown ones, tokens of all documents, an own document that isn't there. No row for each pair that shares a token."""
    rng = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in np.minimum(rng.pareto(0.7, 4000) * 2, 300)]
    docs = [(i * 3, " ".join(words[i * 19 : i * 19 + int(rng.integers(0, 40))] + ["all"] * (i % 3))) for i in range(150)]
    d = spark.createDataFrame([*docs, (1, None), (2, "")], "doc_id long, body string").repartition(3)
    q = spark.createDataFrame([(i, t + " new all all", i if i % 2 else None) for i, t in docs] + [(1001, "", 0), (1002, "nowhere", 7), (1003, None, None)], "query_id long, query string, own long")
    for exclude in (None, "own"):
        want = retrieve.top_with_fill(retrieve.bm25_scores(q, d), q, d, 5, exclude)
        got = retrieve.bm25_top(q, d, 5, exclude, postings_block=300, query_block=20, groups=2)
        key = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
        assert key(got) == key(want)
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "sum((((cast(times" not in plan


def test_records_without_texts(spark):
    docs = spark.createDataFrame([(0, "Ciorba de burta", "Se fierbe burta. Apoi se drege.", "recipes-ro"), (1, "", "ciorba buna de fasole", "x"), (2, None, None, "news")], "doc_id long, title string, body string, source string")
    whole, bare = ({r.query_id: r for r in marco.records(docs, marco.queries(docs), 3, texts=t).collect()} for t in (True, False))
    for i in whole:
        assert bare[i].passage_ids == whole[i].passage_ids and bare[i].answers == whole[i].answers and bare[i].wellFormedAnswers == whole[i].wellFormedAnswers and bare[i].passages.is_selected == whole[i].passages.is_selected
    assert len(bare) == 3
