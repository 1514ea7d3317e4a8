import numpy as np

from retrievium.llm import bitsliced as B

VECTORS = "vec_id long, embedding array<float>, label int, id long"


def brute(x, k):
    out = set()
    ids = sorted(x)
    for i in ids:
        s = sorted((-round(float(np.dot(x[i].astype(float), x[j].astype(float))), 6), j) for j in ids if j != i)
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(s[:k])}
    return out


def test_exact(spark, rng):
    x = {i: rng.normal(size=8).astype(np.float32) for i in range(150)}
    for i in range(20):  # ties
        x[200 + i] = x[i]
    df = spark.createDataFrame([(i, v.tolist(), 0, 7) for i, v in x.items()], VECTORS)
    for blocks in ({}, {"row_block": 40, "query_block": 30}):
        got = {(r.id, r.rank, r.hit) for r in B.top_k(df, 5, **blocks).collect()}
        assert got == brute(x, 5)
    few = {(r.id, r.rank, r.hit) for r in B.top_k(df, 5, query_step=50, row_block=40).collect()}
    assert few == {r for r in brute(x, 5) if r[0] % 50 == 0} and len({r[0] for r in few}) == 4


def test_sums_are_sums(rng):
    index = B.BitSlicedIndex(rng.normal(size=(130, 5)))
    q = np.minimum(((index.x - index.low) / index.step).astype(int), (1 << B.BITS) - 1)
    w = np.array([3, -5, 0, 63, -1])
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << p for p, s in enumerate(index.sums(w)))
    want = np.where(w >= 0, q, (1 << B.BITS) - 1 - q) @ np.abs(w)
    assert (total == want).all() and index.kth(index.sums(w), 7) == np.sort(want)[-7]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0, 0), (2, [1.0, 0.0], 0, 0), (2, [1.0, 0.0], 0, 0), (3, None, 0, 0), (4, [], 0, 0), (None, [1.0, 1.0], 0, 0), (5, [float("nan"), 1.0], 0, 0), (6, [0.0, 0.0], 0, 0), (7, [1.0, 2.0, 3.0], 0, 0)]
    got = {(r.id, r.rank, r.hit) for r in B.top_k(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {(1, 1, 2), (1, 2, 6), (2, 1, 1), (2, 2, 6), (6, 1, 1), (6, 2, 2)}
    assert B.top_k(spark.createDataFrame([], VECTORS)).count() == 0
