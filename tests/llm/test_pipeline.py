import corpus_pipeline as P
from retrievium.llm import ordermin, registry

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, had = docs.columns, docs.count()
    for i, (name, stage) in enumerate(P.STAGES):
        out = P.common.written(stage(spark, docs, SF))
        if i < len(P.STAGES) - 1:
            assert out.columns == columns, name
            n = out.count()
            assert 0 < n <= had, name
            docs, had = out, n
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    packed = {r.doc_id for r in out.collect()}
    assert packed == {r.doc_id for r in docs.collect() if r.text.split()}
    assert ordermin.near_duplicates(docs).count() == 0


def test_registry_has_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)


def test_components(spark):
    from retrievium.llm.components import components

    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
