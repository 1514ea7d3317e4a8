import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievium import schemas
from retrievium.sources import connectors, jsonl, vectors
from retrievium.streaming import flows


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")


def test_scans(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    lines(p, {"doc_id": "x", "title": "școală"}, "", "{bad", {"doc_id": "y"})
    assert sorted(r.doc_id for r in jsonl.read_tolerant(spark, str(p), "document").collect()) == ["x", "y"]
    assert [r[jsonl.BAD] for r in jsonl.read_with_errors(spark, str(p), "document").collect() if r[jsonl.BAD]] == ["{bad"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        jsonl.read_strict(spark, str(p), "document").collect()
    jsonl.write(jsonl.read_tolerant(spark, str(p), "document"), str(tmp_path / "out"))
    assert jsonl.read_strict(spark, str(tmp_path / "out"), "document").where("title = 'școală'").count() == 1
    (tmp_path / "w.json").write_text(json.dumps([{"doc_id": "1"}, {"doc_id": "2"}], indent=1))
    assert jsonl.read_whole(spark, str(tmp_path / "w.json"), "document").count() == 2


def test_categories_leave_combined_files_out(spark, tmp_path):
    lines(tmp_path / "c/news/n.jsonl", {"doc_id": "news_1", "source": "digi"})
    lines(tmp_path / "c/news/news_combined.jsonl", {"doc_id": "news_1"})
    lines(tmp_path / "c/recipes/r.jsonl", {"doc_id": "rec_1"})
    got = jsonl.read_categories(spark, str(tmp_path / "c"), "document")
    assert sorted((r.category, r.doc_id) for r in got.collect()) == [("news", "news_1"), ("recipes", "rec_1")]
    assert jsonl.read_categories(spark, str(tmp_path / "c"), "document", skip_combined=False).count() == 3
    jsonl.write_by_category(got.drop("file"), str(tmp_path / "by"))
    assert (tmp_path / "by/category=news").is_dir()
    jsonl.write_report(connectors.counts_by_source(got), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.json"))) == 1


def test_config(spark, tmp_path):
    (tmp_path / "env").write_text("# no=1\nA=1=2\nnothing\n B = x \n")
    assert {r.key: r.value for r in jsonl.read_config(spark, str(tmp_path / "env")).collect()} == {"A": "1=2", "B": "x"}


def test_connectors(spark):
    raw = spark.createDataFrame([(0, "t", "i", "c"), (1, None, "i", "c")], ["k", "0", "1", "2"])
    assert [(r.doc_id, r.title) for r in connectors.recipes(raw, "k").orderBy("doc_id").collect()] == [("rec_000000", "t"), ("rec_000001", "")]
    n = spark.createDataFrame([(0, ["Ana", "are"], [0, 1])], "k long, tokens array<string>, ner_tags array<int>")
    assert connectors.ner(n, "k").first().text == "Ana are"
    a = connectors.outlet(spark.createDataFrame([(0, "t", "b"), (1, "u", "c")], "k long, title string, text string"), "digi", "k", 1)
    both = connectors.combine(connectors.stories(raw.withColumnRenamed("0", "title"), "k"), a)
    assert both.count() == 3 and "publication" in both.columns
    r = connectors.renumber(spark.createDataFrame([("x_9", 2), ("y_1", 1)], "doc_id string, p int"), ["p"])
    assert sorted((x.p, x.doc_id) for x in r.collect()) == [(1, "y_000000"), (2, "x_000001")]
    d = connectors.dedup_ids(spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "doc_id string, pos int, v string"), "pos")
    assert [x.v for x in d.collect()] == ["new"]
    lit = connectors.literal_rows(spark, [("n", "c")], [("w", "c")], range(2, 4))
    assert sorted(x.doc_id for x in lit.collect()) == ["cc_000001", "cc_000002", "cc_000003", "news_000000"]


def test_qrels(spark):
    s = spark.createDataFrame([("q", [("a",), ("b",), ("a",)])], "query_id string, positive_passages array<struct<docid:string>>")
    p = spark.createDataFrame([("q", ["a", "b"])], "query_id string, positive_passages array<string>")
    for raw in (s, p):
        flat = connectors.qrels_flat(raw)
        assert sorted(r.doc_id for r in flat.collect()) == ["a", "b"] and connectors.qrels_grouped(flat).first().num_positives == 2


def test_encoder_and_index(spark, tmp_path):
    vectors.register_encoder("length", lambda: lambda texts: np.array([[len(t), 1] for t in texts]))
    v = vectors.encode(spark.createDataFrame([("a", "xx"), ("b", None)], "doc_id string, text string"), "length")
    vectors.save_index(v, str(tmp_path / "index"))
    assert sorted((r.doc_id, list(r.vector)) for r in vectors.load_index(spark, str(tmp_path / "index")).collect()) == [("a", [2.0, 1.0]), ("b", [0.0, 1.0])]


def test_streams(spark, tmp_path):
    lines(tmp_path / "in/a.jsonl", {"doc_id": "1", "title": "Supă de pui bună", "source": "recipes-ro"})
    docs = flows.read_documents(spark, str(tmp_path / "in")).withColumn("body", F.coalesce("content", F.lit("")))
    q = flows.write_json(flows.generate_queries(docs).select("doc_id", "type", "num_queries"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [(r.doc_id, r.num_queries) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("1", 3)]


def test_schemas_parse():
    assert all(len(schemas.schema(n).fields) > 1 for n in schemas.NAMES)
