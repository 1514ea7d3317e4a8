import numpy as np

from retrievium.plans import pipeline


def test_whole_and_single_steps(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) + 5 * (i % 3)).tolist(), i % 3) for i in range(60)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>, label int")
    q = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and a[0] != b[0]], "query_id long, doc_id long")
    done = pipeline.run(spark, v.select("doc_id", "vector"), q, str(tmp_path))
    report = {r.metric: r["mean"] for r in done["report"].collect()}
    assert report["mrr"] > 0.9 and 0.9 < report["precision"] <= 1
    assert done["mine"].count() == 180 and done["split"].groupBy("query_id").agg({"split": "count"}).count() == 60
    assert done["split"].select("query_id", "split").distinct().count() == 60
    again = pipeline.run(spark, v, q, str(tmp_path), pipeline.Config(steps=("report",)))
    assert {r.metric: r["mean"] for r in again["report"].collect()} == report
