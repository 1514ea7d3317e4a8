from pyspark.sql import functions as F

from retrievium.functions import ranking as R
from retrievium.functions import text as T
from retrievium.functions import vectors as V
from retrievium.operators import evaluate, profile, querygen, splits, triplets


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.ws_tokens("a"), a="  Școala  are\tcopii? ") == ["școala", "are", "copii?"]
    assert one(spark, T.word_tokens("a"), a="Școala_1 are, copii?") == ["școala_1", "are", "copii"]
    assert one(spark, T.ws_tokens(F.lit(None).cast("string"))) == [] and one(spark, T.ws_tokens("a"), a="") == []
    assert one(spark, T.fold_diacritics("a"), a="ăâîșşțţ") == "aaisstt"


def test_overlaps(spark):
    assert one(spark, T.lexical_overlap("a", "b"), a="a b c", b="B C d") == 0.5
    assert one(spark, T.lexical_overlap("a", "b"), a="", b="b") == 0.0
    assert one(spark, T.ngram_overlap("a", "b", 2), a="a b c", b="a b d") == 1 / 3
    assert one(spark, T.ngram_overlap("a", "b", 2), a="a", b="a b") == 0.0


def test_concepts_and_terms(spark):
    assert one(spark, T.concepts("a", 2), a="zebra apple apple mango mango care x_yz abc1") == ["apple", "mango"]
    assert one(spark, T.key_terms("a"), a="The big, bad wolf! din pădure verde") == ["big", "bad", "wolf"]


def test_query_types(spark):
    for q, want in (("cât de mare", "numeric"), ("Unde este", "location"), ("cine a scris", "person"), ("ce este apa", "entity"), ("povestește", "description")):
        assert one(spark, T.query_type("a"), a=q) == want
    assert one(spark, T.is_trivial("a"), a="Ce este apa?") and not one(spark, T.is_trivial("a"), a="De ce este apa")


def test_words_of_query_types_end_at_other_letters(spark):
    for q, want in (("o ítara", "location"), ("costé", "numeric"), ("costa", "description"), ("_cost", "description"), ("cost1", "description"), ("unde", "location")):
        assert one(spark, T.query_type("a"), a=q) == want


def test_sentences(spark):
    assert one(spark, T.first_sentences("a", 1), a=" One. Two! Three") == "One."
    assert one(spark, T.well_formed("a"), a="one") == "One." and one(spark, T.well_formed("a"), a="one!") == "One!" and one(spark, T.well_formed("a"), a="") == ""


def test_first_line_keeps_digits_at_its_ends(spark):
    assert one(spark, T.first_nonblank_line("a"), a="  0 555-0 \nb") == "0 555-0" and one(spark, T.first_nonblank_line("a"), a=" \n1 a1") == "1 a1"


def test_well_formed_begins_with_one_capital(spark):
    for a, want in (("ßa", "ẞa."), ("ŉa", "ŉa."), ("ᾳa", "ᾼa."), ("ﬁa", "ﬁa."), ("ça", "Ça."), ("a.\n", "A.\n."), ("a!\u2028", "A!\u2028.")):
        assert one(spark, T.well_formed("a"), a=a) == want
    assert one(spark, T.first_sentences("a"), a="a.\x0bb. c") == "a.\x0bb."


def test_falsy_is_not_missing(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b")], "a string, b string")
    assert [r.x for r in df.select(T.falsy_coalesce("a", "b").alias("x")).collect()] == ["b", "b", "a"]
    assert [r.x for r in df.select(T.missing_coalesce("a", "b").alias("x")).collect()] == ["", "b", "a"]
    assert [r.x for r in df.select(T.document_text("a", "b").alias("x")).collect()] == ["b", "b", "a b"]


def test_published_metrics(spark):
    """One relevant document at rank 1 of ten: the published baseline."""
    rel = F.array(*[F.lit(x) for x in [1] + [0] * 9])
    assert abs(one(spark, R.ndcg_fixed_k(rel, 10)) - 0.22009176629808017) < 1e-15
    assert one(spark, R.ndcg_truncated(rel, F.lit(1), 10)) == 1.0
    assert one(spark, R.precision(rel, 10)) == 0.1 and one(spark, R.reciprocal_rank(rel)) == 1.0 and one(spark, R.ap_over_found(rel, 10)) == 1.0
    none = F.array(*[F.lit(0)] * 3)
    assert one(spark, R.reciprocal_rank(none)) == 0 and one(spark, R.ap_over_found(none, 10)) == 0 and one(spark, R.recall(none, F.lit(0), 10)) == 0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert one(spark, V.squared_l2(a, b)) == 25 and one(spark, V.l2(a, b)) == 5 and one(spark, V.dot(a, b)) == 16
    assert one(spark, V.cosine(F.array().cast("array<double>"), b)) == 0 and one(spark, V.margin_loss(a, a, b)) == 0 and one(spark, V.margin_loss(a, b, a)) == 5.5


def test_quality_of_fixed_queries(spark):
    """Averages that can be worked out by hand where nothing overlaps."""
    docs = spark.createDataFrame([(1, "Titlu", "unu doi trei patru cinci sase", "histnero"), (2, "", "x", "recipes-ro"), (3, None, None, "ro-stories"), (4, "a", "b", None)], "doc_id long, title string, body string, source string")
    got = {r.doc_id: r for r in querygen.with_metrics(querygen.generate(docs)).collect()}
    assert abs(got[1].metrics.avg_quality - (0.6 + 0.6 + 0.335) / 3) < 1e-4
    assert got[2].metrics is None and got[3].queries == [] and got[4].type == "unknown"


def test_split_sizes(spark):
    for n, want in ((3000, (2100, 450, 450)), (5, (3, 0, 2)), (1, (0, 0, 1)), (0, (0, 0, 0))):
        got = {r.split: r.n for r in splits.split_stats(splits.split_rows(spark.range(n), "id")).collect()}
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want
    got = {r.split: r.n for r in splits.split_stats(splits.split_rows(spark.range(5), "id", cumulative=True)).collect()}
    assert (got["train"], got["val"], got["test"]) == (3, 1, 1)
    again = [splits.split_rows(spark.range(50), "id").orderBy("id").collect() for _ in range(2)]
    assert again[0] == again[1]


def test_positions_are_dense(spark):
    df = spark.range(0, 1000, 7).repartition(5)
    assert [r.pos for r in splits.dense_positions(df, "id").orderBy("id").collect()] == list(range(143))


def test_gate(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.6), (0.1, 0.2, 0.5), (0.1, 0.3, 0.6), (None, None, None), (None, 0.5, 0.7)], "ngram_overlap double, diversity_score double, entailment_score double")
    got = [(r.is_valid, r.issues) for r in triplets.gate(df).collect()]
    assert [g[0] for g in got] == [False, False, True, False, True]
    assert got[1][1] == ["Low diversity", "Low entailment"] and got[3][1] == ["Missing metrics"]
    assert triplets.gate_overview(triplets.gate(df.limit(0))).first().pass_rate == 0


def test_structure_errors(spark):
    df = spark.createDataFrame([("q", 1, [2]), (None, None, None), ("q", 1, [])], "q string, p long, n array<long>")
    got = [len(r.e) for r in df.select(triplets.structure_errors(F.col("q"), F.col("p"), F.col("n")).alias("e")).collect()]
    assert got == [0, 3, 1]


def test_histogram_leaves_out_its_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.69,), (1.0,)], "v double")
    got = profile.histogram(df, "v", profile.QUALITY_EDGES).collect()
    assert [r.n for r in got] == [1, 1, 1, 0] and got[0].overflow == 1


def test_improvement_of_a_zero_baseline(spark):
    a = spark.createDataFrame([("m", 0.0), ("n", 0.5)], "metric string, mean double")
    b = spark.createDataFrame([("m", 0.2), ("n", 0.75), ("o", 1.0)], "metric string, mean double")
    got = {r.metric: r.percent for r in evaluate.improvement(a, b).collect()}
    assert got == {"m": 0.0, "n": 50.0}


def test_truncated_percent(spark):
    assert one(spark, T.truncated_percent(F.lit(769), F.lit(1000))) == 76
