"""Contract queries: each takes (spark, directory) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import concepts, evaluate, marco, profile, querygen, retrieve, splits, triplets
from ..sources import connectors
from . import adapters as A
from . import roundtrips
from .oracle import SQL as _SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(roundtrips.QUERIES)
SQL: dict[str, str] = _SQL | roundtrips.SQL
HALF = slice(0, 32)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column) -> Column:
    return F.round(c, 6)


# retrieval over vectors


@query
def knn_l2_topk(s: SparkSession, d: str) -> DataFrame:
    return A.neighbours(s, d, A.TOP).withColumnRenamed("score", "distance")


@query
def knn_l2_batch_rank(s: SparkSession, d: str) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return A.neighbours(s, d, A.TOP).groupBy("query_id").agg(F.array_join(x["doc_id"].cast("array<string>"), ",").alias("doc_ids"), F.min("score").alias("nearest"), F.max("score").alias("farthest"))


@query
def knn_inner_product(s: SparkSession, d: str) -> DataFrame:
    return A.neighbours(s, d, 10, "ip")


@query
def knn_cosine(s: SparkSession, d: str) -> DataFrame:
    return A.neighbours(s, d, 10, "cosine")


@query
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return A.table(s, d, "embeddings").select("vec_id", r6(V.norm(v)).alias("norm"), F.size(v).cast("long").alias("dim"))


@query
def label_centroid_cosine(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "embeddings")
    at = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = at.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("c"))
    return e.join(c, "label").select("vec_id", r6(V.cosine(F.col("embedding"), F.col("c"))).alias("cosine"))


# triplets


@query
def triplet_mining_flat(s: SparkSession, d: str) -> DataFrame:
    return A.mined(s, d)


@query
def triplet_mining_grouped(s: SparkSession, d: str) -> DataFrame:
    g = triplets.grouped(A.mined(s, d))
    return g.select("query_id", "positive_doc_id", F.array_join(F.col("negative_doc_ids").cast("array<string>"), ",").alias("negative_doc_ids"))


@query
def triplet_skipped(s: SparkSession, d: str) -> DataFrame:
    hits = A.neighbours(s, d, A.TOP).where("score < 1.2")
    return triplets.skipped(hits, A.vectors(s, d, "query_id"))


@query
def triplet_texts(s: SparkSession, d: str) -> DataFrame:
    t = triplets.with_texts(A.mined(s, d), A.documents(s, d).select("doc_id", "title", F.col("body").alias("content")))
    return t.select("query_id", "negative_doc_id", "positive_title", "negative_title", F.length("positive_content").cast("long").alias("positive_chars"), F.length("negative_content").cast("long").alias("negative_chars"))


@query
def training_examples(s: SparkSession, d: str) -> DataFrame:
    corpus = A.documents(s, d).select("doc_id", "title", F.col("body").alias("content"))
    t = triplets.with_texts(A.mined(s, d), corpus).join(corpus.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")), "query_id")
    own = triplets.training_examples(t)
    return own.select(F.md5("anchor").alias("anchor"), F.md5("positive").alias("positive"), F.md5("negative").alias("negative"))


@query
def hard_negatives_min_sim(s: SparkSession, d: str) -> DataFrame:
    sim = A.neighbours(s, d, A.TOP, "cosine")
    pos = sim.where("rank = 1").select("query_id", F.col("doc_id").alias("positive_doc_id"))
    return triplets.hard_negatives(sim.withColumnRenamed("score", "sim").drop("rank").join(pos, "query_id"), 5, 0.2)


@query
def triplet_margin_loss(s: SparkSession, d: str) -> DataFrame:
    t = A.with_vectors(s, d, A.mined(s, d))
    return t.select("query_id", "negative_doc_id", r6(V.margin_loss(F.col("a"), F.col("p"), F.col("n"))).alias("loss"))


@query
def triplet_loss_mean(s: SparkSession, d: str) -> DataFrame:
    return triplet_margin_loss(s, d).agg(r6(F.avg("loss")).alias("mean_loss"), F.count("*").alias("n"))


def _gated(s: SparkSession, d: str, difference: bool = False) -> DataFrame:
    """Gated triplets; with overlap_difference only where it is asked for, as it takes the tokens of all negatives."""
    # what a query has with its positive is computed once, not for each negative, and nothing but numbers is carried on
    g = A.mined(s, d).groupBy("query_id", "positive_doc_id").agg(F.collect_list(F.struct("negative_doc_id", "difficulty")).alias("negatives"))
    # each document's tokens and bigrams are hashed to 64 bits once, and pairs are scored on those
    hashed = {"g": 2} | ({"w": 1} if difference else {})
    sets = T.let(T.ws_tokens("body"), lambda w: F.struct(*[T.hashed_ngrams(w, n).alias(c) for c, n in hashed.items()]))
    body = A.bodies(s, d).join(A.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", sets.alias("x"))
    none = F.array().cast("array<bigint>")
    of = lambda c, k: F.coalesce(F.col(f"{c}.{k}"), none)
    for i, c in (("query_id", "qt"), ("positive_doc_id", "pt")):
        g = g.join(body.select(F.col("doc_id").alias(i), F.col("x").alias(c)), i, "left")
    more = [T.jaccard(of("qt", "w"), of("pt", "w")).alias("own"), of("qt", "w").alias("qw")] if difference else []
    g = g.select("query_id", "positive_doc_id", "negatives", r6(T.jaccard(of("qt", "g"), of("pt", "g"))).alias("ngram_overlap"), *more)
    for i, c in (("query_id", "a"), ("positive_doc_id", "p")):
        g = g.join(A.vectors(s, d, i).withColumnRenamed("vector", c), i)
    g = g.withColumn("entailment_score", r6(V.cosine(F.col("a"), F.col("p")))).drop("a")
    t = g.select("*", F.inline("negatives")).drop("negatives").join(A.vectors(s, d, "negative_doc_id").withColumnRenamed("vector", "n"), "negative_doc_id")
    t = t.withColumn("diversity_score", r6(1 - V.cosine(F.col("p"), F.col("n")))).drop("p", "n")
    if difference:
        t = t.join(body.select(F.col("doc_id").alias("negative_doc_id"), F.col("x.w").alias("nw")), "negative_doc_id", "left")
        t = t.withColumn("overlap_difference", r6(F.col("own") - T.jaccard(F.col("qw"), F.coalesce("nw", none)))).drop("own", "qw", "nw")
    return triplets.gate(t, overlap=0.05, diversity=0.3, entailment=0.3)


@query
def quality_gate(s: SparkSession, d: str) -> DataFrame:
    return _gated(s, d).select("query_id", "negative_doc_id", "ngram_overlap", "diversity_score", "entailment_score", F.array_join("issues", ";").alias("issues"), "is_valid")


@query
def quality_gate_overview(s: SparkSession, d: str) -> DataFrame:
    return triplets.gate_overview(_gated(s, d)).withColumn("pass_rate", r6(F.col("pass_rate")))


@query
def quality_gate_summary(s: SparkSession, d: str) -> DataFrame:
    return triplets.metric_summary(_gated(s, d), ["ngram_overlap", "diversity_score", "entailment_score"])


@query
def quality_gate_distribution(s: SparkSession, d: str) -> DataFrame:
    label = A.table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") > 0, F.col("label")).cast("string").alias("dataset"))
    return triplets.distribution(_gated(s, d).where("is_valid").join(label, "query_id"), "dataset")


@query
def triplet_quality_report(s: SparkSession, d: str) -> DataFrame:
    return triplets.quality_report(_gated(s, d, difference=True).select("overlap_difference", "difficulty"), ["overlap_difference", "difficulty"])


@query
def validate_triplets(s: SparkSession, d: str) -> DataFrame:
    t = A.table(s, d, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.when(F.col("label") != 1, "q").alias("query"),
        F.when(F.col("label") != 2, F.col("vec_id")).alias("pos"),
        F.when(F.col("label") == 3, F.array().cast("array<bigint>")).when(F.col("label") != 4, F.array("vec_id")).alias("neg"),
    )
    e = triplets.structure_errors(F.col("query"), F.col("pos"), F.col("neg"))
    return t.select("query_id", F.array_join(e, ";").alias("errors"), (F.size(e) == 0).alias("is_valid"))


# evaluation


@query
def eval_per_query_fixed_k(s: SparkSession, d: str) -> DataFrame:
    return A.fixed_metrics(s, d)


@query
def eval_per_query_truncated(s: SparkSession, d: str) -> DataFrame:
    return evaluate.per_query_truncated(A.marked(s, d), A.relevant(s, d))


@query
def eval_report(s: SparkSession, d: str) -> DataFrame:
    return evaluate.report(A.fixed_metrics(s, d))


@query
def eval_report_by_model(s: SparkSession, d: str) -> DataFrame:
    whole, half = A.fixed_metrics(s, d).withColumn("model", F.lit("whole")), A.fixed_metrics(s, d, HALF).withColumn("model", F.lit("half"))
    return evaluate.report_by_model(whole.unionByName(half))


@query
def eval_retrieved_lists(s: SparkSession, d: str) -> DataFrame:
    x = evaluate.lists(A.marked(s, d))
    return x.select("query_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("retrieved_ids", "relevances")])


@query
def report_improvement(s: SparkSession, d: str) -> DataFrame:
    return evaluate.improvement(evaluate.report(A.fixed_metrics(s, d, HALF)), evaluate.report(A.fixed_metrics(s, d)))


# text kernels


@query
def lexical_overlap_pairs(s: SparkSession, d: str) -> DataFrame:
    return A.turns(s, d).select("conv_id", "turn", r6(T.lexical_overlap("a", "b")).alias("overlap"))


@query
def bigram_overlap_pairs(s: SparkSession, d: str) -> DataFrame:
    return A.turns(s, d).select("conv_id", "turn", r6(T.ngram_overlap("a", "b", 2)).alias("overlap"))


@query
def overlap_use(s: SparkSession, d: str) -> DataFrame:
    return lexical_overlap_pairs(s, d).groupBy(profile.use_of(F.col("overlap")).alias("used_for")).agg(F.count("*").alias("n"))


@query
def token_counts(s: SparkSession, d: str) -> DataFrame:
    return A.bodies(s, d).select("doc_id", T.n_words("body").cast("long").alias("n_ws"), F.size(T.word_tokens("body")).cast("long").alias("n_words"), F.size(F.array_distinct(T.ws_tokens("body"))).cast("long").alias("n_distinct"))


@query
def diacritic_fold(s: SparkSession, d: str) -> DataFrame:
    return A.bodies(s, d).select("doc_id", F.md5(T.fold_diacritics(F.lower("body"))).alias("folded"))


@query
def text_truncation(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).select("doc_id", *[F.substring("body", 1, n).alias(f"first_{n}") for n in (30, 60, 100)])


@query
def first_lines(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).select("doc_id", T.first_nonblank_line("body").alias("line"))


@query
def body_coalesce(s: SparkSession, d: str) -> DataFrame:
    x = A.documents(s, d).withColumn("short", F.when(F.length("body") > 500, "").otherwise(F.col("body")))
    return x.select("doc_id", F.md5(T.falsy_coalesce("short", "title")).alias("falsy"), F.md5(T.missing_coalesce("short", "title")).alias("missing"))


@query
def doc_text_concat(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).select("doc_id", F.md5(T.document_text("title", "body")).alias("text"))


@query
def key_terms(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).select("doc_id", F.array_join(T.key_terms("title"), " ").alias("terms"))


@query
def concepts_topn(s: SparkSession, d: str) -> DataFrame:
    return concepts.top_concepts(A.bodies(s, d), 15)


@query
def concept_overlap_group(s: SparkSession, d: str) -> DataFrame:
    src = A.table(s, d, "documents").select("doc_id", "source")
    return concepts.group_overlap(concepts.top_concepts(A.bodies(s, d), 10, stop=T.CONCEPT_STOP_SHORT).join(src, "doc_id"), "source")


@query
def query_type_classify(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_type("text").alias("query_type"))


# retrieval over texts


@query
def lexical_retrieval_topk(s: SparkSession, d: str) -> DataFrame:
    q, b = A.asked(s, d), A.bodies(s, d)
    return retrieve.top_with_fill(retrieve.overlap_scores(q, b), q, b, 10)


@query
def bm25_corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return retrieve.corpus_stats(A.bodies(s, d)).select("n_docs", r6(F.col("avgdl")).alias("avgdl"))


@query
def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    b = A.bodies(s, d)
    return retrieve.token_idf(b, retrieve.corpus_stats(b)).withColumn("idf", r6(F.col("idf")))


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    q, b = A.asked(s, d), A.bodies(s, d)
    return retrieve.top_with_fill(retrieve.bm25_scores(q, b), q, b, 10)


@query
def marco_records(s: SparkSession, d: str) -> DataFrame:
    docs = A.documents(s, d)
    x = marco.records(docs, marco.queries(docs), texts=False)
    j = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return x.select("query_id", "query", "query_type", "language", j("passage_ids").alias("passage_ids"), j("passages.is_selected").alias("is_selected"), F.md5(F.array_join("answers", "")).alias("answers"), F.md5(F.array_join("wellFormedAnswers", "")).alias("well_formed"))


@query
def marco_answers(s: SparkSession, d: str) -> DataFrame:
    a = T.first_sentences("body")
    return A.documents(s, d).select("doc_id", F.md5(a).alias("answer"), F.md5(T.well_formed(a)).alias("well_formed"))


# query generation


@query
def doc_type_routing(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).groupBy("source", querygen.document_type(F.col("source")).alias("type")).agg(F.count("*").alias("n"))


def _generated(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        q = querygen.queries_for(F.lit(kind), F.col("title"), F.col("body"), F.col("doc_id"))
        return A.documents(s, d).select("doc_id", F.posexplode(q).alias("nth", "query")).withColumn("nth", F.col("nth").cast("long"))

    return run


for _kind in ("news", "summarization", "stories", "ner", "recipes"):
    QUERIES[f"querygen_{_kind}"] = _generated(_kind)


@query
def querygen_title_template(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).select("doc_id", querygen.title_query(F.col("title"), F.col("body"), F.col("doc_id")).alias("query"))


@query
def querygen_marco(s: SparkSession, d: str) -> DataFrame:
    return marco.queries(A.documents(s, d)).select("query_id", "query")


@query
def querygen_synthetic(s: SparkSession, d: str) -> DataFrame:
    return querygen.synthetic(A.table(s, d, "documents").select(F.col("doc_id").alias("i")))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return querygen.with_metrics(querygen.generate(A.documents(s, d)))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).select("doc_id", "type", F.posexplode("metrics.quality_scores").alias("nth", "quality"))


@query
def query_quality(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).select("doc_id", F.col("nth").cast("long").alias("nth"), "quality")


@query
def query_diversity(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).where("num_queries > 0").select("doc_id", "num_queries", "metrics.avg_quality", "metrics.diversity")


@query
def quality_stats_by_type(s: SparkSession, d: str) -> DataFrame:
    return profile.with_total(_scores(s, d), "type", F.count("*").alias("n"), *profile.stats(F.col("quality")))


@query
def quality_percentiles_by_type(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).groupBy("type").agg(*profile.stats(F.col("quality"), percentiles=True))


@query
def quality_histogram(s: SparkSession, d: str) -> DataFrame:
    return profile.histogram(_scores(s, d), "quality", profile.QUALITY_EDGES, "type")


@query
def diversity_bands(s: SparkSession, d: str) -> DataFrame:
    return profile.bands(_metrics(s, d).where("num_queries > 0").select("type", F.col("metrics.diversity").alias("v")), "v", "type")


@query
def cross_type_comparison(s: SparkSession, d: str) -> DataFrame:
    m = _metrics(s, d).where("num_queries > 0").select("type", "num_queries", "metrics.avg_quality", "metrics.diversity")
    return m.groupBy("type").agg(r6(F.avg("avg_quality")).alias("avg_quality"), r6(F.avg("diversity")).alias("diversity"), F.sum("num_queries").alias("n_queries"), F.count("*").alias("n_docs"))


# splits, ids, batches


def _ids(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "embeddings").select("vec_id", "label")


@query
def split_rows(s: SparkSession, d: str) -> DataFrame:
    return splits.split_rows(_ids(s, d), "vec_id").select("vec_id", "split")


@query
def split_rows_cumulative(s: SparkSession, d: str) -> DataFrame:
    return splits.split_rows(_ids(s, d), "vec_id", seed=7, cumulative=True).select("vec_id", "split")


@query
def split_by_query(s: SparkSession, d: str) -> DataFrame:
    return splits.split_grouped(A.table(s, d, "conversations").select("conv_id", "turn"), "conv_id").select("conv_id", "turn", "split")


@query
def split_sorted_ids(s: SparkSession, d: str) -> DataFrame:
    return splits.split_sorted(_ids(s, d), "vec_id").select("vec_id", "split")


@query
def split_stats(s: SparkSession, d: str) -> DataFrame:
    return splits.split_stats(splits.split_rows(_ids(s, d), "vec_id"))


@query
def batch_assign(s: SparkSession, d: str) -> DataFrame:
    return splits.batches(A.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 32)


@query
def first_n_per_group(s: SparkSession, d: str) -> DataFrame:
    return splits.first_per_group(A.table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query
def category_ids(s: SparkSession, d: str) -> DataFrame:
    x = connectors.numbered(A.table(s, d, "documents").select("doc_id", "lang").withColumnRenamed("doc_id", "k"), "k", "doc")
    return x.select("k", "doc_id", "original_id")


@query
def renumber_ids(s: SparkSession, d: str) -> DataFrame:
    old = A.table(s, d, "documents").select(F.col("doc_id").alias("k"), F.format_string("%s_%d", "lang", "doc_id").alias("doc_id"))
    return connectors.renumber(old, ["k"])


@query
def template_rotation(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "benchmark").select("item_id", splits.template_at(["a $", "b $", "c $"], F.col("item_id")).alias("template"))


# corpora and profiles


def _union(s: SparkSession, d: str) -> DataFrame:
    docs = A.table(s, d, "documents").select(F.format_string("d_%d", "doc_id").alias("doc_id"), F.col("text").alias("content"), "source")
    pages = A.table(s, d, "pages").select(F.format_string("p_%d", "page_id").alias("doc_id"), F.col("html").alias("content"), F.lit("pages").alias("source"), "url")
    chats = A.table(s, d, "conversations").select(F.format_string("c_%d_%d", "conv_id", "turn").alias("doc_id"), F.col("text").alias("content"))
    return connectors.combine(docs, pages, chats)


@query
def corpus_union_counts(s: SparkSession, d: str) -> DataFrame:
    return connectors.counts_by_source(_union(s, d))


@query
def corpus_union_urls(s: SparkSession, d: str) -> DataFrame:
    return _union(s, d).groupBy((T.falsy_coalesce("url") != "").alias("has_url")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query
def corpus_dedup_ids(s: SparkSession, d: str) -> DataFrame:
    x = A.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return connectors.dedup_ids(x, "turn")


@query
def source_counts(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).agg(*[F.count_if(F.col("source") == x).alias(x.replace("-", "_")) for x in ("recipes-ro", "news", "commoncrawl")])


@query
def qrels_flatten(s: SparkSession, d: str) -> DataFrame:
    raw = A.table(s, d, "labels").groupBy(F.col("quality").cast("string").alias("query_id")).agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("docid"))).alias("positive_passages"))
    return connectors.qrels_flat(raw)


@query
def qrels_counts(s: SparkSession, d: str) -> DataFrame:
    return connectors.qrels_grouped(qrels_flatten(s, d)).select("query_id", "num_positives")


@query
def ranked_relevance(s: SparkSession, d: str) -> DataFrame:
    q, b = A.asked(s, d), A.bodies(s, d)
    hits = retrieve.top_with_fill(retrieve.bm25_scores(q, b), q, b, 10)
    good = A.table(s, d, "labels").where("quality = 1").select("doc_id").crossJoin(F.broadcast(q.select("query_id")))  # the benchmark's items
    return evaluate.mark_relevant(hits, good).select("query_id", "rank", "doc_id", F.col("rel").cast("long").alias("rel"))


@query
def column_profile_lineitem(s: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(A.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_partkey"])


@query
def column_profile_customer(s: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(A.table(s, d, "customer"), ["c_acctbal"], ["c_name", "c_mktsegment"])


@query
def provenance_audit(s: SparkSession, d: str) -> DataFrame:
    return profile.provenance(A.table(s, d, "documents"), "lang", "text", "(License|license|Copyright)", "(example.com|555-)")


@query
def events_by_type(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), *profile.stats(F.col("value"), percentiles=True))


@query
def running_totals(s: SparkSession, d: str) -> DataFrame:
    g = querygen.generate(A.documents(s, d))
    return g.agg(F.count("*").alias("n_records"), F.sum("num_queries").alias("n_queries"))
