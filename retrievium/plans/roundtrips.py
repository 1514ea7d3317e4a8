"""Contract queries of scans, sinks, connectors and hooks: the shared tables are written in the record shapes, read back and compared.

Paths are in the folder that executors share, and go when the application ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, profile, querygen, triplets
from ..sources import connectors, jsonl, vectors
from ..storage import scratch, ship
from . import adapters as A
from .oracle import DOCS, QUALITY, MINED, b, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"
HASHED = "doc_id, md5(text) AS text, lang, source, n_chars"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("text"), "lang", "source", "n_chars")


@query(f"SELECT {HASHED} FROM documents")
def jsonl_write_read_strict(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s)
    jsonl.write(_docs(s, d), at)
    return _hashed(jsonl.read_strict(s, at, ROW))


def _damaged(s: SparkSession, d: str) -> str:
    """Lines of which those of ids that 7 divides are cut in half and followed by a blank one."""
    at = scratch(s)
    line = F.to_json(F.struct("*"))
    half = F.concat(F.substring(line, 1, 9), F.lit("\n"))
    _docs(s, d).select(F.when(F.col("doc_id") % 7 == 0, half).otherwise(line)).write.text(at)
    return at


@query(f"SELECT {HASHED} FROM documents WHERE doc_id % 7 <> 0")
def jsonl_read_tolerant(s: SparkSession, d: str) -> DataFrame:
    return _hashed(jsonl.read_tolerant(s, _damaged(s, d), ROW))


@query(f"SELECT {b('count_if(doc_id % 7 <> 0)')} AS n_good, {b('count_if(doc_id % 7 = 0)')} AS n_bad FROM documents")
def jsonl_read_errors(s: SparkSession, d: str) -> DataFrame:
    return jsonl.read_with_errors(s, _damaged(s, d), ROW).agg(F.count("doc_id").alias("n_good"), F.count(jsonl.BAD).alias("n_bad"))


@query(f"SELECT coalesce(source, 'unknown') AS source, {b('count(*)')} AS n FROM documents GROUP BY 1")
def json_report_whole(s: SparkSession, d: str) -> DataFrame:
    """A report as one array in one file."""
    at = scratch(s)
    report = connectors.counts_by_source(_docs(s, d))  # a row for each source
    report.agg(F.to_json(F.collect_list(F.struct("source", "n")))).coalesce(1).write.text(at)
    return jsonl.read_whole(s, at, "source string, n bigint")


@query(f"SELECT lang, {b('count(*)')} AS n FROM documents GROUP BY lang")
def json_report_sink(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s)
    jsonl.write_report(_docs(s, d).groupBy("lang").agg(F.count("*").alias("n")), at)
    return jsonl.read_strict(s, at, "lang string, n bigint")


@query("SELECT lang AS category, doc_id, md5(text) AS text FROM documents")
def category_files(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s)
    jsonl.write_by_category(_docs(s, d).select(F.col("lang").alias("category"), "doc_id", "text"), at)
    return jsonl.read_categories(s, at, "doc_id bigint, text string", pattern="*.json").select("category", "doc_id", F.md5("text").alias("text"))


@query("SELECT 'de' AS category, doc_id FROM documents WHERE lang = 'de'")
def category_files_of_one(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s)
    jsonl.write_by_category(_docs(s, d).select(F.col("lang").alias("category"), "doc_id"), at)
    return jsonl.read_categories(s, at, "doc_id bigint", "category=de", pattern="*.json").select("category", "doc_id")


@query("SELECT concat('key_', n_nationkey) AS key, concat(n_name, '=', n_regionkey) AS value FROM nation")
def config_lines(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s)
    line = F.concat(F.lit(" key_"), "n_nationkey", F.lit(" = "), "n_name", F.lit("="), "n_regionkey")
    A.table(s, d, "nation").select(F.concat(F.lit("# none=1\n\nno sign\n"), line)).write.text(at)
    return jsonl.read_config(s, at)


def _numbered(prefix: str, columns: str, where: str = "") -> str:
    return f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM docs {where}) SELECT format('{prefix}_{{:06d}}', pos) AS doc_id, {b('pos')} AS original_id, {columns} FROM r"


@query(_numbered("rec", "title, md5(body) AS content, '' AS ingredients, 'recipes-ro' AS source"))
def connector_recipes(s: SparkSession, d: str) -> DataFrame:
    raw = A.documents(s, d).select(F.col("doc_id").alias("k"), F.col("title").alias("0"), F.lit(None).cast("string").alias("1"), F.col("body").alias("2"))
    return connectors.recipes(raw, "k").withColumn("content", F.md5("content"))


@query(_numbered("sto", rf"title, md5(body) AS content, 'unsigned' AS author, {b(r"len(list_filter(string_split_regex(body, '\s+'), lambda t_: t_ <> ''))")} AS word_count, 'ro-stories' AS source"))
def connector_stories(s: SparkSession, d: str) -> DataFrame:
    raw = A.documents(s, d).select(F.col("doc_id").alias("k"), "title", F.lit("unsigned").alias("author"), F.col("body").alias("paragraph"))
    return connectors.stories(raw, "k").withColumn("content", F.md5("content")).withColumn("word_count", F.col("word_count").cast("long"))


@query(_numbered("sum", "title, md5(body) AS content, '' AS summary, source AS category, '' AS source_url, 'ro-text-summarization (unknown)' AS source", "WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50)"))
def connector_summarization(s: SparkSession, d: str) -> DataFrame:
    """The first 50 rows: its row limit."""
    raw = A.documents(s, d).select(F.col("doc_id").alias("k"), F.col("title").alias("Title"), F.col("body").alias("Content"), F.col("source").alias("Category"))
    return connectors.summarization(raw, "k", 50).withColumn("content", F.md5("content"))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, string_split(text, ' ') AS w FROM documents) SELECT format('ner_{:06d}', pos) AS doc_id, CAST(pos AS BIGINT) AS original_id, CAST(doc_id AS VARCHAR) AS item_id, md5(array_to_string(w, ' ')) AS text, CAST(len(w) AS BIGINT) AS n_tokens, '' AS region, 'histnero' AS source FROM r")
def connector_ner(s: SparkSession, d: str) -> DataFrame:
    w = F.split("text", " ")
    raw = _docs(s, d).select(F.col("doc_id").alias("k"), F.col("doc_id").alias("id"), w.alias("tokens"), F.transform(w, lambda _: F.lit(0)).alias("ner_tags"))
    return connectors.ner(raw, "k").select("doc_id", "original_id", "item_id", F.md5("text").alias("text"), F.size("tokens").cast("long").alias("n_tokens"), "region", "source")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents WHERE lang IN ('en', 'de')) SELECT format('{}_{:06d}', lang, pos) AS doc_id, md5(text) AS text, lang AS publication FROM r")
def outlets_fan_in(s: SparkSession, d: str) -> DataFrame:
    """Two outlets' files, one that isn't there and one that isn't JSON."""
    paths = {x: scratch(s) for x in ("en", "de", "gone", "bad")}
    for x in ("en", "de"):
        jsonl.write(_docs(s, d).where(F.col("lang") == x).select("doc_id", "text"), paths[x])
    s.range(1).select(F.lit("{not json")).write.text(paths["bad"])
    return connectors.outlets(s, paths, "doc_id bigint, text string", "k", rename={"doc_id": "k"}, lines=True).select("doc_id", F.md5("text").alias("text"), "publication")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS title, md5(text) AS content, 'miracl' AS source, 'ro' AS language FROM documents")
def miracl_corpus(s: SparkSession, d: str) -> DataFrame:
    raw = _docs(s, d).select(F.col("doc_id").alias("docid"), "text")
    return connectors.miracl_corpus(raw).withColumn("content", F.md5("content"))


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, md5(text) AS query, 'fr' AS language FROM benchmark")
def miracl_queries(s: SparkSession, d: str) -> DataFrame:
    raw = A.asked(s, d)
    return connectors.miracl_queries(raw, "fr").withColumn("query", F.md5("query"))


@query("SELECT CASE WHEN i < 2 THEN 'news' ELSE 'cc' END AS prefix, CASE WHEN i < 2 THEN format('news_{:06d}', i) ELSE format('cc_{:06d}', i) END AS doc_id, CASE WHEN i < 2 THEN 'news' ELSE 'commoncrawl' END AS source, i AS original_id FROM range(0, 10) t(i)")
def literal_source(s: SparkSession, d: str) -> DataFrame:
    rows = connectors.literal_rows(s, [("a", "b"), ("c", "d")], [("e", "f")], range(3, 10))
    return rows.select(F.split_part("doc_id", F.lit("_"), F.lit(1)).alias("prefix"), "doc_id", "source", "original_id")


@query(f"SELECT vec_id AS doc_id, {b('len(embedding)')} AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def vector_index_save_load(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s)
    vectors.save_index(A.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), at)
    v = F.col("vector")
    return vectors.load_index(s, at).select("doc_id", F.size(v).cast("long").alias("dim"), F.round(F.get(v, F.lit(0)).cast("double"), 6).alias("first"), F.round(F.element_at(v, -1).cast("double"), 6).alias("last"))


def _toy_encoder() -> vectors.Encoder:
    return lambda texts: np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS x, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS y, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS z FROM documents")
def encoder_hook(s: SparkSession, d: str) -> DataFrame:
    """A registered encoder, called in batches where the rows are."""
    ship(s)
    vectors.register_encoder("counts", _toy_encoder)
    return vectors.encode(_docs(s, d), "counts").select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('about ', title) ELSE concat('despre ', title) END AS query, doc_id % 3 <> 0 AS fell_back FROM docs")
def generator_hook(s: SparkSession, d: str) -> DataFrame:
    """A generator that has an answer for every third document, raises for another third, and is empty for the rest; templates fill in."""
    ship(s)

    def generate(doc_id: int, title: str, body: str) -> str:
        if doc_id % 3 == 1:
            raise RuntimeError("no answer")
        return f"about {title}" if doc_id % 3 == 0 else " "

    return querygen.generated_by(A.documents(s, d), lambda: generate, F.concat(F.lit("despre "), "title"))


# rows and columns


@query("WITH p AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN text END AS query, CASE WHEN item_id % 2 = 0 THEN text ELSE ' ' END AS positive FROM benchmark) SELECT item_id FROM p WHERE trim(query) <> '' AND trim(positive) <> ''")
def eval_rows_usable(s: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    own = A.table(s, d, "benchmark").select(i, F.when(i % 3 == 0, "").when(i % 3 == 1, F.col("text")).alias("query"), F.when(i % 2 == 0, F.col("text")).otherwise(" ").alias("positive"))
    return evaluate.usable(own, "query", "positive").select("item_id")


@query(f"WITH {QUALITY}, u AS (UNPIVOT (SELECT type, avg_quality, diversity, CAST(num_queries AS DOUBLE) AS num_queries FROM dm) ON avg_quality, diversity, num_queries INTO NAME metric VALUE v) SELECT type, metric, {b('count(*)')} AS n, {stats('v', True)} FROM u GROUP BY type, metric")
def document_percentiles_by_type(s: SparkSession, d: str) -> DataFrame:
    return profile.distributions(_per_document(s, d), "type", ["avg_quality", "diversity", "num_queries"])


@query(f"WITH {QUALITY}, t AS (SELECT type, round(avg(avg_quality), 6) AS avg_quality, {b('count(*)')} AS n_docs FROM dm GROUP BY type) SELECT *, row_number() OVER (ORDER BY avg_quality DESC, type) AS place FROM t")
def cross_type_ranked(s: SparkSession, d: str) -> DataFrame:
    t = _per_document(s, d).groupBy("type").agg(F.round(F.avg("avg_quality"), 6).alias("avg_quality"), F.count("*").alias("n_docs"))
    return profile.placed(t, "avg_quality", "type")


def _per_document(s: SparkSession, d: str) -> DataFrame:
    return querygen.with_metrics(querygen.generate(A.documents(s, d))).where("num_queries > 0").select("type", "num_queries", "metrics.avg_quality", "metrics.diversity")


@query(f"SELECT event_type, {b('count(*)')} AS n, {b("sum(CAST(json_extract_string(props, '$.k') AS BIGINT))")} AS total, {b("max(CAST(json_extract_string(props, '$.k') AS BIGINT))")} AS most FROM events GROUP BY event_type")
def json_column_parse(s: SparkSession, d: str) -> DataFrame:
    own = A.table(s, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


@query("""SELECT event_id, concat('{"id":', event_id, ',"type":"', event_type, '","k":', json_extract_string(props, '$.k'), '}') AS line FROM events""")
def json_column_format(s: SparkSession, d: str) -> DataFrame:
    own = A.table(s, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return own.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("p.k").alias("k"))).alias("line"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS absent, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'x' END AS nothing FROM events")
def field_defaults(s: SparkSession, d: str) -> DataFrame:
    """A default stands in for a missing key, not for a null value."""
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("v"), F.when(F.col("event_id") % 2 == 1, "x")))
    return A.table(s, d, "events").withColumn("m", m).select("event_id", *[T.field(F.col("m"), k, "none").alias(n) for k, n in (("k", "k"), ("absent", "absent"), ("v", "nothing"))])


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS tag FROM events")
def time_stamps(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "events").select("event_id", T.iso_stamp("ts").alias("stamp"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("tag"))


@query("WITH k AS (SELECT lang, doc_id, CASE WHEN regexp_matches(text, '(License|license|Copyright)') THEN 'synthetic' WHEN regexp_matches(text, '(example.com|555-)') THEN 'real' ELSE 'unknown' END AS kind FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, kind ORDER BY doc_id) AS nth FROM k) SELECT lang, kind, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS examples FROM r WHERE nth <= 2 GROUP BY lang, kind")
def provenance_examples(s: SparkSession, d: str) -> DataFrame:
    x = profile.provenance_examples(_docs(s, d), "lang", "text", "doc_id", "(License|license|Copyright)", "(example.com|555-)", 2)
    return x.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(f"WITH {MINED} SELECT query_id, positive_doc_id, string_agg(CAST(negative_doc_id AS VARCHAR), ',' ORDER BY negative_rank) AS negative_doc_ids, round(avg(difficulty), 6) AS mean_difficulty, min(difficulty) AS least_difficulty FROM m GROUP BY query_id, positive_doc_id")
def triplet_grouped_metrics(s: SparkSession, d: str) -> DataFrame:
    """Grouped triplets with a map of metrics."""
    g = triplets.grouped(A.mined(s, d), metrics={"mean_difficulty": F.round(F.avg("difficulty"), 6), "least_difficulty": F.min("difficulty")})
    return g.select("query_id", "positive_doc_id", F.array_join(F.col("negative_doc_ids").cast("array<string>"), ",").alias("negative_doc_ids"), *[F.col("metrics")[k].alias(k) for k in ("mean_difficulty", "least_difficulty")])
