"""Connectors: raw tables of known shapes to the records of this package. Nothing is downloaded; each takes a DataFrame or a path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.splits import dense_positions
from . import jsonl


def _text(df: DataFrame, name: str, default: str = "") -> F.Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def numbered(df: DataFrame, order: str, prefix: str, name: str = "doc_id") -> DataFrame:
    """df with ids prefix_000000, prefix_000001, ... in the order of a unique column."""
    return dense_positions(df, order, "pos_").withColumn(name, F.format_string(f"{prefix}_%06d", "pos_")).withColumn("original_id", F.col("pos_")).drop("pos_")


def first_rows(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(order).limit(limit)


def recipes(raw: DataFrame, order: str) -> DataFrame:
    """From positional columns 0, 1, 2: title, ingredients, content."""
    own = raw.select(order, _text(raw, "0").alias("title"), _text(raw, "1").alias("ingredients"), _text(raw, "2").alias("content"), F.lit("recipes-ro").alias("source"))
    return numbered(own, order, "rec").drop(order)


def stories(raw: DataFrame, order: str) -> DataFrame:
    body = _text(raw, "paragraph") if "paragraph" in raw.columns else _text(raw, "content")
    own = raw.select(order, _text(raw, "title").alias("title"), _text(raw, "author").alias("author"), body.alias("content"), F.lit("ro-stories").alias("source"))
    return numbered(own.withColumn("word_count", T.n_words("content")), order, "sto").drop(order)


def summarization(raw: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    own = first_rows(raw, order, limit)
    names = {"title": "Title", "content": "Content", "summary": "Summary", "category": "Category", "source_url": "href"}
    cols = [_text(own, b if b in own.columns else a).alias(a) for a, b in names.items()]
    return numbered(own.select(order, *cols, F.concat(F.lit("ro-text-summarization ("), _text(own, "Source", "unknown"), F.lit(")")).alias("source")), order, "sum").drop(order)


def ner(raw: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The text is the tokens, joined by spaces."""
    own = first_rows(raw, order, limit)
    one = own.select(order, _text(own, "id").alias("item_id"), F.array_join("tokens", " ").alias("text"), "tokens", "ner_tags", _text(own, "doc_id").alias("original_doc_id"), _text(own, "region").alias("region"), F.lit("histnero").alias("source"))
    return numbered(one, order, "ner").drop(order)


def outlet(raw: DataFrame, name: str, order: str, limit: int | None = None) -> DataFrame:
    """A news outlet's articles."""
    own = first_rows(raw, order, limit)
    one = own.select(order, *[_text(own, c).alias(c) for c in ("title", "text", "summary")], F.lit(name).alias("source"), F.lit(name).alias("publication"))
    return numbered(one, order, name).drop(order)


def outlets(spark: SparkSession, paths: dict[str, str], schema: str, order: str, limit: int | None = None, rename: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    """All outlets in one table; each is read from its JSON file (or lines). Files that aren't there are left out, and so is what isn't JSON in the others."""
    parts = []
    for name, at in paths.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raw = jsonl.read_tolerant(spark, at, schema) if lines else jsonl.read_whole(spark, at, schema, tolerant=True)
            parts.append(outlet(raw.withColumnsRenamed(rename or {}), name, order, limit))
    if not parts:
        raise FileNotFoundError(f"none of {list(paths.values())}")
    return combine(*parts)


def miracl_corpus(raw: DataFrame, language: str = "ro") -> DataFrame:
    return raw.select(_text(raw, "docid").alias("doc_id"), _text(raw, "title").alias("title"), T.missing_coalesce(*[F.col(c) for c in ("content", "text") if c in raw.columns], F.lit("")).alias("content"), F.lit("miracl").alias("source"), F.lit(language).alias("language"))


def miracl_queries(raw: DataFrame, language: str = "ro") -> DataFrame:
    return raw.select(F.col("query_id").cast("string").alias("query_id"), _text(raw, "query").alias("query"), F.lit(language).alias("language"))


def qrels_flat(raw: DataFrame) -> DataFrame:
    """query_id, doc_id from positive_passages, structs with docid or plain ids; repeated pairs count once."""
    x = F.explode("positive_passages").alias("p")
    plain = raw.schema["positive_passages"].dataType.elementType.typeName() != "struct"  # type: ignore[attr-defined]
    return raw.select("query_id", x).select("query_id", (F.col("p") if plain else F.col("p.docid")).cast("string").alias("doc_id")).where("doc_id is not null").distinct()


def qrels_grouped(flat: DataFrame) -> DataFrame:
    ids = F.array_sort(F.collect_set("doc_id"))
    return flat.groupBy("query_id").agg(ids.alias("positive_passages"), F.size(ids).cast("long").alias("num_positives"))


def combine(*parts: DataFrame) -> DataFrame:
    """Bag union by name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup_ids(docs: DataFrame, order: str) -> DataFrame:
    """One row for each doc_id, the last in order."""
    return docs.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), order).alias("x")).select("doc_id", "x.*")


def renumber(docs: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """docs with new ids: what stands before the first _ of the old one, and a new number in the given order."""
    one = docs.withColumn("order_", F.struct(*order))
    return dense_positions(one, "order_", "pos_").withColumn(key, F.format_string("%s_%06d", F.split_part(F.col(key), F.lit("_"), F.lit(1)), "pos_")).drop("order_", "pos_")


def counts_by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def literal_rows(spark: SparkSession, news: list[tuple[str, str]], web: list[tuple[str, str]], generated: range, template: str = "Articol %d") -> DataFrame:
    """Hand-written rows (title, content) and generated ones, numbered by one counter across both prefixes."""
    rows = [("news", i, *x) for i, x in enumerate(news)] + [("cc", len(news) + i, *x) for i, x in enumerate(web)]
    own = spark.createDataFrame(rows, "prefix string, i long, title string, content string")
    made = spark.range(generated.start, generated.stop).select(F.lit("cc").alias("prefix"), F.col("id").alias("i"), F.format_string(template, "id").alias("title"), F.format_string(template, "id").alias("content"))
    both = own.unionByName(made)
    return both.select(F.format_string("%s_%06d", "prefix", "i").alias("doc_id"), "title", "content", F.when(F.col("prefix") == "news", "news").otherwise("commoncrawl").alias("source"), F.col("i").alias("original_id"))


CONNECTORS: dict[str, Callable[..., DataFrame]] = {"recipes": recipes, "stories": stories, "summarization": summarization, "ner": ner}


def register(name: str, connector: Callable[..., DataFrame]) -> None:
    """Add a connector: a function from a raw DataFrame to records."""
    CONNECTORS[name] = connector
