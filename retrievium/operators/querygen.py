"""Template queries for documents (doc_id, title, body, source), their quality and diversity. All but the concepts of long bodies is one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .concepts import concept_arrays

#: Kind of document by what its source contains; the first that matches wins.
ROUTES = {
    "news": sorted("adevarul aleph cotidianul digi evz libertatea mediafax news_ protv realitatea zf".split()),
    "summarization": ["summarization"],
    "stories": ["stories"],
    "ner": ["ner"],
    "recipes": ["recipe"],
}
#: `$` stands for the topic. One of each pair is taken for a document.
NEWS_PAIRS = (("Ce este $?", "Ce înseamnă $?"), ("De ce $?", "Care sunt motivele din spatele $?"), ("Care sunt implicațiile $?", "Cum ne afectează $?"), ("Cum funcționează $?", "Cum putem înțelege $?"))
FIXED = {
    "summarization": "Poți explica: $?|Cum se desfășoară $?|Care sunt faptele principale privind $?|Ce înseamnă cu adevărat $?".split("|"),
    "stories": 'Care este povestea din "$"?|Cine sunt personajele principale?|Ce teme explorează aceasta?'.split("|"),
    "ner": "Ce entități importante sunt menționate?|Cum sunt conectate actorii din text?|Care este contextul istoric?".split("|"),
    "recipes": "Ce ingrediente sunt necesare pentru $?|Cum se prepară $?|Ce variante există pentru $?".split("|"),
}
TOPIC_TEMPLATES = "Cum se $?|Ce este $?|Care sunt beneficiile $?|Cum se face $?|Unde pot găsi informații despre $?|Care este procedura pentru $?|Ce ar trebui să știu despre $?|Cum aleg cel mai bun $?|Care sunt pașii pentru $?|De ce este important $?".split("|")
ACTION_TEMPLATES = (0, 3, 5, 8)  # those whose slot is an action
ACTIONS = "prepară ciorba|construiește o casă|învață programare|pornește o afacere|gătești o masă|plantezi grădina|reparezi o mașină|studiezi biologia|dai o prezentare|escribi un articol".split("|")
TOPICS = "technologia|sănătatea|economie|educație|mediu|transporturi|comunicare|leadership|inovație|calitate".split("|")
RECORD_TEMPLATES = {
    "recipes-ro": "cum se prepară $?|care sunt ingredientele pentru $?|cum se face $?".split("|"),
    "news": "ce s-a întâmplat cu $?|care este subiectul articolului despre $?|ce știri există despre $?".split("|"),
    "commoncrawl": "ce informații conține $?|despre ce este $?".split("|"),
    "default": "ce este $?|care sunt caracteristicile $?|ce reprezintă $?".split("|"),
}
NO_TITLE = "ce este acest document?"


def fill(template: Column, topic: Column) -> Column:
    return F.replace(template, F.lit("$"), topic)


def document_type(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    out = None
    for kind, marks in ROUTES.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | s.contains(m)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def _topic(title: Column, n: int) -> Column:
    """The key terms of a title, or its first n characters."""
    return T.let(T.key_terms(title), lambda terms: F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(F.substring(title, 1, n)))


def _none() -> Column:
    return F.array().cast("array<string>")


def news_queries(title: Column, doc_id: Column) -> Column:
    def own(x: Column) -> Column:
        made = F.array(*[fill(F.when(F.pmod(x["h"] + i, F.lit(2)) == 0, a).otherwise(b), x["topic"]) for i, (a, b) in enumerate(NEWS_PAIRS)])
        return F.filter(made, lambda q: T.n_words(q).between(5, 50))

    def used(t: Column) -> Column:
        return F.when(t != "", T.let(F.struct(_topic(t, 40).alias("topic"), T.stable_hash(doc_id, 100).alias("h")), own)).otherwise(_none())

    return T.let(F.trim(title), used)


def fixed_queries(kind: str, topic: Column, usable: Column) -> Column:
    return F.when(usable, T.let(topic, lambda x: F.array(*[fill(F.lit(q), x) for q in FIXED[kind]]))).otherwise(_none())


def queries_for(kind: Column, title: Column, body: Column, doc_id: Column) -> Column:
    """Queries of a document of a kind; a null title or body is an empty one."""

    def own(x: Column) -> Column:
        t, b = x["t"], x["b"]
        return (
            F.when(x["kind"] == "news", news_queries(t, x["id"]))
            .when(x["kind"] == "summarization", fixed_queries("summarization", _topic(t, 30), t != ""))
            .when(x["kind"] == "stories", fixed_queries("stories", F.substring(t, 1, 50), t != ""))
            .when(x["kind"] == "ner", fixed_queries("ner", F.lit(""), F.length(b) >= 20))
            .when(x["kind"] == "recipes", fixed_queries("recipes", t, t != ""))
            .otherwise(_none())
        )

    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return T.let(F.struct(kind.alias("kind"), trimmed(title).alias("t"), trimmed(body).alias("b"), doc_id.alias("id")), own)  # each of them once, not once a template


def generate(docs: DataFrame) -> DataFrame:
    """doc_id, source, type, title, body, queries, num_queries."""
    kind = document_type(F.col("source"))
    own = docs.select("doc_id", F.lower("source").alias("source"), kind.alias("type"), "title", "body")
    return own.withColumn("queries", queries_for(F.col("type"), F.col("title"), F.col("body"), F.col("doc_id"))).withColumn("num_queries", F.size("queries").cast("long"))


def quality(query: Column, query_concepts: Column, body_concepts: Column) -> Column:
    """0.4 of concept overlap, 0.35 of fitting length, 0.25 of not being trivial; in [0, 1]."""
    n = T.n_words(query)
    length = F.when(n.between(5, 20), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - 12) / 20))
    plain = F.when(T.is_trivial(query), 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * T.jaccard(query_concepts, body_concepts) + 0.35 * length + 0.25 * plain))


def diversity(concept_sets: Column) -> Column:
    """1 minus the mean overlap of all pairs of concept sets; 1 for fewer than two."""
    n = F.size(concept_sets)
    pairs = F.flatten(F.transform(concept_sets, lambda a, i: F.transform(F.slice(concept_sets, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: T.jaccard(a, b))))
    return F.when(n <= 1, 1.0).otherwise(1 - F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y) / F.size(pairs))


def metrics(queries: Column, body_concepts: Column) -> Column:
    """Struct of quality_scores, avg_quality, diversity and num_queries; null without queries."""

    def scored(x: Column) -> Column:
        score = lambda q: F.round(quality(q["q"], q["c"], x["body"]), 6)
        return F.struct(F.transform(x["each"], score).alias("s"), x["each"].alias("each"))

    def own(x: Column) -> Column:
        mean = F.round(F.aggregate(x["s"], F.lit(0.0), lambda a, b: a + b) / F.size(x["s"]), 6)
        sets = F.transform(x["each"], lambda q: q["c10"])
        return F.struct(x["s"].alias("quality_scores"), mean.alias("avg_quality"), F.round(diversity(sets), 6).alias("diversity"), F.size(x["s"]).cast("long").alias("num_queries"))

    each = F.transform(queries, lambda q: T.let(T.concepts(q, 10), lambda c: F.struct(q.alias("q"), F.slice(c, 1, 8).alias("c"), c.alias("c10"))))
    return F.when(F.size(queries) > 0, T.let(T.let(F.struct(each.alias("each"), body_concepts.alias("body")), scored), own))


def with_metrics(generated: DataFrame) -> DataFrame:
    """generated with metrics (see metrics). Only ids and concepts of bodies move, never bodies."""
    has = generated.where("num_queries > 0").select("doc_id", T.falsy_coalesce("body", "title").alias("body"))
    body = concept_arrays(has, 15).select("doc_id", F.col("concepts").alias("body_c"))
    own = generated.join(body, "doc_id", "left")
    return own.withColumn("metrics", metrics(F.col("queries"), F.coalesce("body_c", _none()))).drop("body_c")


def title_query(title: Column, content: Column, index: Column) -> Column:
    """Three words of the title, or five of the content, in the template of the index."""
    words = F.when(F.coalesce(title, F.lit("")) != "", F.slice(T.ws_tokens(title), 1, 3)).otherwise(F.slice(T.ws_tokens(content), 1, 5))
    k = (F.pmod(index, F.lit(len(TOPIC_TEMPLATES))) + 1).cast("int")
    return fill(F.element_at(T.literals(TOPIC_TEMPLATES), k), F.array_join(words, " "))


def synthetic(ids: DataFrame, seed: int = 0) -> DataFrame:
    """query_id, query and type for ids (i): template and slot drawn by a hash of i."""
    draw = lambda salt, n: T.stable_hash(F.concat(F.lit(f"{seed}:{salt}:"), F.col("i").cast("string")), n)
    at = lambda words, k: F.element_at(T.literals(words), (k + 1).cast("int"))
    own = ids.select("i", draw("t", len(TOPIC_TEMPLATES)).alias("t"), draw("a", len(ACTIONS)).alias("a"), draw("o", len(TOPICS)).alias("o"))
    slot = F.when(F.col("t").isin(list(ACTION_TEMPLATES)), at(ACTIONS, F.col("a"))).otherwise(at(TOPICS, F.col("o")))
    return own.select(F.format_string("q_%06d", "i").alias("query_id"), fill(at(TOPIC_TEMPLATES, F.col("t")), slot).alias("query"), F.lit("synthetic").alias("type"))


def record_query(title: Column, content: Column, source: Column, index: Column) -> Column:
    """A question in the template of the source, rotated by index; from the first eight words of the content where there is no title."""
    t = F.trim(F.coalesce(title, F.lit("")))
    raw = F.filter(F.split(F.coalesce(content, F.lit("")), r"\s+"), lambda w: w != "")
    t = F.when(t != "", t).otherwise(F.array_join(F.slice(raw, 1, 8), " "))
    t = F.lower(F.regexp_replace(t, r"[ ?.!]+$", ""))
    pick = lambda s: F.element_at(T.literals(RECORD_TEMPLATES[s]), (F.pmod(index, F.lit(len(RECORD_TEMPLATES[s]))) + 1).cast("int"))
    tpl = F.when(source == "recipes-ro", pick("recipes-ro")).when(source == "news", pick("news")).when(source == "commoncrawl", pick("commoncrawl")).otherwise(pick("default"))
    return F.when(t == "", NO_TITLE).otherwise(fill(tpl, t))


def generated_by(docs: DataFrame, load: Callable[[], Callable[[object, str, str], str]], template: Column) -> DataFrame:
    """doc_id, query, fell_back. load is called once a worker and returns a function from (doc_id, title, body) to a query; where it raises or has no text, the template stands in."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = load()

        def one(*x: object) -> str | None:
            try:
                return (make(*x) or "").strip() or None
            except Exception:  # a remote model may fail in any way
                return None

        for p in parts:
            made = pd.Series([one(*x) for x in zip(p["doc_id"], p["title"], p["body"])], dtype=object)
            yield pd.DataFrame({"doc_id": p["doc_id"], "query": made.where(made.notna(), p["t_"]), "fell_back": made.isna()})

    own = docs.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "body")], template.alias("t_"))
    return own.mapInPandas(run, f"doc_id {kind}, query string, fell_back boolean")
