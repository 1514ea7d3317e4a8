"""Explicit schemas of the records that are read and written."""

from __future__ import annotations

from pyspark.sql import types as t

_BASE = "doc_id string, title string, content string, text string, source string, original_id bigint"
_DDL = {
    "document": _BASE,
    "recipe": f"{_BASE}, ingredients string",
    "story": f"{_BASE}, author string, word_count int",
    "summarization": f"{_BASE}, summary string, category string, source_url string",
    "ner": "doc_id string, item_id string, text string, tokens array<string>, ner_tags array<int>, original_doc_id string, region string, source string, original_id bigint",
    "news": f"{_BASE}, summary string, publication string",
    "web": f"{_BASE}, url string, warc_url string",
    "miracl_document": f"{_BASE}, docid string, language string",
    "miracl_query": "query_id string, query string, language string, original_id bigint",
    "qrel": "query_id string, positive_passages array<struct<docid:string>>, num_positives int, language string",
    "query_record": "doc_id string, source string, type string, title string, queries array<string>, num_queries int, metrics struct<quality_scores:array<double>,avg_quality:double,diversity:double,num_queries:int>",
    "query_version": "doc_id string, title string, source string, version string, queries array<string>, num_queries int",
    "synthetic_query": "query_id string, query string, type string",
    "triplet_flat": "query_id string, query string, positive_doc_id string, positive_title string, positive_content string, negative_doc_id string, negative_title string, negative_content string, difficulty double",
    "triplet_grouped": "query string, positive_doc_id string, negative_doc_ids array<string>, query_version string, temperature double, dataset string, metrics map<string,double>",
    "vector": "doc_id string, embedding array<float>",
    "hit": "rank int, doc_id string, index_id bigint, distance double",
    "marco_record": "query_id bigint, query string, query_type string, language string, passages struct<passage_text:array<string>,is_selected:array<int>,url:array<string>>, answers array<string>, wellFormedAnswers array<string>",
    "eval_report": "metric string, mean double, median double, stdev double, total_queries bigint",
    "training_history": "epoch int, train_loss double, val_loss double",
}


def schema(name: str) -> t.StructType:
    return t.StructType.fromDDL(_DDL[name])


NAMES = tuple(_DDL)
