"""The same results in DuckDB's SQL, by contract name. It shares no code with the DataFrames: only names of templates and word lists."""

from __future__ import annotations

from ..functions import text as T
from ..operators import querygen as Q
from .adapters import SOURCES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(words: list[str]) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def ws(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '\s+'), lambda t_: t_ <> '')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"


def grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({x}) - {n} + 2, 1)), lambda i_: array_to_string({x}[i_:i_ + {n - 1}], ' ')))"


def short_concepts(x: str, n: int) -> str:
    toks = rf"list_filter({words(x)}, lambda w_: length(w_) > 3 AND regexp_full_match(w_, '\p{{L}}+') AND NOT list_contains({lits(T.CONCEPT_STOP)}, w_))"
    return f"list_transform(list_sort(list_transform(list_distinct({toks}), lambda w_: {{'c': -len(list_filter({toks}, lambda v_: v_ = w_)), 'i': list_position({toks}, w_), 'w': w_}}))[1:{n}], lambda s_: s_.w)"


def b(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


DOCS = f"docs AS (SELECT doc_id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS title, coalesce(text, '') AS body, {lits(SOURCES)}[CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % {len(SOURCES)} + 1] AS source FROM documents)"
VEC = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
HALF = "v AS (SELECT vec_id AS id, label, CAST(embedding[1:32] AS DOUBLE[]) AS x FROM embeddings)"
SCORE = {"l2": ("round(list_distance(p.x, q.x) * list_distance(p.x, q.x), 6)", "ASC"), "ip": ("round(list_inner_product(p.x, q.x), 6)", "DESC"), "cosine": ("round(list_cosine_similarity(p.x, q.x), 6)", "DESC")}


def near(k: int, metric: str = "l2", vec: str = VEC, tag: str = "") -> str:
    score, order = SCORE[metric]
    return f"""{vec.replace("v AS", f"v{tag} AS", 1)},
s{tag} AS (SELECT q.id AS query_id, p.id AS doc_id, {score} AS score, CASE WHEN p.label = q.label THEN 1 ELSE 0 END AS rel FROM v{tag} q, v{tag} p WHERE q.id <> p.id),
h{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank FROM s{tag}) WHERE rank <= {k})"""


MINED = f"""{near(20)},
m AS (SELECT h.query_id, p.doc_id AS positive_doc_id, h.doc_id AS negative_doc_id, h.score AS difficulty, h.rank - 1 AS negative_rank FROM h JOIN h p ON p.query_id = h.query_id AND p.rank = 1
  WHERE h.rank BETWEEN 2 AND 4 AND (SELECT count(*) FROM v) > 4)"""


def fixed(vec: str = VEC, tag: str = "") -> str:
    return f"""{near(10, "l2", vec, tag)},
n{tag} AS (SELECT a.id AS query_id, (SELECT count(*) FROM v{tag} z WHERE z.label = a.label) - 1 AS n FROM v{tag} a),
r{tag} AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h{tag}),
f{tag} AS (SELECT query_id, round(sum(rel / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i)), 6) AS ndcg, round(coalesce(1.0 / min(rank) FILTER (WHERE rel = 1), 0), 6) AS mrr,
  round(sum(rel) / 10.0, 6) AS precision, round(CASE WHEN any_value(n) > 0 THEN sum(rel) / any_value(n) ELSE 0 END, 6) AS recall, round(sum(CASE WHEN rel = 1 THEN seen / CAST(rank AS DOUBLE) ELSE 0 END) / greatest(1, sum(rel)), 6) AS map
  FROM r{tag} JOIN n{tag} USING (query_id) GROUP BY query_id)"""


def report(tag: str = "") -> str:
    return f"""l{tag} AS (UNPIVOT f{tag} ON ndcg, mrr, precision, recall, map INTO NAME metric VALUE value),
t{tag} AS (SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(stddev_pop(value), 6) AS stdev, {b("count(*)")} AS total_queries FROM l{tag} GROUP BY metric)"""


def texts(alias: str, key: str) -> str:
    return f"LEFT JOIN bw {alias} ON {alias}.doc_id = {key}"


BW = f"bw AS (SELECT doc_id, w, list_distinct(w) AS d, {grams('w', 2)} AS g FROM (SELECT doc_id, {ws('text')} AS w FROM documents))"
GATED = f"""{MINED}, {BW},
x AS (SELECT m.query_id, m.negative_doc_id, m.difficulty, round({jac("coalesce(qt.g, [])", "coalesce(pt.g, [])")}, 6) AS ngram_overlap,
  round(1 - list_cosine_similarity(p.x, n.x), 6) AS diversity_score, round(list_cosine_similarity(a.x, p.x), 6) AS entailment_score,
  round({jac("coalesce(qt.d, [])", "coalesce(pt.d, [])")} - {jac("coalesce(qt.d, [])", "coalesce(nt.d, [])")}, 6) AS overlap_difference
  FROM m JOIN v a ON a.id = m.query_id JOIN v p ON p.id = m.positive_doc_id JOIN v n ON n.id = m.negative_doc_id {texts("qt", "m.query_id")} {texts("pt", "m.positive_doc_id")} {texts("nt", "m.negative_doc_id")}),
g AS (SELECT *, array_to_string(list_filter([CASE WHEN ngram_overlap >= 0.05 THEN 'High overlap' END, CASE WHEN diversity_score < 0.3 THEN 'Low diversity' END, CASE WHEN entailment_score < 0.3 THEN 'Low entailment' END], lambda i_: i_ IS NOT NULL), ';') AS issues FROM x),
gv AS (SELECT *, issues = '' AS is_valid FROM g)"""
TURNS = "p AS (SELECT c.conv_id, c.turn, d.text AS a, c.text AS b FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn + 1 = c.turn)"
LEX = f"{TURNS}, o AS (SELECT conv_id, turn, {ws('a')} AS a, {ws('b')} AS b FROM p)"
TOKS = "bt AS (SELECT doc_id, unnest(" + ws("text") + ") AS token FROM documents), po AS (SELECT doc_id, token, count(*) AS tf FROM bt GROUP BY ALL), dl AS (SELECT doc_id, len(" + ws("text") + ") AS dl FROM documents)"
IDF = f"""{TOKS}, st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM po GROUP BY token), rw AS (SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
mn AS (SELECT avg(raw) AS mean_raw FROM rw), idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM rw CROSS JOIN mn)"""


def bm25(asked: str, k: int, exclude: bool = False) -> str:
    keep = "WHERE q.query_id <> d.doc_id" if exclude else ""
    return f"""{IDF}, aq AS ({asked}), qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({ws("query")}) AS token FROM aq) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (token) JOIN po USING (token) JOIN dl USING (doc_id), st GROUP BY ALL),
al AS (SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM aq q CROSS JOIN dl d LEFT JOIN sc s ON s.query_id = q.query_id AND s.doc_id = d.doc_id {keep}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al) WHERE rank <= {k})"""


ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
KEY = rf"(list_transform(list_filter({ws('title')}, lambda w_: length(w_) > 2 AND NOT list_contains({lits(T.TERM_STOP)}, w_)), lambda w_: regexp_replace(w_, '[,.!?;:]+$', ''))[1:3])"


def topic(n: int) -> str:
    return f"(CASE WHEN len({KEY}) > 0 THEN array_to_string({KEY}, ' ') ELSE substr(title, 1, {n}) END)"


def md5_mod(x: str, n: int) -> str:
    return f"(CAST(concat('0x', substr(md5({x}), 1, 8)) AS BIGINT) % {n})"


def one_of(pair: tuple[str, str], i: int) -> str:
    return f"replace(CASE WHEN ({md5_mod('CAST(doc_id AS VARCHAR)', 100)} + {i}) % 2 = 0 THEN {lit(pair[0])} ELSE {lit(pair[1])} END, '$', tp)"


def generated(kind: str) -> str:
    """A list of queries from title and body."""
    if kind == "news":
        own = "[" + ", ".join(one_of(p, i) for i, p in enumerate(Q.NEWS_PAIRS)) + "]"
        return f"CASE WHEN title <> '' THEN list_filter({own.replace('tp', topic(40))}, lambda q_: len({ws('q_')}) BETWEEN 5 AND 50) ELSE [] END"
    by = {"summarization": (topic(30), "title <> ''"), "stories": ("substr(title, 1, 50)", "title <> ''"), "ner": ("''", "length(trim(body)) >= 20"), "recipes": ("title", "title <> ''")}
    slot, ok = by[kind]
    return f"CASE WHEN {ok} THEN [" + ", ".join(f"replace({lit(x)}, '$', {slot})" for x in Q.FIXED[kind]) + "] ELSE [] END"


def kind_of(source: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({source}), {lit(m)})' for m in marks)} THEN {lit(kind)}" for kind, marks in Q.ROUTES.items())
    return f"CASE {whens} ELSE 'unknown' END"


def by_kind() -> str:
    return "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {generated(k)}" for k in Q.ROUTES) + " ELSE [] END"


def long_concepts(n: int, stop: list[str]) -> str:
    return rf"""ct AS (SELECT doc_id, w[i] AS concept, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {words("text")} AS w FROM documents))),
cc AS (SELECT doc_id, concept, count(*) AS times, min(i) AS at_ FROM ct WHERE length(concept) > 3 AND regexp_full_match(concept, '\p{{L}}+') AND NOT list_contains({lits(stop)}, concept) GROUP BY ALL),
cr AS (SELECT * FROM (SELECT doc_id, concept, {b("times")} AS times, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, at_) AS rank FROM cc) WHERE rank <= {n})"""


QUALITY = f"""{DOCS}, ge AS (SELECT doc_id, kind, {by_kind()} AS qs FROM (SELECT *, {kind_of("source")} AS kind FROM docs)), {long_concepts(15, T.CONCEPT_STOP)},
bc AS (SELECT doc_id, list(concept) AS c FROM cr GROUP BY doc_id),
qu AS (SELECT doc_id, kind, i - 1 AS nth, qs[i] AS q, coalesce(c, []) AS c FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM ge) LEFT JOIN bc USING (doc_id)),
qc AS (SELECT *, {short_concepts("q", 8)} AS q8, {short_concepts("q", 10)} AS q10, len({ws("q")}) AS n FROM qu),
qq AS (SELECT doc_id, kind AS type, nth, q10, round(greatest(0.0, least(1.0, 0.4 * {jac("q8", "c")} + 0.35 * (CASE WHEN n BETWEEN 5 AND 20 THEN 1.0 ELSE greatest(0.0, 1 - abs(n - 12) / 20.0) END) + 0.25 * (CASE WHEN regexp_matches(lower(q), '^(care|ce|cine|cum) este') THEN 0.5 ELSE 1.0 END))), 6) AS quality FROM qc),
dv AS (SELECT a.doc_id, avg({jac("a.q10", "b.q10")}) AS sim FROM qq a JOIN qq b ON a.doc_id = b.doc_id AND a.nth < b.nth GROUP BY a.doc_id),
dm AS (SELECT doc_id, any_value(type) AS type, count(*) AS num_queries, round(avg(quality), 6) AS avg_quality, round(1 - coalesce(any_value(sim), 0), 6) AS diversity FROM qq LEFT JOIN dv USING (doc_id) GROUP BY doc_id)"""


def stats(v: str, pct: bool = False) -> str:
    more = "".join(f", round(quantile_cont({v}, {q}), 9) AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75)) if pct else ""
    return f"round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, min({v}) AS min, max({v}) AS max{more}"


def shuffled(rel: str, key: str, seed: int) -> str:
    return f"sp AS (SELECT {key}, row_number() OVER (ORDER BY md5(concat('{seed}:', {key})), {key}) - 1 AS pos, count(*) OVER () AS n FROM {rel})"


def cut(cumulative: bool) -> str:
    second = "floor(n * (0.7 + 0.15))" if cumulative else "floor(n * 0.7) + floor(n * 0.15)"
    second = second.replace("(0.7 + 0.15)", "CAST(0.85 AS DOUBLE)").replace("0.7)", "CAST(0.7 AS DOUBLE))").replace("0.15)", "CAST(0.15 AS DOUBLE))")
    return f"CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN pos < {second} THEN 'val' ELSE 'test' END AS split"


FIRST_SENTENCE = r"coalesce(nullif(regexp_extract(trim(body), '(?s)^(.*?[.!?])(\s|$)', 1), ''), trim(body))"


def formed(a: str) -> str:
    return f"(CASE WHEN {a} = '' THEN '' ELSE upper(substr({a}, 1, 1)) || substr({a}, 2) || (CASE WHEN regexp_matches({a}, '[.!?]$') THEN '' ELSE '.' END) END)"


def qtype(x: str) -> str:
    q = f"translate(lower({x}), 'ăâîșşțţ', 'aaisstt')"
    rules = (("numeric", "cat|cate|cati|cost|how many|how much|number|pret"), ("location", "locatie|oras|tara|unde|where"), ("person", "autor|cine|who"), ("entity", "care este|ce este|what is|which"))
    return "CASE " + " ".join(rf"WHEN regexp_matches({q}, '\b({w})\b') THEN '{k}'" for k, w in rules) + " ELSE 'description' END"


def marco_query() -> str:
    t = r"regexp_replace(CASE WHEN title <> '' THEN title ELSE array_to_string(list_filter(string_split_regex(body, '\s+'), lambda w_: w_ <> '')[1:8], ' ') END, '[ ?.!]+$', '')"
    pick = lambda s: f"{lits(Q.RECORD_TEMPLATES[s])}[doc_id % {len(Q.RECORD_TEMPLATES[s])} + 1]"
    tpl = "CASE source " + " ".join(f"WHEN {lit(s)} THEN {pick(s)}" for s in ("recipes-ro", "news", "commoncrawl")) + f" ELSE {pick('default')} END"
    return f"CASE WHEN {t} = '' THEN {lit(Q.NO_TITLE)} ELSE replace({tpl}, '$', lower({t})) END"


def title_query() -> str:
    return f"replace({lits(Q.TOPIC_TEMPLATES)}[doc_id % {len(Q.TOPIC_TEMPLATES)} + 1], '$', array_to_string(CASE WHEN title <> '' THEN {ws('title')}[1:3] ELSE {ws('body')}[1:5] END, ' '))"


def synthetic() -> str:
    d = lambda salt, n: md5_mod(f"concat('0:{salt}:', doc_id)", n)
    return f"""WITH i AS (SELECT doc_id, {d("t", len(Q.TOPIC_TEMPLATES))} AS t, {d("a", len(Q.ACTIONS))} AS a, {d("o", len(Q.TOPICS))} AS o FROM documents)
SELECT format('q_{{:06d}}', doc_id) AS query_id, replace({lits(Q.TOPIC_TEMPLATES)}[t + 1], '$', CASE WHEN t IN {Q.ACTION_TEMPLATES} THEN {lits(Q.ACTIONS)}[a + 1] ELSE {lits(Q.TOPICS)}[o + 1] END) AS query, 'synthetic' AS type FROM i"""


def column_profile(table: str, numeric: list[str], other: list[str]) -> str:
    num = [f"SELECT '{c}' AS \"column\", {b(f'count({c})')} AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, CAST(NULL AS BIGINT) AS n_distinct FROM {table}" for c in numeric]
    oth = [f"SELECT '{c}', {b(f'count({c})')}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {b(f'count(DISTINCT {c})')} FROM {table}" for c in other]
    return " UNION ALL ".join(num + oth)


UNION = "u AS (SELECT text AS content, source, NULL AS url FROM documents UNION ALL SELECT html, 'pages', url FROM pages UNION ALL SELECT text, NULL, NULL FROM conversations)"
SQL: dict[str, str] = {
    "knn_l2_topk": f"WITH {near(20)} SELECT query_id, doc_id, score AS distance, rank FROM h",
    "knn_l2_batch_rank": f"WITH {near(20)} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids, min(score) AS nearest, max(score) AS farthest FROM h GROUP BY query_id",
    "knn_inner_product": f"WITH {near(10, 'ip')} SELECT query_id, doc_id, score, rank FROM h",
    "knn_cosine": f"WITH {near(10, 'cosine')} SELECT query_id, doc_id, score, rank FROM h",
    "vector_norms": f"WITH {VEC} SELECT id AS vec_id, round(sqrt(list_inner_product(x, x)), 6) AS norm, {b('len(x)')} AS dim FROM v",
    "label_centroid_cosine": f"WITH {VEC}, e AS (SELECT label, i, avg(x[i]) AS c FROM (SELECT label, x, unnest(range(1, len(x) + 1)) AS i FROM v) GROUP BY ALL), c AS (SELECT label, list(c ORDER BY i) AS c FROM e GROUP BY label) SELECT id AS vec_id, round(list_cosine_similarity(x, c), 6) AS cosine FROM v JOIN c USING (label)",
    "triplet_mining_flat": f"WITH {MINED} SELECT * FROM m",
    "triplet_mining_grouped": f"WITH {MINED} SELECT query_id, positive_doc_id, string_agg(CAST(negative_doc_id AS VARCHAR), ',' ORDER BY negative_rank) AS negative_doc_ids FROM m GROUP BY ALL",
    "triplet_skipped": f"WITH {near(20)}, n AS (SELECT v.id, (SELECT count(*) FROM h WHERE h.query_id = v.id AND score < 1.2) AS n FROM v) SELECT {b('count(*)')} AS n_skipped FROM n WHERE n < 4",
    "triplet_texts": f"WITH {MINED}, {DOCS} SELECT query_id, negative_doc_id, coalesce(p.title, '') AS positive_title, coalesce(n.title, '') AS negative_title, {b("length(coalesce(p.body, ''))")} AS positive_chars, {b("length(coalesce(n.body, ''))")} AS negative_chars FROM m LEFT JOIN docs p ON p.doc_id = positive_doc_id LEFT JOIN docs n ON n.doc_id = negative_doc_id",
    "training_examples": f"WITH {MINED}, {DOCS} SELECT md5(q.title) AS anchor, md5(p.body) AS positive, md5(n.body) AS negative FROM m JOIN docs q ON q.doc_id = query_id JOIN docs p ON p.doc_id = positive_doc_id JOIN docs n ON n.doc_id = negative_doc_id WHERE q.title <> '' AND p.body <> '' AND n.body <> ''",
    "hard_negatives_min_sim": f"WITH {near(20, 'cosine')}, p AS (SELECT query_id, doc_id AS positive_doc_id FROM h WHERE rank = 1), k AS (SELECT query_id, doc_id, score AS sim, positive_doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h JOIN p USING (query_id) WHERE score >= 0.2 AND doc_id <> positive_doc_id) SELECT * FROM k WHERE rank <= 5",
    "triplet_margin_loss": f"WITH {MINED} SELECT query_id, negative_doc_id, round(greatest(0.0, 0.5 + list_distance(a.x, p.x) - list_distance(a.x, n.x)), 6) AS loss FROM m JOIN v a ON a.id = query_id JOIN v p ON p.id = positive_doc_id JOIN v n ON n.id = negative_doc_id",
    "triplet_loss_mean": f"WITH {MINED} SELECT round(avg(round(greatest(0.0, 0.5 + list_distance(a.x, p.x) - list_distance(a.x, n.x)), 6)), 6) AS mean_loss, {b('count(*)')} AS n FROM m JOIN v a ON a.id = query_id JOIN v p ON p.id = positive_doc_id JOIN v n ON n.id = negative_doc_id",
    "quality_gate": f"WITH {GATED} SELECT query_id, negative_doc_id, ngram_overlap, diversity_score, entailment_score, issues, is_valid FROM gv",
    "quality_gate_overview": f"WITH {GATED} SELECT {b('count(*)')} AS total, {b('count_if(is_valid)')} AS valid, {b('count_if(NOT is_valid)')} AS invalid, round(coalesce(count_if(is_valid) / CAST(nullif(count(*), 0) AS DOUBLE), 0), 6) AS pass_rate FROM gv",
    "quality_gate_summary": f"WITH {GATED}, w AS (SELECT ngram_overlap, diversity_score, entailment_score FROM gv WHERE is_valid), u AS (UNPIVOT w ON ngram_overlap, diversity_score, entailment_score INTO NAME metric VALUE value) SELECT metric, {stats('value')} FROM u GROUP BY metric",
    "quality_gate_distribution": f"WITH {GATED} SELECT coalesce(CASE WHEN v.label > 0 THEN CAST(v.label AS VARCHAR) END, 'unknown') AS dataset, {b('count(*)')} AS n FROM gv JOIN v ON v.id = query_id WHERE is_valid GROUP BY 1",
    "triplet_quality_report": f"WITH {GATED}, w AS (SELECT overlap_difference, difficulty FROM gv), u AS (UNPIVOT w ON overlap_difference, difficulty INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, min(value) AS min, max(value) AS max, {b('count(value)')} AS n FROM u GROUP BY metric",
    "validate_triplets": "WITH e AS (SELECT vec_id AS query_id, CASE label WHEN 1 THEN 'Missing field: query' WHEN 2 THEN 'Missing field: positive_doc_id' WHEN 3 THEN 'negative_doc_ids cannot be empty' WHEN 4 THEN 'Missing field: negative_doc_ids' ELSE '' END AS errors FROM embeddings) SELECT *, errors = '' AS is_valid FROM e",
    "eval_per_query_fixed_k": f"WITH {fixed()} SELECT * FROM f",
    "eval_per_query_truncated": f"""WITH {fixed()}, i AS (SELECT query_id, n, (SELECT coalesce(sum(1 / log2(j + 1)), 0) FROM range(1, 11) t(j) WHERE j <= n) AS ideal FROM n)
SELECT query_id, round(CASE WHEN any_value(ideal) > 0 THEN sum(rel / log2(rank + 1)) / any_value(ideal) ELSE 0 END, 6) AS ndcg, round(coalesce(1.0 / min(rank) FILTER (WHERE rel = 1), 0), 6) AS mrr, round(sum(rel) / 10.0, 6) AS precision,
round(CASE WHEN any_value(n) > 0 THEN sum(rel) / any_value(n) ELSE 0 END, 6) AS recall, round(CASE WHEN any_value(n) > 0 THEN sum(CASE WHEN rel = 1 THEN seen / CAST(rank AS DOUBLE) ELSE 0 END) / any_value(n) ELSE 0 END, 6) AS map FROM r JOIN i USING (query_id) GROUP BY query_id""",
    "eval_report": f"WITH {fixed()}, {report()} SELECT * FROM t",
    "eval_report_by_model": f"WITH {fixed()}, {fixed(HALF, '2')}, w AS (SELECT 'whole' AS model, * FROM f UNION ALL SELECT 'half', * FROM f2), u AS (UNPIVOT w ON ndcg, mrr, precision, recall, map INTO NAME metric VALUE value) SELECT model, metric, {stats('value')} FROM u GROUP BY ALL",
    "eval_retrieved_lists": f"WITH {near(10)} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS retrieved_ids, string_agg(CAST(rel AS VARCHAR), ',' ORDER BY rank) AS relevances FROM h GROUP BY query_id",
    "report_improvement": f"WITH {fixed()}, {report()}, {fixed(HALF, '2')}, {report('2')} SELECT metric, t2.mean AS baseline, t.mean AS improved, round(t.mean - t2.mean, 6) AS difference, round(CASE WHEN t2.mean <> 0 THEN 100 * (t.mean - t2.mean) / t2.mean ELSE 0 END, 6) AS percent FROM t JOIN t2 USING (metric)",
    "lexical_overlap_pairs": f"WITH {LEX} SELECT conv_id, turn, round({jac('a', 'b')}, 6) AS overlap FROM (SELECT conv_id, turn, list_distinct(a) AS a, list_distinct(b) AS b FROM o)",
    "bigram_overlap_pairs": f"WITH {LEX} SELECT conv_id, turn, round({jac('a', 'b')}, 6) AS overlap FROM (SELECT conv_id, turn, {grams('a', 2)} AS a, {grams('b', 2)} AS b FROM o)",
    "overlap_use": f"WITH {LEX}, j AS (SELECT round({jac('a', 'b')}, 6) AS x FROM (SELECT list_distinct(a) AS a, list_distinct(b) AS b FROM o)) SELECT CASE WHEN x < 0.5 THEN 'drop' WHEN x <= 0.7 THEN 'augment' ELSE 'high' END AS used_for, {b('count(*)')} AS n FROM j GROUP BY 1",
    "token_counts": f"SELECT doc_id, {b(f'len({ws("text")})')} AS n_ws, {b(f'len({words("text")})')} AS n_words, {b(f'len(list_distinct({ws("text")}))')} AS n_distinct FROM documents",
    "diacritic_fold": "SELECT doc_id, md5(translate(lower(text), 'ăâîșşțţ', 'aaisstt')) AS folded FROM documents",
    "text_truncation": "SELECT doc_id, substr(text, 1, 30) AS first_30, substr(text, 1, 60) AS first_60, substr(text, 1, 100) AS first_100 FROM documents",
    "first_lines": "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda l_: trim(l_)), lambda l_: l_ <> '')[1], '') AS line FROM documents",
    "body_coalesce": f"WITH {DOCS}, s AS (SELECT *, CASE WHEN length(body) > 500 THEN '' ELSE body END AS short FROM docs) SELECT doc_id, md5(coalesce(nullif(short, ''), nullif(title, ''), '')) AS falsy, md5(coalesce(short, title)) AS missing FROM s",
    "doc_text_concat": f"WITH {DOCS} SELECT doc_id, md5(trim(concat_ws(' ', title, body))) AS text FROM docs",
    "key_terms": f"WITH {DOCS} SELECT doc_id, array_to_string({KEY}, ' ') AS terms FROM docs",
    "concepts_topn": f"WITH {long_concepts(15, T.CONCEPT_STOP)} SELECT * FROM cr",
    "concept_overlap_group": f"WITH {long_concepts(10, T.CONCEPT_STOP_SHORT)}, s AS (SELECT source, doc_id, concept FROM cr JOIN documents USING (doc_id)), n AS (SELECT source, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY source), p AS (SELECT source, concept, count(DISTINCT doc_id) AS w FROM s GROUP BY ALL) SELECT source, {b('n_docs')} AS n_docs, {b('count_if(w = n_docs)')} AS n_common, {b('count(*)')} AS n_all, round(count_if(w = n_docs) / CAST(count(*) AS DOUBLE), 6) AS overlap FROM p JOIN n USING (source) GROUP BY source, n_docs",
    "query_type_classify": f"SELECT conv_id, turn, {qtype('text')} AS query_type FROM conversations WHERE role = 'user'",
    "lexical_retrieval_topk": f"""WITH q AS (SELECT item_id AS query_id, list_distinct({ws("text")}) AS a FROM benchmark), d AS (SELECT doc_id, list_distinct({ws("text")}) AS b FROM documents),
s AS (SELECT query_id, doc_id, round({jac("a", "b")}, 6) AS score FROM q, d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "bm25_corpus_stats": f"SELECT {b('count(*)')} AS n_docs, round(avg(len({ws('text')})), 6) AS avgdl FROM documents",
    "bm25_idf": f"WITH {IDF} SELECT token, {b('df')} AS df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {bm25(ASKED, 10)} SELECT * FROM top",
    "marco_answers": f"WITH {DOCS}, a AS (SELECT doc_id, {FIRST_SENTENCE} AS a FROM docs) SELECT doc_id, md5(a) AS answer, md5({formed('a')}) AS well_formed FROM a",
    "marco_records": f"""WITH {DOCS}, {bm25(f"SELECT doc_id AS query_id, {marco_query()} AS query FROM docs", 9, True)},
pl AS (SELECT query_id, doc_id, rank FROM top UNION ALL SELECT query_id, query_id, 0 FROM aq), ls AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS passage_ids, string_agg(CASE WHEN rank = 0 THEN '1' ELSE '0' END, ',' ORDER BY rank) AS is_selected FROM pl GROUP BY query_id),
an AS (SELECT doc_id, {FIRST_SENTENCE} AS a FROM docs) SELECT query_id, query, {qtype("query")} AS query_type, 'ro' AS language, passage_ids, is_selected, md5(a) AS answers, md5({formed("a")}) AS well_formed FROM aq JOIN ls USING (query_id) JOIN an ON an.doc_id = query_id""",
    "doc_type_routing": f"WITH {DOCS} SELECT source, {kind_of('source')} AS type, {b('count(*)')} AS n FROM docs GROUP BY ALL",
    **{f"querygen_{k}": f"WITH {DOCS}, g AS (SELECT doc_id, {generated(k)} AS qs FROM docs), i AS (SELECT doc_id, qs, unnest(range(1, len(qs) + 1)) AS i FROM g) SELECT doc_id, {b('i - 1')} AS nth, qs[i] AS query FROM i" for k in Q.ROUTES},
    "querygen_title_template": f"WITH {DOCS} SELECT doc_id, {title_query()} AS query FROM docs",
    "querygen_marco": f"WITH {DOCS} SELECT doc_id AS query_id, {marco_query()} AS query FROM docs",
    "querygen_synthetic": synthetic(),
    "query_quality": f"WITH {QUALITY} SELECT doc_id, {b('nth')} AS nth, quality FROM qq",
    "query_diversity": f"WITH {QUALITY} SELECT doc_id, {b('num_queries')} AS num_queries, avg_quality, diversity FROM dm",
    "quality_stats_by_type": f"WITH {QUALITY} SELECT type, {b('count(*)')} AS n, {stats('quality')} FROM qq GROUP BY type UNION ALL SELECT 'TOTAL', {b('count(*)')}, {stats('quality')} FROM qq",
    "quality_percentiles_by_type": f"WITH {QUALITY} SELECT type, {stats('quality', True)} FROM qq GROUP BY type",
    "quality_histogram": f"WITH {QUALITY}, bi AS (SELECT * FROM (VALUES (CAST(0.0 AS DOUBLE), CAST(0.3 AS DOUBLE)), (0.3, 0.5), (0.5, 0.7), (0.7, 1.0)) t(low, high)) SELECT type, low, high, {b('count_if(quality >= low AND quality < high)')} AS n, round(100.0 * count_if(quality >= low AND quality < high) / count(*), 6) AS percent, {b('count_if(quality >= 1.0)')} AS overflow FROM qq, bi GROUP BY type, low, high",
    "diversity_bands": f"WITH {QUALITY} SELECT type, {b('count_if(diversity > 0.5)')} AS n_high, {b('count_if(diversity BETWEEN 0.3 AND 0.5)')} AS n_medium, {b('count_if(diversity < 0.3)')} AS n_low FROM dm GROUP BY type",
    "cross_type_comparison": f"WITH {QUALITY} SELECT type, round(avg(avg_quality), 6) AS avg_quality, round(avg(diversity), 6) AS diversity, {b('sum(num_queries)')} AS n_queries, {b('count(*)')} AS n_docs FROM dm GROUP BY type",
    "split_rows": f"WITH {shuffled('embeddings', 'vec_id', 42)} SELECT vec_id, {cut(False)} FROM sp",
    "split_rows_cumulative": f"WITH {shuffled('embeddings', 'vec_id', 7)} SELECT vec_id, {cut(True)} FROM sp",
    "split_by_query": f"WITH k AS (SELECT DISTINCT conv_id FROM conversations), {shuffled('k', 'conv_id', 42)}, c AS (SELECT conv_id, {cut(False)} FROM sp) SELECT conv_id, turn, split FROM conversations JOIN c USING (conv_id)",
    "split_sorted_ids": f"WITH sp AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) SELECT vec_id, {cut(True)} FROM sp",
    "split_stats": f"WITH {shuffled('embeddings', 'vec_id', 42)}, c AS (SELECT {cut(False)} FROM sp) SELECT split, {b('count(*)')} AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS ratio FROM c GROUP BY split",
    "batch_assign": f"SELECT o_orderkey, {b('(row_number() OVER (ORDER BY o_orderkey) - 1) // 32')} AS batch FROM orders",
    "first_n_per_group": "SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 3",
    "category_ids": "WITH r AS (SELECT doc_id AS k, row_number() OVER (ORDER BY doc_id) - 1 AS original_id FROM documents) SELECT k, format('doc_{:06d}', original_id) AS doc_id, original_id FROM r",
    "renumber_ids": "SELECT doc_id AS k, format('{}_{:06d}', lang, row_number() OVER (ORDER BY doc_id) - 1) AS doc_id FROM documents",
    "template_rotation": "SELECT item_id, ['a $', 'b $', 'c $'][item_id % 3 + 1] AS template FROM benchmark",
    "corpus_union_counts": f"WITH {UNION} SELECT coalesce(source, 'unknown') AS source, {b('count(*)')} AS n FROM u GROUP BY 1",
    "corpus_union_urls": f"WITH {UNION} SELECT coalesce(url, '') <> '' AS has_url, {b('count(*)')} AS n, {b('sum(length(content))')} AS n_chars FROM u GROUP BY 1",
    "corpus_dedup_ids": f"SELECT conv_id AS doc_id, max(turn) AS turn, max_by(role, turn) AS role, {b('max_by(length(text), turn)')} AS n_chars FROM conversations GROUP BY conv_id",
    "source_counts": f"WITH {DOCS} SELECT {b("count_if(source = 'recipes-ro')")} AS recipes_ro, {b("count_if(source = 'news')")} AS news, {b("count_if(source = 'commoncrawl')")} AS commoncrawl FROM docs",
    "qrels_flatten": "SELECT DISTINCT CAST(quality AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id FROM labels",
    "qrels_counts": f"SELECT CAST(quality AS VARCHAR) AS query_id, {b('count(DISTINCT doc_id)')} AS num_positives FROM labels GROUP BY 1",
    "ranked_relevance": f"WITH {bm25(ASKED, 10)} SELECT query_id, rank, doc_id, {b('CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END')} AS rel FROM top",
    "column_profile_lineitem": column_profile("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_partkey"]),
    "column_profile_customer": column_profile("customer", ["c_acctbal"], ["c_name", "c_mktsegment"]),
    "provenance_audit": f"WITH k AS (SELECT lang, CASE WHEN regexp_matches(text, '(License|license|Copyright)') THEN 's' WHEN regexp_matches(text, '(example.com|555-)') THEN 'r' ELSE 'u' END AS k FROM documents) SELECT lang, {b('count(*)')} AS total, {b("count_if(k = 's')")} AS synthetic, {b("count_if(k = 'r')")} AS real, {b("count_if(k = 'u')")} AS unknown, {b("floor(100 * count_if(k = 's') / count(*))")} AS percent_synthetic FROM k GROUP BY lang",
    "events_by_type": f"SELECT event_type, {b('count(*)')} AS n, {stats('value', True)} FROM events GROUP BY event_type",
    "running_totals": f"WITH {DOCS}, g AS (SELECT {by_kind()} AS qs FROM (SELECT *, {kind_of('source')} AS kind FROM docs)) SELECT {b('count(*)')} AS n_records, {b('sum(len(qs))')} AS n_queries FROM g",
}
