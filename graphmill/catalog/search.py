"""Ranked retrieval on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import vector
from graphmill.functions.text import PLAIN_STOP_WORDS, SEARCH_STOP_WORDS
from graphmill.operators import search
from graphmill.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


# The questions asked of the corpus.
QUESTIONS = (("q1", "letter archive"), ("q2", "private harbour policy of the guild"), ("q3", "memory canal memory"))


def questions(spark):
    return spark.createDataFrame(list(QUESTIONS), "query_id string, query string")


_STOP = ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS)
_TOK = f"list_filter(list_transform(string_split_regex(lower({{}}), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{{{L}}}}\\p{{{{N}}}}]', '', 'g')), lambda w: strlen(w) > 2 AND w NOT IN ({_STOP}))"
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ") t(query_id, query))"
_BM25 = f"""{_Q}, d AS (SELECT doc_id, {_TOK.format("coalesce(text, '')")} AS t FROM documents), w AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS n FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM q) GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id AS id, sum(times * (ln(docs / df) + 1) * (n / length * 2.2) / (n / length + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN qt USING (term) JOIN df USING (term), w GROUP BY 1, 2)"""


def _bm25(spark, sf):
    return search.bm25(table(spark, sf, "documents"), questions(spark), "doc_id", "text")


@query(f"WITH {_BM25} SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(spark, sf):
    return search.ranked(_bm25(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1""")
def term_df(spark, sf):
    return search.document_frequency(search.postings(table(spark, sf, "documents"), "doc_id", "text"))


_KW = ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS + "is was are been has had were said did".split())


@query(f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_-]', '', 'g'))), lambda w: strlen(w) > 2 AND w NOT IN ({_KW}) AND NOT regexp_full_match(w, '\\p{{N}}+')) AS t FROM documents),
tf AS (SELECT doc_id, length, term, count(*) AS n FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, term, n / length * ln((SELECT count(*) FROM documents) / df) AS score FROM tf JOIN df USING (term))
SELECT id, term, round(score, 6) AS score FROM (SELECT doc_id AS id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS r FROM s) WHERE r <= 5""")
def tfidf_keywords(spark, sf):
    t = search.tfidf(table(spark, sf, "documents"), "doc_id", "text").withColumn("key", F.round("score", 9))
    return search.top_k(t, 5, ["id"], [F.desc("key"), F.asc("term")]).select("id", "term", F.round("score", 6).alias("score"))


_PLAIN = ", ".join(f"'{w}'" for w in PLAIN_STOP_WORDS)


@query(f"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: strlen(w) > 3 AND w NOT IN ({_PLAIN}))) AS term FROM documents), c AS (SELECT id, term, count(*) AS n FROM w GROUP BY 1, 2)
SELECT id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 5""")
def frequent_words(spark, sf):
    return search.frequent_words(table(spark, sf, "documents"), "doc_id", "text", 5)


# ---------------------------------------------------------------- vectors

_VEC = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"


def _queries(spark, sf):
    """Every vector whose id is divisible by 20."""
    v = table(spark, sf, "embeddings").where("embedding is not null")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS rank
FROM {_VEC} q, {_VEC} v WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def knn_batch(spark, sf):
    return search.knn(table(spark, sf, "embeddings"), _queries(spark, sf), 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, exp(-list_distance(q.e, v.e)) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, v.e), v.vec_id) AS rank
FROM {_VEC} q, {_VEC} v WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def knn_exp_euclidean(spark, sf):
    return search.knn(table(spark, sf, "embeddings"), _queries(spark, sf), 10, "vec_id", "embedding", "exp_euclidean").withColumn("score", F.round("score", 6))


@query(f"""SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM {_VEC} q, {_VEC} v WHERE q.vec_id % 20 = 0 AND list_cosine_similarity(q.e, v.e) >= 0.5""")
def range_search(spark, sf):
    return search.within(table(spark, sf, "embeddings"), _queries(spark, sf), 0.5, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"""SELECT label, pos - 1 AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""")
def centroids(spark, sf):
    return search.centroid(table(spark, sf, "embeddings"), "embedding", ["label"]).withColumn("value", F.round("value", 6))


@query(f"""SELECT count(*) AS vectors, max(len(e)) AS dimension, round(min(n), 6) AS least, round(avg(n), 6) AS mean, round(max(n), 6) AS most FROM (SELECT e, sqrt(list_inner_product(e, e)) AS n FROM {_VEC})""")
def vector_statistics(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null").select(F.size("embedding").alias("d"), vector.norm("embedding").alias("n"))
    return v.agg(F.count(F.lit(1)).alias("vectors"), F.max("d").alias("dimension"), F.round(F.min("n"), 6).alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.max("n"), 6).alias("most"))


@query(f"""SELECT source, target, round(score, 6) AS score FROM (SELECT q.vec_id AS source, v.vec_id AS target, list_cosine_similarity(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS r
FROM {_VEC} q, {_VEC} v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND list_cosine_similarity(q.e, v.e) > 0.3) WHERE r <= 5""")
def similarity_edges(spark, sf):
    near = search.knn(table(spark, sf, "embeddings"), _queries(spark, sf), 6, "vec_id", "embedding").where("query_id != id and score > 0.3")
    return search.ranked(near.drop("rank"), 5).select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.round("score", 6).alias("score"))


@query()
def hashed_embeddings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    return d.select("doc_id", vector.hash_embedding("w", 16).alias("embedding"))


# ---------------------------------------------------------------- fusion


def _two_lists(spark, sf):
    """Keyword list, and a list by closeness of the length to the query's own target, both of documents."""
    kw = search.ranked(_bm25(spark, sf), 100).drop("rank")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars").where("n_chars > 0")
    other = d.crossJoin(F.broadcast(questions(spark))).select("query_id", "id", (1 / (1 + F.abs(F.col("n_chars") - 500 - F.length("query")))).alias("score"))
    return search.ranked(other, 100).drop("rank"), kw


_LISTS = f"""{_BM25}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM bm) WHERE k <= 100),
lo AS (SELECT query_id, doc_id AS id, 1 / (1 + abs(n_chars - 500 - length(query))) AS score FROM documents, q WHERE n_chars > 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM lo) WHERE k <= 100)"""


def _fused(expr: str) -> str:
    return f"""WITH {_LISTS}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM l), n AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r)
SELECT coalesce(m.query_id, n.query_id) AS query_id, coalesce(m.id, n.id) AS id, round({expr}, 6) AS score FROM m FULL JOIN n ON m.query_id = n.query_id AND m.id = n.id"""


def _fusion(spark, sf, method):
    left, right = _two_lists(spark, sf)
    return search.fuse(left, right, method).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_fused("coalesce(0.7 / (60 + m.k), 0) + coalesce(0.3 / (60 + n.k), 0)"))
def rrf(spark, sf):
    return _fusion(spark, sf, "rrf")


@query(_fused("coalesce(0.7 * m.score / m.best, 0) + coalesce(0.3 * n.score / n.best, 0)"))
def weighted_fusion(spark, sf):
    return _fusion(spark, sf, "weighted")


@query(_fused("coalesce(m.score, 0) + coalesce(n.score, 0)"))
def combsum(spark, sf):
    return _fusion(spark, sf, "combsum")


@query(_fused("greatest(coalesce(m.score, 0), coalesce(n.score, 0))"))
def max_fusion(spark, sf):
    return _fusion(spark, sf, "max")


@query(f"""WITH {_LISTS}, u AS (SELECT query_id, id, 2 * k AS key FROM l UNION ALL SELECT query_id, id, 2 * k + 1 FROM r), b AS (SELECT query_id, id, min(key) AS key FROM u GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY key, id) AS rank FROM b""")
def interleave(spark, sf):
    return search.merge_lists(*_two_lists(spark, sf)).select("query_id", "id", "rank")


@query(f"""WITH {_LISTS}, u AS (SELECT query_id, id, k AS key FROM l UNION ALL SELECT query_id, id, 1000000000 + k FROM r), b AS (SELECT query_id, id, min(key) AS key FROM u GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY key, id) AS rank FROM b""")
def high_first(spark, sf):
    return search.merge_lists(*_two_lists(spark, sf), how="high_first").select("query_id", "id", "rank")


def _results(spark, sf):
    """Keyword results with a type, content and entities."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), "title")
    kind = F.when(F.col("id") % 3 == 0, "Entity").when(F.col("id") % 3 == 1, "Chunk").otherwise("Hybrid")
    return _bm25(spark, sf).join(d, "id").withColumn("result_type", kind).withColumn("entities", F.split("title", " "))


_RES = f"{_BM25}, res AS (SELECT bm.query_id, bm.id, bm.score, coalesce(text, '') AS content, CASE WHEN doc_id % 3 = 0 THEN 'Entity' WHEN doc_id % 3 = 1 THEN 'Chunk' ELSE 'Hybrid' END AS result_type FROM bm JOIN documents ON doc_id = id)"


@query(f"""WITH {_RES} SELECT query_id, id, result_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_type ORDER BY score DESC, id) AS r FROM res) WHERE r <= CASE result_type WHEN 'Entity' THEN 4 WHEN 'Chunk' THEN 6 ELSE 3 END""")
def type_quota(spark, sf):
    return search.type_quota(_results(spark, sf), 12).select("query_id", "id", "result_type")


@query(f"""WITH {_RES} SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(left(content, 50), '[^\\p{{L}}\\p{{N}}]', '', 'g') || '_' || strlen(content) ORDER BY score DESC, id) AS r FROM res) WHERE r = 1""")
def content_dedup(spark, sf):
    return search.best_per_content(_results(spark, sf), "content").select("query_id", "id")


@query(f"""WITH {_RES}, twice AS (SELECT query_id, id, score FROM res UNION ALL SELECT query_id, id, score / 2 FROM res) SELECT query_id, id, round(max(score), 6) AS score FROM twice GROUP BY 1, 2""")
def id_dedup(spark, sf):
    r = _results(spark, sf).select("query_id", "id", "score")
    return search.best_per_id(r.unionByName(r.withColumn("score", F.col("score") / 2))).withColumn("score", F.round("score", 6))


@query(f"""WITH {_RES}, g AS (SELECT query_id, left(content, 50) AS k, avg(score) AS m, count(DISTINCT result_type) AS t FROM res GROUP BY 1, 2) SELECT query_id, k AS content_key, round(least(m + 0.2 * (t - 1), 1), 6) AS score FROM g WHERE t > 1""")
def cross_strategy(spark, sf):
    return search.across_types(_results(spark, sf)).select("query_id", "content_key", F.round("score", 6).alias("score"))


@query(f"""WITH {_RES}, r AS (SELECT res.query_id, res.id, res.score, string_split(d.title, ' ') AS es, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM res JOIN documents d ON d.doc_id = res.id),
n AS (SELECT DISTINCT query_id, k FROM (SELECT query_id, e, min(r) AS k FROM (SELECT query_id, r, unnest(es) AS e FROM r) GROUP BY 1, 2)), m AS (SELECT r.*, score > 0.8 OR k IS NOT NULL OR r <= 5 AS fine FROM r LEFT JOIN n ON n.query_id = r.query_id AND n.k = r.r)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fine DESC, r) AS p FROM m) WHERE p <= 10""")
def diverse_selection(spark, sf):
    return search.diverse(_results(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25} SELECT query_id, round(greatest(0, least(1, 0.7 * avg(score) + 0.3)), 6) AS confidence FROM bm GROUP BY 1""")
def answer_confidence(spark, sf):
    return search.explained(_results(spark, sf), "content").select("query_id", F.round("confidence", 6).alias("confidence"))


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN lower(c_name) = 'customer#00000001' THEN 1.0 ELSE 0.8 END AS score FROM customer WHERE contains(lower(c_name), 'customer#00000001')""")
def name_search(spark, sf):
    return search.substring_search(table(spark, sf, "customer"), "Customer#00000001", "c_custkey", "c_name")


@query("""WITH c AS (SELECT DISTINCT ON (id) id, keywords, chapter FROM text_chunks ORDER BY id)
SELECT id, round(least(0.5 + 0.2 * len(list_intersect(list_transform(coalesce(keywords, []), lambda k: lower(k)), ['record', 'chapter', 'silent'])) / 3 + CASE WHEN regexp_matches(lower(coalesce(chapter, '')), 'record|chapter|silent') THEN 0.15 ELSE 0 END, 1.0), 6) AS score FROM c""")
def metadata_boost(spark, sf):
    c = table(spark, sf, "text_chunks").select(F.lit("q").alias("query_id"), "id", F.lit(0.5).alias("score"), "keywords", "chapter").dropDuplicates(["id"])
    return search.boosted_by_metadata(c, ["record", "chapter", "silent"]).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- end to end


def _engine(spark, sf):
    from graphmill.api import Engine

    e = Engine(spark, dimension=32)
    e.add_documents(table(spark, sf, "graph_documents"))
    return e


@query()
def build_graph(spark, sf):
    return _engine(spark, sf).statistics()


@query()
def hybrid_search(spark, sf):
    return _engine(spark, sf).search(questions(spark), 10).select("query_id", "id", "score", "rank")


@query()
def pagerank_search(spark, sf):
    return _engine(spark, sf).ranked_search(questions(spark), 10, 5).select("id", "score")


@query()
def ask(spark, sf):
    return _engine(spark, sf).ask(questions(spark), 5).select("query_id", "confidence", "answer")


@query()
def refined_search(spark, sf):
    from graphmill.operators import inference

    d = table(spark, sf, "documents")
    better = inference.refined_queries(_bm25(spark, sf), d, questions(spark), "doc_id", "text")
    return search.ranked(search.bm25(d, better, "doc_id", "text"), 10)


@query()
def generated_answers(spark, sf):
    from graphmill import models

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    return models.checked(models.answers(questions(spark), _bm25(spark, sf).join(d, "id"))).select("query_id", "answer", "grounded", "accepted")


@query()
def gleaned_entities(spark, sf):
    from graphmill import models

    return models.gleaned(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")
