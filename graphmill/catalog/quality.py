"""Roll-ups of quality, checks of phases, coherence of texts, word classes, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.catalog.graph import _E, star
from graphmill.catalog.search import _BM25, _bm25
from graphmill.catalog.text import _U
from graphmill.functions import measures, text, vector
from graphmill.operators import chunking, quality
from graphmill.operators.bloom import Bloom
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


@query(f"WITH {_BM25} SELECT query_id, count(*) AS results, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least_score, round(max(score), 6) AS most_score FROM bm GROUP BY 1")
def retrieval_statistics(spark, sf):
    s = quality.result_statistics(_bm25(spark, sf))
    return s.select("query_id", "results", *[F.round(c, 6).alias(c) for c in ("mean_score", "least_score", "most_score")])


_VALUES = "v AS (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL)"


def _events(spark, sf):
    return table(spark, sf, "events").where("value is not null")


@query(f"WITH {_VALUES} SELECT count(*) AS total, count(*) FILTER (value >= 50) AS above, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(median(value), 6) AS median FROM v")
def score_statistics(spark, sf):
    return quality.score_statistics(_events(spark, sf), "value", 50).withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query(f"""WITH {_VALUES}, m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS step FROM v)
SELECT CAST(CASE WHEN step > 0 THEN least(floor((value - lo) / step), 9) ELSE 0 END AS INT) AS bin, count(*) AS n FROM v, m GROUP BY 1""")
def score_histogram(spark, sf):
    return quality.score_histogram(_events(spark, sf), "value").select("bin", "n")


@query(f"WITH {_VALUES} SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM v GROUP BY 1")
def strategy_quality(spark, sf):
    q = quality.strategy_quality(_events(spark, sf), "event_type", "value")
    return q.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query(f"""WITH {_VALUES}, q AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) AS d FROM v GROUP BY 1), b AS (SELECT * FROM q WHERE event_type = 'view')
SELECT q.event_type, round(100 * (q.m - b.m) / b.m, 5) AS improvement, round((q.m - b.m) / sqrt(q.d ** 2 / q.n + b.d ** 2 / b.n), 5) AS t, coalesce(abs((q.m - b.m) / sqrt(q.d ** 2 / q.n + b.d ** 2 / b.n)) > 1.96, false) AS significant FROM q, b WHERE q.event_type <> 'view'""")
def strategy_comparison(spark, sf):
    q = quality.strategy_quality(_events(spark, sf), "event_type", "value")
    return quality.compared(q, "event_type", "view").withColumns({"improvement": F.round("improvement", 5), "t": F.round("t", 5)})


@query(f"WITH {_VALUES} SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING), 6) AS rolling FROM v")
def rolling_monitor(spark, sf):
    return quality.rolling(_events(spark, sf), ["event_id"], "value", 10, ["event_type"]).select("event_id", F.round("rolling", 6).alias("rolling"))


@query(f"""WITH {_VALUES}, r AS (SELECT event_id, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING) AS r FROM v)
SELECT event_id, CASE WHEN r < 20 THEN 'low' ELSE 'high' END AS alert FROM r WHERE r < 20 OR r > 120""")
def quality_alerts(spark, sf):
    r = quality.rolling(_events(spark, sf), ["event_id"], "value", 10, ["event_type"])
    return quality.alerts(r, "rolling", 20, 120).select("event_id", "alert")


@query("""WITH d AS (SELECT DISTINCT id, content FROM graph_documents), c AS (SELECT DISTINCT id, content FROM text_chunks), e AS (SELECT DISTINCT ON (id) id, name, confidence FROM extracted_entities ORDER BY id, extracted_at),
n AS (SELECT DISTINCT name AS x FROM extracted_entities WHERE name IS NOT NULL), r AS (SELECT source, target, confidence FROM extracted_relationships),
k AS (SELECT 'documents' AS phase, 'documents_not_empty' AS name, (SELECT count(*) > 0 FROM d) AS passed UNION ALL SELECT 'documents', 'contents_filled', (SELECT count(*) = 0 FROM d WHERE trim(coalesce(content, ''), ' ') = '')
UNION ALL SELECT 'chunks', 'chunks_created', (SELECT count(*) > 0 FROM c) UNION ALL SELECT 'chunks', 'no_empty_chunks', (SELECT count(*) = 0 FROM c WHERE trim(coalesce(content, ''), ' ') = '') UNION ALL SELECT 'chunks', 'ids_unique', (SELECT count(*) = count(DISTINCT id) FROM c)
UNION ALL SELECT 'coverage', 'content_coverage', (SELECT (SELECT sum(length(content)) FROM c) >= 0.9 * (SELECT sum(length(content)) FROM d))
UNION ALL SELECT 'entities', 'entities_found', (SELECT count(*) > 0 FROM e) UNION ALL SELECT 'entities', 'names_filled', (SELECT count(*) = 0 FROM e WHERE trim(coalesce(name, ''), ' ') = '') UNION ALL SELECT 'entities', 'confidence_valid', (SELECT count(*) = 0 FROM e WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false))
UNION ALL SELECT 'relations', 'relations_found', (SELECT count(*) > 0 FROM r) UNION ALL SELECT 'relations', 'no_self_relations', (SELECT count(*) = 0 FROM r WHERE source = target) UNION ALL SELECT 'relations', 'relation_confidence_valid', (SELECT count(*) = 0 FROM r WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false))
UNION ALL SELECT 'graph', 'ends_known', (SELECT count(*) = 0 FROM r WHERE source NOT IN (SELECT x FROM n) OR source IS NULL OR target NOT IN (SELECT x FROM n) OR target IS NULL))
SELECT phase, CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS checks, count(*) FILTER (NOT passed) AS failed FROM k GROUP BY 1""")
def phase_checks(spark, sf):
    d = table(spark, sf, "graph_documents").select("id", "content").distinct()
    c = table(spark, sf, "text_chunks").select("id", "content").distinct()
    e = table(spark, sf, "extracted_entities").select("name", F.col("name").alias("id"), F.col("confidence").cast("double").alias("confidence"))
    r = table(spark, sf, "extracted_relationships").select("source", "target", F.col("confidence").cast("double").alias("confidence"))
    return quality.phase_summary(quality.phase_checks(d, c, e, r))


@query("""SELECT doc_id, CASE WHEN coalesce(title, '') = '' THEN 'empty' WHEN strlen(title) > 10000 THEN 'too long' WHEN contains(lower(title), 'drop table') OR contains(lower(title), 'delete from') OR contains(lower(title), 'union select') OR contains(lower(title), 'insert into') OR contains(lower(title), 'update set') OR contains(lower(title), 'drop database') THEN 'forbidden' END AS fault,
regexp_replace(title, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g') AS clean FROM documents""")
def query_checks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", quality.query_fault("title").alias("fault"), quality.sanitized("title").alias("clean"))


@query(r"""WITH w AS (SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}\p{M}_]+')) AS a, list_distinct(regexp_extract_all(lower('rate the answer from 0 to 1 as json context question ' || coalesce(lang, '')), '[\p{L}\p{N}_]+')) AS k FROM documents)
SELECT query_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, k)) / len(a) END, 6) AS score, CASE WHEN len(a) = 0 THEN false ELSE len(list_intersect(a, k)) / len(a) >= 0.1 END AS passed FROM w""")
def evaluated_answers(spark, sf):
    """Titles as answers to the question of their language."""
    from graphmill.models import evaluated

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query"), F.col("title").alias("answer"))
    return evaluated(d, least=0.1).select("query_id", F.round("score", 6).alias("score"), "passed")


# ---------------------------------------------------------------- texts

_SENT = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"
_SETS = "list_transform({}, lambda s: list_distinct(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: w <> '')))"


@query(f"""WITH d AS (SELECT doc_id, {_SETS.format(_SENT)} AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM d WHERE len(s) > 1)
SELECT doc_id, round(avg(len(list_intersect(s[i], s[i + 1])) / len(list_distinct(list_concat(s[i], s[i + 1])))), 6) AS coherence FROM p GROUP BY 1 UNION ALL SELECT doc_id, 1.0 FROM d WHERE len(s) < 2""")
def sentence_coherence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(chunking.sentence_coherence("text"), 6).alias("coherence"))


_WS = "list_filter(string_split_regex(lower(coalesce({}, '')), '\\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, list_distinct({_WS.format('title')}) AS a, list_distinct({_WS.format('text')}) AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(list_concat(a, b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS cohesion FROM w""")
def lexical_cohesion(spark, sf):
    from graphmill.functions.similarity import jaccard

    return table(spark, sf, "documents").select("doc_id", F.round(jaccard(F.lower("title"), F.lower("text"), 0.0), 6).alias("cohesion"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '([ \\t\\r\\n\\f])', '\\1\\1', 'g') AS u FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[.!?](?:[ \\n]|$)')) - len(regexp_extract_all(u, '(?i)(?:^|[ \\t\\r\\n\\f])(?:Dr|Mr|Mrs|Ms|Prof|Jr|Sr|Inc|Corp|Ltd|Co|etc|vs|e\\.g|i\\.e|cf|pp)[.](?:[ \\n]|$)'))
- CASE WHEN regexp_matches(t, '^[A-Z]\\.(?:[ \\n]|$)') THEN 1 ELSE 0 END AS ends FROM d""")
def sentence_boundaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", chunking.sentence_ends("text").alias("ends"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(2, len(w))) AS i FROM t WHERE len(w) > 2)
SELECT doc_id, w[i] AS word, i - 1 AS place FROM p WHERE contains(lower(w[i - 1]), 'the') AND contains(lower(w[i]), 'a') AND contains(lower(w[i + 1]), 'of')""")
def context_windows(spark, sf):
    return chunking.contexts(table(spark, sf, "documents"), "doc_id", "text", "the", "a", "of")


_TAGS = "CASE WHEN regexp_matches(w, '^[[:punct:]]+$') THEN 'Punctuation' WHEN regexp_matches(w, '^[0-9]+$') THEN 'Number' " + " ".join(f"WHEN lower(w) IN ({', '.join(repr(x) for x in known)}) THEN '{name}'" for name, known in text.WORD_CLASSES.items()) + """
WHEN regexp_matches(w, '^\\p{Lu}') THEN 'ProperNoun' WHEN lower(w) LIKE '%ing' THEN 'VerbGerund' WHEN lower(w) LIKE '%ed' THEN 'VerbPast' WHEN lower(w) LIKE '%s' AND lower(w) NOT LIKE '%ss' THEN 'NounPlural'
WHEN regexp_matches(lower(w), '(ive|ous|ful)$') THEN 'Adjective' WHEN lower(w) LIKE '%ly' THEN 'Adverb' ELSE 'Noun' END"""


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(title, ''), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]')) AS w FROM documents) SELECT doc_id, {_TAGS} AS tag, count(*) AS n FROM w GROUP BY 1, 2""")
def word_classes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(text.tagged("title")).alias("t"))
    return d.groupBy("doc_id", F.col("t.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query()
def noun_phrases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.noun_phrases("text")).alias("phrase"))


def _chunker(name):
    def run(spark, sf):
        return chunking.chunk_with(table(spark, sf, "documents"), name, "doc_id", "text")

    run.__name__ = f"{name}_chunks"
    return query()(run)


sized_chunks, topic_chunks, hybrid_chunks, coherent_chunks = (_chunker(n) for n in ("sized", "topic", "hybrid", "coherent"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, n, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, n, string_split(t, chr(10) || chr(10)) AS ps FROM d WHERE n > 4000)),
o AS (SELECT doc_id, i, CAST(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2 AS BIGINT) AS a, CAST(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS BIGINT) AS b FROM p),
g AS (SELECT doc_id, i, a AS s, b FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, CASE WHEN o.b - g.s <= 4000 THEN g.s ELSE o.a END, o.b FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1),
x AS (SELECT doc_id, s, max(b) AS e FROM g GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, n FROM d WHERE n <= 4000), y AS (SELECT x.doc_id, s, e, substr(t, s + 1, e - s) AS content FROM x JOIN d ON d.doc_id = x.doc_id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS seq, s AS start_offset, e AS end_offset, content FROM y WHERE regexp_matches(content, '[^{_U}]')""")
def late_chunk_sections(spark, sf):
    return chunking.per_row(table(spark, sf, "documents"), "doc_id", "text", lambda t: chunking.late_sections(t, 4000), chunking.CHUNK)


# ---------------------------------------------------------------- membership and small measures


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def bloom_members(spark, sf):
    """Customers with an order: those that the filter admits, checked by a join."""
    o = table(spark, sf, "orders").select("o_custkey").distinct()
    some = Bloom.of(o, "o_custkey").admit(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return some.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT vec_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: x / n)), 5) AS total FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL))")
def unit_vectors(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", vector.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT doc_id, substr(text, 1, 20) AS short FROM documents")
def truncated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate("text", 20).alias("short"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normal FROM documents")
def normalized_for_linking(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_for_linking("title").alias("normal"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-02-10' AS inside, ts <= TIMESTAMP '2024-02-10' AND ts + INTERVAL '3 days' >= TIMESTAMP '2024-01-10' AS meets FROM events WHERE ts IS NOT NULL")
def temporal_predicates(spark, sf):
    e = table(spark, sf, "events").where("ts is not null")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-02-10 00:00:00"))
    t = F.col("ts").cast("timestamp_ntz")
    return e.select("event_id", measures.contains(a, b, t).alias("inside"), measures.overlaps(t, t + F.expr("interval 3 days"), a, b).alias("meets"))


@query("SELECT id, round(((title IS NOT NULL)::INT + (path IS NOT NULL)::INT + (content IS NOT NULL)::INT + (size_bytes IS NOT NULL)::INT + (created_at IS NOT NULL)::INT + (modified_at IS NOT NULL)::INT + (content_hash IS NOT NULL)::INT + (document_type IS NOT NULL)::INT + (language IS NOT NULL)::INT) / 9.0, 6) AS score, count(*) AS n FROM document_metadata GROUP BY ALL")
def metadata_completeness(spark, sf):
    m = table(spark, sf, "document_metadata")
    full = measures.completeness([F.col(c) for c in ("title", "path", "content", "size_bytes", "created_at", "modified_at", "content_hash", "document_type", "language")])
    return m.groupBy("id", F.round(full, 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'price' ELSE '' END AS changed, CASE WHEN o_orderkey % 2 = 0 THEN 'extra' ELSE '' END AS added FROM orders")
def property_changes(spark, sf):
    o = table(spark, sf, "orders")
    was = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.lit("1"))
    now = F.map_concat(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("1")), F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("extra"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    d = measures.map_changes(was, now)
    return o.select("o_orderkey", F.array_join(d["changed"], ",").alias("changed"), F.array_join(d["added"], ",").alias("added"))


@query(f"""WITH {_E}, u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, weight FROM e WHERE source <> target) SELECT a, b, round(sum(weight), 6) AS weight FROM u GROUP BY 1, 2""")
def undirected_graph(spark, sf):
    from graphmill.operators import graph

    return graph.undirected(star(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_E}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e) SELECT node, round(0.3 * length(node) + 0.4 * (CASE WHEN node LIKE 'N%' THEN 1 ELSE 0 END), 6) AS score FROM n""")
def combined_scores(spark, sf):
    from graphmill.operators import graph

    n = graph.oriented(star(spark, sf).select("source", "target")).select(F.col("source").alias("node")).distinct()
    long, nation = n.select("node", F.length("node").alias("score")), n.where("node like 'N%'").withColumn("score", F.lit(1.0))
    return graph.combine_scores({"vector": (long, 0.3), "rank": (nation, 0.4)}).withColumn("score", F.round("score", 6))
