"""The queries of the ten problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, dedup, encoding, mix, names, pairs, split, terms, vectors
from graphmill.operators.components import connected_components
from graphmill.session import materialize, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.id_pairs(*dedup.near_duplicates(table(spark, sf, "document_metadata")))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Of every record of 10 words or more, its group of similar records and the number of similar contents."""
    members, near = dedup.near_duplicates(table(spark, sf, "document_metadata"))
    near = materialize(near, "near")
    linked = near.select(F.col("a").alias("n")).unionByName(near.select(F.col("b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("links"))
    parts = connected_components(near, "a", "b").withColumnRenamed("node", "n")
    rows = members.join(linked, "n", "left").join(parts, "n", "left").select("id", F.coalesce("component", "n").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    names = rows.groupBy("c").agg(F.min("id").alias("group_id"))
    return rows.join(names, "c").select("id", "group_id", "links")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    best = vectors.nearest(table(spark, sf, "text_chunks"), k=5, least=0.8)
    return best.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    seen = dedup.new_records(table(spark, sf, "document_metadata"), table(spark, sf, "document_index"))
    return seen.where("verdict in ('known', 'copy', 'near')").select("id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = pairs.PairTable(spark)
    counts.apply(after=pairs.baskets(table(spark, sf, "text_chunks"), "id", "entities"))
    return counts.scores(min_count=4, min_lift=8.0).select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))


def p3_updated_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The table built without coll_main, then that collection merged as a change; scores of all pairs in 4 chunks or more."""
    chunks = table(spark, sf, "text_chunks")
    counts = pairs.PairTable(spark)
    later = F.coalesce(F.col("collection") == "coll_main", F.lit(False))
    # A chunk id delivered under two collections is all in the change.
    some = chunks.where(later).select("id").distinct()
    counts.apply(after=pairs.baskets(chunks.join(some, "id", "left_anti"), "id", "entities"))
    first = materialize(counts.scores(), "scores")
    changed = counts.apply(after=pairs.baskets(chunks.join(some, "id", "left_semi"), "id", "entities"))
    out = counts.rescored(first, changed).where("n_ab >= 4")
    return out.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_documents(table(spark, sf, "graph_documents"))


def _content_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.content_terms(table(spark, sf, "graph_documents"))


def p6_method(spark: SparkSession, sf: str) -> DataFrame:
    """Hypergeometric enrichment of every term of every document, both fields."""
    field = lambda name, df: terms.enrichment(df).select(F.lit(name).alias("field"), "document_id", "term", "tf", "score", "q")
    return field("content", _content_terms(spark, sf)).unionByName(field("keywords", terms.keyword_terms(table(spark, sf, "text_chunks"))))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    field = lambda name, df: terms.distinctive(df).select(F.lit(name).alias("field"), "document_id", "term")
    return field("content", _content_terms(spark, sf)).unionByName(field("keywords", terms.keyword_terms(table(spark, sf, "text_chunks"))))


def _typed_names(spark: SparkSession, sf: str) -> DataFrame:
    mentions = table(spark, sf, "extracted_entities").select("name", "entity_type")
    relations = table(spark, sf, "extracted_relationships")
    ends = relations.select(F.explode(F.array("source", "target")).alias("name"), F.lit(None).cast("string").alias("entity_type"))
    return mentions.unionByName(ends)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variant_pairs(names.variants(_typed_names(spark, sf), table(spark, sf, "given_name_forms")))


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Of every spelling with a variant, its group, named by the smallest spelling, and the number of its accepted links."""
    return names.variant_groups(names.variants(_typed_names(spark, sf), table(spark, sf, "given_name_forms")))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that encoding and decoding do not give back; none are expected."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = bpe.decode_ids(bpe.encode_texts(table(spark, sf, "documents")))
    return docs.join(back, "doc_id").where("was != text").select("doc_id")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = mix.sized(table(spark, sf, "documents"))
    rate = mix.rates(docs, table(spark, sf, "mix_targets"))
    return rate, mix.draw(docs, rate)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.reached(*_mix(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.Garbled(table(spark, sf, "documents")).found().withColumnRenamed("id", "doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.Garbled(table(spark, sf, "documents")).restored().withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_updated_scores": p3_updated_scores,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_method": p6_method,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

_P3 = """
WITH item AS (SELECT DISTINCT id, e FROM (SELECT id, unnest(entities) AS e FROM text_chunks) WHERE e IS NOT NULL),
n AS (SELECT e, count(*) AS n FROM item GROUP BY e),
total AS (SELECT count(DISTINCT id) AS n FROM item),
pair AS (SELECT x.e AS entity_a, y.e AS entity_b, count(*) AS n_ab FROM item x JOIN item y ON x.id = y.id AND x.e < y.e GROUP BY 1, 2)
"""

#: Distinct contents of 10 words or more with their shingles, and the pairs of them that are similar.
_NEAR = """
txt AS (SELECT content, min(id) AS h FROM document_metadata WHERE content IS NOT NULL AND id IS NOT NULL GROUP BY 1),
doc AS (SELECT h, list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) AS w FROM txt),
sh AS (SELECT DISTINCT h, s FROM (SELECT h, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM doc WHERE len(w) >= 10)),
n AS (SELECT h, count(*) AS n FROM sh GROUP BY 1), c AS (SELECT x.h AS a, y.h AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.h <> y.h GROUP BY 1, 2),
near AS (SELECT a, b FROM c JOIN n x ON x.h = a JOIN n y ON y.h = b WHERE c >= 0.5 * (x.n + y.n - c))"""

SQL: dict[str, str] = {
    "p1_groups": f"""WITH RECURSIVE {_NEAR}, r AS (SELECT h AS node, h AS c FROM n UNION SELECT near.b, r.c FROM r JOIN near ON near.a = r.node), g AS (SELECT node, min(c) AS c FROM r GROUP BY 1),
m AS (SELECT DISTINCT id, h FROM document_metadata JOIN txt USING (content) WHERE id IS NOT NULL), k AS (SELECT a, count(*) AS links FROM near GROUP BY 1),
x AS (SELECT m.id, g.c, coalesce(links, 0) AS links FROM m JOIN g ON g.node = m.h LEFT JOIN k ON k.a = m.h) SELECT id, min(id) OVER (PARTITION BY c) AS group_id, links FROM x""",
    "p5_found": f"""WITH RECURSIVE {_NEAR}, ids AS (SELECT id, min(batch_no) AS batch, arg_min(content, batch_no) AS content FROM document_metadata WHERE id IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1),
i AS (SELECT ids.*, txt.h, 'hash_' || left(sha256(ids.content), 16) AS proper FROM ids JOIN txt USING (content) WHERE regexp_matches(ids.content, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')),
old AS (SELECT DISTINCT h FROM i WHERE batch < 1), known AS (SELECT DISTINCT id FROM i JOIN document_index d ON d.content_hash = i.proper AND d.document_id <> i.id),
f AS (SELECT h, min((batch, id)) AS first FROM i WHERE batch >= 1 AND id NOT IN (SELECT id FROM known) AND h NOT IN (SELECT h FROM old) GROUP BY 1),
o AS (SELECT h, row_number() OVER (ORDER BY first) AS k, h IN (SELECT a FROM near WHERE b IN (SELECT h FROM old)) AS gone FROM f),
e AS (SELECT x.k AS later, list(y.k) AS before FROM near JOIN o x ON x.h = near.a JOIN o y ON y.h = near.b AND y.k < x.k GROUP BY 1),
q AS (SELECT o.k, o.gone, coalesce(before, []) AS before FROM o LEFT JOIN e ON e.later = o.k),
w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken UNION ALL SELECT q.k, CASE WHEN q.gone OR list_has_any(q.before, w.taken) THEN w.taken ELSE list_append(w.taken, q.k) END FROM w JOIN q ON q.k = w.k + 1),
good AS (SELECT h, first FROM f JOIN o USING (h) WHERE k IN (SELECT unnest(taken) FROM w WHERE k = (SELECT max(k) FROM w)))
SELECT id FROM i LEFT JOIN good USING (h) WHERE batch >= 1 AND (id IN (SELECT id FROM known) OR good.h IS NULL OR (batch, id) <> good.first)""",
    "p1_found": """
WITH doc AS (SELECT DISTINCT id, list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) AS w FROM document_metadata),
sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM doc WHERE len(w) >= 10)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
c AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE c >= 0.5 * (a.n + b.n - c)""",
    "p3_found": _P3 + """
SELECT entity_a, entity_b FROM pair JOIN n a ON a.e = entity_a JOIN n b ON b.e = entity_b, total
WHERE n_ab >= 4 AND n_ab * total.n >= 8 * a.n * b.n""",
    "p3_updated_scores": _P3 + """
SELECT entity_a, entity_b, n_ab, a.n AS n_a, b.n AS n_b, round(n_ab * total.n / (CAST(a.n AS DOUBLE) * b.n), 6) AS lift
FROM pair JOIN n a ON a.e = entity_a JOIN n b ON b.e = entity_b, total WHERE n_ab >= 4""",
    "p6_found": """
WITH word AS (SELECT 'content' AS field, id AS document_id, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}]+')) AS w FROM (SELECT DISTINCT id, content FROM graph_documents)),
kw AS (SELECT DISTINCT 'keywords' AS field, document_id, id, lower(trim(k)) AS w FROM (SELECT document_id, id, unnest(keywords) AS k FROM text_chunks) WHERE k IS NOT NULL AND trim(k) != ''),
tf AS (SELECT field, document_id, lower(w) AS term, count(*) AS tf FROM word WHERE length(w) >= 3 GROUP BY 1, 2, 3
       UNION ALL SELECT field, document_id, w, count(*) FROM kw GROUP BY 1, 2, 3),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
n AS (SELECT field, count(DISTINCT document_id) AS n FROM tf GROUP BY 1)
SELECT field, document_id, term FROM tf JOIN df USING (field, term) JOIN n USING (field)
WHERE df >= 2 AND tf * ln(n / df) / ln(n) >= 3""",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
}
