"""Text functions, chunkers and document structure."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from graphmill.functions import measures, similarity, text
from graphmill.operators import chunking
from graphmill.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS words FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", text.word_count("text").alias("words"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", text.clean("text").alias("cleaned"))


@query("""SELECT doc_id, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')) AS sentences FROM documents""")
def sentence_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(text.sentences("text")).alias("sentences"))


@query("""SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]?'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')) AS sentences FROM documents""")
def sentence_split_kept(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(text.sentences_kept("text")).alias("sentences"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[ñóéíáú]') THEN 'es' WHEN regexp_matches(text, '[çãõ]') THEN 'pt' WHEN regexp_matches(text, '[àèùò]') THEN 'fr' ELSE 'en' END AS guess FROM documents""")
def detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", text.detect_language("text").alias("guess"))


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS words, greatest(len(regexp_extract_all(t, '[.!?]')), 1) AS sentences,
 greatest(len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: trim(p) <> '')), 1) AS paragraphs, length(t) AS characters FROM t)
SELECT doc_id, words, sentences, paragraphs, characters, round(words / sentences, 6) AS words_per_sentence, round(CASE WHEN words > 0 THEN characters / words ELSE 0 END, 6) AS chars_per_word FROM s""")
def text_stats(spark, sf):
    cols = text.text_statistics("text")
    return docs(spark, sf).select("doc_id", *[F.round(c, 6).alias(n) if "_per_" in n else c.alias(n) for n, c in cols.items()])


@query("SELECT doc_id, strlen(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf):
    return docs(spark, sf).select("doc_id", text.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id, regexp_replace(text, '<[^>]*>', '', 'g') AS stripped FROM documents")
def strip_tags(spark, sf):
    return docs(spark, sf).select("doc_id", text.strip_tags("text").alias("stripped"))


@query("""SELECT doc_id, regexp_replace(left(coalesce(text, ''), 50), '[^\\p{L}\\p{N}]', '', 'g') || '_' || strlen(coalesce(text, '')) AS signature FROM documents""")
def content_signature(spark, sf):
    return docs(spark, sf).select("doc_id", text.content_signature("text").alias("signature"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^\\p{L}\\p{N}_]', '', 'g') AS normal, 'CUSTOMER_' || regexp_replace(lower(c_name), '[^\\p{L}\\p{N}_]', '', 'g') AS entity_id FROM customer")
def normalize_name(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.normalize_name("c_name").alias("normal"), text.entity_id(F.lit("CUSTOMER"), "c_name").alias("entity_id"))


@query("""WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT id, content FROM graph_documents WHERE content IS NOT NULL))
SELECT id, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level, count(*) AS headings FROM l WHERE regexp_matches(line, '^#{1,6}\\s') GROUP BY 1, 2""")
def heading_levels(spark, sf):
    lines = table(spark, sf, "graph_documents").select("id", "content").distinct().where("content is not null").select("id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.select("id", text.heading_level("line").alias("level")).where("level is not null").groupBy("id", "level").agg(F.count(F.lit(1)).alias("headings"))


#: White space as Python sees it, for a character class of the SQL engine; line ends of the JVM's patterns.
_U = "\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_EOL = "\\n\\r\\x{85}\\x{2028}\\x{2029}"


@query(f"""WITH d AS (SELECT DISTINCT id, content FROM graph_documents), h AS (SELECT id, trim(regexp_extract(coalesce(content, ''), '(?:^|[{_EOL}])#{{1,6}}[\\s\\x{{0b}}]+([^{_EOL}]+)', 1), ' ') AS h, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS l FROM d),
t AS (SELECT id, CASE WHEN h <> '' THEN h ELSE l END AS title FROM h), x AS (SELECT id, title, trim(title, ' ') AS t FROM t)
SELECT DISTINCT id, title, coalesce(nullif(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)[.)]?\\s', 1), ''), nullif(regexp_extract(t, '(?i)^(?:chapter|section|part)\\s+(\\d+|[ivxlcdm]+)\\b', 1), ''), nullif(regexp_extract(t, '^([IVXLCDM]+)[.)]\\s', 1), ''), nullif(regexp_extract(t, '^([A-Z])[.)]\\s', 1), '')) AS number FROM x""")
def document_titles(spark, sf):
    return table(spark, sf, "graph_documents").select("id", text.title_of("content").alias("title"), text.section_number(text.title_of("content")).alias("number")).distinct()


@query("""SELECT n AS numeral, v AS value FROM (VALUES ('I', 1), ('IV', 4), ('IX', 9), ('XLII', 42), ('MCMXCIV', 1994)) AS t(n, v)""")
def roman_numerals(spark, sf):
    df = spark.createDataFrame([(x,) for x in ("I", "IV", "IX", "XLII", "MCMXCIV")], "numeral string")
    return df.select("numeral", text.roman_value("numeral").alias("value"))


@query("""SELECT doc_id, (CAST(regexp_extract(text, '([0-9]{1,4})', 1) AS BIGINT) * CASE WHEN regexp_matches(text, '(?i)\\b(bc|bce|b\\.c\\.)') THEN -1 ELSE 1 END - 1970) * 365 * 86400 AS seconds
FROM documents WHERE regexp_matches(text, '[0-9]')""")
def fact_times(spark, sf):
    return docs(spark, sf).where(F.col("text").rlike("[0-9]")).select("doc_id", text.fact_time("text").alias("seconds"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT *, coalesce(least(nullif(strpos(lower(t), 'letter'), 0), nullif(strpos(lower(t), 'archive'), 0)), 1) AS p FROM d), s AS (SELECT *, greatest(p - 40, 1) AS s FROM a)
SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(t, s, 80) || CASE WHEN s + 79 < length(t) THEN '...' ELSE '' END AS preview FROM s""")
def content_previews(spark, sf):
    return docs(spark, sf).select("doc_id", text.preview("text", "letter archive", 80).alias("preview"))


# ---------------------------------------------------------------- similarity of names



def _name_pairs(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("a_key"), F.col("c_name").alias("a"))
    right = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b_key"), F.col("n_name").alias("b"))
    return left.crossJoin(F.broadcast(right))  # 25 nations, a fixed table


@query("""SELECT c_custkey AS a_key, n_nationkey AS b_key, levenshtein(c_name, n_name) AS distance,
round(1 - levenshtein(c_name, n_name) / greatest(strlen(c_name), strlen(n_name)), 6) AS similarity FROM customer, nation""")
def levenshtein_similarity(spark, sf):
    return _name_pairs(spark, sf).select("a_key", "b_key", F.levenshtein("a", "b").alias("distance"), F.round(similarity.levenshtein_similarity("a", "b"), 6).alias("similarity"))


@query("""SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, round(jaro_similarity(a.n_name, b.n_name), 6) AS jaro, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS jaro_winkler FROM nation a, nation b""")
def jaro_winkler(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a_key"), F.col("n_name").alias("a"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b_key"), F.col("n_name").alias("b"))
    return a.crossJoin(F.broadcast(b)).select("a_key", "b_key", F.round(similarity.jaro("a", "b"), 6).alias("jaro"), F.round(similarity.jaro_winkler("a", "b"), 6).alias("jaro_winkler"))


_WORDS = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


@query(f"""WITH w AS (SELECT p_partkey, {_WORDS.format('p_name')} AS a, {_WORDS.format('p_type')} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS containment FROM w""")
def token_overlap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(similarity.jaccard("p_name", "p_type"), 6).alias("jaccard"), F.round(similarity.containment("p_name", "p_type"), 6).alias("containment"))


def _soundex(name: str) -> str:
    letters = f"regexp_replace(upper({name}), '[^A-Z]', '', 'g')"
    digits = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '111122222222334556')"
    for _ in range(2):
        for d in "123456":
            digits = f"replace(replace({digits}, '{d * 3}', '{d}'), '{d * 2}', '{d}')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE left(left({letters}, 1) || substr({digits}, CASE WHEN contains('BFPVCGJKQSXZDTLMNR', left({letters}, 1)) THEN 2 ELSE 1 END) || '000', 4) END"


@query(f"SELECT n_name, {_soundex('n_name')} AS code FROM nation")
def soundex_codes(spark, sf):
    return table(spark, sf, "nation").select("n_name", similarity.soundex_steady("n_name").alias("code"))


_LINK = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT c_custkey AS a_key, n_nationkey AS b_key, lower(c_name) AS a, lower(n_name) AS b, {_LINK.format('c_name')} AS x, {_LINK.format('n_name')} AS y FROM customer, nation),
w AS (SELECT *, {_WORDS.format('a')} AS wa, {_WORDS.format('b')} AS wb, {_WORDS.format('x')} AS wx, {_WORDS.format('y')} AS wy FROM p), j AS (SELECT *, len(list_intersect(wa, wb)) AS common, len(list_distinct(list_concat(wa, wb))) AS every, levenshtein(x, y) AS d FROM w)
SELECT a_key, b_key, round(0.4 * common / every + 0.4 * common / least(len(wa), len(wb)) + 0.2 * (1 - levenshtein(a, b) / greatest(strlen(a), strlen(b))), 6) AS text,
round(CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE common / every END, 6) AS name,
round(CASE WHEN x = y THEN 1 ELSE greatest(CASE WHEN d > 2 THEN 0 ELSE 1 - d / greatest(strlen(x), strlen(y)) END, jaro_winkler_similarity(x, y), len(list_intersect(wx, wy)) / len(list_distinct(list_concat(wx, wy))), CASE WHEN {_soundex('x')} = {_soundex('y')} THEN 0.9 ELSE 0 END) END, 6) AS link FROM j""")
def combined_similarity(spark, sf):
    parts = {"text": similarity.text_similarity("a", "b"), "name": similarity.name_similarity("a", "b"), "link": similarity.link_similarity("a", "b", True)}
    return _name_pairs(spark, sf).select("a_key", "b_key", *[F.round(c, 6).alias(n) for n, c in parts.items()])


# ---------------------------------------------------------------- answers


def _answers(spark, sf):
    """Title and whole text of each document, as truth and answer."""
    return docs(spark, sf).select("doc_id", F.col("text").alias("answer"), F.col("title").alias("truth"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS g, list_filter(string_split_regex(lower(coalesce(title, '')), '\\s+'), lambda w: w <> '') AS t FROM documents),
h AS (SELECT doc_id, g, t, len(list_filter(g, lambda w: list_contains(t, w))) AS h FROM t)
SELECT doc_id, round(CASE WHEN h = 0 OR len(g) = 0 OR len(t) = 0 THEN 0 ELSE 2 * (h / len(g)) * (h / len(t)) / (h / len(g) + h / len(t)) END, 6) AS f1 FROM h""")
def answer_f1(spark, sf):
    return _answers(spark, sf).select("doc_id", F.round(measures.f1("answer", "truth"), 6).alias("f1"))


_GRAMS = "SELECT doc_id, n, unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i:i + n - 1], ' '))) AS gram FROM w, range(1, 5) r(n) WHERE len({0}) >= n"


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[{_U}]+'), lambda x: x <> '') AS g, list_filter(string_split_regex(coalesce(title, ''), '[{_U}]+'), lambda x: x <> '') AS t FROM documents),
a AS (SELECT doc_id, n, gram, count(*) AS c FROM ({_GRAMS.format('g')}) GROUP BY 1, 2, 3), b AS (SELECT doc_id, n, gram, count(*) AS k FROM ({_GRAMS.format('t')}) GROUP BY 1, 2, 3),
p AS (SELECT doc_id, n, sum(least(c, coalesce(k, 0))) AS hit, sum(c) AS every FROM a LEFT JOIN b USING (doc_id, n, gram) GROUP BY 1, 2), q AS (SELECT doc_id, count(*) AS n, min(hit) AS least_hit, sum(CASE WHEN hit > 0 THEN ln(hit / every) END) / 4 AS l FROM p GROUP BY 1)
SELECT w.doc_id, round(CASE WHEN q.n = 4 AND least_hit > 0 THEN exp(l) * CASE WHEN len(g) >= len(t) THEN 1 ELSE exp(1 - len(t) / len(g)) END ELSE 0 END, 6) AS bleu FROM w LEFT JOIN q ON q.doc_id = w.doc_id""")
def answer_bleu(spark, sf):
    return _answers(spark, sf).select("doc_id", F.round(measures.bleu4("answer", "truth"), 6).alias("bleu"))


@query()
def answer_rouge(spark, sf):
    return _answers(spark, sf).select("doc_id", measures.rouge_l("answer", "truth").alias("rouge_l"))


# ---------------------------------------------------------------- chunkers


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE length(text) > 0)
SELECT doc_id, (s - 1) // 900 AS seq, s - 1 AS start_offset, least(s - 1 + 1000, length(t)) AS end_offset, substr(t, s, 1000) AS content
FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(length(t), 1), 900)) AS s FROM d)""")
def fixed_chunks(spark, sf):
    return chunking.fixed_chunks(docs(spark, sf), "doc_id", "text", 1000, 100)


@query("""SELECT doc_id, i - 1 AS seq, p AS content FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM
(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL))""")
def paragraph_chunks(spark, sf):
    return chunking.paragraph_chunks(docs(spark, sf), "doc_id", "text")


def _walked(cut: str, following: str, kept: str) -> str:
    """Chunks that follow each other: ``cut`` gives the end of the one from s to at most z, ``following`` the next start from s and e."""
    one = lambda rows: f"SELECT doc_id, t, n, s, CASE WHEN z < n THEN {cut} ELSE z END AS e FROM (SELECT *, least(s + 1000, n) AS z FROM ({rows}))"
    first, more = one("SELECT doc_id, t, n, 0::BIGINT AS s FROM d WHERE n > 0"), one(f"SELECT doc_id, t, n, {following} AS s FROM c WHERE e < n")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS ({first} UNION ALL {more})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS seq, s AS start_offset, e AS end_offset, substr(t, s + 1, e - s) AS content FROM c WHERE {kept}"""


def _before(piece: str, mark: str) -> str:
    """How many characters of a piece come before the last ``mark`` in it."""
    return f"length(regexp_extract({piece}, '(?s)^(.*){mark}', 1))"


_LAST_200, _LAST_50 = "substr(t, greatest(s, z - 200) + 1, z - greatest(s, z - 200))", "substr(t, greatest(s, z - 50) + 1, z - greatest(s, z - 50))"
_ENDED = f"regexp_extract({_LAST_200}, '(?s)^(.*[.!?])(?:[{_U}]|$)', 1)"
_SPACE = f"greatest(s, z - 50) + {_before(_LAST_50, ' ')}"


@query(_walked(f"CASE WHEN {_ENDED} <> '' THEN greatest(s, z - 200) + length({_ENDED}) WHEN contains({_LAST_50}, ' ') AND {_SPACE} > s THEN {_SPACE} ELSE z END", "greatest(s + 1, e - 200)", f"regexp_matches(substr(t, s + 1, e - s), '[^{_U}]')"))
def window_chunks(spark, sf):
    return chunking.window_chunks(docs(spark, sf), "doc_id", "text", 1000, 200)


_SLICE = "substr(t, s + 1, z - s)"
_MARKED = [(f"s + {_before(_SLICE, re.escape(m) if m.strip() else m)} + {len(m)}", m) for m in chunking.SEPARATORS]
_BACK = "substr(t, s + 2, greatest(e - 200 - s - 1, 0))"
_WORD = f"CASE WHEN e - 200 > s + 1 AND regexp_matches({_BACK}, '[ \\n\\t]') THEN s + 2 + {_before(_BACK, '[ ' + chr(92) + 'n' + chr(92) + 't]')} ELSE greatest(e - 200, s + 1) END"


@query(_walked("CASE " + " ".join(f"WHEN contains({_SLICE}, '{m}') AND {at} > s + (z - s) // 4 THEN {at}" for at, m in _MARKED) + " ELSE z END", _WORD, f"length(regexp_replace(substr(t, s + 1, e - s), '^[{_U}]+|[{_U}]+$', '', 'g')) >= 50"))
def hierarchical_chunks(spark, sf):
    return chunking.hierarchical_chunks(docs(spark, sf), "doc_id", "text", 1000, 200)


_SENTENCES = f"""k AS (SELECT doc_id, t, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM (SELECT doc_id, text AS t, regexp_extract_all(text, '[.!?]+|[^.!?]+[.!?]*[{_U}]*') AS ks FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, t, k, sum(length(k)) OVER (PARTITION BY doc_id ORDER BY i) - length(k) AS a, i FROM k),
sn AS (SELECT doc_id, t, a, a + length(k) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM o WHERE NOT regexp_full_match(k, '[.!?]+') AND regexp_matches(k, '[^{_U}]'))"""


@query(f"""WITH {_SENTENCES} SELECT doc_id, CAST(n // 5 AS INT) AS seq, CAST(min(a) AS BIGINT) AS start_offset, CAST(max(b) AS BIGINT) AS end_offset, substr(any_value(t), CAST(min(a) AS BIGINT) + 1, CAST(max(b) - min(a) AS BIGINT)) AS content FROM sn GROUP BY doc_id, n // 5""")
def sentence_chunks(spark, sf):
    return chunking.sentence_chunks(docs(spark, sf), "doc_id", "text", 5)


@query()
def semantic_chunks(spark, sf):
    return chunking.semantic_chunks(docs(spark, sf), "doc_id", "text")


@query()
def similarity_chunks(spark, sf):
    return chunking.similarity_chunks(docs(spark, sf), "doc_id", "text", 0.1, 5)


@query()
def text_boundaries(spark, sf):
    return chunking.boundaries(docs(spark, sf), "doc_id", "text")


@query()
def extractive_summaries(spark, sf):
    return chunking.extractive_summaries(docs(spark, sf), "doc_id", "text", 300)


_SECTIONS = """l AS (SELECT id, c, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT id, max(content) AS c, string_split(max(content), chr(10)) AS ls FROM graph_documents WHERE content IS NOT NULL GROUP BY id)),
p AS (SELECT id, c, line, i, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i) - length(line) - 1 AS a FROM l),
h AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS n, CAST(length(regexp_extract(line, '^(#{1,6})[ \\t]', 1)) AS INT) AS level, regexp_extract(line, '^#{1,6}[ \\t]+(.+?)[ \\t]*$', 1) AS title, CAST(a AS BIGINT) AS start_offset, CAST(a + length(line) AS BIGINT) AS body_offset, length(c) AS whole
FROM p WHERE regexp_matches(line, '^#{1,6}[ \\t]+(?s:.+?)[ \\t]*$'))"""


@query(f"""WITH RECURSIVE {_SECTIONS}, t AS (SELECT x.*, (SELECT max(y.n) FROM h y WHERE y.id = x.id AND y.n < x.n AND y.level < x.level) AS parent, coalesce((SELECT min(y.start_offset) FROM h y WHERE y.id = x.id AND y.n > x.n AND y.level <= x.level), whole) AS end_offset FROM h x),
r AS (SELECT id, n, title AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.n, r.path || ' > ' || t.title FROM t JOIN r ON r.id = t.id AND r.n = t.parent)
SELECT t.id, t.n, parent, level, title, path, start_offset, body_offset, end_offset FROM t JOIN r ON r.id = t.id AND r.n = t.n""")
def document_sections(spark, sf):
    s = chunking.sections(table(spark, sf, "graph_documents").where("content is not null").groupBy("id").agg(F.max("content").alias("content")), "id", "content")
    return s.withColumn("path", F.array_join("path", " > "))


@query()
def enriched_chunks(spark, sf):
    d = table(spark, sf, "graph_documents")
    return chunking.enriched(chunking.window_chunks(d, "id", "content", 1000, 200), chunking.sections(d, "id", "content"))


@query()
def summary_trees(spark, sf):
    return chunking.summary_tree(chunking.window_chunks(table(spark, sf, "graph_documents"), "id", "content", 1000, 200), 5, 300)


@query("""WITH c AS (SELECT document_id, strlen(content) AS n FROM (SELECT DISTINCT id, document_id, content FROM text_chunks WHERE content IS NOT NULL))
SELECT document_id, count(*) AS chunks, round(avg(n), 6) AS mean_bytes, min(n) AS least_bytes, max(n) AS most_bytes FROM c GROUP BY 1""")
def chunk_statistics(spark, sf):
    c = table(spark, sf, "text_chunks").select("id", "document_id", "content").distinct().where("content is not null").select("document_id", F.octet_length("content").alias("n"))
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 6).alias("mean_bytes"), F.min("n").alias("least_bytes"), F.max("n").alias("most_bytes"))


@query("""SELECT count(*) AS chunks, count(*) FILTER (chapter IS NOT NULL) AS with_chapter, count(*) FILTER (len(keywords) > 0) AS with_keywords, count(*) FILTER (summary IS NOT NULL) AS with_summary,
round(avg(((chapter IS NOT NULL)::INT + (len(keywords) > 0 AND keywords IS NOT NULL)::INT + (summary IS NOT NULL)::INT + (structural_level IS NOT NULL)::INT + (position_in_document IS NOT NULL)::INT) / 5.0), 6) AS completeness FROM text_chunks""")
def enrichment_statistics(spark, sf):
    c = table(spark, sf, "text_chunks")
    some = F.when(F.size("keywords") > 0, 1)
    full = measures.completeness([F.col("chapter"), some, F.col("summary"), F.col("structural_level"), F.col("position_in_document")])
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count("chapter").alias("with_chapter"), F.count(some).alias("with_keywords"), F.count("summary").alias("with_summary"), F.round(F.avg(full), 6).alias("completeness"))
