"""From documents to a graph, and from questions to ranked answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.text import content_signature, search_tokens
from graphmill.functions.vector import hash_embedding
from graphmill.operators import chunking, entities, graph, search
from graphmill.plans import questions
from graphmill.session import materialize
from graphmill.sources.workspace import Workspaces
from graphmill.streaming import changes


@dataclass
class Engine:
    """Holds the tables of one graph as DataFrames.

    documents(id, content), chunks(id, document_id, seq, content, …),
    mentions(chunk, entity_id, …), entities(id, name, …), relations(source,
    target, …).  Building is lazy up to the tables that are stored.
    """

    spark: SparkSession
    chunk_size: int = 1000
    overlap: int = 200
    strategy: str = "window"
    dimension: int = 128
    least_confidence: float = 0.65
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add_documents(self, docs: DataFrame, id_col: str = "id", text_col: str = "content") -> None:
        """Add documents; an id known before is replaced if its content changed."""
        new = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("content")).where("id is not null and content is not null").dropDuplicates(["id"])
        old = self.tables.get("documents")
        self.tables["documents"] = new if old is None else changes.upsert(old, new, ["id"])
        for t in ("chunks", "mentions", "entities", "relations"):
            self.tables.pop(t, None)

    def build(self) -> dict[str, DataFrame]:
        """Chunk, extract, merge and relate; the tables are stored once and then read."""
        docs = self.tables["documents"]
        make = {"window": lambda: chunking.window_chunks(docs, "id", "content", self.chunk_size, self.overlap), "hierarchical": lambda: chunking.hierarchical_chunks(docs, "id", "content", self.chunk_size, self.overlap)}
        raw = make.get(self.strategy, lambda: chunking.chunk_with(docs, self.strategy, "id", "content"))().withColumnRenamed("id", "document_id")
        chunks = materialize(raw.withColumn("id", F.concat_ws("_", "document_id", "seq")).withColumn("embedding", hash_embedding(search_tokens("content"), self.dimension)), "chunks")
        mentions = materialize(entities.extract_entities(chunks, "id", "content", self.least_confidence).withColumnRenamed("id", "chunk"), "mentions")
        merged = entities.merge_entities(mentions, [F.col("entity_id")])
        ents = materialize(merged.withColumn("id", F.concat_ws("_", "entity_type", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_]", ""))), "entities")
        relations = materialize(entities.relations_in_chunks(mentions, chunks.select(F.col("id").alias("chunk"), "content")), "relations")
        self.tables |= {"chunks": chunks, "mentions": mentions, "entities": ents, "relations": relations}
        return self.tables

    def _built(self) -> None:
        if "chunks" not in self.tables:
            self.build()

    def statistics(self) -> DataFrame:
        """``(table, rows)``."""
        self._built()
        out = None
        for name, df in self.tables.items():
            row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = row if out is None else out.unionByName(row)
        return out

    def search(self, asked: DataFrame, k: int = 10, method: str = "rrf", candidates: int = 100) -> DataFrame:
        """``(query_id, id, score, rank, content)``: keyword and vector search of the chunks, fused.

        ``asked`` has ``query_id, query``; all questions are answered together.
        """
        self._built()
        chunks = self.tables["chunks"]
        words = search.ranked(search.bm25(chunks, asked, "id", "content"), candidates).drop("rank")
        vectors = asked.select("query_id", hash_embedding(search_tokens("query"), self.dimension).alias("query_vector"))
        near = search.knn(chunks, vectors, candidates, "id", "embedding").drop("rank")
        best = search.ranked(search.fuse(near, words, method), k)
        return best.select("query_id", "id", "score", "rank").join(chunks.select("id", "content"), "id")

    def entity_search(self, asked: DataFrame, k: int = 10, hops: int = 1) -> DataFrame:
        """``(query_id, id, score, rank)``: entities named in a question, and what is within ``hops`` of them at 0.8 a hop."""
        self._built()
        named = questions.analyse(asked, "query_id", "query", self.tables["entities"].select("name")).select(F.col("id").alias("query_id"), F.explode("key_entities").alias("name"))
        seeds = named.join(self.tables["entities"].select(F.col("id").alias("node"), "name"), "name").select("query_id", "node")
        seen = seeds.distinct().withColumn("score", F.lit(0.9))
        steps = graph.oriented(self.tables["relations"].select("source", "target")).distinct()
        ring = seen
        for _ in range(hops):
            ring = ring.join(steps.withColumnRenamed("source", "node"), "node").select("query_id", F.col("target").alias("node"), (F.col("score") * 0.8).alias("score"))
            seen = seen.unionByName(ring)
        best = seen.groupBy("query_id", F.col("node").alias("id")).agg(F.max("score").alias("score"))
        return search.ranked(best, k)

    def ranked_search(self, asked: DataFrame, k: int = 10, iterations: int = 20) -> DataFrame:
        """``(id, score)`` of chunks by personalised PageRank over entities and chunks, from all chunks found for the questions."""
        self._built()
        found = self.search(asked, 20)
        m = self.tables["mentions"].select(F.col("entity_id").alias("source"), F.col("chunk").alias("target")).distinct()
        seeds = found.groupBy(F.col("id").alias("node")).agg(F.max("score").alias("weight"))
        rank = graph.pagerank(graph.oriented(m), seeds, 0.85, iterations, 1e-6, "zero")
        chunks = self.tables["chunks"].select("id", "content")
        return rank.withColumnRenamed("node", "id").join(chunks, "id").orderBy(F.desc("score"), "id").limit(k)

    def ask(self, asked: DataFrame, k: int = 10) -> DataFrame:
        """``(query_id, answer, confidence, sources)``: the branches weighted by type and intent, merged, cut and joined to text."""
        self._built()
        kinds = questions.analyse(asked, "query_id", "query", self.tables["entities"].select("name"))
        table = [(t, i, *questions.branch_weights(t, i)) for t in ("EntityFocused", "Relationship", "Conceptual", "Exploratory", "Factual") for i in ("Overview", "Detailed", "Comparative", "Causal", "Temporal")]
        weights = self.spark.createDataFrame(table, "query_type string, intent string, w_vector double, w_graph double, w_tree double")
        w = kinds.select(F.col("id").alias("query_id"), "query_type", "intent").join(F.broadcast(weights), ["query_type", "intent"])
        text = self.search(asked, 3 * k).withColumn("result_type", F.lit("Chunk"))
        top = F.max("score").over(search.W.partitionBy("query_id"))
        text = text.join(w, "query_id").withColumn("score", F.col("score") / top * F.col("w_vector")).select("query_id", "id", "score", "content", "result_type")
        ents = self.entity_search(asked, 3 * k).join(self.tables["entities"].select("id", F.concat_ws(" is a ", "name", "entity_type").alias("content")), "id").withColumn("result_type", F.lit("Entity"))
        ents = ents.join(w, "query_id").withColumn("score", F.col("score") * F.col("w_graph")).select("query_id", "id", "score", "content", "result_type")
        both = search.best_per_content(text.unionByName(ents), "content")
        best = search.ranked(search.type_quota(both, 2 * k), k)
        made = search.explained(best.drop("rank"), "content", 5)
        lines = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.substring("content", 1, 300), F.lit(" (score: "), F.format_number("score", 2), F.lit(")")).alias("t")))), lambda x: x["t"]), "\n").alias("answer"))  # at most k rows a question
        return made.join(lines, "query_id")

    def signatures(self) -> DataFrame:
        self._built()
        return self.tables["chunks"].select("id", content_signature("content").alias("signature"))

    def save(self, root: str, name: str, codec: str = "zstd") -> int:
        self._built()
        return Workspaces(self.spark, root).save(name, self.tables, codec)

    def load(self, root: str, name: str) -> None:
        self.tables = Workspaces(self.spark, root).load(name)
