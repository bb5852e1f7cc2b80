"""Places where a language or embedding model may be plugged in, with deterministic stand-ins.

A model is any callable on a list of texts; it runs in Arrow batches on the
executors.  Without one, the stand-ins below keep every pipeline working.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]


def quoting_model(prompts: list[str]) -> list[str]:
    """Answers each prompt with the context line that shares most words with its question."""
    out = []
    for p in prompts:
        question = (re.findall(r"(?m)^Question: (.*)$", p) or [""])[0]
        words = set(re.findall(r"\w+", question.lower()))
        lines = re.findall(r"(?m)^- (.*)$", p)
        out.append(max(lines, key=lambda x: (len(words & set(re.findall(r"\w+", x.lower()))), -len(x)), default="No context."))
    return out


def generate(prompts: str | Column, model: Model = quoting_model) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(model([x or "" for x in batch]))

    return run(prompts)


def answers(asked: DataFrame, results: DataFrame, model: Model = quoting_model, k: int = 5) -> DataFrame:
    """``(query_id, query, answer, grounded, sources)``: a prompt of the ``k`` best contents, the model's answer, and the share of its words that the contents hold."""
    from graphmill.operators.search import ranked

    best = ranked(results, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "content"))).alias("c"))  # at most k a question
    lines = F.array_join(F.transform("c", lambda x: F.concat(F.lit("- "), F.regexp_replace(x["content"], r"\s+", " "))), "\n")
    full = asked.join(best, "query_id", "left").select("query_id", "query", F.coalesce(lines, F.lit("")).alias("context"), F.transform("c", lambda x: x["id"]).alias("sources"))
    said = full.withColumn("answer", generate(F.concat(F.lit("Context:\n"), "context", F.lit("\nQuestion: "), "query"), model))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    share = F.size(F.array_intersect(words(F.col("answer")), words(F.col("context")))) / F.greatest(F.size(words(F.col("answer"))), F.lit(1))
    return said.select("query_id", "query", "answer", share.alias("grounded"), "sources")


def checked(answered: DataFrame, least: float = 0.7) -> DataFrame:
    """Answers with ``accepted`` (grounded at least that far, not empty) and ``problems``."""
    problems = F.array_compact(F.array(F.when(F.length(F.trim("answer")) == 0, "empty answer"), F.when(F.col("grounded") < least, "not grounded"), F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no sources")))
    return answered.withColumn("problems", problems).withColumn("accepted", F.size("problems") == 0)


def overlap_judge(prompts: list[str]) -> list[str]:
    """Stands in for a judging model: the share of the answer's words that the question or the context holds, as JSON."""
    out = []
    for p in prompts:
        answer = set(re.findall(r"\w+", (re.findall(r"(?ms)^Answer: (.*)\Z", p) or [""])[0].lower()))
        known = set(re.findall(r"\w+", p.split("\nAnswer:")[0].lower()))
        out.append(json.dumps({"score": len(answer & known) / len(answer) if answer else 0.0}))
    return out


def evaluated(answered: DataFrame, model: Model = overlap_judge, least: float = 0.7) -> DataFrame:
    """``answered`` (query_id, query, answer and, if known, context) with a model's ``score`` in [0, 1] and whether it ``passed``.

    The model answers ``{"score": …}``; what is no such JSON scores null and does not pass.
    """
    context = F.coalesce(F.col("context"), F.lit("")) if "context" in answered.columns else F.lit("")
    prompt = F.concat(F.lit("Rate the answer from 0 to 1 as JSON.\nContext: "), context, F.lit("\nQuestion: "), F.coalesce("query", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    said = F.from_json(F.regexp_extract(generate(prompt, model), r"(?s)\{.*\}", 0), "score double")["score"]
    out = answered.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), said)))
    return out.withColumn("score", F.when(said.isNotNull(), F.col("score"))).withColumn("passed", F.coalesce(F.col("score") >= least, F.lit(False)))


EXTRACTED = "struct<entities:array<struct<name:string,type:string,confidence:double>>,relationships:array<struct<source:string,target:string,relation_type:string,confidence:double>>>"


def pattern_extractor(texts: list[str]) -> list[str]:
    """Stands in for an extracting model: pattern entities as the JSON such a model is asked for."""
    from graphmill.operators.entities import find_entities

    return [json.dumps({"entities": [{"name": n, "type": t, "confidence": c} for n, t, c, _, _ in find_entities(x)], "relationships": []}) for x in texts]


def gleaned(chunks: DataFrame, id_col: str, text_col: str, model: Model = pattern_extractor, rounds: int = 1) -> DataFrame:
    """``(chunk, name, entity_type, confidence, round)``: entities from a model's JSON, asked up to ``rounds`` times; a name counts once a chunk.

    Answers wrapped in text or code fences are unwrapped; what is no JSON gives nothing.
    """
    from graphmill.functions.text import json_in_markdown

    out, seen = None, None
    for n in range(rounds):
        ask = F.concat(F.col(text_col), F.lit(f"\n(more, round {n + 1})")) if n else F.col(text_col)
        said = chunks.select(F.col(id_col).alias("chunk"), F.from_json(json_in_markdown(generate(ask, model)), EXTRACTED).alias("x"))
        got = said.select("chunk", F.explode("x.entities").alias("e")).select("chunk", "e.name", F.col("e.type").alias("entity_type"), F.col("e.confidence").alias("confidence")).where("name is not null").groupBy("chunk", "name", "entity_type").agg(F.max("confidence").alias("confidence"))
        new = got if seen is None else got.join(seen, ["chunk", "name", "entity_type"], "left_anti")
        new = new.withColumn("round", F.lit(n + 1))
        out = new if out is None else out.unionByName(new)
        seen = out.select("chunk", "name", "entity_type")
    return out


def titled_context(prompts: list[str]) -> list[str]:
    """Stands in for a model that says where a chunk belongs: the first line of its document."""
    return [f"From: {(re.findall(r'(?m)^[#> ]*(.*[^ #>\n].*)$', p.split('Chunk:')[0].removeprefix('Document:')) or [''])[0].strip()}" for p in prompts]


def contextualised(chunks: DataFrame, documents: DataFrame, model: Model = titled_context) -> DataFrame:
    """``chunks`` (id, document_id, content) with ``context``, what a model says of a chunk within its document (id, content), put before the content."""
    d = documents.select(F.col("id").alias("document_id"), F.col("content").alias("_whole"))
    prompt = F.concat(F.lit("Document:\n"), F.coalesce("_whole", F.lit("")), F.lit("\nChunk:\n"), "content")
    said = chunks.join(d, "document_id", "left").withColumn("context", generate(prompt, model)).drop("_whole")
    return said.withColumn("content", F.concat_ws("\n\n", "context", "content"))


def synthesized(parts: DataFrame, how: str = "ordered", model: Model | None = None) -> DataFrame:
    """``(query_id, answer)`` of the answers to the parts of a question (query_id, part, answer, confidence).

    ``ordered``: all in order of the part; ``best``: that of the highest
    confidence; ``template``: numbered lines; ``model``: what a model makes of
    the ordered ones.  A question has few parts.
    """
    if how == "best":
        return parts.groupBy("query_id").agg(F.max_by("answer", F.struct("confidence", -F.col("part"))).alias("answer"))
    line = F.concat(F.col("part").cast("string"), F.lit(". "), "answer") if how == "template" else F.col("answer")
    lines = parts.where("answer is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", line.alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["t"]), "\n" if how == "template" else " ")
    return lines.select("query_id", (generate(text, model) if how == "model" and model else text).alias("answer"))


class Functions:
    """Functions by name over the tables of a graph, with a log of calls and a limit."""

    def __init__(self, tables: dict[str, DataFrame], most_calls: int = 100) -> None:
        self.tables, self.most_calls, self.log = tables, most_calls, []
        self._known: dict[str, Callable[..., DataFrame]] = {
            "graph_search": self.graph_search,
            "entity_expand": self.entity_expand,
            "relationship_traverse": self.relationship_traverse,
            "get_entity_context": self.get_entity_context,
            "infer_relationships": self.infer_relationships,
        }

    def register(self, name: str, function: Callable[..., DataFrame]) -> None:
        self._known[name] = function

    def call(self, name: str, /, **arguments) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"no function {name!r}; there are {', '.join(sorted(self._known))}")
        if len(self.log) >= self.most_calls:
            raise RuntimeError(f"more than {self.most_calls} calls")
        self.log.append((name, arguments))
        return self._known[name](**arguments)

    def graph_search(self, name: str, limit: int = 10) -> DataFrame:
        from graphmill.operators.search import substring_search

        return substring_search(self.tables["entities"], name, "id", "name").orderBy(F.desc("score"), "id").limit(limit)

    def _node(self, entity: str) -> DataFrame:
        return self.tables["entities"].sparkSession.createDataFrame([(entity,)], "node string")

    def entity_expand(self, entity: str, depth: int = 2) -> DataFrame:
        from graphmill.operators.graph import reach

        return reach(self.tables["relations"], self._node(entity), depth)

    def relationship_traverse(self, source: str, target: str, hops: int = 3) -> DataFrame:
        from graphmill.operators.graph import simple_paths

        return simple_paths(self.tables["relations"].select("source", "target"), source, target, hops)

    def get_entity_context(self, entity: str) -> DataFrame:
        m = self.tables["mentions"].where(F.col("entity_id") == entity).select(F.col("chunk").alias("id")).distinct()
        return self.tables["chunks"].join(m, "id", "left_semi").select("id", "content")

    def infer_relationships(self, entity: str) -> DataFrame:
        from graphmill.operators.entities import inferred_relations

        return inferred_relations(self.tables["mentions"], entity, 0.0)

    def plan(self, question: str) -> list[tuple[str, dict]]:
        """Calls that answer a question: two entities named are traversed, one is expanded and put in context, none is searched by words."""
        words = {w for w in re.findall(r"\w+", question.lower()) if len(w) > 2}
        known = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        hit = self.tables["entities"].where(F.forall(known, lambda w: w.isin(*words)) & (F.size(known) > 0)) if words else self.tables["entities"].limit(0)
        named = [r["id"] for r in hit.orderBy(F.desc(F.length("name")), "id").limit(2).collect()]
        if len(named) == 2:
            return [("relationship_traverse", {"source": named[0], "target": named[1]}), ("relationship_traverse", {"source": named[1], "target": named[0]})]
        if named:
            return [("entity_expand", {"entity": named[0]}), ("get_entity_context", {"entity": named[0]}), ("infer_relationships", {"entity": named[0]})]
        return [("graph_search", {"name": w}) for w in sorted(words, key=lambda w: (-len(w), w))[:3]]

    def run(self, question: str) -> list[tuple[str, DataFrame]]:
        """The results of the planned calls, in order."""
        return [(name, self.call(name, **arguments)) for name, arguments in self.plan(question)]
