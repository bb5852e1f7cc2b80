"""What a question asks for: type, intent, complexity, routing, rewriting, decomposition, logic forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.text import PLAIN_STOP_WORDS, split_words

# Words by which type and intent of a question are told.
ABSTRACT = "concept idea theory principle philosophy meaning understanding knowledge wisdom truth beauty justice".split()
ASKING = "what how why when where who which explain describe".split()
INTENTS = (
    ("Overview", "overview summary general about".split()),
    ("Detailed", "detailed specific exactly precise".split()),
    ("Comparative", "compare vs versus between difference".split()),
    ("Causal", "cause why because lead result".split()),
    ("Temporal", "when time before after during".split()),
)
# Words of broad and of specific questions.
BROAD = ("overview", "summary", "summarize", "main", "general", "all", "themes", "topics", "overall", "broadly", "big picture", "what are", "list all", "show me all")
SPECIFIC = ("relationship between", "how does", "why does", "specific", "detail", "exactly", "precisely", "what is the connection", "explain how", "describe the", "between", "and")
# Weights of the vector, graph and hierarchy branches by type and intent.
BRANCH_WEIGHTS = {
    ("EntityFocused", None): (0.5, 0.4, 0.1),
    ("Relationship", None): (0.3, 0.6, 0.1),
    ("Conceptual", "Overview"): (0.2, 0.2, 0.6),
    ("Conceptual", None): (0.4, 0.3, 0.3),
    ("Exploratory", "Overview"): (0.3, 0.2, 0.5),
    ("Exploratory", None): (0.4, 0.4, 0.2),
    ("Factual", None): (0.6, 0.3, 0.1),
}


def _any(words: Column, known: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))


def intent(text: str | Column) -> Column:
    words = split_words(F.lower(F.col(text) if isinstance(text, str) else text))
    out = None
    for name, known in INTENTS:
        out = F.when(_any(words, known), name) if out is None else out.when(_any(words, known), name)
    return out.otherwise("Detailed")


def analyse(questions: DataFrame, id_col: str, text_col: str, names: DataFrame | None = None) -> DataFrame:
    """``(id, query_type, intent, key_entities, concepts, complexity)``.

    ``names`` has ``name``; a name counts as mentioned if a word of three or
    more letters of the question is one of its words.  Matching is an equality
    join on words, so neither side is compared whole.
    """
    q = questions.select(F.col(id_col).alias("id"), split_words(F.lower(F.col(text_col))).alias("words"))
    if names is None:
        keyed = q.withColumn("key_entities", F.array().cast("array<string>"))
    else:
        by_word = names.select("name", F.explode(F.array_distinct(split_words(F.lower("name")))).alias("w")).where(F.length("w") > 2)
        hits = q.select("id", F.explode(F.array_distinct("words")).alias("w")).join(by_word, "w").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("key_entities"))
        keyed = q.join(hits, "id", "left").withColumn("key_entities", F.coalesce("key_entities", F.array().cast("array<string>")))
    spoken = F.flatten(F.transform("key_entities", lambda n: split_words(F.lower(n))))
    stop = F.array(*[F.lit(w) for w in PLAIN_STOP_WORDS])
    concepts = F.filter("words", lambda w: (F.octet_length(w) > 3) & ~F.array_contains(stop, w) & ~F.array_contains(F.col("spoken"), w))
    k = F.size("key_entities")
    kind = F.when(k > 1, "Relationship").when(k == 1, "EntityFocused").when(_any(F.col("words"), ABSTRACT), "Conceptual").when(_any(F.col("words"), ASKING), "Exploratory").otherwise("Factual")
    full = keyed.withColumn("spoken", spoken).withColumn("concepts", concepts)
    score = F.least(F.size("words") * 0.1 + k * 0.3 + F.size("concepts") * 0.2, F.lit(1.0))
    return full.select("id", kind.alias("query_type"), intent(F.array_join("words", " ")).alias("intent"), "key_entities", "concepts", score.alias("complexity"))


def branch_weights(kind: str, what: str) -> tuple[float, float, float]:
    return BRANCH_WEIGHTS.get((kind, what)) or BRANCH_WEIGHTS[kind, None]


def complexity_level(text: str | Column, max_level: int = 3, weights: tuple[float, float, float] = (0.5, 0.2, 0.3)) -> dict[str, Column]:
    """Score of a question from specific (-1) to broad (+1), its class, and the community level to answer at."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.lower(t)
    count = lambda words: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    broad, specific = count(BROAD), count(SPECIFIC)
    keyword = F.when(broad + specific > 0, (broad - specific) / (broad + specific)).otherwise(0.0)
    n = F.size(split_words(t))
    length = F.when(n.between(1, 3), 0.5).when(n.between(4, 5), 0.2).when(n.between(6, 7), 0.0).when(n.between(8, 10), -0.3).otherwise(-0.5)
    marks = F.floor((F.length(low) - F.length(F.replace(low, F.lit('"'), F.lit("")))) / 2) + F.regexp_count(low, F.lit(" and ")) + F.regexp_count(low, F.lit("between"))
    mention = F.when(marks == 0, 0.3).when(marks == 1, 0.0).when(marks == 2, -0.4).otherwise(-0.7)
    score = keyword * weights[0] + length * weights[1] + mention * weights[2]
    kind = F.when(score >= 0.7, "VeryBroad").when(score >= 0.4, "Broad").when(score >= -0.2, "Medium").when(score >= -0.5, "Specific").otherwise("VerySpecific")
    level = F.when(kind == "VeryBroad", max(max_level, 2)).when(kind == "Broad", max(max_level - 1, 1)).when(kind == "Medium", 1).otherwise(0)
    return {"score": score, "complexity": kind, "level": level}


def rewrite(text: str, synonyms: dict[str, list[str]]) -> str:
    """Lower case, trimmed, each word followed by its synonyms."""
    return " ".join(w for word in text.lower().split() for w in (word, *synonyms.get(word, [])))


_CLAUSE = re.compile(r"\s*(?:,?\s+and then\s+|;\s*|\?\s*|,\s+and\s+|\s+and\s+(?=(?:what|how|why|when|where|who|which)\b))\s*", re.I)


def decompose(text: str) -> list[str]:
    """A question's parts: at marks and at connectives before a new question word."""
    return [p for p in (x.strip(" .") for x in _CLAUSE.split(text)) if p] or [text]


@dataclass(frozen=True)
class LogicForm:
    predicate: str
    arguments: tuple[str, ...]
    confidence: float = 0.8


# Forms of questions and the predicates they ask for.
FORMS = (
    ("Related", r"(?i)^(?:how (?:is|are)|what is the (?:relation|relationship|connection) between)\s+(.+?)\s+(?:related to|connected to|and)\s+(.+?)\??$"),
    ("Compare", r"(?i)^(?:compare|what is the difference between)\s+(.+?)\s+(?:with|to|and)\s+(.+?)\??$"),
    ("Caused", r"(?i)^(?:what caused|why did|what led to)\s+(.+?)\??$"),
    ("Happened", r"(?i)^when (?:did|was|were)\s+(.+?)(?:\s+(?:happen|occur|born|founded))?\??$"),
    ("Count", r"(?i)^how many\s+(.+?)\??$"),
    ("Located", r"(?i)^where (?:is|are|was|were)\s+(.+?)\??$"),
    ("Has", r"(?i)^what (type|name|confidence) (?:does|has)\s+(.+?)(?:\s+have)?\??$"),
    ("Is", r"(?i)^(?:who|what) (?:is|are|was|were)\s+(.+?)\??$"),
)


def parse(text: str) -> LogicForm | None:
    for predicate, pattern in FORMS:
        m = re.match(pattern, text.strip())
        if m:
            args = m.groups()
            return LogicForm(predicate, tuple(a.strip() for a in (args[::-1] if predicate == "Has" else args)))
    return None


def answer(form: LogicForm, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(value, kind, confidence)`` of a logic form over ``entities`` (entity_id, name, entity_type, confidence) and ``relations`` (source, target names, relation_type)."""
    has = lambda arg, col="name": F.contains(F.lower(col), F.lit(arg.lower()))
    args = form.arguments
    if form.predicate == "Related" or form.predicate == "Compare":
        a, b = args
        if form.predicate == "Related":
            hit = relations.where((has(a, "source") & has(b, "target")) | (has(b, "source") & has(a, "target")))
            return hit.select(F.concat_ws(" ", "source", "relation_type", "target").alias("value"), F.lit("relation").alias("kind"), F.lit(form.confidence).alias("confidence")).distinct()
        hit = entities.where(has(a) | has(b))
        return hit.select(F.concat_ws(" is a ", "name", "entity_type").alias("value"), F.lit("comparison").alias("kind"), F.lit(0.7).alias("confidence")).distinct()
    if form.predicate == "Caused":
        from graphmill.functions.measures import CAUSAL_WORDS

        hit = relations.where(F.col("relation_type").rlike(CAUSAL_WORDS) & (has(args[0], "target") | has(args[0], "source")))
        return hit.select(F.concat_ws(" ", "source", "relation_type", "target").alias("value"), F.lit("cause").alias("kind"), F.lit(0.8).alias("confidence")).distinct()
    if form.predicate == "Happened":
        hit = relations.where(F.col("relation_type").rlike("(?i)when|date|time|before|after|during|founded|born") & (has(args[0], "source") | has(args[0], "target")))
        return hit.select(F.concat_ws(" ", "source", "relation_type", "target").alias("value"), F.lit("time").alias("kind"), F.lit(0.6).alias("confidence")).distinct()
    if form.predicate == "Located":
        hit = relations.where(F.col("relation_type").rlike("(?i)locat|live|based|near|in_") & has(args[0], "source"))
        return hit.select(F.col("target").alias("value"), F.lit("place").alias("kind"), F.lit(0.7).alias("confidence")).distinct()
    if form.predicate == "Count":
        hit = entities.where(has(args[0].rstrip("s"), "entity_type") | has(args[0]))
        return hit.agg(F.count_distinct("entity_id").cast("string").alias("value")).select("value", F.lit("count").alias("kind"), F.lit(0.9).alias("confidence"))
    if form.predicate == "Has":
        col = {"type": "entity_type"}.get(args[1].lower(), args[1].lower())
        return entities.where(has(args[0])).select(F.col(col).cast("string").alias("value"), F.lit("property").alias("kind"), F.lit(0.9).alias("confidence")).distinct()
    return entities.where(has(args[0])).select(F.concat_ws(" is a ", "name", "entity_type").alias("value"), F.lit("definition").alias("kind"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("confidence")).groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))
