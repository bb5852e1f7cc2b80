"""Readers of entities and relations from files, with validation.

Every reader gives ``(entities, relations, rejects)``:
entities(id, name, entity_type, attributes), relations(source, target,
relation_type, attributes), rejects(record, reason).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.chunking import per_row


class Imported(NamedTuple):
    entities: DataFrame
    relations: DataFrame
    rejects: DataFrame


@dataclass(frozen=True)
class Mapping:
    """Which columns of a table hold what; the rest become attributes."""

    id: str = "entity_id"
    name: str = "entity_name"
    type: str = "entity_type"
    source: str = "relationship_source"
    target: str = "relationship_target"
    relation: str = "relationship_type"
    attributes: tuple[str, ...] = field(default=())


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def _missing(fields: dict[str, Column]) -> Column:
    """Names of the required fields that are empty, as one text; null if none is."""
    names = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(f"no {n}")) for n, c in fields.items()]))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def validate(rows: DataFrame, mapping: Mapping = Mapping()) -> Imported:
    """Split rows into valid entities, valid relations and rejects.

    A row is an entity unless its id, name and type are all empty; a row with a
    source or target is a relation as well.  Missing columns count as empty.
    """
    for c in (mapping.id, mapping.name, mapping.type, mapping.source, mapping.target, mapping.relation):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    extra = [c for c in rows.columns if c in mapping.attributes]
    attributes = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if extra else F.create_map().cast("map<string,string>")
    ent = {"id": _text(mapping.id), "name": _text(mapping.name), "type": _text(mapping.type)}
    rel = {"source": _text(mapping.source), "target": _text(mapping.target), "relation type": _text(mapping.relation)}
    some_ent = ent["id"].isNotNull() | ent["name"].isNotNull() | ent["type"].isNotNull()
    some_rel = rel["source"].isNotNull() | rel["target"].isNotNull()
    record = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    marked = rows.select(*[c.alias(f"e_{n}") for n, c in ent.items()], *[c.alias(f"r_{n.split(' ')[0]}") for n, c in rel.items()], attributes.alias("attributes"), record.alias("record"), (some_ent | ~some_rel).alias("is_ent"), some_rel.alias("is_rel"), _missing(ent).alias("ent_fault"), _missing(rel).alias("rel_fault"))
    entities = marked.where("is_ent and ent_fault is null").select(F.col("e_id").alias("id"), F.col("e_name").alias("name"), F.col("e_type").alias("entity_type"), "attributes")
    relations = marked.where("is_rel and rel_fault is null").select(F.col("r_source").alias("source"), F.col("r_target").alias("target"), F.col("r_relation").alias("relation_type"), "attributes")
    bad = marked.where("is_ent and ent_fault is not null").select("record", F.col("ent_fault").alias("reason")).unionByName(marked.where("is_rel and rel_fault is not null").select("record", F.col("rel_fault").alias("reason")))
    return Imported(entities, relations, bad)


def read_delimited(spark: SparkSession, path: str, mapping: Mapping = Mapping(), sep: str = ",") -> Imported:
    """CSV with a header; ``sep="\\t"`` for TSV."""
    return validate(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, sep=sep), mapping)


ENTITY = "struct<id:string,name:string,type:string,attributes:map<string,string>>"
RELATION = "struct<source:string,target:string,relation_type:string,attributes:map<string,string>>"


def _from_structs(entities: DataFrame, relations: DataFrame) -> Imported:
    m = Mapping("id", "name", "type", "source", "target", "relation_type")
    e, r = validate(entities, m), validate(relations, m)
    keep = lambda out, df, keys: out.drop("attributes").join(df.select(*[F.col(k).alias(v) for k, v in keys.items()], "attributes").dropDuplicates(list(keys.values())), list(keys.values()), "left")
    ents = keep(e.entities, entities, {"id": "id"})
    return Imported(ents, r.relations.drop("attributes").withColumn("attributes", F.create_map().cast("map<string,string>")), e.rejects.unionByName(r.rejects))


def read_json(spark: SparkSession, path: str) -> Imported:
    """Documents with an array ``entities`` and an array ``relationships``."""
    doc = spark.read.schema(f"entities array<{ENTITY}>, relationships array<{RELATION}>").option("multiLine", True).json(path)
    return _from_structs(doc.select(F.explode("entities").alias("x")).select("x.*"), doc.select(F.explode("relationships").alias("x")).select("x.*"))


def read_jsonl(spark: SparkSession, path: str) -> Imported:
    """Lines tagged ``"kind": "entity"`` or ``"relationship"``; lines that are no JSON are rejected."""
    schema = "kind string, id string, name string, type string, source string, target string, relation_type string, attributes map<string,string>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    out = _from_structs(rows.where("kind = 'entity'").select("id", "name", "type", "attributes"), rows.where("kind = 'relationship'").select("source", "target", "relation_type", "attributes"))
    # A corrupt-record column alone cannot be queried from a file; the tag is read beside it.
    odd = rows.select("kind", "_bad").where("kind is null or kind not in ('entity', 'relationship')").select(F.coalesce("_bad", F.lit("")).alias("record"), F.lit("no known kind").alias("reason"))
    return Imported(out.entities, out.relations, out.rejects.unionByName(odd))


_TRIPLE = r'^\s*(<[^>]*>|_:\S+|[\w-]*:[\w.-]+)\s+(<[^>]*>|a|[\w-]*:[\w.-]+)\s+(<[^>]*>|_:\S+|[\w-]*:[\w.-]+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?)\s*\.\s*$'


def local_name(uri: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:`` of a name, or the text of a literal."""
    bare = F.regexp_replace(uri, r'^<|>$|^"|"(@[\w-]+|\^\^\S+)?$', "")
    return F.when(uri.startswith('"'), bare).otherwise(F.regexp_extract(bare, r"([^#/:]+)/?$", 1))


def read_triples(spark: SparkSession, path: str) -> Imported:
    """N-Triples, and Turtle with one triple a line.

    ``a`` and rdf:type give an entity its type, rdfs:label its name; other
    triples between resources are relations, those with literals attributes.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value != '' and not value like '#%' and not lower(value) like '@%' and not lower(value) like 'prefix %'")
    t = lines.select("value", *[F.regexp_extract("value", _TRIPLE, i).alias(n) for i, n in enumerate("spo", 1)])
    fine = t.where("s != ''").select(local_name(F.col("s")).alias("s"), F.when(F.col("p") == "a", "type").otherwise(local_name(F.col("p"))).alias("p"), local_name(F.col("o")).alias("o"), F.col("o").startswith('"').alias("literal"))
    nodes = fine.select(F.col("s").alias("id")).unionByName(fine.where("not literal and p != 'type'").select(F.col("o").alias("id"))).distinct()
    said = fine.groupBy(F.col("s").alias("id")).agg(F.min(F.when(F.col("p") == "type", F.col("o"))).alias("type"), F.min(F.when(F.col("p").isin("label", "name"), F.col("o"))).alias("name"))
    facts = fine.where("literal and p not in ('label', 'name')").groupBy(F.col("s").alias("id"), "p").agg(F.min("o").alias("o")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("attributes"))
    entities = nodes.join(said, "id", "left").join(facts, "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.coalesce("type", F.lit("Resource")).alias("entity_type"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))
    relations = fine.where("not literal and p != 'type'").select(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("relation_type"), F.create_map().cast("map<string,string>").alias("attributes"))
    return Imported(entities, relations, t.where("s = ''").select(F.col("value").alias("record"), F.lit("no triple").alias("reason")))


def read_graphml(spark: SparkSession, path: str) -> Imported:
    """GraphML nodes and edges; the data keys ``name``, ``type`` and ``relation`` are used, the others are attributes."""
    data = "array<struct<_key:string,_VALUE:string>>"
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    attrs = F.coalesce(F.map_from_entries(F.transform(F.array_distinct("data"), lambda d: F.struct(d["_key"], d["_VALUE"]))), F.create_map().cast("map<string,string>"))
    pick = lambda k: F.try_element_at("attributes", F.lit(k))
    n = xml("node", f"_id string, data {data}").select(F.col("_id").alias("id"), attrs.alias("attributes")).select("id", F.coalesce(pick("name"), pick("label"), "id").alias("name"), F.coalesce(pick("type"), F.lit("Node")).alias("type"), "attributes")
    e = xml("edge", f"_source string, _target string, data {data}").select(F.col("_source").alias("source"), F.col("_target").alias("target"), attrs.alias("attributes")).select("source", "target", F.coalesce(pick("relation"), pick("type"), pick("label"), F.lit("RELATED_TO")).alias("relation_type"), "attributes")
    return _from_structs(n, e)


def read_import(spark: SparkSession, path: str, kind: str, mapping: Mapping = Mapping()) -> Imported:
    """Dispatch by format: csv, tsv, json, jsonl, rdf or graphml."""
    readers = {
        "csv": lambda: read_delimited(spark, path, mapping),
        "tsv": lambda: read_delimited(spark, path, mapping, "\t"),
        "json": lambda: read_json(spark, path),
        "jsonl": lambda: read_jsonl(spark, path),
        "rdf": lambda: read_triples(spark, path),
        "graphml": lambda: read_graphml(spark, path),
    }
    if kind not in readers:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(readers)}")
    return readers[kind]()


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(path, document_type, content, content_hash, size_bytes)`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("md", "markdown"), "Markdown").when(ext.isin("htm", "html"), "Html").when(ext == "txt", "Text").when(ext == "pdf", "Pdf").when(ext == "json", "Json").otherwise("Unknown")
    text = F.when(kind != "Pdf", F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", kind.alias("document_type"), text.alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"))


def duplicate_contents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(content_hash, documents, first_id)`` of contents under more than one id."""
    return documents.where(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias("content_hash")).agg(F.count_distinct(id_col).alias("documents"), F.min(id_col).alias("first_id")).where("documents > 1")


def page_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Text of HTML pages by block: tags removed, entities resolved."""
    import html
    import re

    def blocks(page: str) -> list[tuple]:
        body = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", page)
        parts = re.split(r"(?i)</?(?:p|div|h[1-6]|li|br|tr|section|article)\b[^>]*>", body)
        clean = [html.unescape(re.sub(r"<[^>]*>", "", p)).strip() for p in parts]
        return [(i, p) for i, p in enumerate(x for x in clean if x)]

    return per_row(pages, id_col, html_col, blocks, "seq int, content string")
