"""The property graph of documents, clauses, concepts and items: nodes, edges, and the sorted file of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T


def nodes(contracts: DataFrame, clauses: DataFrame, concepts: DataFrame, items: DataFrame) -> DataFrame:
    """(id, type, label, sector, document, sitting_date): one node per id.

    Of rows with the same id one is taken whole: a row with a label of its own before one whose label is made of its id, then
    the last by the id of its table, as later rows overwrite earlier ones.
    """
    docs = contracts.select(F.concat(F.lit("document:"), "slug").alias("id"), F.lit("document").alias("type"), F.coalesce("title", "slug").alias("label"), F.coalesce("sector", F.lit("")).alias("sector"), F.col("title").isNotNull().alias("_own"), F.col("id").alias("_at"))
    parts = clauses.where("ref is not null").select(F.concat(F.lit("clause:"), "ref").alias("id"), F.lit("clause").alias("type"), T.clause_label(F.col("number"), F.col("heading"), F.col("anchor")).alias("label"), F.substring_index("ref", "#", 1).alias("document"), F.lit(True).alias("_own"), F.col("id").alias("_at"))
    ideas = concepts.select(F.concat(F.lit("concept:"), "slug").alias("id"), F.lit("concept").alias("type"), F.coalesce("name", "slug").alias("label"), F.col("name").isNotNull().alias("_own"), F.col("id").alias("_at"))
    day = T.iso_date(F.col("sitting_date"))
    talks = items.where("slug is not null").select(F.concat(F.lit("parliament:"), F.coalesce(day, F.lit("")), F.lit("-"), "slug").alias("id"), F.lit("parliament_item").alias("type"), F.coalesce("title", "slug").alias("label"), day.alias("sitting_date"), F.col("title").isNotNull().alias("_own"), F.col("id").alias("_at"))
    every = docs.unionByName(parts, True).unionByName(ideas, True).unionByName(talks, True)
    fields = ("type", "label", "sector", "document", "sitting_date")
    return every.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("_own", "_at")).alias("_r")).select("id", *[f"_r.{c}" for c in fields])


def edges(contracts: DataFrame, clauses: DataFrame, concepts: DataFrame, tags: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(source, target, type), a bag: contains, tagged and mentions edges."""
    named = clauses.where("ref is not null")
    contains = named.join(contracts.select(F.col("id").alias("document_id"), "slug"), "document_id").select(F.concat(F.lit("document:"), "slug").alias("source"), F.concat(F.lit("clause:"), "ref").alias("target"), F.lit("contains").alias("type"))
    tagged = tags.join(named.select(F.col("id").alias("clause_id"), "ref"), "clause_id").join(F.broadcast(concepts.select(F.col("id").alias("concept_id"), "slug")), "concept_id")
    tagged = tagged.select(F.concat(F.lit("clause:"), "ref").alias("source"), F.concat(F.lit("concept:"), "slug").alias("target"), F.lit("tagged").alias("type"))
    out = contains.unionByName(tagged)
    return out if mentions is None else out.unionByName(mentions.select(F.col("item").alias("source"), F.concat(F.lit("concept:"), "slug").alias("target"), F.lit("mentions").alias("type")))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, line): the graph as JSON lines; written in order of kind and key they are the sorted graph file. Fields without a value are left out."""
    node = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.to_json(F.struct("id", "type", "label", "sector", "document", "sitting_date")).alias("line"))
    edge = edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "source", "target", "type").alias("key"), F.to_json(F.struct("source", "target", "type")).alias("line"))
    return node.unionByName(edge)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The sorted graph as text files that are in order from file to file; replaces what is in the folder."""
    graph_lines(nodes, edges).orderBy(F.desc("kind"), "key").select("line").write.mode("overwrite").text(folder)
