"""Documents, concepts, items and the index as markdown texts, and documents read back from them.

Everything is rendered as a text column, so nothing but the finished files leaves Spark; ``write_files`` stores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.runtime import filesystem, put_file


def front_matter(**pairs: Column) -> Column:
    return F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs.items()], F.lit("---"))


def yaml_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def in_order(part: Column, *order: str) -> Column:
    """Aggregate: texts joined by line ends in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("part")))), lambda x: x.getField("part")), "\n")


def documents(contracts: DataFrame, clauses: DataFrame, tags: DataFrame) -> DataFrame:
    """(slug, markdown): each contract with its clauses in order; tags: (clause_id, slug, name)."""
    links = tags.select("clause_id", "slug", "name").distinct().groupBy("clause_id").agg(F.array_sort(F.collect_list(F.struct("slug", F.concat(F.lit("[["), "slug", F.lit("|"), F.coalesce("name", "slug"), F.lit("]]")).alias("link")))).alias("links"))
    c = clauses.join(links, F.col("id") == F.col("clause_id"), "left")
    both = F.concat_ws(" ", F.nullif(F.trim("number"), F.lit("")), F.nullif(F.trim("heading"), F.lit("")))
    concepts = F.when(F.size("links") > 0, F.concat(F.lit("\n\n**Concepts:** "), F.array_join(F.transform("links", lambda x: x.getField("link")), ", "))).otherwise("")
    part = F.concat(F.lit("## "), F.when(both != "", both).otherwise("Clause"), F.lit("\n<!-- anchor: "), F.coalesce("anchor", F.lit("")), F.lit(" -->\n\n"), F.trim(F.coalesce("text", F.lit(""))), concepts, F.lit("\n"))
    body = c.where("document_id is not null").groupBy("document_id").agg(in_order(part, "order_index", "id").alias("body"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("links", F.expr("cast(array() as array<struct<slug:string,link:string>>)")), lambda x: x.getField("slug")))))).alias("slugs"))
    d = contracts.join(body, F.col("id") == F.col("document_id"), "left")
    head = front_matter(
        title=T.yaml_scalar(F.col("title")), slug=T.yaml_scalar(F.col("slug")), sector=T.yaml_scalar(F.col("sector")), source=T.yaml_scalar(F.col("source_path")), file_type=T.yaml_scalar(F.col("file_type")), version=F.col("version").cast("string"),
        clause_count=F.coalesce("n", F.lit(0)).cast("string"), concepts=yaml_list(F.coalesce("slugs", F.expr("cast(array() as array<string>)"))),
    )
    broken = F.concat(F.lit("This document could not be parsed automatically ("), F.col("parse_error"), F.lit(")."))
    text = F.concat(head, F.lit("\n\n# "), F.coalesce("title", "slug"), F.lit("\n\n"), F.when(F.col("parse_error").isNotNull(), broken).otherwise(F.coalesce("body", F.lit(""))))
    return d.select("slug", T.finalize(text).alias("markdown"))


def concept_pages(concepts: DataFrame, clauses: DataFrame, tags: DataFrame) -> DataFrame:
    """(slug, markdown): each concept with the clauses it is tagged on, by document and anchor."""
    ref = clauses.where("ref is not null").select(F.col("id").alias("clause_id"), F.substring_index("ref", "#", 1).alias("doc"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.coalesce("heading", F.lit("")).alias("head"))
    rows = tags.join(ref, "clause_id").select(F.col("slug"), "doc", "anchor", "head").distinct()
    listing = rows.groupBy("slug").agg(in_order(F.concat(F.lit("- [["), "doc", F.lit("#"), "anchor", F.lit("]] "), "head"), "doc", "anchor", "head").alias("listing"), F.count("*").alias("n"))
    out = concepts.select("slug", "name", "description").join(listing, "slug", "left")
    head = front_matter(title=T.yaml_scalar(F.col("name")), slug=T.yaml_scalar(F.col("slug")), clause_count=F.coalesce("n", F.lit(0)).cast("string"))
    return out.select("slug", T.finalize(F.concat(head, F.lit("\n\n# "), F.coalesce("name", "slug"), F.lit("\n\n"), F.trim(F.coalesce("description", F.lit(""))), F.lit("\n\n"), F.coalesce("listing", F.lit("")))).alias("markdown"))


def item_pages(items: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(id, markdown): each item with its body, else its summary. tags: (item_id, slug), the concepts of its front matter."""
    slugs = F.expr("cast(array() as array<string>)")
    if tags is not None:
        listed = tags.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_set("slug")).alias("_slugs"))
        items, slugs = items.join(listed, "id", "left"), F.coalesce("_slugs", slugs)
    day = T.iso_date(F.col("sitting_date"))
    head = front_matter(**{"title": T.yaml_scalar(F.col("title")), "slug": T.yaml_scalar(F.col("slug")), "sitting_date": T.yaml_scalar(day), "item_type": T.yaml_scalar(F.col("item_type")), "speaker": T.yaml_scalar(F.col("speaker")), "url": T.yaml_scalar(F.col("url")), "concepts": yaml_list(slugs)})
    body = F.coalesce(F.nullif(F.trim("body_text"), F.lit("")), F.col("summary"), F.lit(""))
    return items.select("id", T.finalize(F.concat(head, F.lit("\n\n# "), F.coalesce("title", "slug", F.lit("")), F.lit("\n\n"), body)).alias("markdown"))


def index_lines(contracts: DataFrame) -> DataFrame:
    """(sector, line): the lines of the index."""
    return contracts.select(F.lower("sector").alias("sector"), "slug", F.concat(F.lit("- [["), "slug", F.lit("|"), F.coalesce("title", "slug"), F.lit("]]")).alias("line"))


def read_clauses(pages: DataFrame) -> DataFrame:
    """(slug, position, number, heading, anchor, text, concepts) of rendered documents (slug, markdown)."""
    parts = pages.select("slug", F.posexplode(F.slice(F.split("markdown", r"(?m)^## "), 2, 1_000_000)).alias("position", "part"))
    line = F.regexp_extract("part", r"^([^\n]*)", 1)
    number = F.regexp_extract(line, r"^(\d\S*)", 1)
    body = F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n<!-- anchor: [^\n]* -->\n", ""), r"\n\*\*Concepts:\*\* [^\n]*\s*$", "")
    last = F.regexp_extract("part", r"\n\*\*Concepts:\*\* ([^\n]*)\s*$", 1)
    return parts.select(
        "slug", "position", number.alias("number"), F.trim(F.regexp_replace(line, r"^\d\S*", "")).alias("heading"), F.regexp_extract("part", r"<!-- anchor: ([^\n]*) -->", 1).alias("anchor"), T.collapse_whitespace(body).alias("text"),
        F.regexp_extract_all(last, F.lit(r"\[\[([^|\]]+)\|"), F.lit(1)).alias("concepts"),
    )


def write_files(pages: DataFrame, folder: str, name: str = "slug", text: str = "markdown") -> int:
    """Write each row to its own file under a folder all executors share; the number of files."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(folder)
        for batch in batches:
            for stem, body in zip(batch["_name"], batch["_text"]):
                put_file(files, f"{root}/{stem}.md", body.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    return pages.select(F.col(name).alias("_name"), F.col(text).alias("_text")).mapInPandas(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
