"""Whole-sitting reports as rows: their sections, their metadata, who attended.

A report is one JSON file per sitting (metadata, takesSectionVOList, attendanceList). Only the list of sections that are
taken is read; sections without text are left out. Repeated titles of a sitting get numbered slugs, and the key of an item is made
of its sitting, kind and slug, so a report that is read again gives the same keys.

Defined results: missing fields are null, and so is what is made of them; an unknown kind of section is named in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

_SECTION = "sectionType string, title string, subTitle string, content string, questionNo string, questionCount string, startPgNo string, endPgNo string"
_METADATA = "parlimentNO string, sessionNO string, volumeNO string, sittingNO string, sittingDate string, dateToDisplay string, speaker string, startTimeStr string"
_field = lambda ddl: "struct<" + ", ".join(x.strip().replace(" ", ":") for x in ddl.split(",")) + ">"
SCHEMA = f"metadata {_field(_METADATA)}, takesSectionVOList array<{_field(_SECTION)}>, attendanceList array<{_field('mpName string, attendance string, locationName string')}>"


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded reports, one row each."""
    return spark.read.json(folder, schema=SCHEMA, multiLine=True)


def sections(reports: DataFrame) -> DataFrame:
    """(sitting_date, position, section_type, title, content) of reports."""
    rows = reports.select(T.iso_date(F.col("metadata.sittingDate")).alias("sitting_date"), F.posexplode("takesSectionVOList").alias("position", "s"))
    return rows.select("sitting_date", F.col("position").cast("long").alias("position"), F.col("s.sectionType").alias("section_type"), "s.title", "s.content")


def metadata(reports: DataFrame) -> DataFrame:
    """(sitting_date, parliament, session, volume, sitting, speaker, starts): what a report says of its sitting."""
    m = lambda c: F.col(f"metadata.{c}")
    return reports.select(T.iso_date(m("sittingDate")).alias("sitting_date"), m("parlimentNO").alias("parliament"), m("sessionNO").alias("session"), m("volumeNO").alias("volume"), m("sittingNO").alias("sitting"), m("speaker").alias("speaker"), m("startTimeStr").alias("starts"))


def attendance(reports: DataFrame) -> DataFrame:
    """(sitting_date, member, attendance): one row a member."""
    rows = reports.select(T.iso_date(F.col("metadata.sittingDate")).alias("sitting_date"), F.explode("attendanceList").alias("a"))
    return rows.select("sitting_date", F.col("a.mpName").alias("member"), F.col("a.attendance").alias("attendance"))


def items(parts: DataFrame) -> DataFrame:
    """Sections (sitting_date, position, section_type, title, content) as items, one for each that has a text."""
    read = parts.select("sitting_date", "position", "section_type", T.collapse_whitespace(F.coalesce("title", F.lit(""))).alias("title"), "content", T.html_to_text(F.col("content")).alias("body_text")).where("body_text <> ''")
    read = read.withColumn("_base", T.item_slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy("sitting_date", "_base").orderBy("position"))
    slug = F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n.cast("string")))
    named = read.withColumn("slug", slug)
    return named.select(
        T.composite_id(F.col("sitting_date"), F.col("section_type"), F.col("slug")).alias("sprs_id"), "slug", "title", "sitting_date", "position", T.section_label(F.col("section_type")).alias("item_type"),
        T.legislation_type(F.col("title"), F.col("body_text")).alias("legislation_type"), T.speaker(F.col("content")).alias("speaker"), T.summarize(F.col("body_text")).alias("summary"), "body_text",
    )
