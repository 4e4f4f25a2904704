"""Queries on rendered documents, feeds, models and event streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import order
from lexloom.plans.relational import _DAY
from lexloom.plans.scalars import _SLUG, _WS, _cut
from lexloom.runtime import Scratch, read
from lexloom.sources import feed, inbox, markdown, report
from lexloom.streaming import items as stream


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "clause_concepts").join(F.broadcast(read(spark, d, "concepts").select(F.col("id").alias("concept_id"), "slug", "name")), "concept_id").select("clause_id", "slug", "name")


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return markdown.documents(read(spark, d, "contracts"), read(spark, d, "clauses"), _tags(spark, d))


def pages_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Clauses per rendered document, read back from its text."""
    back = markdown.read_clauses(document_pages(spark, d))
    return back.groupBy("slug").agg(F.count("*").alias("n"), F.sum(F.size("concepts")).alias("n_concepts"))


def concept_pages(spark: SparkSession, d: str) -> DataFrame:
    return markdown.concept_pages(read(spark, d, "concepts"), read(spark, d, "clauses"), _tags(spark, d))


def item_pages(spark: SparkSession, d: str) -> DataFrame:
    return markdown.item_pages(read(spark, d, "parliament_items"))


def index_lines(spark: SparkSession, d: str) -> DataFrame:
    return markdown.index_lines(read(spark, d, "contracts"))


def streamed_items(spark: SparkSession, d: str) -> DataFrame:
    """All items taken in by the stream; the last scrape of each counts."""
    scratch = Scratch(spark, "stream")
    items = read(spark, d, "parliament_items").where("sprs_id is not null")
    landing = f"{scratch.root}/landing"
    items.write.parquet(landing)
    stream.ingest(spark, landing, items.schema, f"{scratch.root}/store", f"{scratch.root}/seen")
    return stream.current(spark, f"{scratch.root}/store", items.schema).select("sprs_id", "title")


_CODES = {"oral answer": "OA", "written answer": "WA", "written answer (not answered)": "WANA", "debate": "OS", "written statement": "WS"}


def sitting_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of all sittings, each taken as a section of its sitting's report and read as such."""
    i = read(spark, d, "parliament_items")
    code = F.lit("XX")
    for label, x in _CODES.items():
        code = F.when(F.col("item_type") == label, x).otherwise(code)
    content = F.concat(F.lit("<p>"), F.replace(F.replace("body_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    parts = i.select(T.iso_date(F.col("sitting_date")).alias("sitting_date"), F.col("id").alias("position"), code.alias("section_type"), "title", content.alias("content"))
    return report.items(parts).select("position", "sprs_id", "slug", "sitting_date", "item_type", F.length("body_text").alias("chars"))


def _recorded(spark: SparkSession, d: str) -> str:
    """A folder with the recorded pages of a search for all items with a day, the newest first."""
    scratch = Scratch(spark, "feed")
    i = read(spark, d, "parliament_items").select("id", "title", "sprs_id", "speaker", T.iso_date(F.col("sitting_date")).alias("day")).where("day is not null")
    i = order.positions(i.withColumn("_new", -F.unix_date(F.col("day").cast("date"))), "_new", "id", scratch=scratch)
    hits = i.count()
    hit = F.struct("title", F.col("sprs_id").alias("reportId"), F.date_format(F.col("day").cast("date"), "d-M-yyyy").alias("sittingDate"), F.lit(str(hits)).alias("maxResult"), F.col("speaker").alias("memberName"))
    pages = i.groupBy(F.floor(F.col("position") / feed.PAGE).alias("page")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", hit.alias("hit")))), lambda x: x.getField("hit"))).alias("hits"))
    folder = f"{scratch.root}/pages"

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, held in zip(batch["page"], batch["hits"]):
                feed.record(folder, feed.page_name("2000-01-01", "2030-12-31", int(page) * feed.PAGE), json.loads(held))
            yield pd.DataFrame({"n": [len(batch)]})

    pages.mapInPandas(store, "n long").agg(F.sum("n")).collect()
    return folder


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of half a year, replayed from recorded pages; the days are pushed down to the source."""
    hits = feed.search(spark, _recorded(spark, d), "2000-01-01", "2030-12-31")
    return hits.where("sitting_date >= '2024-01-01' and sitting_date <= '2024-06-30'").select("reportId", "sitting_date", "title", "memberName")


def sitting_days(spark: SparkSession, d: str) -> DataFrame:
    """All sitting days that the recorded pages tell of."""
    return feed.search(spark, _recorded(spark, d), "2000-01-01", "2030-12-31").select("sitting_date").distinct()


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = stream.windowed_counts(read(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = stream.sessions(read(spark, d, "events"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def judged_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct clause heading put to a rule-based provider once, through the cache."""
    inbox.PROVIDERS.setdefault("rules", _rules)
    asked = read(spark, d, "clauses").where("heading is not null").select("id", F.col("heading").alias("prompt"))
    answers, _ = inbox.ask(asked, spark.createDataFrame([], "key string, answer string"), "rules", "v1")
    return answers.select("id", F.get_json_object("answer", "$.kind").alias("kind"))


def _rules(prompt: str) -> str:
    return f"Answer: {json.dumps({'kind': 'money' if any(w in prompt.lower() for w in ('rent', 'deposit', 'payment', 'charge')) else 'other'})}."


QUERIES = {f.__name__: f for f in (document_pages, pages_read_back, concept_pages, item_pages, index_lines, streamed_items, sitting_items, search_hits, sitting_days, event_windows, user_sessions, judged_clauses)}

_ITEM_SLUG = _cut(_SLUG.format(_WS.format("coalesce(title, '')")), 80)
_CODE = "CASE item_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " ELSE 'XX' END"

def _yaml(x: str) -> str:
    """A YAML scalar of a column."""
    unsafe = f"lower({x}) IN ('null', 'true', 'false', 'yes', 'no', '~', '') OR {x} <> trim({x}) OR regexp_matches({x}, '^[-?:,\\[\\]{{}}#&*!|>''\"%@`\\s]|\\s$') OR contains({x}, ': ') OR {x} LIKE '%:' OR contains({x}, chr(10)) OR contains({x}, '#')"
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN {unsafe} THEN '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE {x} END"


def _head(**pairs: str) -> str:
    return "'---'" + "".join(f" || chr(10) || '{k}: ' || ({v})" for k, v in pairs.items()) + " || chr(10) || '---'"


def _finalized(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(?m)[\\t\\f\\v\\r ]+$', '', 'g'), '\\n+$', '') || chr(10)"


_GAP = "chr(10) || chr(10)"
_LINKED = "(SELECT DISTINCT clause_id, o.slug, o.name FROM clause_concepts e JOIN concepts o ON o.id = e.concept_id)"
_ITEM_PAGE = _finalized(_head(title=_yaml("title"), slug=_yaml("slug"), sitting_date=_yaml("day"), item_type=_yaml("item_type"), speaker=_yaml("speaker"), url=_yaml("url"), concepts="'[]'") + f" || {_GAP} || '# ' || coalesce(title, slug, '') || {_GAP} || coalesce(nullif(trim(body_text), ''), summary, '')")
_CONCEPT_PAGE = _finalized(_head(title=_yaml("name"), slug=_yaml("slug"), clause_count="coalesce(n, 0)::VARCHAR") + f" || {_GAP} || '# ' || coalesce(name, slug) || {_GAP} || trim(coalesce(description, '')) || {_GAP} || coalesce(listing, '')")
_BOTH = "concat_ws(' ', nullif(trim(number), ''), nullif(trim(heading), ''))"
_CLAUSE = f"'## ' || CASE WHEN {_BOTH} <> '' THEN {_BOTH} ELSE 'Clause' END || chr(10) || '<!-- anchor: ' || coalesce(anchor, '') || ' -->' || {_GAP} || trim(coalesce(text, '')) || coalesce({_GAP} || '**Concepts:** ' || links, '') || chr(10)"
_DOCUMENT_PAGE = _finalized(
    _head(title=_yaml("title"), slug=_yaml("slug"), sector=_yaml("sector"), source=_yaml("source_path"), file_type=_yaml("file_type"), version="version::VARCHAR", clause_count="coalesce(n, 0)::VARCHAR", concepts="'[' || coalesce(slugs, '') || ']'")
    + f" || {_GAP} || '# ' || coalesce(title, slug) || {_GAP} || CASE WHEN parse_error IS NOT NULL THEN 'This document could not be parsed automatically (' || parse_error || ').' ELSE coalesce(body, '') END"
)

SQL = {
    "item_pages": f"SELECT id, {_ITEM_PAGE} AS markdown FROM (SELECT *, {_DAY} AS day FROM parliament_items)",
    "concept_pages": f"""SELECT slug, {_CONCEPT_PAGE} AS markdown FROM concepts LEFT JOIN (
      SELECT slug AS s, count(*) AS n, string_agg('- [[' || doc || '#' || anchor || ']] ' || head, chr(10) ORDER BY doc, anchor, head) AS listing FROM (
        SELECT DISTINCT l.slug, string_split(ref, '#')[1] AS doc, coalesce(anchor, '') AS anchor, coalesce(heading, '') AS head FROM {_LINKED} l JOIN clauses c ON c.id = l.clause_id WHERE ref IS NOT NULL) GROUP BY 1) ON s = slug""",
    "document_pages": f"""WITH k AS (SELECT clause_id, string_agg('[[' || slug || '|' || coalesce(name, slug) || ']]', ', ' ORDER BY slug) AS links FROM {_LINKED} GROUP BY 1),
      b AS (SELECT document_id, count(*) AS n, string_agg({_CLAUSE}, chr(10) ORDER BY order_index NULLS FIRST, id) AS body FROM clauses c LEFT JOIN k ON k.clause_id = c.id WHERE document_id IS NOT NULL GROUP BY 1),
      t AS (SELECT document_id AS t_id, array_to_string(list_sort(list(DISTINCT l.slug)), ', ') AS slugs FROM {_LINKED} l JOIN clauses c ON c.id = l.clause_id WHERE document_id IS NOT NULL GROUP BY 1)
      SELECT slug, {_DOCUMENT_PAGE} AS markdown FROM contracts d LEFT JOIN b ON b.document_id = d.id LEFT JOIN t ON t_id = d.id""",
    "sitting_items": f"""SELECT position, 'report:' || sitting_date || ':' || lower(code) || ':' || slug AS sprs_id, slug, sitting_date, coalesce(CASE WHEN code <> 'XX' THEN item_type END, 'xx') AS item_type, CAST(chars AS INTEGER) AS chars FROM (
      SELECT position, sitting_date, code, item_type, chars, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS slug FROM (
        SELECT id AS position, {_DAY} AS sitting_date, {_CODE} AS code, item_type, {_ITEM_SLUG} AS base, length({_WS.format('body_text')}) AS chars FROM parliament_items WHERE {_WS.format('body_text')} <> '')
      WINDOW w AS (PARTITION BY sitting_date, base ORDER BY position))""",
    "search_hits": f"SELECT sprs_id AS \"reportId\", {_DAY} AS sitting_date, title, speaker AS \"memberName\" FROM parliament_items WHERE {_DAY} BETWEEN '2024-01-01' AND '2024-06-30'",
    "sitting_days": f"SELECT DISTINCT {_DAY} AS sitting_date FROM parliament_items WHERE {_DAY} IS NOT NULL",
    "pages_read_back": """WITH e AS (SELECT clause_id, count(DISTINCT o.slug) AS n FROM clause_concepts e JOIN concepts o ON o.id = e.concept_id GROUP BY 1)
      SELECT slug, count(*) AS n, sum(coalesce(e.n, 0)) AS n_concepts FROM contracts d JOIN clauses c ON c.document_id = d.id LEFT JOIN e ON e.clause_id = c.id WHERE d.parse_error IS NULL GROUP BY 1""",
    "index_lines": "SELECT lower(sector) AS sector, slug, '- [[' || slug || '|' || coalesce(title, slug) || ']]' AS line FROM contracts",
    "streamed_items": "SELECT sprs_id, arg_max(title, (created_at, id)) AS title FROM (SELECT sprs_id, coalesce(title, chr(0)) AS t, title, created_at, id FROM parliament_items WHERE sprs_id IS NOT NULL) GROUP BY 1",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM (
      SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS gap FROM events)) GROUP BY user_id, s""",
    "judged_clauses": "SELECT id, CASE WHEN regexp_matches(lower(heading), 'rent|deposit|payment|charge') THEN 'money' ELSE 'other' END AS kind FROM clauses WHERE heading IS NOT NULL",
}
