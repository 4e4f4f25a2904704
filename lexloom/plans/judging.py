"""Queries on labels, verdicts by rule, and what is asked of a model and made of its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import retrieve, tagging
from lexloom.plans import patterns
from lexloom.plans.relational import query as _query
from lexloom.plans.retrieval import _RANKED, ranked_clauses
from lexloom.runtime import Scratch, read
from lexloom.sources import inbox

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, SQL)


_TABLE = "(VALUES " + ", ".join(f"({n}, '{name}', '{w.replace(chr(39), chr(39) * 2)}')" for n, (name, words) in enumerate(tagging.KEYWORDS.items()) for w in words) + ") k(n, name, word)"
_HELD = "list_transform(list_sort(list(DISTINCT {{'n': n, 'name': name}})), lambda x: x.name)"
_CONCEPTS = "coalesce((SELECT " + _HELD + f" FROM {_TABLE} WHERE contains(lower({{}}), word)), [])"


@query(f"SELECT id, array_to_string({_CONCEPTS.format('text')}, ', ') AS concepts FROM clauses WHERE text IS NOT NULL")
def keyword_tags(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of every clause by keywords, in the order of the table."""
    return read(spark, d, "clauses").where("text is not null").select("id", F.array_join(tagging.keyword_concepts(F.col("text")), ", ").alias("concepts"))


@query("SELECT id, name, list_contains(['" + "', '".join(tagging.VOCABULARY) + "'], name) AS known FROM concepts")
def known_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Which concepts a tagger's vocabulary has."""
    return read(spark, d, "concepts").select("id", "name", F.col("name").isin(*tagging.VOCABULARY).alias("known"))


def _tags(prompt: str) -> str:
    """A tagger that answers with the headings of a document: each anchor gets its own heading, twice, and one that wasn't asked for."""
    import json

    pairs = [line.split("\t") for line in prompt.split("\n") if line.count("\t") == 1]
    return "```json\n" + json.dumps({"nowhere": ["Lost"]} | {anchor: [heading.lower(), heading.upper()] for anchor, heading in pairs}) + "\n```"


@query(
    r"""SELECT DISTINCT document_id, anchor, array_to_string(list_transform(string_split(h, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM (
  SELECT document_id, anchor, arg_max(trim(regexp_replace(heading, '\s+', ' ', 'g')), id) AS h FROM clauses WHERE document_id IS NOT NULL AND anchor IS NOT NULL AND trim(heading) <> '' GROUP BY 1, 2)"""
)
def batch_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of a model that is asked once a document for all its clauses."""
    inbox.PROVIDERS.setdefault("headings", _tags)
    c = read(spark, d, "clauses").where("document_id is not null and anchor is not null and trim(heading) <> ''").select("id", "document_id", "anchor", T.collapse_whitespace(F.col("heading")).alias("heading"))
    last = c.groupBy("document_id", "anchor").agg(F.max_by("heading", "id").alias("heading"))
    prompt = F.array_join(F.array_sort(F.collect_list(F.concat("anchor", F.lit("\t"), "heading"))), "\n")
    asked = last.groupBy(F.col("document_id").alias("id")).agg(prompt.alias("prompt"))
    with_answers, _ = inbox.ask(asked, spark.createDataFrame([], "key string, answer string"), "headings", "v1")
    return tagging.tags_of_answer(last, with_answers.select(F.col("id").alias("document_id"), "answer")).select("document_id", "anchor", "name")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, ref, text, own, legislation_type): each item with its best clauses, and what its text said."""
    ranked = ranked_clauses(spark, d)
    # the long texts of items stay where they are read
    items = read(spark, d, "parliament_items").select(F.col("id").alias("item_id"), *tagging.said(F.concat_ws("\n", "title", "body_text")))
    c = read(spark, d, "clauses").select(F.col("id").alias("clause_id"), F.concat_ws("@", "ref", F.col("id").cast("string")).alias("ref"), "text")
    pairs = ranked.select("item_id", "clause_id").join(retrieve.picked(c, ranked, "clause_id"), "clause_id")
    return pairs.join(items, "item_id").select("item_id", "ref", "text", "own", "legislation_type")


_PAIRS = f"""{_RANKED}, pairs AS (SELECT r.item_id, concat_ws(chr(10), i.title, i.body_text) AS item_text, concat_ws('@', c.ref, c.id) AS ref, c.text FROM ranked r JOIN parliament_items i ON i.id = r.item_id JOIN clauses c ON c.id = r.clause_id),
said AS (SELECT item_id, {_CONCEPTS.format('item_text')} AS own FROM (SELECT DISTINCT item_id, item_text FROM pairs)),
held AS (SELECT DISTINCT ref, text, {_CONCEPTS.format('text')} AS held FROM (SELECT DISTINCT ref, text FROM pairs)),
verdicts AS (SELECT p.item_id, p.ref, len(s) > 0 AS impacted, CASE WHEN len(s) = 0 THEN 'low' WHEN {patterns._THREE} <> text OR regexp_matches(text, '(?i){T.PERIOD}') OR len(s) >= 2 THEN 'high' ELSE 'medium' END AS severity, array_to_string(s, ', ') AS shared,
  CASE WHEN len(s) > 0 THEN CASE WHEN {patterns._THREE} <> text THEN {patterns._THREE} ELSE rtrim(text, chr(32) || chr(9) || chr(10) || chr(13)) || '{T.FALLBACK}' END END AS suggested_text,
  CASE WHEN contains(lower(item_text), 'amend') THEN 'amendment' WHEN contains(lower(item_text), 'new act') OR contains(lower(item_text), 'introduces') OR contains(lower(item_text), 'framework') THEN 'new_legislation' END AS legislation_type
  FROM (SELECT p.*, list_filter(h.held, lambda x: list_contains(w.own, x)) AS s FROM pairs p JOIN said w ON w.item_id = p.item_id JOIN held h ON h.ref = p.ref) p)"""


@query(f"{_PAIRS} SELECT * FROM verdicts")
def rule_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by rule on the best clauses of every item."""
    return tagging.judged_by(_candidates(spark, d))


@query(f"{_PAIRS} SELECT item_id, ref, impacted, CASE WHEN impacted THEN severity ELSE 'low' END AS severity, CASE WHEN impacted THEN 'shares ' || shared ELSE '' END AS rationale, coalesce(suggested_text, '') AS suggested_text, legislation_type FROM verdicts")
def coerced_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a careless model, mapped onto what was asked: clauses named twice, clauses nobody asked for, unknown severities."""
    asked = Scratch(spark, "judging").put(_candidates(spark, d), "asked")
    v = tagging.judged_by(asked)
    entry = F.struct(F.col("ref").alias("clause_ref"), "impacted", F.when(F.col("impacted"), F.col("severity")).otherwise("grave").alias("severity"), F.when(F.col("impacted"), F.concat(F.lit("shares "), "shared")).alias("rationale"), "suggested_text")
    told = v.groupBy("item_id", "legislation_type").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    other = F.transform("e", lambda x: x.withField("severity", F.lit("medium")).withField("impacted", ~x.getField("impacted")).withField("clause_ref", F.when(x.getField("impacted"), x.getField("clause_ref")).otherwise("unknown")))
    answers = told.select("item_id", F.to_json(F.struct(F.coalesce("legislation_type", F.lit("unsure")).alias("legislation_type"), F.concat("e", other).alias("assessments"))).alias("answer"))
    return tagging.coerced(asked.select("item_id", "ref", "text"), answers)


_HEAD = "CASE WHEN concat_ws(' ', nullif(trim(number), ''), nullif(trim(heading), '')) <> '' THEN concat_ws(' ', nullif(trim(number), ''), nullif(trim(heading), '')) ELSE '(none)' END"


@query(f"""{_RANKED} SELECT i.id AS item_id, md5('Judge.' || chr(10) || '## Item' || chr(10) || 'Title: ' || coalesce(i.title, '') || chr(10) || chr(10) || substr(trim(coalesce(nullif(body_text, ''), summary, '')), 1, 6000) || chr(10) || chr(10) || string_agg('## Candidate clause ' || coalesce(c.ref, '') || chr(10) || 'Heading: ' || {_HEAD} || chr(10) || 'Text:' || chr(10) || coalesce(substr(trim(c.text), 1, 20000), '') || chr(10), chr(10) ORDER BY rank)) AS prompt
FROM ranked r JOIN parliament_items i ON i.id = r.item_id JOIN clauses c ON c.id = r.clause_id GROUP BY i.id, i.title, body_text, summary""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked about every item, as a digest."""
    p = tagging.prompts(read(spark, d, "parliament_items"), ranked_clauses(spark, d), read(spark, d, "clauses"), "Judge.")
    return p.select("item_id", F.md5("prompt").alias("prompt"))
