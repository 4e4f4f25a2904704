"""Queries on hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import STOPWORDS
from lexloom.operators import retrieve
from lexloom.runtime import read
from lexloom.sources import markdown


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [read(spark, sf_dir, x) for x in ("parliament_items", "clauses", "contracts", "concepts", "clause_concepts")]


#: Of queries whose SQL takes the beginning of a body only.
_BEGINNING = retrieve.Settings(query_chars=6_000)


def ranked_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.ranked(*_tables(spark, sf_dir), _BEGINNING)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the form of items."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body_text"), F.lit(None).cast("string").alias("summary"))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best clauses of each document of the corpus, by the whole of its text; it names concepts more often than the feed does."""
    return retrieve.ranked(_documents(spark, sf_dir), *_tables(spark, sf_dir)[1:])


def document_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts named in the documents."""
    _, _, _, concepts, edges = _tables(spark, sf_dir)
    return retrieve.item_tags(_documents(spark, sf_dir), concepts, retrieve.clause_tags(edges, concepts), retrieve.Settings())


def declared_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written into the front matter of rendered pages and read back from it."""
    items = _documents(spark, sf_dir).select("*", F.lit(None).cast("string").alias("slug"), *[F.lit("").alias(c) for c in ("sitting_date", "item_type", "speaker", "url")])
    pages = markdown.item_pages(items, document_concepts(spark, sf_dir))
    return retrieve.declared_tags(pages.select(F.col("id").alias("item_id"), "markdown"))


def item_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, _, concepts, edges = _tables(spark, sf_dir)
    return retrieve.item_tags(items, concepts, retrieve.clause_tags(edges, concepts), retrieve.Settings())


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, clauses, contracts, _, _ = _tables(spark, sf_dir)
    corpus = retrieve.readable(clauses, contracts)
    return retrieve.idf_table(retrieve.postings(corpus), corpus, retrieve.Settings()).selectExpr("term", "df", "round(idf, 6) as idf")


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each item, ranked by the whole of its text."""
    return retrieve.gated(retrieve.ranked(*_tables(spark, sf_dir)), read(spark, sf_dir, "parliament_items"))


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.run_summary(retrieve.gated(ranked_clauses(spark, sf_dir), read(spark, sf_dir, "parliament_items")))


QUERIES = {f.__name__: f for f in (ranked_clauses, ranked_documents, item_concepts, document_concepts, declared_concepts, term_idf, gate_outcomes, gate_summary)}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"
_INDEX = f"""
corpus AS (SELECT c.id, c.text, coalesce(c.ref, '') AS ref FROM clauses c WHERE trim(text) <> '' AND document_id IN (SELECT id FROM contracts WHERE parse_error IS NULL)),
toks AS (SELECT id, {_TOKENS.format('text')} AS t FROM corpus),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM corpus) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw FROM post GROUP BY term),
idf AS (SELECT term, df, least(CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM raw) ELSE raw END, 2.5e0) AS idf FROM raw),
size AS (SELECT (SELECT sum(tf) FROM post) / (SELECT count(*) FROM corpus)::DOUBLE AS avgdl)"""
_TAGS = """
tags AS (SELECT DISTINCT clause_id AS id, slug FROM clause_concepts e JOIN concepts c ON c.id = e.concept_id),
named AS (SELECT slug, '(?i)\\b' || array_to_string(w, '\\W+') || 's?\\b' AS pattern FROM (SELECT slug, regexp_extract_all(lower(name), '[a-z]+') AS w FROM concepts)
  WHERE (len(w) > 1 OR (len(w) = 1 AND length(w[1]) >= 6)) AND slug IN (SELECT slug FROM tags GROUP BY slug HAVING count(*) >= 2)),
own AS (SELECT DISTINCT i.id AS item_id, named.slug FROM parliament_items i JOIN named ON regexp_matches(coalesce(title, '') || chr(10) || coalesce(body_text, ''), pattern))"""
#: Every clause has a score; ties go by ref, then id.
_RANKED = f"""WITH {_INDEX}, {_TAGS},
qt AS (SELECT id AS item_id, term, count(*) AS qtf FROM (SELECT id, unnest({_TOKENS.format("coalesce(title, '') || chr(10) || coalesce(nullif(body_text, ''), summary, '')[:6000]")}) AS term FROM parliament_items) GROUP BY ALL),
q AS (SELECT item_id, term, idf FROM (SELECT item_id, qt.term, idf, row_number() OVER (PARTITION BY item_id ORDER BY round(qtf * idf, 6) DESC, qt.term) AS r FROM qt JOIN idf ON qt.term = idf.term WHERE idf > 0) WHERE r <= 40),
hits AS (SELECT item_id, id, sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS bm25 FROM q JOIN post ON q.term = post.term, size GROUP BY ALL),
shared AS (SELECT item_id, t.id, count(*) AS shared FROM own JOIN tags t ON own.slug = t.slug WHERE t.id IN (SELECT id FROM corpus) GROUP BY ALL),
scored AS (SELECT i.id AS item_id, c.id AS clause_id, c.ref, round(coalesce(bm25, 0), 4) AS bm25, coalesce(shared, 0) AS shared FROM parliament_items i CROSS JOIN corpus c LEFT JOIN hits h ON h.item_id = i.id AND h.id = c.id LEFT JOIN shared s ON s.item_id = i.id AND s.id = c.id),
ranked AS (SELECT item_id, rank, clause_id, bm25, shared, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ref, clause_id) AS rank FROM (SELECT *, round(bm25 + 3 * shared, 4) AS score FROM scored)) WHERE rank <= 5)"""
#: Documents in place of the items.
_BY_DOCUMENTS = "(SELECT doc_id AS id, title, text AS body_text, NULL::VARCHAR AS summary FROM documents)"
_DAY = "strftime(coalesce(CASE WHEN regexp_full_match(sitting_date, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(sitting_date, '%Y-%m-%d') END, CASE WHEN regexp_full_match(sitting_date, '\\d{1,2}-\\d{1,2}-\\d{4}') THEN try_strptime(sitting_date, '%d-%m-%Y') END), '%Y-%m-%d')"
_OUTCOMES = f"""{_RANKED},
best AS (SELECT i.id AS item_id, {_DAY} AS day, r.score AS best FROM parliament_items i LEFT JOIN ranked r ON r.item_id = i.id AND r.rank = 1),
outcomes AS (SELECT item_id, best, CASE WHEN best IS NULL THEN 'no_candidates' WHEN best < 20 THEN 'gated' WHEN row_number() OVER (PARTITION BY coalesce(best, 0) >= 20 ORDER BY best DESC NULLS LAST, day DESC NULLS LAST, item_id) <= 15 THEN 'judged' ELSE 'over_budget' END AS outcome FROM best)"""

SQL = {
    "ranked_clauses": f"{_RANKED} SELECT * FROM ranked",
    "ranked_documents": f"{_RANKED} SELECT * FROM ranked".replace("FROM parliament_items", f"FROM {_BY_DOCUMENTS}").replace("[:6000]", ""),
    "item_concepts": f"WITH {_TAGS} SELECT * FROM own",
    "document_concepts": f"WITH {_TAGS} SELECT * FROM own".replace("FROM parliament_items", f"FROM {_BY_DOCUMENTS}"),
    "declared_concepts": f"WITH {_TAGS} SELECT * FROM own".replace("FROM parliament_items", f"FROM {_BY_DOCUMENTS}"),
    "term_idf": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "gate_outcomes": f"{_OUTCOMES} SELECT * FROM outcomes".replace("[:6000]", ""),
    "gate_summary": f"{_OUTCOMES} SELECT count(*) AS items, count(*) FILTER (outcome = 'judged') AS judged, count(*) FILTER (outcome = 'over_budget') AS over_budget, count(*) FILTER (outcome = 'gated') AS gated, count(*) FILTER (outcome = 'no_candidates') AS no_candidates FROM outcomes",
}
