"""Filters, joins, aggregates, windows, sorts and set operations over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import graph, merge, retrieve, segment
from lexloom.operators.redline import redline
from lexloom.runtime import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, queries: dict | None = None, texts: dict | None = None):
    """Registers a query under its name, with its SQL if it has one."""
    queries, texts = Q if queries is None else queries, SQL if texts is None else texts

    def add(f):
        queries[f.__name__] = f
        if sql:
            texts[f.__name__] = sql
        return f

    return add


_DAY = "strftime(coalesce(CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime({0}, '%Y-%m-%d') END, CASE WHEN regexp_full_match({0}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({0}, '%d-%m-%Y') END), '%Y-%m-%d')".format("sitting_date")


@query("SELECT lower(sector) AS sector, count(*) AS n, string_agg(slug, ',' ORDER BY slug) AS slugs, sum(clause_count) AS clauses FROM contracts GROUP BY 1")
def contracts_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contracts").groupBy(F.lower("sector").alias("sector")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"), F.sum("clause_count").alias("clauses"))


@query("SELECT id, slug, sector FROM contracts WHERE lower(sector) = 'real-estate' AND file_type = 'pdf' AND parse_error IS NULL")
def contracts_filtered(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contracts").where("lower(sector) = 'real-estate' and file_type = 'pdf' and parse_error is null").select("id", "slug", "sector").orderBy("slug")


@query(f"SELECT id, sprs_id, {_DAY} AS day FROM parliament_items WHERE {_DAY} = (SELECT max({_DAY}) FROM parliament_items)")
def latest_sitting(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "parliament_items").select("id", "sprs_id", T.iso_date(F.col("sitting_date")).alias("day"))
    return items.join(F.broadcast(items.agg(F.max("day").alias("day"))), "day").select("id", "sprs_id", "day")


@query("SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE matter_ref LIKE 'CC-2025-%' GROUP BY 1")
def matters_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.startswith("matter_ref", F.lit("CC-2025-"))).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


@query("SELECT 'clauses' AS name, count(*) AS n FROM clauses UNION ALL SELECT 'contracts', count(*) FROM contracts UNION ALL SELECT 'concepts', count(*) FROM concepts UNION ALL SELECT 'items', count(*) FROM parliament_items")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, table: read(spark, d, table).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("clauses", "clauses").union(one("contracts", "contracts")).union(one("concepts", "concepts")).union(one("items", "parliament_items"))


@query("SELECT document_id, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank, sum(length(text)) AS chars FROM clauses WHERE document_id IN (SELECT id FROM contracts WHERE parse_error IS NULL) GROUP BY 1")
def readable_clauses(spark: SparkSession, d: str) -> DataFrame:
    good = read(spark, d, "contracts").where("parse_error is null").select(F.col("id").alias("document_id"))
    blank = F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "")
    return read(spark, d, "clauses").join(good, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"), blank.alias("blank"), F.sum(F.length("text")).alias("chars"))


@query("SELECT c.id, c.ref, o.slug, o.name FROM clauses c JOIN (SELECT DISTINCT clause_id, concept_id FROM clause_concepts) e ON e.clause_id = c.id JOIN concepts o ON o.id = e.concept_id")
def clause_concept_names(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "clause_concepts").select("clause_id", "concept_id").distinct()
    concepts = read(spark, d, "concepts").select(F.col("id").alias("concept_id"), "slug", "name")
    return read(spark, d, "clauses").select("id", "ref").join(edges, F.col("id") == F.col("clause_id")).join(F.broadcast(concepts), "concept_id").select("id", "ref", "slug", "name")


@query("SELECT (e.clause_id IS NOT NULL AND c.id IS NULL) AS no_clause, (e.concept_id IS NOT NULL AND o.id IS NULL) AS no_concept, e.clause_id IS NULL OR e.concept_id IS NULL AS null_end, count(*) AS n FROM clause_concepts e LEFT JOIN clauses c ON c.id = e.clause_id LEFT JOIN concepts o ON o.id = e.concept_id GROUP BY ALL")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "clause_concepts")
    c = read(spark, d, "clauses").select(F.col("id").alias("clause_id"), F.lit(True).alias("c"))
    o = read(spark, d, "concepts").select(F.col("id").alias("concept_id"), F.lit(True).alias("o"))
    j = e.join(c, "clause_id", "left").join(F.broadcast(o), "concept_id", "left")
    return j.groupBy((F.col("clause_id").isNotNull() & F.col("c").isNull()).alias("no_clause"), (F.col("concept_id").isNotNull() & F.col("o").isNull()).alias("no_concept"), (F.col("clause_id").isNull() | F.col("concept_id").isNull()).alias("null_end")).agg(F.count("*").alias("n"))


@query("SELECT id, slug FROM contracts WHERE id IN (SELECT document_id FROM clauses WHERE id IN (SELECT clause_id FROM clause_concepts WHERE concept_id = (SELECT min(id) FROM concepts)))")
def contracts_with_concept(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "concepts").agg(F.min("id").alias("concept_id"))
    tagged = read(spark, d, "clause_concepts").join(F.broadcast(first), "concept_id", "left_semi").select(F.col("clause_id").alias("id"))
    docs = read(spark, d, "clauses").join(tagged, "id", "left_semi").select(F.col("document_id").alias("id"))
    return read(spark, d, "contracts").join(docs, "id", "left_semi").select("id", "slug")


@query("SELECT id, ref FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM clause_concepts e WHERE e.clause_id = c.id)")
def untagged_clauses(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "clauses").join(read(spark, d, "clause_concepts").select(F.col("clause_id").alias("id")), "id", "left_anti").select("id", "ref")


_KEYS = ("insurance", "deposit", "termination", "confidential", "arbitration", "franchise")


@query("SELECT k AS keyword, count(*) AS n, count(DISTINCT document_id) AS contracts FROM clauses, (VALUES " + ", ".join(f"('{k}')" for k in _KEYS) + ") t(k) WHERE contains(lower(text), k) GROUP BY 1")
def keyword_clauses(spark: SparkSession, d: str) -> DataFrame:
    hit = F.explode(F.filter(F.array(*[F.lit(k) for k in _KEYS]), lambda k: F.contains(F.lower("text"), k)))
    return read(spark, d, "clauses").select("document_id", hit.alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("contracts"))


@query(
    """WITH s AS (SELECT clause_id, list_sort(list(DISTINCT concept_id)) AS c FROM clause_concepts WHERE concept_id IS NOT NULL AND clause_id IS NOT NULL GROUP BY 1),
  n AS (SELECT c.id, lead(c.id) OVER (PARTITION BY document_id ORDER BY order_index, c.id) AS next_id FROM clauses c WHERE document_id IS NOT NULL)
SELECT n.id, next_id, array_to_string(list_sort(list_intersect(a.c, b.c)), ',') AS shared FROM n JOIN s a ON a.clause_id = n.id JOIN s b ON b.clause_id = next_id WHERE len(list_intersect(a.c, b.c)) > 0"""
)
def shared_with_next(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that a clause shares with the next one of its contract."""
    sets = read(spark, d, "clause_concepts").where("concept_id is not null and clause_id is not null").groupBy(F.col("clause_id").alias("id")).agg(F.array_sort(F.collect_set("concept_id")).alias("c"))
    after = F.lead("id").over(Window.partitionBy("document_id").orderBy("order_index", "id"))
    pairs = read(spark, d, "clauses").where("document_id is not null").select("id", after.alias("next_id")).where("next_id is not null")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("next_id"), F.col("c").alias("c2")), "next_id").withColumn("s", F.array_sort(F.array_intersect("c", "c2")))
    return both.where(F.size("s") > 0).select("id", "next_id", F.array_join("s", ",").alias("shared"))


@query("SELECT o.slug, count(DISTINCT e.clause_id) AS clauses, count(DISTINCT c.document_id) AS contracts FROM clause_concepts e JOIN clauses c ON c.id = e.clause_id JOIN concepts o ON o.id = e.concept_id GROUP BY 1 HAVING count(DISTINCT e.clause_id) >= 2")
def concept_spread(spark: SparkSession, d: str) -> DataFrame:
    """Two hops: concept, clause, contract; only concepts on two clauses or more."""
    edges = read(spark, d, "clause_concepts").select("clause_id", "concept_id").distinct()
    j = edges.join(read(spark, d, "clauses").select(F.col("id").alias("clause_id"), "document_id"), "clause_id")
    n = j.groupBy("concept_id").agg(F.count("*").alias("clauses"), F.countDistinct("document_id").alias("contracts")).where("clauses >= 2")
    return n.join(F.broadcast(read(spark, d, "concepts").select(F.col("id").alias("concept_id"), "slug")), "concept_id").select("slug", "clauses", "contracts")


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sprs_id ORDER BY created_at DESC, id DESC) AS r FROM parliament_items WHERE sprs_id IS NOT NULL) WHERE r = 1"


@query(f"SELECT sprs_id, id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM ({_LATEST})")
def current_items(spark: SparkSession, d: str) -> DataFrame:
    """The last scrape of each item."""
    rows = merge.latest(read(spark, d, "parliament_items"), "sprs_id", "created_at", "id")
    return rows.select("sprs_id", "id", "title", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT count(*) FILTER (first_id = id) AS created, count(*) FILTER (first_id <> id) AS updated FROM (SELECT id, first_value(id) OVER (PARTITION BY sprs_id ORDER BY created_at, id) AS first_id FROM parliament_items WHERE sprs_id IS NOT NULL)")
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "parliament_items").where("sprs_id is not null").groupBy("sprs_id").agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("created"), F.sum(F.col("n") - 1).alias("updated"))


@query(
    f"""WITH l AS ({_LATEST}), o AS (SELECT sprs_id, id, title FROM parliament_items QUALIFY row_number() OVER (PARTITION BY sprs_id ORDER BY created_at, id) = 1 AND sprs_id IS NOT NULL)
SELECT o.sprs_id, o.id, l.title FROM o JOIN l ON l.sprs_id = o.sprs_id"""
)
def upserted_items(spark: SparkSession, d: str) -> DataFrame:
    """The first scrapes with the last ones put in; ids stay."""
    items = read(spark, d, "parliament_items").where("sprs_id is not null")
    first = items.groupBy("sprs_id").agg(F.min_by(F.struct("id", "title"), F.struct("created_at", "id")).alias("_f")).select("sprs_id", "_f.*")
    last = merge.latest(items, "sprs_id", "created_at", "id").select("sprs_id", "id", "title")
    return merge.upsert(first, last, "sprs_id", keep=("id",))


@query(
    f"""SELECT id, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS unique_slug FROM (SELECT id, base, row_number() OVER (PARTITION BY day, base ORDER BY id) AS r
  FROM (SELECT id, {_DAY} AS day, trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(title, '')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM parliament_items))"""
)
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs made unique within a sitting: the first bare, the n-th with -n."""
    i = read(spark, d, "parliament_items").select("id", T.iso_date(F.col("sitting_date")).alias("day"), T.slugify(F.coalesce("title", F.lit("")), 10_000).alias("base"))
    n = F.row_number().over(Window.partitionBy("day", "base").orderBy("id"))
    return i.withColumn("n", n).select("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("unique_slug"))


@query("SELECT id, document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY order_index, id) - 1 AS INTEGER) AS new_index FROM clauses WHERE document_id IS NOT NULL AND trim(text) <> ''")
def renumbered_clauses(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("order_index", "id"))
    return read(spark, d, "clauses").where("document_id is not null and trim(text) <> ''").select("id", "document_id", (n - 1).alias("new_index"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""SELECT document_id, term, n FROM (SELECT document_id, term, count(*) AS n, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, term) AS r
  FROM (SELECT document_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))) AS term FROM clauses WHERE document_id IS NOT NULL) GROUP BY 1, 2) WHERE r <= 5""")
def contract_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent terms of each contract."""
    n = read(spark, d, "clauses").where("document_id is not null").select("document_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("document_id", "term").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "term"))).where("r <= 5").select("document_id", "term", "n")


@query("SELECT id, length(text) AS chars FROM clauses WHERE text IS NOT NULL ORDER BY chars DESC, id LIMIT 10")
def longest_clauses(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "clauses").where("text is not null").select("id", F.length("text").alias("chars")).orderBy(F.desc("chars"), "id").limit(10)


@query("SELECT ref, arg_min(text, id) AS first_text, arg_max(text, id) AS last_text, count(*) AS n FROM clauses WHERE text IS NOT NULL AND ref IS NOT NULL GROUP BY ref HAVING count(*) > 1")
def reingested_clauses(spark: SparkSession, d: str) -> DataFrame:
    """First and last text of clauses that came in more than once."""
    rows = read(spark, d, "clauses").where("text is not null and ref is not null").groupBy("ref").agg(F.min_by("text", "id").alias("first_text"), F.max_by("text", "id").alias("last_text"), F.count("*").alias("n"))
    return rows.where("n > 1")


@query()
def clause_redlines(spark: SparkSession, d: str) -> DataFrame:
    """How the last text of a re-ingested clause differs from its first."""
    pairs = reingested_clauses(spark, d)
    return pairs.select("ref", F.posexplode(redline(F.col("first_text"), F.col("last_text"))).alias("step", "o")).select("ref", "step", "o.op", "o.text")


@query("SELECT doc_slug, trim(text) AS text FROM blocks WHERE kind = 'heading' AND trim(text) <> '' AND doc_slug IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_headings(spark: SparkSession, d: str) -> DataFrame:
    return segment.noisy_headings(read(spark, d, "blocks").where("doc_slug is not null"))


@query("SELECT doc_slug, section, count(*) AS n_blocks, sum(length(text)) AS n_chars FROM (SELECT doc_slug, text, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_slug ORDER BY pos, id ROWS UNBOUNDED PRECEDING) AS section FROM blocks WHERE doc_slug IS NOT NULL AND trim(text) <> '') GROUP BY 1, 2")
def block_sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.running_sections(read(spark, d, "blocks"))


@query()
def segmented_clauses(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(read(spark, d, "blocks"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no line names."""
    return merge.orphans(read(spark, d, "orders"), read(spark, d, "lineitem").select("l_orderkey"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT id, slug FROM concepts WHERE id NOT IN (SELECT concept_id FROM clause_concepts WHERE concept_id IS NOT NULL)")
def orphan_concepts(spark: SparkSession, d: str) -> DataFrame:
    return merge.orphans(read(spark, d, "concepts"), read(spark, d, "clause_concepts").select("concept_id")).select("id", "slug")


_LABEL = "CASE WHEN coalesce(trim(number), '') <> '' OR coalesce(trim(heading), '') <> '' THEN concat_ws(' ', nullif(trim(number), ''), nullif(trim(heading), '')) ELSE coalesce(anchor, 'Clause') END"


_NODES = f"""SELECT id, r.type AS type, r.label AS label, r.sector AS sector, r.document AS document, r.sitting_date AS sitting_date FROM (SELECT id, arg_max({{'type': type, 'label': label, 'sector': sector, 'document': document, 'sitting_date': sitting_date}}, (own, pos)) AS r FROM (
  SELECT 'document:' || slug AS id, 'document' AS type, coalesce(title, slug) AS label, coalesce(sector, '') AS sector, NULL AS document, NULL AS sitting_date, title IS NOT NULL AS own, id AS pos FROM contracts
  UNION ALL SELECT 'clause:' || ref, 'clause', {_LABEL}, NULL, string_split(ref, '#')[1], NULL, true, id FROM clauses WHERE ref IS NOT NULL
  UNION ALL SELECT 'concept:' || slug, 'concept', coalesce(name, slug), NULL, NULL, NULL, name IS NOT NULL, id FROM concepts
  UNION ALL SELECT 'parliament:' || coalesce({_DAY}, '') || '-' || slug, 'parliament_item', coalesce(title, slug), NULL, NULL, {_DAY}, title IS NOT NULL, id FROM parliament_items WHERE slug IS NOT NULL) GROUP BY id)"""


@query(_NODES)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(*[read(spark, d, x) for x in ("contracts", "clauses", "concepts", "parliament_items")])


_EDGES = """SELECT 'document:' || slug AS source, 'clause:' || ref AS target, 'contains' AS type FROM clauses JOIN contracts ON contracts.id = document_id WHERE ref IS NOT NULL
UNION ALL SELECT 'clause:' || ref, 'concept:' || o.slug, 'tagged' FROM clause_concepts e JOIN clauses c ON c.id = e.clause_id JOIN concepts o ON o.id = e.concept_id WHERE ref IS NOT NULL"""


@query(_EDGES)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(*[read(spark, d, x) for x in ("contracts", "clauses", "concepts", "clause_concepts")])


_NAMED = """SELECT i.doc_id, slug FROM documents i JOIN (SELECT slug, '(?i)\\b' || array_to_string(w, '\\W+') || 's?\\b' AS pattern FROM (SELECT slug, regexp_extract_all(lower(name), '[a-z]+') AS w FROM concepts) WHERE len(w) > 1 OR (len(w) = 1 AND length(w[1]) >= 6)) n
  ON regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, ''), pattern) WHERE slug IN (SELECT o.slug FROM clause_concepts e JOIN concepts o ON o.id = e.concept_id GROUP BY 1 HAVING count(DISTINCT clause_id) >= 2)"""
_MENTIONS = f"SELECT DISTINCT 'text:' || doc_id AS source, 'concept:' || slug AS target, 'mentions' AS type FROM ({_NAMED})"


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    """(item, slug): concepts that the documents of the corpus name."""
    concepts, tags = read(spark, d, "concepts"), retrieve.clause_tags(read(spark, d, "clause_concepts"), read(spark, d, "concepts"))
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body_text"))
    return retrieve.item_tags(texts, concepts, tags, retrieve.Settings()).select(F.concat(F.lit("text:"), F.col("item_id").cast("string")).alias("item"), "slug")


@query(_MENTIONS)
def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from texts to the concepts they name."""
    none = [read(spark, d, x).limit(0) for x in ("contracts", "clauses", "concepts", "clause_concepts")]
    return graph.edges(*none, _mentioned(spark, d))


@query(f"SELECT concept, count(DISTINCT ref) AS clauses, count(DISTINCT item) AS texts FROM (SELECT target AS concept, source AS item FROM ({_MENTIONS})) m JOIN (SELECT target, source AS ref FROM ({_EDGES}) WHERE type = 'tagged') t ON t.target = m.concept GROUP BY 1")
def texts_to_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Two hops over the graph, from texts by the concepts they name to the clauses tagged with them, counted by concept."""
    e = graph_edges(spark, d).where("type = 'tagged'").groupBy(F.col("target").alias("concept")).agg(F.countDistinct("source").alias("clauses"))
    m = mention_edges(spark, d).groupBy(F.col("target").alias("concept")).agg(F.countDistinct("source").alias("texts"))
    return e.join(m, "concept").select("concept", "clauses", "texts")


@query(f"""SELECT 'node' AS kind, id AS key, '{{"id":' || to_json(id) || ',"type":' || to_json(type) || ',"label":' || to_json(label) || coalesce(',"sector":' || to_json(sector), '') || coalesce(',"document":' || to_json(document), '') || coalesce(',"sitting_date":' || to_json(sitting_date), '') || '}}' AS line FROM ({_NODES})
UNION ALL SELECT 'edge', source || '|' || target || '|' || type, '{{"source":' || to_json(source) || ',"target":' || to_json(target) || ',"type":' || to_json(type) || '}}' FROM ({_EDGES})""")
def graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the graph file."""
    return graph.graph_lines(graph_nodes(spark, d), graph_edges(spark, d))


_ONCE, _AGAIN = (f"(SELECT * FROM clauses WHERE ref IS NOT NULL AND trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY ref ORDER BY id {x}) = 1)" for x in ("", "DESC"))
_LAST = "(SELECT * FROM (SELECT * FROM clauses WHERE ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY id DESC) = 1) WHERE trim(coalesce(text, '')) <> '')"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the clauses as they first came in with a text, the clauses as they came in last and still have one), by ref."""
    c = read(spark, d, "clauses").where("ref is not null").select("ref", "id", "document_id", "number", "heading", "text")
    first = c.where("trim(coalesce(text, '')) <> ''").groupBy("ref").agg(F.min_by(F.struct("id", "document_id", "number", "heading", "text"), "id").alias("r")).select("ref", "r.*")
    last = merge.latest(c, "ref", "id").where("trim(coalesce(text, '')) <> ''")
    return first, last.select(*first.columns)


@query(f"""SELECT coalesce(o.ref, n.ref) AS ref, CASE WHEN o.ref IS NULL THEN 'insert' WHEN n.ref IS NULL THEN 'delete' WHEN o.text IS NOT DISTINCT FROM n.text AND o.heading IS NOT DISTINCT FROM n.heading AND o.number IS NOT DISTINCT FROM n.number THEN 'keep' ELSE 'update' END AS action
FROM (SELECT * FROM {_ONCE} WHERE document_id IN (SELECT document_id FROM {_LAST})) o FULL JOIN {_LAST} n ON o.ref = n.ref""")
def clause_merge(spark: SparkSession, d: str) -> DataFrame:
    """What the last ingest of every contract does to the clauses of the first, by ref."""
    return merge.merge_actions(*_versions(spark, d), "ref", "document_id", ("number", "heading", "text"))


@query(f"""SELECT n.ref, coalesce(o.id, n.id) AS id, n.document_id, n.heading, n.text FROM {_LAST} n LEFT JOIN (SELECT * FROM {_ONCE} WHERE document_id IN (SELECT document_id FROM {_LAST})) o ON o.ref = n.ref
UNION ALL SELECT ref, id, document_id, heading, text FROM {_ONCE} WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM {_LAST} WHERE document_id IS NOT NULL)""")
def merged_clauses(spark: SparkSession, d: str) -> DataFrame:
    """The clauses after that ingest; ids of known refs stay."""
    return merge.merged(*_versions(spark, d), "ref", "document_id", keep=("id",)).select("ref", "id", "document_id", "heading", "text")


@query(f"""WITH old AS (SELECT DISTINCT c.document_id, e.clause_id, e.concept_id FROM clause_concepts e JOIN clauses c ON c.id = e.clause_id WHERE e.concept_id IS NOT NULL AND c.document_id IS NOT NULL),
again AS (SELECT document_id FROM clauses WHERE ref IS NOT NULL AND document_id IS NOT NULL GROUP BY 1 HAVING count(*) > count(DISTINCT ref)),
new AS (SELECT o.* FROM old o WHERE document_id IN (FROM again) AND clause_id IN (SELECT id FROM {_AGAIN}))
SELECT * FROM old WHERE document_id NOT IN (FROM again) UNION ALL SELECT * FROM new""")
def replaced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Concept edges after those of contracts that came in more than once are replaced by the edges of their last clauses."""
    c = read(spark, d, "clauses").where("document_id is not null")
    e = read(spark, d, "clause_concepts").where("concept_id is not null").select("clause_id", "concept_id").distinct()
    old = e.join(c.select(F.col("id").alias("clause_id"), "document_id"), "clause_id").select("document_id", "clause_id", "concept_id")
    again = c.where("ref is not null").groupBy("document_id").agg(F.count("*").alias("n"), F.countDistinct("ref").alias("refs")).where("n > refs")
    last = merge.latest(read(spark, d, "clauses").where("trim(coalesce(text, '')) <> ''").select("ref", "id"), "ref", "id").select(F.col("id").alias("clause_id"))
    return merge.replace_children(old, old.join(last, "clause_id", "left_semi"), again, "document_id").select("document_id", "clause_id", "concept_id")


def _keyword_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "clauses").where("document_id is not null")
    e = read(spark, d, "clause_concepts").where("concept_id is not null").select(F.col("clause_id").alias("id"), "concept_id").distinct()
    old = c.join(e, "id").select("document_id", F.col("concept_id").cast("string").alias("label")).distinct()
    new = c.select("document_id", F.explode(F.filter(F.array(*[F.lit(k) for k in _KEYS]), lambda k: F.contains(F.lower("text"), k))).alias("label")).distinct()
    return old, new


_LABELS = f"""WITH old AS (SELECT DISTINCT document_id, concept_id::VARCHAR AS label FROM clause_concepts e JOIN clauses c ON c.id = e.clause_id WHERE concept_id IS NOT NULL AND document_id IS NOT NULL),
new AS (SELECT DISTINCT document_id, k AS label FROM clauses, (VALUES {', '.join(f"('{k}')" for k in _KEYS)}) t(k) WHERE contains(lower(text), k) AND document_id IS NOT NULL)"""


@query(_LABELS + " SELECT * FROM old UNION ALL SELECT * FROM new WHERE document_id NOT IN (SELECT document_id FROM old)")
def labels_kept(spark: SparkSession, d: str) -> DataFrame:
    """Labels of contracts after a run by keywords that leaves labelled contracts as they are."""
    return merge.keep_unless_forced(*_keyword_labels(spark, d), "document_id")


@query(_LABELS + " SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new")
def labels_forced(spark: SparkSession, d: str) -> DataFrame:
    """The same run when it is forced."""
    return merge.keep_unless_forced(*_keyword_labels(spark, d), "document_id", force=True)


_LOG = "(SELECT user_id, seq, before, after FROM (SELECT user_id, event_id AS seq, lag(event_type) OVER w AS before, event_type AS after, row_number() OVER w AS n FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 1 AND before IS DISTINCT FROM after)"


@query(f"SELECT * FROM {_LOG}")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of changes from one kind of event of a user to another."""
    return merge.change_log(read(spark, d, "events"), "user_id", "event_type", "event_id")


@query(f"SELECT user_id, arg_max(after, seq) AS value, count(*) AS changes FROM {_LOG} GROUP BY 1")
def log_replayed(spark: SparkSession, d: str) -> DataFrame:
    """What the log says that each user did last."""
    return merge.replayed(change_log(spark, d), "user_id")


@query(f"SELECT user_id, arg_min(before, seq) AS value FROM {_LOG} WHERE after <> 'error' GROUP BY 1")
def log_rewound(spark: SparkSession, d: str) -> DataFrame:
    """What each user did before the first change that was no error."""
    return merge.rewound(change_log(spark, d), "user_id", F.col("after") != "error")


@query(f"SELECT user_id, after AS event_type, min(greatest(v - 1, 1)) AS version FROM (SELECT user_id, after, row_number() OVER (PARTITION BY user_id ORDER BY seq) + 1 AS v FROM {_LOG}) GROUP BY 1, 2")
def versions_rewound(spark: SparkSession, d: str) -> DataFrame:
    """The version that each user and kind of event goes back to: the least version that such a change was made from, 1 at least."""
    log = change_log(spark, d).withColumn("v", F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) + 1)
    return log.groupBy("user_id", F.col("after").alias("event_type")).agg(F.min(F.greatest(F.col("v") - 1, F.lit(1))).alias("version"))


@query("SELECT category, count(r.doc_id) AS n, count(r.doc_id) FILTER (flagged = 1) AS flagged FROM (VALUES ('abuse'), ('hate'), ('sexual'), ('spam')) v(category) LEFT JOIN review_labels r USING (category) GROUP BY 1")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts for a fixed vocabulary, zero where nothing is found."""
    words = spark.createDataFrame([("abuse",), ("hate",), ("sexual",), ("spam",)], "category string")
    n = read(spark, d, "review_labels").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("flagged") == 1).alias("flagged"))
    return words.join(n, "category", "left").na.fill(0)


@query("SELECT CASE WHEN CAST(collected_at AS DATE) >= DATE '2025-06-01' THEN 'today' WHEN CAST(collected_at AS DATE) >= DATE '2025-01-01' THEN 'recent' ELSE 'earlier' END AS bucket, count(*) AS n FROM documents WHERE collected_at IS NOT NULL GROUP BY 1")
def date_buckets(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("collected_at")
    bucket = F.when(day >= F.lit("2025-06-01").cast("date"), "today").when(day >= F.lit("2025-01-01").cast("date"), "recent").otherwise("earlier")
    return read(spark, d, "documents").where("collected_at is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT substr(matter_ref, 4, 4) AS year, CAST(substr(matter_ref, 9) AS BIGINT) AS n FROM documents WHERE regexp_full_match(matter_ref, 'CC-\\d{4}-\\d{4}')),
c AS (SELECT year, count(*) + 1 AS start FROM u GROUP BY 1), k AS (SELECT year, start AS n FROM c UNION SELECT u.year, u.n + 1 FROM u JOIN c ON c.year = u.year AND u.n >= c.start)
SELECT year, min(n) AS next_number FROM k WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.year = k.year AND u.n = k.n) GROUP BY 1""")
def next_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The next free number of each year: the count of used ones plus one, or the first gap behind it."""
    used = read(spark, d, "documents").where(F.col("matter_ref").rlike(r"^CC-\d{4}-\d{4}$")).select(F.substring("matter_ref", 4, 4).alias("year"), F.substring("matter_ref", 9, 4).cast("long").alias("n")).distinct()
    start = used.groupBy("year").agg((F.count("*") + 1).alias("start"))
    free = start.select("year", F.col("start").alias("n")).union(used.join(start, "year").where("n >= start").select("year", F.col("n") + 1)).distinct()
    return free.join(used, ["year", "n"], "left_anti").groupBy("year").agg(F.min("n").alias("next_number"))


@query("SELECT clause_id, array_to_string(list_slice(s, 1, 4), ',') AS shown, greatest(len(s) - 4, 0) AS more FROM (SELECT clause_id, list_sort(list(DISTINCT concept_id)) AS s FROM clause_concepts WHERE clause_id IS NOT NULL AND concept_id IS NOT NULL GROUP BY 1)")
def tags_with_overflow(spark: SparkSession, d: str) -> DataFrame:
    """The first four concepts of a clause and how many more there are."""
    s = read(spark, d, "clause_concepts").where("clause_id is not null and concept_id is not null").groupBy("clause_id").agg(F.array_sort(F.collect_set("concept_id")).alias("s"))
    return s.select("clause_id", F.array_join(F.slice("s", 1, 4), ",").alias("shown"), F.greatest(F.size("s") - 4, F.lit(0)).alias("more"))


@query("(SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40) EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def part_sets(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference of sets of keys."""
    line = read(spark, d, "lineitem")
    both = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")).intersect(line.where("l_quantity > 40").select("l_partkey"))
    return both.subtract(read(spark, d, "part").where("p_size > 25").select("p_partkey"))


QUERIES = Q
