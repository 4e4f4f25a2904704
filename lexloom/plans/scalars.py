"""Queries on the text functions, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import segment
from lexloom.runtime import read

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def clause_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.tokens("text")
    return read(spark, sf_dir, "clauses").where("text is not null").select("id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def contract_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "contracts")
    title = T.file_title(F.col("source_path"))
    return c.select("id", T.slugify(F.col("title")).alias("title_slug"), title.alias("file_title"), T.slugify(F.col("title"), 20).alias("short_slug"), T.slug_label(F.lower("sector")).alias("sector_label"), T.slug_title(F.col("slug")).alias("slug_title"), T.title_case(F.col("title")).alias("title_case"))


def item_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "parliament_items")
    return i.select(
        "id", T.item_slug(F.col("title")).alias("item_slug"), T.item_slug(F.col("title"), 30).alias("short_slug"), T.summarize(F.col("body_text")).alias("summary"), T.legislation_type(F.col("title"), F.col("body_text")).alias("legislation_type"),
        T.iso_date(F.col("sitting_date")).alias("iso_date"), T.feed_date(T.iso_date(F.col("sitting_date"))).alias("feed_date"),
    )


def topic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetched topics as items; payloads that are no JSON are left out."""
    p = read(spark, sf_dir, "topic_payloads").withColumn("v", F.try_parse_json("payload")).where("v is not null")
    inner = F.coalesce(F.try_parse_json(F.try_variant_get("v", "$.resultHTML", "string")), F.try_variant_get("v", "$.resultHTML", "variant"))
    p = p.withColumn("h", inner)
    content = F.try_variant_get("h", "$.content", "string")
    return p.select(
        "payload_id", T.topic_id(F.col("report_id")).alias("sprs_id"), T.item_type(T.topic_id(F.col("report_id"))).alias("item_type"), T.collapse_whitespace(F.try_variant_get("h", "$.title", "string")).alias("title"),
        T.iso_date(F.try_variant_get("v", "$.sittingDate", "string")).alias("sitting_date"), T.html_to_text(content).alias("body_text"), T.speaker(content).alias("speaker"), T.first_heading(content).alias("first_heading"),
        F.trim(F.element_at(F.split(F.try_variant_get("h", "$.mpNames", "string"), ","), 1)).alias("first_name"),
    )


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, heading and text of each clause as the cells of a table row with merged cells, as blocks."""
    cells = F.array("number", "heading", "heading", F.substring("text", 1, 80))
    blocks = segment.table_row_blocks(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))))
    return read(spark, sf_dir, "clauses").select("id", F.posexplode(blocks).alias("place", "b")).select("id", "place", "b.kind", "b.text")


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the headings that blocks would have as styles."""
    b = read(spark, sf_dir, "blocks")
    style = F.when(F.col("kind") == "heading", F.concat(F.lit("Heading "), F.col("level").cast("string"))).when(F.col("level").isNull(), "Title").otherwise("Body Text")
    return b.select("id", T.style_level(style).alias("depth"))


def noisy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads found again within a noisy text, as far as they are JSON objects."""
    p = read(spark, sf_dir, "topic_payloads").where("payload is not null")
    return p.select("payload_id", T.first_json(F.concat(F.lit("Here it is:\n```json\n"), "payload", F.lit("\n```\nDone."))).isNotNull().alias("found"))


def block_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "blocks").where("text is not null").withColumn("t", F.trim("text"))
    n = T.clause_number(F.col("t"))
    return b.select("id", T.is_fill_line(F.col("t")).alias("is_fill"), T.looks_like_heading(F.col("t")).alias("is_heading"), n.getField("number").alias("number"), n.getField("anchor").alias("anchor"), n.getField("rest").alias("rest"), T.is_sub_heading(F.col("t")).alias("is_sub_heading"))


def clause_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "clauses")
    return c.select("id", T.clause_label(F.col("number"), F.col("heading"), F.col("anchor")).alias("label"), T.yaml_scalar(F.col("heading")).alias("yaml_heading"), T.matching_sentence(F.col("text"), F.lit("consent")).alias("quote"))


def edited_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two literal edits on each clause; empty where one doesn't apply exactly once."""
    edits = F.array(F.struct(F.lit("such consent").alias("find"), F.lit("that consent").alias("replace")), F.struct(F.lit("For the purposes").alias("find"), F.lit("In the sense").alias("replace")))
    return read(spark, sf_dir, "clauses").where("text is not null").select("id", T.apply_edits(F.col("text"), edits).alias("edited"))


def concept_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "concepts").select("slug", T.concept_pattern(F.col("name")).alias("pattern"))


QUERIES = {f.__name__: f for f in (clause_tokens, contract_slugs, item_scalars, topic_text, table_rows, styles, noisy_json, block_scalars, clause_labels, edited_clauses, concept_patterns)}

_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"
_SLUG = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"
_WS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LABEL = "list_aggregate(list_transform(string_split({}, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '-')"


def _cut(full: str, n: int) -> str:
    return f"CASE WHEN length({full}) <= {n} THEN {full} ELSE regexp_replace(CASE WHEN contains({full}[:{n}], '-') THEN regexp_replace({full}[:{n}], '-[^-]*$', '') ELSE {full}[:{n}] END, '-+$', '') END"


_DATE = "strftime(coalesce(CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime({0}, '%Y-%m-%d') END, CASE WHEN regexp_full_match({0}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({0}, '%d-%m-%Y') END), '{1}')"
_FRESH = "'(?is)\\b(new|introduc(?:e|es|ed|ing|tion of))\\b.{0,40}\\b(bill|act|legislation|law|framework|scheme|regime)\\b'"
_SUMMARY = """CASE WHEN length(f) <= 300 THEN f ELSE regexp_replace(CASE WHEN regexp_extract(f[:300], '(?s)^(.+) ', 1) <> '' THEN regexp_extract(f[:300], '(?s)^(.+) ', 1) ELSE f[:300] END, '\\s+$', '') || '...' END"""
_FILL = "(regexp_matches(t, '_{3,}') OR (length(regexp_replace(t, '\\s', '', 'g')) > 0 AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) < 0.3 * length(regexp_replace(t, '\\s', '', 'g'))))"
_SCH = "'(?i)^schedule\\s+(\\d+)\\s*,?\\s*(?:para(?:graph)?\\.?\\s*(\\d+))?'"
_NUM = "'(?i)^(?:clause\\s+)?(\\d+(?:\\.\\d+)*)(\\([a-z0-9]+\\))?[.:)]?\\s*'"
_STRIPPED = "regexp_replace({}, '^[ .:\\-–—]+|[ .:\\-–—]+$', '', 'g')"
_GONE = {"one": "such consent", "two": "For the purposes"}

_PARTS = "list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(coalesce({}, ''), '(?i)</?(p|h[1-6]|li|div|br|tr)([^A-Za-z0-9>][^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), chr(1)), lambda x: trim(regexp_replace(x, '[\\s\\x{{00A0}}]+', ' ', 'g'))), lambda x: x <> '')"
_FLAT = "trim(regexp_replace(replace(regexp_replace(coalesce(content, ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"
_OFFICE = "array_to_string(list_slice(w, 1, coalesce(list_position(list_transform(w, lambda x: regexp_full_match(x, '[A-Z][A-Za-z''\\-]*|for|of|the|and|to|de')), false), len(w) + 1) - 1), ' ')"
_BOLD = "trim(regexp_replace(regexp_replace(" + _WS.format("regexp_replace(regexp_extract(coalesce(content, ''), '(?is)<strong\\b[^>]*>(.*?)</strong>', 1), '<[^>]*>', '', 'g')") + ", ':+$', ''), '\\s*\\([^)]*\\)\\s*$', ''))"

SQL = {
    "topic_text": f"""WITH v AS (SELECT payload_id, rtrim(report_id, '#') AS sprs_id, CAST(payload AS JSON) AS j FROM topic_payloads WHERE json_valid(payload)),
      h AS (SELECT payload_id, sprs_id, j, CASE WHEN json_type(j -> 'resultHTML') = 'VARCHAR' AND json_valid(j ->> 'resultHTML') THEN CAST(j ->> 'resultHTML' AS JSON) ELSE j -> 'resultHTML' END AS h FROM v),
      c AS (SELECT *, h ->> 'content' AS content, regexp_replace(sprs_id, '-\\d+$', '') AS prefix FROM h),
      w AS (SELECT *, string_split(regexp_extract({_FLAT}, '(?i:asked|to ask)\\s+(?i:the)\\s+(.*)', 1), ' ') AS w FROM c)
      SELECT payload_id, sprs_id, CASE prefix WHEN 'oral-answer' THEN 'oral answer' WHEN 'written-answer' THEN 'written answer' WHEN 'written-answer-na' THEN 'written answer (not answered)' ELSE replace(prefix, '-', ' ') END AS item_type,
        {_WS.format("h ->> 'title'")} AS title, {_DATE.format("(j ->> 'sittingDate')", '%Y-%m-%d')} AS sitting_date, array_to_string({_PARTS.format('content')}, chr(10) || chr(10)) AS body_text,
        CASE WHEN {_OFFICE} <> '' THEN {_OFFICE} ELSE {_BOLD} END AS speaker, {_WS.format("regexp_replace(regexp_extract(coalesce(content, ''), '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>', 1), '<[^>]*>', '', 'g')")} AS first_heading,
        trim(string_split(h ->> 'mpNames', ',')[1]) AS first_name FROM w""",
    "table_rows": f"""WITH c AS (SELECT id, list_filter([{', '.join(_WS.format(f"coalesce({x}, '')") for x in ('number', 'heading', 'heading', 'substr(text, 1, 80)'))}], lambda x: x <> '') AS l FROM clauses),
      k AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS k FROM c)
      SELECT id, 0 AS place, 'heading' AS kind, k[1] AS text FROM k WHERE len(k) >= 2 AND length(k[1]) <= 60 UNION ALL SELECT id, 1, 'paragraph', array_to_string(k[2:], ' ') FROM k WHERE len(k) >= 2 AND length(k[1]) <= 60
      UNION ALL SELECT id, 0, 'paragraph', array_to_string(k, ' | ') FROM k WHERE len(k) >= 1 AND NOT (len(k) >= 2 AND length(k[1]) <= 60)""",
    "styles": "SELECT id, CASE WHEN kind = 'heading' THEN level WHEN level IS NULL THEN 1 END AS depth FROM blocks",
    "noisy_json": "SELECT payload_id, regexp_matches(payload, '(?s)^\\s*\\{.*\\}\\s*$') AND json_valid(payload) AS found FROM topic_payloads WHERE payload IS NOT NULL",
    "clause_tokens": f"SELECT id, CAST(len({_TOKENS.format('text')}) AS INTEGER) AS n_tokens, coalesce(list_aggregate({_TOKENS.format('text')}, 'string_agg', ' '), '') AS tokens FROM clauses WHERE text IS NOT NULL",
    "contract_slugs": f"""SELECT id, {_SLUG.format('title')} AS title_slug, {_WS.format("regexp_replace(regexp_replace(regexp_extract(source_path, '[^/]*$'), '\\.[^.]*$', ''), '^\\d+[.\\s]+', '')")} AS file_title,
      regexp_replace(({_SLUG.format('title')})[:20], '-+$', '') AS short_slug,
      array_to_string(list_transform(string_split(lower(sector), '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS sector_label,
      array_to_string(list_transform(string_split(regexp_replace(slug, '^\\d+-', ''), '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS slug_title,
      array_to_string(list_transform(string_split({_WS.format('title')}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title_case FROM contracts""",
    "item_scalars": f"""SELECT id, {_cut('s', 80)} AS item_slug, {_cut('s', 30)} AS short_slug, {_SUMMARY} AS summary,
      CASE WHEN (regexp_matches(t, '(?i)\\bbill\\b') AND NOT regexp_matches(t, '(?i)\\bamendment\\b')) OR regexp_matches(t, {_FRESH}) OR regexp_matches(x, {_FRESH}) THEN 'new_legislation' ELSE 'amendment' END AS legislation_type,
      {_DATE.format('sitting_date', '%Y-%m-%d')} AS iso_date, {_DATE.format('sitting_date', '%d-%m-%Y')} AS feed_date
      FROM (SELECT *, {_SLUG.format('title')} AS s, trim(string_split(coalesce(body_text, ''), chr(10) || chr(10))[1]) AS f, coalesce(title, '') AS t, coalesce(body_text, '') AS x FROM parliament_items)""",
    "block_scalars": f"""SELECT id, {_FILL} AS is_fill,
      length(t) > 0 AND length(t) <= 90 AND NOT {_FILL} AND (regexp_matches(t, '(?i)^(clause\\s+\\d+(\\.\\d+)*|schedule\\s+\\d+|article\\s+\\d+|\\d+(\\.\\d+)*\\.?\\s|\\d+\\([a-z0-9]+\\))')
        OR (length(regexp_replace(t, '\\P{{L}}', '', 'g')) >= 3 AND length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) >= 0.7 * length(regexp_replace(t, '\\P{{L}}', '', 'g')))) AS is_heading,
      CASE WHEN sch <> '' THEN 'Schedule ' || sch || CASE WHEN para <> '' THEN ', para ' || para ELSE '' END WHEN num <> '' THEN num || CASE WHEN paren <> '' THEN '(' || paren || ')' ELSE '' END END AS number,
      CASE WHEN sch <> '' THEN 'sch-' || sch || CASE WHEN para <> '' THEN '-' || para ELSE '' END WHEN num <> '' THEN replace(num, '.', '-') || CASE WHEN paren <> '' THEN '-' || lower(paren) ELSE '' END END AS anchor,
      CASE WHEN sch <> '' THEN {_STRIPPED.format(f"regexp_replace(t, {_SCH}, '')")} WHEN num <> '' THEN {_STRIPPED.format(f"regexp_replace(t, {_NUM}, '')")} END AS rest,
      length(t) > 0 AND length(t) <= 60 AND NOT regexp_matches(t, '[.;,:]$') AS is_sub_heading
      FROM (SELECT *, regexp_extract(t, {_SCH}, 1) AS sch, regexp_extract(t, {_SCH}, 2) AS para, regexp_extract(t, {_NUM}, 1) AS num, regexp_replace(regexp_extract(t, {_NUM}, 2), '[()]', '', 'g') AS paren
        FROM (SELECT id, trim(text) AS t FROM blocks WHERE text IS NOT NULL))""",
    "edited_clauses": f"""SELECT id, CASE WHEN length(text) - length(replace(text, '{_GONE["one"]}', '')) = {len(_GONE["one"])} AND length(text) - length(replace(text, '{_GONE["two"]}', '')) = {len(_GONE["two"])}
      THEN replace(replace(text, '{_GONE["one"]}', 'that consent'), '{_GONE["two"]}', 'In the sense') ELSE '' END AS edited FROM clauses WHERE text IS NOT NULL""",
    "clause_labels": f"""SELECT id, CASE WHEN coalesce(trim(number), '') <> '' OR coalesce(trim(heading), '') <> '' THEN concat_ws(' ', nullif(trim(number), ''), nullif(trim(heading), '')) ELSE coalesce(anchor, 'Clause') END AS label,
      CASE WHEN heading IS NULL THEN 'null' WHEN lower(heading) IN ('null', 'true', 'false', 'yes', 'no', '~', '') OR heading <> trim(heading) OR regexp_matches(heading, '^[-?:,\\[\\]{{}}#&*!|>''"%@`\\s]|\\s$') OR contains(heading, ': ') OR heading LIKE '%:' OR contains(heading, chr(10)) OR contains(heading, '#')
        THEN '"' || replace(replace(heading, '\\', '\\\\'), '"', '\\"') || '"' ELSE heading END AS yaml_heading,
      (list_filter(string_split(regexp_replace({_WS.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'consent'))[1])[:240] AS quote FROM clauses""",
    "concept_patterns": """SELECT slug, CASE WHEN len(w) > 1 OR (len(w) = 1 AND length(w[1]) >= 6) THEN '(?i)\\b' || array_to_string(w, '\\W+') || 's?\\b' END AS pattern FROM (SELECT slug, regexp_extract_all(lower(name), '[a-z]+') AS w FROM concepts)""",
}
