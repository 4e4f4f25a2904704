"""Blocks of a document folded into clauses.

Every block is sorted into a kind by Spark's own functions. Which of the labels (a), (b), (i), (ii) go on with an
enumeration depends on those taken before, so the rows are sorted by document and position and a stream of them passes a
small counter, one document after the other. All else are windows: a running sum over the starts numbers the sections, the
first row of a stretch between numbered headings names the parent of its labels, and sections without a body fall into the
island of the next one that has a body.

Repeated headings (three times or more in a document) are page furniture and start nothing. Null and blank blocks are
skipped; blocks without document give no clause; ties in position are taken by id; headings behind the last body are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Roman numbers that count as labels: fixed values.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
REPEATED = 3
#: A label in brackets at the start of a block, of at most four letters: fixed value.
LABEL = r"(?is)^\(([a-z]{1,4})\)\s*(.*)$"
NONE = -9


def ordinals(label: Column) -> tuple[Column, Column]:
    """A label's place in each of the two numberings, NONE where it has none: (b) is the second letter, (ii) the second Roman number."""
    letter = F.when(F.length(label) == 1, F.ascii(label) - F.ascii(F.lit("a")) + 1).otherwise(NONE)
    place = F.array_position(F.array(*[F.lit(x) for x in ROMAN]), label).cast("int")
    return letter, F.when(place > 0, place).otherwise(NONE)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows whether their label is the next one in either numbering since the last heading."""
    doc, last = None, (0, 0)
    for batch in batches:
        taken = []
        for slug, start, letter, roman in zip(*(batch.column(c).to_pylist() for c in ("doc_slug", "resets", "letter", "roman"))):
            if slug != doc:
                doc, last = slug, (0, 0)
            fits = letter is not None and (letter == last[0] + 1 or roman == last[1] + 1)
            if fits or start:
                last = (letter, roman) if fits else (0, 0)
            taken.append(fits)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], [*batch.schema.names, "taken"])


def noisy_headings(blocks: DataFrame) -> DataFrame:
    """(doc_slug, text): headings that repeat like page furniture."""
    heads = blocks.where("kind = 'heading'").select("doc_slug", F.trim("text").alias("text")).where("text <> ''")
    return heads.groupBy("doc_slug", "text").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED).select("doc_slug", "text")


def numbered(clauses: DataFrame, key: str, base: str, order: str, name: str) -> DataFrame:
    """Unique names: the first bearer keeps the bare one, the n-th gets -n; taken names are passed over by a second suffix."""
    n = F.row_number().over(Window.partitionBy(key, base).orderBy(order))
    named = clauses.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
    again = F.row_number().over(Window.partitionBy(key, name).orderBy(order))
    return named.withColumn(name, F.when(again == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-x"), again.cast("string"))))


def _kinds(blocks: DataFrame) -> DataFrame:
    """Blocks in order (_at) with what they may start: numbered and plain headings, and labels that go on an enumeration."""
    b = blocks.where("doc_slug is not null").select("id", "doc_slug", "pos", "kind", F.trim("text").alias("text")).where("text <> ''")
    b = b.join(noisy_headings(b).withColumn("noisy", F.lit(True)), ["doc_slug", "text"], "left")
    head, n = (F.col("kind") == "heading") & F.col("noisy").isNull(), T.clause_number(F.col("text"))
    b = b.select("doc_slug", "pos", "id", "text", F.coalesce(head, F.lit(False)).alias("head"), n.alias("n"), F.lower(F.regexp_extract("text", LABEL, 1)).alias("label"))
    # a number in running prose starts nothing
    titled = (F.col("n.rest") == "") | F.substring("n.rest", 1, 1).rlike(r"\p{Lu}")
    b = b.withColumn("numbered", F.col("n").isNotNull() & (F.col("head") | titled))
    b = b.withColumn("resets", F.col("numbered") | F.col("head"))
    labelled, (letter, roman) = (F.col("label") != "") & ~F.col("numbered"), ordinals(F.col("label"))
    rows = b.select("doc_slug", "pos", "id", "text", "head", "numbered", "resets", F.col("n.number").alias("number"), F.col("n.anchor").alias("anchor"), F.col("n.rest").alias("rest"), F.when(labelled, F.col("label")).alias("label"), F.when(labelled, letter).alias("letter"), F.when(labelled, roman).alias("roman"))
    rows = rows.repartition("doc_slug").sortWithinPartitions("doc_slug", "pos", "id")
    return rows.mapInArrow(_taken, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", taken boolean")


def segment(blocks: DataFrame) -> DataFrame:
    """(doc_slug, anchor, ref, number, heading, text, order_index) of blocks (id, doc_slug, pos, kind, text)."""
    b = _kinds(blocks)
    # a heading with a label that goes on no enumeration is a plain heading
    plain = F.col("head") & ~F.col("numbered") & ~F.col("taken")
    upto = Window.partitionBy("doc_slug").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("section", F.count_if(F.col("numbered") | plain | F.col("taken")).over(upto)).withColumn("stretch", F.count_if(F.col("numbered") | plain).over(upto))
    first = Window.partitionBy("doc_slug", "stretch").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)
    parent = lambda c: F.first(F.when(F.col("numbered"), F.col(c))).over(first)
    b = b.withColumn("_number", parent("number")).withColumn("_anchor", parent("anchor"))
    inner = F.trim(F.regexp_extract("text", LABEL, 2))
    short = T.is_sub_heading(inner)
    number = F.when(F.col("numbered"), F.col("number")).when(F.col("taken"), F.concat(F.coalesce("_number", F.lit("")), F.lit("("), "label", F.lit(")")))
    anchor = F.when(F.col("numbered"), F.col("anchor")).when(F.col("taken"), F.concat("_anchor", F.lit("-"), "label"))
    heading = F.when(F.col("numbered"), F.col("rest")).when(F.col("taken"), F.when(short, inner)).when(plain, F.col("text"))
    body = F.when(F.col("taken"), F.when(~short, inner)).when(~(F.col("numbered") | plain), F.col("text"))
    lines = b.select("doc_slug", "section", "pos", "id", (F.col("numbered") | plain | F.col("taken")).alias("_starts"), F.coalesce(number, F.lit("")).alias("number"), anchor.alias("anchor_base"), F.coalesce(heading, F.lit("")).alias("heading"), body.alias("body"))
    opened = F.max(F.when(F.col("_starts"), F.struct("number", "anchor_base", "heading")))
    words = F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("pos", "id", "body")))), lambda x: x.getField("body"))
    c = lines.groupBy("doc_slug", "section").agg(opened.alias("_o"), T.collapse_whitespace(F.array_join(words, " ")).alias("body"))
    c = c.select("doc_slug", "section", F.coalesce("_o.number", F.lit("")).alias("number"), F.col("_o.anchor_base").alias("anchor_base"), F.coalesce("_o.heading", F.lit("")).alias("heading"), "body")
    return _carried(c)


def _carried(c: DataFrame) -> DataFrame:
    """Sections (doc_slug, section, number, heading, anchor_base, body) as clauses: those without a body go before the next body."""
    before = Window.partitionBy("doc_slug").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("order_index", F.coalesce(F.count_if(F.col("body") != "").over(before), F.lit(0)).cast("int"))
    name = F.when(F.col("body") == "", F.coalesce(F.nullif("heading", F.lit("")), F.nullif("number", F.lit(""))))
    waiting = F.array_sort(F.collect_list(F.when(name.isNotNull(), F.struct("section", name.alias("name")))))
    held = F.max(F.when(F.col("body") != "", F.struct("number", "heading", "anchor_base", "body")))
    c = c.groupBy("doc_slug", "order_index").agg(held.alias("_h"), F.transform(waiting, lambda x: x.getField("name")).alias("_names")).where("_h is not null")
    c = c.select("doc_slug", "_h.number", "_h.heading", "_h.anchor_base", T.collapse_whitespace(F.array_join(F.concat("_names", F.array("_h.body")), ". ")).alias("text"), "order_index")
    named = F.coalesce("anchor_base", F.nullif(T.slugify(F.col("heading"), 40), F.lit("")), F.concat(F.lit("s"), F.col("order_index").cast("string")))
    c = numbered(c.withColumn("_base", named), "doc_slug", "_base", "order_index", "anchor")
    return c.select("doc_slug", "anchor", F.concat_ws("#", "doc_slug", "anchor").alias("ref"), "number", "heading", "text", "order_index")


def table_row_blocks(cells: Column) -> Column:
    """Blocks of a table row: merged cells once, a short first cell as heading, else one paragraph of all cells."""
    kept = F.array_distinct(F.filter(F.transform(cells, T.collapse_whitespace), lambda c: c != ""))
    first = F.get(kept, F.lit(0))
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    paired = F.array(block("heading", first), block("paragraph", F.array_join(F.slice(kept, 2, 1_000), " ")))
    none = F.expr("cast(array() as array<struct<kind:string,text:string>>)")
    return F.when(F.size(kept) == 0, none).when((F.size(kept) >= 2) & (F.length(first) <= 60), paired).otherwise(F.array(block("paragraph", F.array_join(kept, " | "))))


def running_sections(blocks: DataFrame) -> DataFrame:
    """(doc_slug, section, n_blocks, n_chars): the part of the fold that a window can do, a new section at each heading."""
    w = Window.partitionBy("doc_slug").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.where("doc_slug is not null and trim(text) <> ''").withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(w))
    return b.groupBy("doc_slug", "section").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
