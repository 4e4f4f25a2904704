"""Labels and verdicts by rule: keyword concepts, a judge that needs no model, and the coercion of what a model answers.

Everything is a column or a join, so a table of any size is labelled without leaving Spark. Model answers come as JSON text
(sources/inbox.ask) and are mapped onto what was asked by ``coerced``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import retrieve, rollup

#: Concepts and what a text in lower case holds if it is about them, in order: fixed values.
KEYWORDS = {
    "Notice Period": ("notice period", "days' notice", "days notice", "written notice"),
    "Termination": ("terminate", "termination"),
    "Confidentiality": ("confidential", "non-disclosure", "nda"),
    "Indemnity": ("indemnif",),
    "Payment Terms": ("payment terms", "invoice", "payable", "due within"),
    "Governing Law": ("governing law", "governed by the laws", "jurisdiction"),
    "Force Majeure": ("force majeure", "act of god"),
    "Assignment": ("assign",),
    "Dispute Resolution": ("dispute", "arbitration", "mediation"),
    "Personal Data": ("personal data", "pdpa", "data protection"),
    "Warranties": ("warrant",),
    "Subletting": ("sublet", "sub-let", "sub-letting"),
    "Rent Review": ("rent review", "revised rent", "review the rent"),
    "Insurance": ("insurance", "insured", "insurer"),
    "Liability Cap": ("liability cap", "limitation of liability", "cap on liability"),
    "Tenure": ("tenure", "lease term", "term of this lease", "term of this agreement"),
    "Exclusivity": ("exclusivity", "exclusive right", "sole and exclusive"),
    "Conditions Precedent": ("condition precedent", "conditions precedent"),
    "Renewal": ("renew", "renewal", "option to renew"),
}
#: The names a tagger may give: fixed values.
VOCABULARY = (
    "Acceptance Of Offer", "Additional Services", "Appointment", "Arbitration", "Assignment", "Commencement", "Completion", "Completion Date", "Compulsory Acquisition", "Condition Of Property",
    "Conditions Precedent", "Confidentiality", "Conflict Of Interest", "Costs And Expenses", "Damages", "Default", "Defects Liability", "Definitions", "Delay", "Deposit", "Dispute Resolution",
    "Encumbrances", "Exclusivity", "Extension Of Time", "Force Majeure", "Forfeiture Of Deposit", "Goods And Services Tax", "Governing Law", "Indemnity", "Insolvency", "Insurance",
    "Intellectual Property", "Interpretation", "Joint And Several Liability", "Jurisdiction", "Licence", "Limitation Of Liability", "Mediation", "Notice Period", "Notices", "Parties",
    "Payment Terms", "Permitted Use", "Personal Data", "Purchase Price", "Refund Of Deposit", "Regulatory Compliance", "Remuneration", "Renewal", "Rent", "Rent Review", "Requisitions",
    "Rescission", "Scope Of Services", "Standard Of Care", "Statutory Compliance", "Subletting", "Survival Of Terms", "Tenancy", "Term", "Termination", "Third Party Rights", "Title",
    "Vacant Possession", "Variation", "Waiver", "Warranties",
)
#: Severities from the least to the greatest, and kinds of legislation: fixed values.
SEVERITIES = ("low", "medium", "high")
LEGISLATION = ("amendment", "new_legislation")


def keyword_concepts(text: Column) -> Column:
    """array<string>: the concepts whose keywords a text holds, in the order of the table; null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = []
    for name, words in KEYWORDS.items():
        any_of = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            any_of = any_of | F.contains(low, F.lit(w))
        held.append(F.when(any_of, F.lit(name)))
    return F.array_compact(F.array(*held))


def tags_of_answer(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(document_id, anchor, name): what a model tagged, one answer a document.

    asked: (document_id, anchor); answers: (document_id, answer), JSON of anchors to names. Anchors that weren't asked for are
    dropped; names are put into title case, those that aren't in the vocabulary are kept as new ones, repeated ones count once; a
    document without a readable answer gets no tags.
    """
    per = answers.select("document_id", F.explode(F.from_json("answer", "map<string, array<string>>")).alias("anchor", "names"))
    named = per.select("document_id", "anchor", F.explode("names").alias("name")).select("document_id", "anchor", T.title_case(F.col("name")).alias("name")).where("name <> ''")
    return named.join(asked.select("document_id", "anchor").distinct(), ["document_id", "anchor"], "left_semi").distinct()


def said_legislation(text: Column) -> Column:
    """The kind of legislation that keywords tell, null if they tell none."""
    low = F.lower(text)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.when(has("amend"), "amendment").when(has("new act", "introduces", "framework"), "new_legislation")


def judged(pairs: DataFrame) -> DataFrame:
    """Verdicts by rule on pairs (item_id, item_text, ref, text): what a clause shares with an item decides.

    impacted: they share a concept; severity: high if a short period was rewritten, a period is set or two concepts are shared, else
    medium, low where not impacted; suggested_text: the rewritten clause where impacted.
    """
    return judged_by(pairs.select("item_id", "ref", "text", *said(F.col("item_text"))))


def said(item_text: Column) -> tuple[Column, Column]:
    """What counts of an item's text: its concepts and the kind of legislation."""
    return keyword_concepts(item_text).alias("own"), said_legislation(item_text).alias("legislation_type")


def judged_by(pairs: DataFrame) -> DataFrame:
    """judged, of pairs (item_id, ref, text, own, legislation_type) with what the text of the item said."""
    shared = F.array_intersect(keyword_concepts(F.col("text")), "own")
    p = pairs.select("item_id", "ref", shared.alias("shared"), T.rewrite_periods(F.col("text")).alias("r"), T.has_period(F.col("text")).alias("set"), "legislation_type")
    hit = F.size("shared") > 0
    severity = F.when(~hit, "low").when(F.col("r.changed") | F.col("set") | (F.size("shared") >= 2), "high").otherwise("medium")
    return p.select("item_id", "ref", hit.alias("impacted"), severity.alias("severity"), F.array_join("shared", ", ").alias("shared"), F.when(hit, F.col("r.text")).alias("suggested_text"), "legislation_type")


_ENTRY = "struct<clause_ref:string, impacted:boolean, severity:string, rationale:string, suggested_text:string, edits:array<struct<find:string, replace:string>>>"


def coerced(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """A model's answers put onto what it was asked, one row for each that was asked.

    asked: (item_id, ref, text); answers: (item_id, answer), JSON with legislation_type and assessments. Of several for a clause
    the first counts, one for an unknown clause is dropped, a missing one counts as not impacted; an unknown severity is low, an
    unknown kind of legislation null; edits are applied where no text is suggested. An item without a readable answer gives no
    rows, so that it is asked again.
    """
    read = answers.select("item_id", F.from_json("answer", f"legislation_type string, assessments array<{_ENTRY}>").alias("a")).where("a.assessments is not null")
    said = read.select("item_id", rollup.within(F.col("a.legislation_type"), LEGISLATION).alias("legislation_type"))
    entries = read.select("item_id", F.posexplode("a.assessments").alias("pos", "e")).where("e.clause_ref is not null")
    first = entries.groupBy("item_id", F.col("e.clause_ref").alias("ref")).agg(F.min_by("e", "pos").alias("e"))
    out = asked.join(said, "item_id").join(first, ["item_id", "ref"], "left")
    suggested = F.coalesce(F.nullif("e.suggested_text", F.lit("")), T.apply_edits(F.col("text"), F.col("e.edits")), F.lit(""))
    return out.select(
        "item_id", "ref", F.coalesce("e.impacted", F.lit(False)).alias("impacted"), rollup.within(F.col("e.severity"), SEVERITIES, SEVERITIES[0]).alias("severity"),
        F.when(F.col("e").isNull(), "not assessed").otherwise(F.coalesce("e.rationale", F.lit(""))).alias("rationale"), F.when(F.col("e").isNull(), "").otherwise(suggested).alias("suggested_text"), "legislation_type",
    )


#: Characters of an item and of a clause that go into a prompt: fixed values.
ITEM_CHARS, CLAUSE_CHARS = 6_000, 20_000


def prompts(items: DataFrame, ranked: DataFrame, clauses: DataFrame, task: str) -> DataFrame:
    """(item_id, prompt): an item and its candidates in order of rank, behind the words of the task.

    items: (id, title, body_text, summary); ranked: (item_id, rank, clause_id), k rows an item; clauses: (id, ref, number, heading, text).
    """
    c = clauses.select(F.col("id").alias("clause_id"), "ref", F.concat_ws(" ", F.nullif(F.trim("number"), F.lit("")), F.nullif(F.trim("heading"), F.lit(""))).alias("head"), F.substring(F.trim("text"), 1, CLAUSE_CHARS).alias("text"))
    part = F.concat(F.lit("## Candidate clause "), F.coalesce("ref", F.lit("")), F.lit("\nHeading: "), F.when(F.col("head") != "", F.col("head")).otherwise("(none)"), F.lit("\nText:\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    candidates = ranked.select("item_id", "rank", "clause_id").join(retrieve.picked(c, ranked, "clause_id"), "clause_id").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x.getField("part")), "\n").alias("candidates"))
    body = F.substring(F.trim(F.coalesce(F.nullif("body_text", F.lit("")), "summary", F.lit(""))), 1, ITEM_CHARS)
    head = items.select(F.col("id").alias("item_id"), F.concat(F.lit("## Item\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), body, F.lit("\n")).alias("head"))
    return head.join(candidates, "item_id").select("item_id", F.concat_ws("\n", F.lit(task), "head", "candidates").alias("prompt"))
