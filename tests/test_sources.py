import json
import zipfile

import pytest

from lexloom.operators.merge import upsert
from lexloom.sources import inbox, markdown
from lexloom.streaming import items as stream
from lexloom.streaming.store import BucketStore


def docx(path, body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def par(text, style=""):
    return f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_inbox(spark, tmp_path):
    (tmp_path / "real estate").mkdir()
    row = "".join(f"<w:tc>{par(x)}</w:tc>" for x in ("Rent", "Rent", "S$5"))
    docx(tmp_path / "real estate" / "01. Lease.DOCX", par("Terms", "Heading2") + par("The tenant  pays.") + f"<w:tbl><w:tr>{row}</w:tr></w:tbl>")
    (tmp_path / "a.html").write_text("<p>One &amp; two</p><p></p>")
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "x.png").write_bytes(b"")
    files = inbox.discover(spark, str(tmp_path))
    assert sorted((r["name"], r["sector"]) for r in files.collect()) == [("01. Lease.DOCX", "real-estate"), ("a.html", "general"), ("bad.docx", "general"), ("old.doc", "general")]
    got = {r["path"].rsplit("/", 1)[1]: r for r in inbox.parse_files(files).collect()}
    lease = next(r for r in got.values() if r["title"] == "Lease")
    assert [tuple(b) for b in lease["blocks"]] == [("heading", "Terms", 2), ("paragraph", "The tenant pays.", 0), ("heading", "Rent", 0), ("paragraph", "S$5", 0)]
    assert [b["text"] for b in got["a.html"]["blocks"]] == ["One & two"]
    assert got["old.doc"]["parse_error"] and got["bad.docx"]["parse_error"] and not got["bad.docx"]["blocks"]


def test_search_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"title": "a", "sittingDate": "5-8-2026", "reportId": "x#"}, {"sittingDate": "4-8-2026"}, {"sittingDate": "5-8-2026"}, {}]))
    hits = inbox.search_pages(spark, str(tmp_path))
    assert [r[0] for r in inbox.sitting_dates(hits).collect()] == ["2026-08-05", "2026-08-04"]
    assert inbox.sitting_dates(hits, last="2026-08-04").count() == 1


def test_models_are_asked_once_and_failures_are_not_kept(spark):
    def answer(prompt):
        if prompt == "boom":
            raise RuntimeError
        return f'sure: {{"n": {len(prompt)}}}' if prompt != "odd" else "no json"

    inbox.PROVIDERS["test"] = answer
    asked = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "boom"), (4, "odd"), (5, None)], "id long, prompt string")
    empty = spark.createDataFrame([], "key string, answer string")
    answers, new = inbox.ask(asked, empty, "test", "m")
    got = {r["id"]: r["answer"] for r in answers.collect()}
    assert got[1] == got[2] == '{"n": 2}' and got[3] is None and got[4] is None
    assert new.count() == 1
    _, again = inbox.ask(asked.where("id < 3"), new, "test", "m")
    assert again.count() == 0
    with pytest.raises(ValueError):
        inbox.ask(asked, empty, "nobody", "m")


def test_documents_round_trip(spark, tmp_path):
    contracts = spark.createDataFrame([(1, "lease-1", "Lease: one", "Real", "in/1. x.pdf", "pdf", 1, None), (2, "bad", "Bad", None, None, "doc", 1, "unreadable")], "id long, slug string, title string, sector string, source_path string, file_type string, version int, parse_error string")
    clauses = spark.createDataFrame([(1, 1, "7-2", "7.2", "Rent", "Pay  it.", 1), (2, 1, "s0", None, " ", "Intro", 0), (3, 1, "x", "", "Tail", None, 2)], "id long, document_id long, anchor string, number string, heading string, text string, order_index int")
    tags = spark.createDataFrame([(1, "rent", "Rent"), (1, "rent", "Rent"), (1, "notice", None)], "clause_id long, slug string, name string")
    pages = markdown.documents(contracts, clauses, tags)
    back = [(r["anchor"], r["number"], r["heading"], r["text"], r["concepts"]) for r in markdown.read_clauses(pages).orderBy("position").collect()]
    assert back == [("s0", "", "Clause", "Intro", []), ("7-2", "7.2", "Rent", "Pay it.", ["notice", "rent"]), ("x", "", "Tail", "", [])]
    text = {r["slug"]: r["markdown"] for r in pages.collect()}
    assert 'title: "Lease: one"' in text["lease-1"] and "concepts: [notice, rent]" in text["lease-1"]
    assert "could not be parsed" in text["bad"] and text["bad"].endswith(".\n")
    assert markdown.write_files(pages, str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "bad.md").read_text() == text["bad"]


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = "id long, sprs_id string, title string, created_at timestamp"
    rows = lambda *r: spark.createDataFrame([(i, s, t, __import__("datetime").datetime(2024, 1, d)) for i, s, t, d in r], schema)
    land, store, seen = (str(tmp_path / x) for x in ("land", "store", "seen"))
    rows((1, "a", "old", 1), (2, "b", "b", 1), (3, "a", "new", 2)).write.parquet(land)
    run = lambda: stream.ingest(spark, land, spark.createDataFrame([], schema).schema, store, seen)
    run()
    run()
    table = lambda: sorted((r["sprs_id"], r["id"], r["title"]) for r in stream.current(spark, store, spark.createDataFrame([], schema).schema).collect())
    assert table() == [("a", 3, "new"), ("b", 2, "b")]
    rows((9, "b", "late", 3), (10, "c", "c", 3)).write.mode("append").parquet(land)
    run()
    assert table() == [("a", 3, "new"), ("b", 2, "late"), ("c", 10, "c")]


def test_stream_writes_only_the_buckets_hit(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, sprs_id string, title string, created_at timestamp").schema
    day = __import__("datetime").datetime
    land, store, seen = (str(tmp_path / x) for x in ("land", "store", "seen"))
    rows = lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(land)
    rows([(i, f"s{i}", "old", day(2024, 1, 1)) for i in range(200)])
    stream.ingest(spark, land, schema, store, seen)
    table = BucketStore(spark, store, schema, "sprs_id")
    first = table.versions()
    rows([(500, "s7", "new", day(2024, 1, 2))])
    rows([(501, "s8", "new", day(2024, 1, 2)), (502, "extra", "x", day(2024, 1, 2))])
    stream.ingest(spark, land, schema, store, seen, files_per_batch=1)
    last = table.versions()
    changed = {b for b in last if last[b] != first.get(b)}
    assert 1 <= len(changed) <= 3 and len(first) == 32 and len(table.batches()) == 3
    got = {r["sprs_id"]: (r["id"], r["title"]) for r in stream.current(spark, store, schema).collect()}
    assert len(got) == 201 and got["s7"] == (7, "new") and got["s8"] == (8, "new") and got["extra"] == (502, "x") and got["s9"] == (9, "old")
    # a batch that is run again leaves the same table
    table.merge(table.batches()[-1], spark.createDataFrame([(501, "s8", "new", day(2024, 1, 2)), (502, "extra", "x", day(2024, 1, 2))], schema), lambda old, new: upsert(old, new, "sprs_id", keep=("id",)))
    assert {r["sprs_id"]: (r["id"], r["title"]) for r in stream.current(spark, store, schema).collect()} == got


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    day = __import__("datetime").datetime
    land, store, seen = (str(tmp_path / x) for x in ("land", "out", "seen"))
    schema = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double").schema
    for n, hours in enumerate(([(1, 0), (1, 30)], [(4, 0)], [(4, 5)], [(1, 40), (4, 10)], [(9, 0)], [(9, 5)])):
        spark.createDataFrame([(n, day(2024, 1, 1, h, m), 1, "view", 1.0) for h, m in hours], schema).coalesce(1).write.mode("append").parquet(land)
        __import__("time").sleep(1.1)
    stream.late_events(spark, land, schema, store, seen)
    got = sorted((r["start"].hour, r["n"]) for r in spark.read.parquet(store).collect())
    # the row of 1:40 came after the hour was closed; the last window is still open
    assert got == [(1, 2), (4, 3)]
