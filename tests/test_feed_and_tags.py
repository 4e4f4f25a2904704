import http.server
import json
import sys
import threading

import pytest
from pyspark.sql import functions as F

from lexloom.operators import tagging
from lexloom.plans import patterns
from lexloom.sources import feed, inbox, report


def hits(first, last, start):
    days = [f"{d}-8-2026" for d in range(1, 29) for _ in range(2)]
    inside = [x for x in days if first <= feed.iso_day(x) <= last]
    return [{"title": f"t{start + k}", "sittingDate": x, "maxResult": str(len(inside)), "reportId": f"r{start + k}#"} for k, x in enumerate(inside[start : start + feed.PAGE])]


def test_pages_are_recorded_and_replayed(spark, tmp_path):
    folder = str(tmp_path / "live")
    live = feed.search(spark, folder, "2026-08-01", "2026-08-31", hits)
    assert live.count() == 56 and live.select("sitting_date").distinct().count() == 28
    assert sorted(p.name for p in (tmp_path / "live").iterdir()) == ["2026-08-01_2026-08-31.json", "2026-08-01_2026-08-31_20.json", "2026-08-01_2026-08-31_40.json"]
    assert feed.search(spark, folder, "2026-08-01", "2026-08-31").count() == 56


def test_days_are_pushed_down(spark, tmp_path):
    folder = str(tmp_path / "live")
    some = feed.search(spark, folder, "2026-08-01", "2026-08-31", hits).where("sitting_date >= '2026-08-05' and sitting_date <= '2026-08-06' and title is not null")
    assert some.count() == 4
    assert [p.name for p in (tmp_path / "live").iterdir()] == ["2026-08-05_2026-08-06.json"]
    assert feed.search(spark, folder, "2026-08-05", "2026-08-06").where("sitting_date = '2026-08-06'").count() == 2


def test_offline_ends_at_what_is_not_recorded(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(Exception, match="FixtureMissing|2026-08-01_2026-08-31"):
        feed.search(spark, folder, "2026-08-01", "2026-08-31").count()
    feed.record(folder, "2026-08-01_2026-08-31", hits("2026-08-01", "2026-08-31", 0))
    assert feed.search(spark, folder, "2026-08-01", "2026-08-31").count() == 20
    feed.record(folder, "e", [])
    assert feed.replay(folder, "e") == [] and feed.replay(folder, "nothing") is None
    (tmp_path / "broken.json").write_text("{")
    assert feed.replay(folder, "broken") is None
    with pytest.raises(feed.FixtureMissing):
        feed.call(folder, "nothing", None)
    feed.record(folder, "1900-01-01_2999-12-31", [])
    assert feed.search(spark, folder, "1900-01-01", "2999-12-31").count() == 0


def test_reports(spark, tmp_path):
    section = lambda title, kind, html: {"sectionType": kind, "title": title, "content": html}
    held = {
        "metadata": {"parlimentNO": 15, "sittingDate": "5-8-2026", "speaker": "S"},
        "takesSectionVOList": [section("Road  Works", "OA", "<p>asked the Minister for Roads whether it is so</p>"), section("Road Works", "OA", "<p>x&#8217;s</p>"), section("Empty", "WA", "<p> </p>"), section(None, "ZZ", "<p>y</p>")],
        "attendanceList": [{"mpName": "A", "attendance": "true"}, {"mpName": "B"}],
    }
    (tmp_path / "2026-08-05.json").write_text(json.dumps(held))
    (tmp_path / "2026-07-01.json").write_text("{}")
    (tmp_path / "other.txt").write_text("x")
    reports = report.read_reports(spark, str(tmp_path / "*.json"))
    got = [(r["sprs_id"], r["item_type"], r["body_text"]) for r in report.items(report.sections(reports)).orderBy("position").collect()]
    assert got == [("report:2026-08-05:oa:road-works", "oral answer", "asked the Minister for Roads whether it is so"), ("report:2026-08-05:oa:road-works-2", "oral answer", "x’s"), ("report:2026-08-05:zz:", "zz", "y")]
    assert report.items(report.sections(reports)).orderBy("position").first()["speaker"] == "Minister for Roads"
    assert [r["parliament"] for r in report.metadata(reports).where("sitting_date is not null").collect()] == ["15"]
    assert {(r["member"], r["attendance"]) for r in report.attendance(reports).collect()} == {("A", "true"), ("B", None)}
    assert [r["day"] for r in feed.recorded_days(spark, str(tmp_path)).collect()] == ["2026-08-05", "2026-07-01"]


def test_each_prompt_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def answer(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        return '{"n": %d}' % len(open(calls).readlines())

    inbox.PROVIDERS["counting"] = answer
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id long, prompt string")
    answers, new = inbox.ask(asked, spark.createDataFrame([], "key string, answer string"), "counting", "m")
    got = {r["id"]: r["answer"] for r in answers.collect()}
    kept = {r["key"]: r["answer"] for r in new.collect()}
    assert sorted(calls.read_text().split()) == ["p", "q"] and got[1] == got[2] and set(got.values()) == set(kept.values())
    again, more = inbox.ask(asked, new, "counting", "m")
    assert {r["id"]: r["answer"] for r in again.collect()} == got and more.count() == 0 and len(calls.read_text().split()) == 2


def test_coercion(spark):
    asked = spark.createDataFrame([(1, "a", "one two"), (1, "b", "x"), (2, "a", "x"), (3, "a", "x")], "item_id long, ref string, text string")
    say = lambda **x: {"clause_ref": "a", "impacted": True, **x}
    answers = [(1, json.dumps({"legislation_type": "amendment", "assessments": [say(severity="high", edits=[{"find": "one", "replace": "1"}]), say(severity="low"), {"clause_ref": "zz"}, {"impacted": True}]})), (2, "not json"), (3, json.dumps({"legislation_type": "odd", "assessments": [say(severity="grave", suggested_text="new")]}))]
    got = {(r["item_id"], r["ref"]): (r["impacted"], r["severity"], r["rationale"], r["suggested_text"], r["legislation_type"]) for r in tagging.coerced(asked, spark.createDataFrame(answers, "item_id long, answer string")).collect()}
    assert got == {(1, "a"): (True, "high", "", "1 two", "amendment"), (1, "b"): (False, "low", "not assessed", "", "amendment"), (3, "a"): (True, "low", "", "new", None)}


def test_judge_and_tags(spark):
    pairs = [(1, "The framework sets a notice period", "a", "two months' written notice"), (1, "The framework sets a notice period", "b", "rent"), (1, "They amend insurance law", "c", "The insurer pays")]
    got = {r["ref"]: (r["impacted"], r["severity"], r["suggested_text"], r["legislation_type"]) for r in tagging.judged(spark.createDataFrame(pairs, "item_id long, item_text string, ref string, text string")).collect()}
    assert got["a"] == (True, "high", "three (3) months' written notice", "new_legislation") and got["b"] == (False, "low", None, "new_legislation")
    assert got["c"][:2] == (True, "medium") and got["c"][2].startswith("The insurer pays Notwithstanding") and got["c"][3] == "amendment"
    asked = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "document_id long, anchor string")
    answers = spark.createDataFrame([(1, '{"x": ["notice period", "NOTICE  period", ""], "q": ["Lost"]}'), (2, "broken")], "document_id long, answer string")
    assert [tuple(r) for r in tagging.tags_of_answer(asked, answers).collect()] == [(1, "x", "Notice Period")]
    df = spark.createDataFrame([(None,), ("",)], "t string").select(tagging.keyword_concepts(F.col("t")).alias("c"))
    assert [r["c"] for r in df.collect()] == [[], []]


def test_lookup_tells_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert patterns.lookup(df, "k", "a").first()["v"] == 1
    with pytest.raises(patterns.NotFound):
        patterns.lookup(df, "k", "b")


def test_programs_and_servers_as_providers():
    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": asked["model"] + ":" + asked["messages"][0]["content"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert inbox.http_provider(url, "m")("hello") == "m:hello"
    server.shutdown()
    shout = [sys.executable, "-c", "import sys; print(sys.stdin.read().upper())"]
    assert inbox.command_provider(shout)("x{}") == "X{}\n"
    with pytest.raises(RuntimeError):
        inbox.command_provider([sys.executable, "-c", "raise SystemExit(3)"])("x")
    for call in (inbox.command_provider(shout, offline=True), inbox.http_provider(url, "m", offline=True)):
        with pytest.raises(inbox.Offline):
            call("x")
