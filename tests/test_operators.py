import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import graph, merge, order, retrieve, rollup, segment, tagging
from lexloom.operators.redline import redline_ops


def clauses(spark, *lines, slug="d"):
    rows = [(i, slug, i, "heading" if x.startswith("#") else "paragraph", x.lstrip("#")) for i, x in enumerate(lines)]
    out = segment.segment(spark.createDataFrame(rows, "id long, doc_slug string, pos int, kind string, text string"))
    return [(r["anchor"], r["heading"], r["text"]) for r in out.orderBy("order_index").collect()]


def test_sub_clauses(spark):
    assert [a for a, _, _ in clauses(spark, "#4. Covenants", "Intro.", "(a) Access to Premises", "Body.", "(b) To pay.")] == ["4", "4-a", "4-b"]


def test_nested_enumeration_stays_in_its_clause(spark):
    got = clauses(spark, "#4. Covenants", "Intro.", "(a) first:", "(i) one", "(ii) two", "(b) second.")
    assert [a for a, _, _ in got] == ["4", "4-a", "4-b"] and "(ii) two" in got[1][2]


def test_empty_heading_is_carried_forward(spark):
    assert clauses(spark, "#Covenants", "(a) To pay the rent.")[0][2] == "Covenants. To pay the rent."
    assert clauses(spark, "#Only a heading") == []


def test_repeated_anchors_and_headings(spark):
    got = clauses(spark, "#DEFINITIONS", "x", "#TERM", "y", "#DEFINITIONS", "z")
    assert [a for a, _, _ in got] == ["definitions", "term", "definitions-2"]
    got = clauses(spark, "#CONFIDENTIAL", "a", "#CONFIDENTIAL", "b", "#CONFIDENTIAL", "c")
    assert len(got) == 1 and got[0][0] == "s0"


def test_second_seven_does_not_clash_with_seven_two(spark):
    anchors = [a for a, _, _ in clauses(spark, "#7. A", "x", "#7.2 B", "y", "#7. C", "z")]
    assert len(set(anchors)) == 3


def test_body_prose_that_starts_with_a_number(spark):
    assert len(clauses(spark, "#1. Notice", "2 months' notice is due.", "3. Term", "t")) == 2


def test_fold_survives_blank_null_and_several_documents(spark):
    df = spark.createDataFrame([(1, "a", 0, "heading", "1. X"), (2, "a", 1, "paragraph", None), (3, "a", 2, "paragraph", " "), (4, "a", 3, "paragraph", "x"), (5, None, 0, "paragraph", "lost"), (6, "b", 0, "paragraph", "y")], "id long, doc_slug string, pos int, kind string, text string")
    assert sorted((r["doc_slug"], r["anchor"]) for r in segment.segment(df).collect()) == [("a", "1"), ("b", "s0")]
    assert segment.segment(df.limit(0)).count() == 0


def test_table_rows(spark):
    df = spark.createDataFrame([(["Rent", "Rent", "S$5"],), (["", "only"],), ([],), (["x" * 70, "y"],)], "c array<string>")
    got = [[(b["kind"], b["text"]) for b in r["b"]] for r in df.select(segment.table_row_blocks(F.col("c")).alias("b")).collect()]
    assert got == [[("heading", "Rent"), ("paragraph", "S$5")], [("paragraph", "only")], [], [("paragraph", "x" * 70 + " | y")]]


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=30), st.text("ab \n", max_size=30))
def test_redline_gives_both_texts(before, after):
    ops = redline_ops(before, after)
    assert "".join(t for o, t in ops if o != "insert") == before
    assert "".join(t for o, t in ops if o != "delete") == after
    assert all(a[0] != b[0] for a, b in zip(ops, ops[1:]))


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, id int, v string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 8, "w")], "k string, id int, v string")
    once = merge.upsert(old, new, "k", keep=("id",))
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 8, "w")]
    assert sorted(map(tuple, merge.upsert(once, new, "k", keep=("id",)).collect())) == sorted(map(tuple, once.collect()))


def corpus(spark, texts, edges=()):
    clauses = spark.createDataFrame([(i, 1, f"d#{i}", t) for i, t in enumerate(texts)], "id long, document_id long, ref string, text string")
    contracts = spark.createDataFrame([(1, None)], "id long, parse_error string")
    concepts = spark.createDataFrame([(1, "notice-period", "Notice Period"), (2, "rent", "Rent")], "id long, slug string, name string")
    edges = spark.createDataFrame(list(edges), "clause_id long, concept_id long")
    return clauses, contracts, concepts, edges


def items(spark, *bodies):
    return spark.createDataFrame([(i, "title", b, None, "1-2-2024") for i, b in enumerate(bodies)], "id long, title string, body_text string, summary string, sitting_date string")


def test_ranking_prefers_the_clause_in_question(spark):
    texts = ["the tenant keeps a dog and a parrot", "rent falls due monthly", "insurance covers fire", "deposit is returned", "parking space is let"]
    got = retrieve.ranked(items(spark, "May a parrot be kept?"), *corpus(spark, texts)).collect()
    assert got[0]["clause_id"] == 0 and got[0]["rank"] == 1


def test_concepts_add_a_bonus_and_need_two_clauses(spark):
    texts = ["alpha", "beta", "gamma", "delta", "epsilon"]
    got = retrieve.ranked(items(spark, "On notice, periods matter. Notice periods 2 rent"), *corpus(spark, texts, [(1, 1), (2, 1), (2, 1), (3, 2), (4, 2)])).collect()
    # clauses that share nothing fill the list up by ref
    assert [(r["clause_id"], r["shared"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 3.0), (2, 1, 3.0), (0, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0)]
    assert {r["score"] for r in retrieve.ranked(items(spark, "notice period"), *corpus(spark, texts, [(1, 1)])).collect()} == {0.0}


def test_declared_concepts_count_like_named_ones(spark):
    declared = spark.createDataFrame([(0, "notice-period")], "item_id long, slug string")
    got = retrieve.ranked(items(spark, "nothing"), *corpus(spark, ["a", "beta", "gamma"], [(1, 1), (2, 1)]), retrieve.Settings(k=2), declared).collect()
    assert sorted((r["rank"], r["clause_id"], r["score"]) for r in got) == [(1, 1, 3.0), (2, 2, 3.0)]
    pages = spark.createDataFrame([(0, "---\ntitle: x\nconcepts: [notice-period, b]\n---\n\n# x\n"), (1, "---\ntitle: x\n---\n\nconcepts: [c]\n"), (2, None), (3, "---\nconcepts: []\n---\n")], "item_id long, markdown string")
    assert sorted(map(tuple, retrieve.declared_tags(pages).collect())) == [(0, "b"), (0, "notice-period")]


def test_ranking_with_nulls_ties_and_nothing_to_rank(spark):
    clauses, contracts, concepts, edges = corpus(spark, ["parrot", "parrot", None, "", "x"])
    clauses = clauses.unionByName(spark.createDataFrame([(None, 1, "d#9", "parrot"), (7, 1, None, "parrot"), (8, None, "d#0", "parrot")], clauses.schema))
    asked = items(spark, "parrot", None).unionByName(spark.createDataFrame([(None, None, "parrot", None, None), (5, None, None, "parrot", None)], "id long, title string, body_text string, summary string, sitting_date string"))
    got = {(r["item_id"], r["rank"]): r["clause_id"] for r in retrieve.ranked(asked, clauses, contracts, concepts, edges).collect()}
    # clauses without a ref come first among equals; items without a word get the clauses by ref
    assert [got[0, k] for k in range(1, 5)] == [7, 0, 1, 4] and [got[1, k] for k in range(1, 5)] == [7, 0, 1, 4] and {k for k, _ in got} == {0, 1, 5}
    assert retrieve.ranked(asked.limit(0), clauses, contracts, concepts, edges).count() == 0


def test_blocks_do_not_change_the_ranking(spark):
    draw = random.Random(3)
    words = ["parrot", "insurance", "deposit", "monthly", "damage", "garden", "ceiling", "water"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 9))) for _ in range(60)]
    asked = items(spark, *[" ".join(draw.choices(words, k=3)) for _ in range(17)], "")
    tables = corpus(spark, texts, [(draw.randrange(60), 1) for _ in range(9)])
    whole, cut = (sorted(map(tuple, retrieve.ranked(asked, *tables, s).collect())) for s in (retrieve.Settings(), retrieve.Settings(clause_block=7, item_block=4)))
    assert whole == cut and len(whole) == 18 * 5


def shuffled(spark):
    """Bytes that the session's tasks wrote to shuffle files so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_more_blocks_of_items_shuffle_no_more(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("bcdfglmnprst", k=5)) for _ in range(60)]
    asked = items(spark, *[" ".join(draw.choices(words, k=6)) for _ in range(128)])
    tables = corpus(spark, [" ".join(draw.choices(words, k=40)) for _ in range(400)])
    took = []
    for item_block in (128, 2):
        before = shuffled(spark)
        assert retrieve.ranked(asked, *tables, retrieve.Settings(clause_block=100, item_block=item_block)).count() == 128 * 5
        took.append(shuffled(spark) - before)
    assert 0 < took[1] < 1.5 * took[0]


def test_no_corpus_no_candidates(spark):
    assert retrieve.ranked(items(spark, "x y z"), *corpus(spark, ["  "])).count() == 0


def test_gate_is_inclusive_and_the_budget_takes_the_best(spark):
    ranks = spark.createDataFrame([(0, 1, 12.0), (1, 1, 40.0), (2, 1, 20.0), (3, 1, 25.0)], "item_id long, rank int, score double")
    out = retrieve.gated(ranks, items(spark, *"abcde"), retrieve.Settings(budget=2))
    assert {r["item_id"]: r["outcome"] for r in out.collect()} == {0: "gated", 1: "judged", 2: "over_budget", 3: "judged", 4: "no_candidates"}


def test_merge_actions_tell_nulls_apart(spark):
    """A null in one column is not the same as a null in another."""
    schema = "k string, s int, a string, b string"
    old = spark.createDataFrame([("x", 1, None, "v"), ("same", 1, None, None), ("gone", 1, "q", "q"), ("other", 2, "q", "q")], schema)
    new = spark.createDataFrame([("x", 1, "v", None), ("same", 1, None, None), ("new", 1, "q", "q")], schema)
    assert {r["k"]: r["action"] for r in merge.merge_actions(old, new, "k", "s", ("a", "b")).collect()} == {"x": "update", "same": "keep", "gone": "delete", "new": "insert"}
    assert sorted(r["k"] for r in merge.merged(old, new, "k", "s").collect()) == ["new", "other", "same", "x"]
    again = merge.merged(merge.merged(old, new, "k", "s"), new, "k", "s")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, merge.merged(old, new, "k", "s").collect()), key=str)


def test_labels_edges_and_first_valid(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "z")], "p int, v string")
    new = spark.createDataFrame([(1, "n"), (3, "m")], "p int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(merge.keep_unless_forced(old, new, "p")) == [(1, "a"), (2, "b"), (3, "m"), (None, "z")]
    assert rows(merge.keep_unless_forced(old, new, "p", force=True)) == [(1, "n"), (2, "b"), (3, "m"), (None, "z")]
    assert rows(merge.replace_children(old, new.where("p = 3"), spark.createDataFrame([(2,)], "p int"), "p")) == [(1, "a"), (None, "z")]
    values = spark.createDataFrame([(1, 0, "bad"), (1, 1, "ok"), (1, 2, "fine"), (2, 0, None)], "k int, o int, v string")
    first = merge.first_valid(values, "k", "v", ("o",), ("ok", "fine"))
    assert rows(first) == [(1, "ok")]
    assert rows(merge.update_where_given(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), first, "k", "v")) == [(1, "ok"), (2, "y")]


def test_log_replay_and_rewind(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None), ("b", 1, "q"), (None, 1, "w")], "k string, n int, v string")
    log = merge.change_log(rows, "k", "v", "n")
    assert sorted(map(tuple, log.collect())) == [("a", 3, "x", "y"), ("a", 4, "y", None)]
    assert list(map(tuple, merge.replayed(log, "k").collect())) == [("a", None, 2)]
    assert list(map(tuple, merge.rewound(log, "k").collect())) == [("a", "x")]
    assert list(map(tuple, merge.rewound(log, "k", F.col("seq") > 3).collect())) == [("a", "y")]


def test_rollups(spark):
    df = spark.createDataFrame([(1, "low", "done"), (1, "high", "done"), (2, "odd", "new"), (2, None, None), (3, "medium", "new"), (3, "low", "done")], "k int, s string, t string")
    got = df.groupBy("k").agg(rollup.greatest_of(F.col("s"), ("low", "medium", "high"), "low").alias("s"), rollup.settled_state(F.col("t"), "new", "done", "open", "closed", "mixed").alias("t")).collect()
    assert sorted(map(tuple, got)) == [(1, "high", "closed"), (2, "low", "open"), (3, "medium", "mixed")]
    counts = rollup.zero_filled(spark.createDataFrame([("a", 2)], "w string, n long"), spark.createDataFrame([("a",), ("b",)], "w string"), "w")
    assert sorted(map(tuple, counts.collect())) == [("a", 2), ("b", 0)]


def test_positions_and_dealing(spark):
    draw = random.Random(2)
    rows = [(draw.random(), i) for i in range(500)]
    got = order.positions(spark.createDataFrame(rows, "x double, i int"), "x", "i").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(500)) and [(r["x"], r["i"]) for r in got] == sorted(rows)
    assert order.positions(spark.createDataFrame([], "x int"), "x").count() == 0
    hands = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "position long, hand string")
    dealt = order.dealt_out(spark.createDataFrame([(0, "a"), (4, "b")], "position long, row string"), hands, 2)
    assert sorted((r["row"], r["hand"]) for r in dealt.collect()) == [("a", "p"), ("a", "q"), ("b", "q"), ("b", "r")]
    assert order.dealt_out(spark.createDataFrame([(0, "a")], "position long, row string"), hands.limit(0), 2).count() == 0


def test_graph_takes_rows_whole_and_keeps_curated_labels(spark):
    contracts = spark.createDataFrame([(1, "d", "Curated", "law"), (2, "d", None, "other")], "id long, slug string, title string, sector string")
    none = spark.createDataFrame([], "id long, ref string, number string, heading string, anchor string, document_id long")
    concepts, items = spark.createDataFrame([], "id long, slug string, name string"), spark.createDataFrame([], "id long, slug string, title string, sitting_date string")
    nodes = graph.nodes(contracts, none, concepts, items)
    assert [(r["id"], r["label"], r["sector"]) for r in nodes.collect()] == [("document:d", "Curated", "law")]
    edges = graph.edges(contracts, none, concepts, spark.createDataFrame([], "clause_id long, concept_id long"), spark.createDataFrame([("item:1", "rent")], "item string, slug string"))
    assert list(map(tuple, edges.collect())) == [("item:1", "concept:rent", "mentions")]
    lines = [r["line"] for r in graph.graph_lines(nodes, edges).orderBy(F.desc("kind"), "key").collect()]
    assert lines == ['{"id":"document:d","type":"document","label":"Curated","sector":"law"}', '{"source":"item:1","target":"concept:rent","type":"mentions"}']


def rows_of_tables(con, **tables):
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con


def test_ids_in_several_rows_rank_as_by_sql(spark):
    import duckdb

    from lexloom.plans import retrieval

    draw = random.Random(5)
    words = ["".join(draw.choices("bcdfglmnprst", k=5)) for _ in range(30)]
    ids = [*range(40), 3, 3, 7, None, None]
    clauses = spark.createDataFrame([(x, 1, f"d#{draw.randrange(9)}", " ".join(draw.choices(words, k=draw.choice([6, 6, 9])))) for x in ids], "id long, document_id long, ref string, text string").where("id is not null")
    _, contracts, concepts, _ = corpus(spark, [])
    edges = spark.createDataFrame([(3, 1), (3, 1), (9, 1), (99, 1)], "clause_id long, concept_id long")
    asked = items(spark, *[" ".join(draw.choices(words, k=8)) for _ in range(9)], "notice periods")
    con = rows_of_tables(duckdb.connect(), clauses=clauses, contracts=contracts, concepts=concepts, clause_concepts=edges, parliament_items=asked)
    want = con.execute(retrieval.SQL["ranked_clauses"]).fetchall()
    got = retrieve.ranked(asked, clauses, contracts, concepts, edges, retrieve.Settings(clause_block=16)).collect()
    key = lambda r: (r[0], r[1])
    assert [(a, b, c, round(d, 4), e, round(f, 4)) for a, b, c, d, e, f in sorted(map(tuple, got), key=key)] == [(a, b, c, round(d, 4), e, round(f, 4)) for a, b, c, d, e, f in sorted(want, key=key)]


def test_terms_of_an_item_held_or_joined(spark, monkeypatch):
    draw = random.Random(6)
    words = ["".join(draw.choices("bcdfglmnprst", k=4)) for _ in range(80)]
    asked = items(spark, *[" ".join(draw.choices(words, k=90)) for _ in range(12)], None)
    tables = corpus(spark, [" ".join(draw.choices(words, k=9)) for _ in range(50)])
    held = sorted(map(tuple, retrieve.ranked(asked, *tables).collect()))
    monkeypatch.setattr(retrieve, "HELD_TERMS", 0)
    assert held == sorted(map(tuple, retrieve.ranked(asked, *tables).collect())) and len(held) == 13 * 5


def test_postings_are_shuffled_less_than_once_as_text(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices("bcdfglmnprst", k=8)) for _ in range(3_000)]
    texts = [" ".join(draw.choices(words, k=80)) for _ in range(2_000)]
    asked = items(spark, *[" ".join(draw.choices(words, k=60)) for _ in range(100)])
    before = shuffled(spark)
    assert retrieve.ranked(asked, *corpus(spark, texts)).count() == 100 * 5
    assert shuffled(spark) - before < sum(map(len, texts))


def test_texts_of_items_are_not_shuffled_for_their_concepts(spark):
    draw = random.Random(8)
    texts = ["rent and a notice period " + " ".join("".join(draw.choices("bcdfglmnprst", k=6)) for _ in range(300)) for _ in range(200)]
    _, _, concepts, edges = corpus(spark, [], [(1, 1), (2, 1), (3, 2), (4, 2)])
    asked, tags = items(spark, *texts), retrieve.clause_tags(edges, concepts)
    before = shuffled(spark)
    assert retrieve.item_tags(asked, concepts, tags, retrieve.Settings()).count() == 200
    assert shuffled(spark) - before < 50_000


def test_clauses_that_no_item_got_are_not_shuffled_for_prompts(spark):
    draw = random.Random(9)
    c = spark.createDataFrame([(i, f"d#{i}", "1", "h", "".join(draw.choices("bcdfglmnprst ", k=3_000))) for i in range(300)], "id long, ref string, number string, heading string, text string")
    ranks = spark.createDataFrame([(0, 1, 7), (0, 2, 9), (1, 1, 7)], "item_id long, rank int, clause_id long")
    before = shuffled(spark)
    got = {r["item_id"]: r["prompt"] for r in tagging.prompts(items(spark, "a", "b"), ranks, c, "Judge.").collect()}
    assert [got[k].count("## Candidate clause d#") for k in (0, 1)] == [2, 1] and got[0].index("d#7") < got[0].index("d#9")
    assert shuffled(spark) - before < 50_000


def test_texts_of_clauses_are_not_shuffled_for_their_documents(spark):
    draw = random.Random(10)
    clauses, contracts, _, _ = corpus(spark, ["".join(draw.choices("bcdfglmnprst ", k=3_000)) for _ in range(300)])
    before = shuffled(spark)
    assert retrieve.readable(clauses, contracts).agg(F.sum(F.length("text"))).first()[0] == 900_000
    assert shuffled(spark) - before < 50_000


def test_concepts_are_found_as_their_patterns_find_them(spark):
    bodies = ["a NOTICE-\n period", "notice, periods", "notice_period", "notice 2 period", "noticeperiod", "notice periodss", "xnotice period", "énotice period", "notice periodK", "notice period.", "", None, "rent", "period notice"]
    _, _, concepts, edges = corpus(spark, [], [(1, 1), (2, 1), (3, 2), (4, 2)])
    asked = items(spark, *bodies)
    got = {r["item_id"] for r in retrieve.item_tags(asked, concepts, retrieve.clause_tags(edges, concepts), retrieve.Settings()).collect()}
    want = asked.where(r"regexp_like(concat(title, '\n', coalesce(body_text, '')), '(?i)\\bnotice\\W+periods?\\b')")
    assert got == {r["id"] for r in want.collect()} and {0, 1, 9} <= got and not got & {2, 3, 4, 5, 6, 10, 11, 12, 13}


def test_words_of_concepts_do_not_make_texts_be_searched_for_patterns(spark):
    """Where the words stand but not the name, a text costs little more than its words do."""
    words = ["".join(p) for p in itertools.product("bcdfg", repeat=3)]
    concepts = spark.createDataFrame([(i, f"c{i}", f"{w}{w}x {w}y") for i, w in enumerate(words)], "id long, slug string, name string")
    edges = spark.createDataFrame([(k, i) for i in range(len(words)) for k in (1, 2)], "clause_id long, concept_id long")
    text = " ".join(f"{w}{w}x, and not {w}y, and {'q' * 40}" for w in words)
    asked, tags = items(spark, *[f"{text} {i}" for i in range(1_500)]).repartition(4).localCheckpoint(), retrieve.clause_tags(edges, concepts).localCheckpoint()

    def seconds(df):
        began = time.perf_counter()
        assert df.count() == 0
        return time.perf_counter() - began

    patterns = [r["p"] for r in concepts.select(T.concept_pattern(F.col("name")).alias("p")).limit(20).collect()]
    found, some = (min(seconds(df) for _ in range(2)) for df in (retrieve.item_tags(asked, concepts, tags, retrieve.Settings()), asked.where(" or ".join(f"regexp_like(body_text, r'{p}')" for p in patterns))))
    assert found < 3 * some


def test_scores_by_item_and_as_a_product_are_those_of_all_pairs(tmp_path):
    draw = np.random.default_rng(11)
    n, m, held, named = 50, 40, np.arange(100, 160), np.arange(150, 160)
    weight = draw.random((60, n)) * (draw.random((60, n)) < draw.choice([0.02, 0.3, 0.9], 60)[:, None])
    term, place = np.nonzero(weight)
    terms, begin = np.unique(held[term], return_index=True)
    one = lambda x: pa.array([x])
    pq.write_table(pa.table({"ids": one(np.arange(n)), "terms": one(terms), "begin": one(np.append(begin, len(term))), "place": one(place.astype(np.int32)), "weight": one(weight[term, place])}), tmp_path / "0.parquet")
    block = retrieve._Block(pa.fs.LocalFileSystem(), str(tmp_path / "0.parquet"))
    asks = draw.random((m, 60)) < 0.3
    asks[3] = False
    idf = draw.random(60)
    row, col = np.nonzero(asks)
    part = retrieve._Asked(np.arange(m), row, held[col], np.where(np.isin(held[col], named), np.nan, idf[col]), retrieve.Settings())
    at = np.minimum(np.searchsorted(block.terms, part.terms), len(block.terms) - 1)
    near = part._near(block, np.flatnonzero(block.terms[at] == part.terms), at)
    assert np.allclose(near, (asks * np.where(np.isin(held, named), 3.0, idf)) @ weight, rtol=1e-5)
