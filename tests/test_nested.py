import json

from lexloom.operators.nested import flatten
from lexloom.runtime import Scratch


def flat(spark, texts, schema="k long, j string"):
    rows = [(i, t if isinstance(t, str) or t is None else json.dumps(t)) for i, t in enumerate(texts)]
    return flatten(spark.createDataFrame(rows, schema), "k", "j", Scratch(spark, "test"))


def nodes(df):
    return sorted((r["k"], r["_parent"], r["_node"]) for r in df.collect())


def test_levels_link_to_parents(spark):
    out = flat(spark, [{"a": {"q": [{"s": [{"t": 1}, None, {"t": "x"}]}, {"s": {"t": 2}}]}}, {"a": json.dumps({"q": {"s": []}})}])
    assert nodes(out.children["a.q"]) == [(0, "a", "a.q[0]"), (0, "a", "a.q[1]"), (1, "a", "a.q[0]")]
    assert nodes(out.children["a.q[].s"]) == [(0, "a.q[0]", "a.q[0].s[0]"), (0, "a.q[0]", "a.q[0].s[2]"), (0, "a.q[1]", "a.q[1].s[0]")]
    assert sorted(r["t"] for r in out.children["a.q[].s"].collect()) == ["1", "2", "x"]


def test_broken_and_empty(spark):
    out = flat(spark, [None, "{", "NaN", "", {"a": [1]}, "[" * 5000])
    assert sorted((r["k"], r["_valid"]) for r in out.root.collect()) == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, False)]
    assert nodes(out.children["a"]) == [(4, "", "a[0]")]
    empty = flatten(spark.createDataFrame([], "k long, j string"), "k", "j", Scratch(spark, "test"))
    assert empty.root.count() == 0 and empty.children == {}


def test_clashing_names_arrays_of_arrays_and_mixed_kinds(spark):
    out = flat(spark, [{"k": "x", "K": 1, "l": [[1, 2], [], None, 3]}, {"l": [{"_node": "n", "k": 5}, "s"]}, [{"z": 1}], '"plain"'])
    assert out.root.count() == 4
    assert len({c.lower() for c in out.root.columns}) == len(out.root.columns)
    for df in out.children.values():
        df.collect()
        assert len({c.lower() for c in df.columns}) == len(df.columns)


def test_text_that_looks_like_json_stays_text(spark):
    out = flat(spark, [{"f": ["[1]", "note"], "t": "{x"}, {"f": ["b"]}])
    assert [r["_value"] for r in out.children["f"].orderBy("k", "_ordinal").collect()] == ["[1]", "note", "b"]


def test_repeated_rows_extra_columns_and_long_text(spark):
    long = {"a": ["x" * 300_000]}
    df = spark.createDataFrame([(1, json.dumps(long), "e")] * 2, "k long, j string, _node string")
    out = flatten(df, "k", "j", Scratch(spark, "test"))
    assert out.children["a"].count() == 2
    assert out.children["a"].first()["_value"] == "x" * 300_000


def test_lone_surrogates_do_not_break(spark):
    assert flat(spark, ['{"a": ["\\ud800"]}']).children["a"].count() == 1


def test_ids_for_names_become_entries(spark):
    """Objects with ids for names, one within the other, and lists and scalars as their values."""
    records = [{"by": {f"id{i}{k}": {"n": k, "to": {f"u{i}{k}": [1, {"z": k}]}} for k in range(3)}, "c": {"x": 1}} for i in range(4)] + [{"by": {'q"\\ é': None}}, {"by": None}, {"c": {"y": "s"}}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    out = flatten(spark.createDataFrame(rows, "k long, j string"), "k", "j", Scratch(spark, "test"), most_names=5)
    assert set(out.children) == {"by", "by[].value.to", "by[].value.to[].value"}
    got = sorted((r["k"], r["_node"], r["_name"], r["value_n"]) for r in out.children["by"].collect())
    assert got == sorted([(i, f"by[{k}]", f"id{i}{k}", str(k)) for i in range(4) for k in range(3)] + [(4, "by[0]", 'q"\\ é', None)], key=str)
    inner = sorted((r["k"], r["_parent"], r["_name"]) for r in out.children["by[].value.to"].collect())
    assert inner == [(i, f"by[{k}].value", f"u{i}{k}") for i in range(4) for k in range(3)]
    last = sorted((r["k"], r["_parent"], r["_ordinal"], r["z"], r["_value"]) for r in out.children["by[].value.to[].value"].collect())
    assert [x[2:] for x in last[:2]] == [(0, None, "1"), (1, "0", None)] and len(last) == 24
    assert sorted((r["k"], r["c_x"], r["c_y"]) for r in out.root.collect()) == [*[(i, "1", None) for i in range(4)], (4, None, None), (5, None, None), (6, None, "s")]


def test_a_whole_record_of_ids(spark):
    out = flatten(spark.createDataFrame([(i, json.dumps({f"a{i}{k}": k for k in range(4)})) for i in range(3)], "k long, j string"), "k", "j", Scratch(spark, "test"), most_names=5)
    (child,) = out.children.values()
    assert sorted((r["k"], r["_name"], r["value"]) for r in child.collect()) == [(i, f"a{i}{k}", str(k)) for i in range(3) for k in range(4)]
