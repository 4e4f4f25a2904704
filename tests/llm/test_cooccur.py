import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from lexloom.llm import cooccur
from lexloom.llm.cooccur import PairTable
from lexloom.runtime import Scratch


def brute(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, single = len(baskets), Counter(i for x in baskets.values() for i in x)
    return {(a, b, k, single[a], single[b], n) for (a, b), k in Counter(p for x in baskets.values() for p in combinations(sorted(x), 2)).items()}


def counts(table):
    return {(r["a"], r["b"], r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in table.associations().collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "b long, i long")


def test_updates_equal_a_count_from_scratch(spark):
    draw = random.Random(5)
    rows = [(draw.randint(1, 40), draw.randint(1, 9)) for _ in range(200)] + [(None, 1), (1, None), (1, 1), (1, 1)]
    table = PairTable(spark, Scratch(spark, "test")).update(frame(spark, rows), "b", "i")
    assert counts(table) == brute(rows)
    changed = [(b, draw.randint(1, 9)) for b in range(30, 50) for _ in range(3)]
    table.update(frame(spark, changed), "b", "i", gone=frame(spark, [(2, None), (3, None)]).select("b"))
    rows = [r for r in rows if r[0] is not None and r[0] < 30 and r[0] not in (2, 3)] + changed
    assert counts(table) == brute(rows)
    table.update(frame(spark, []), "b", "i")
    assert counts(table) == brute(rows)


def test_only_the_buckets_hit_are_written(spark):
    rows = [(b, i) for b in range(20) for i in (b, b + 1, b + 2)]
    scratch = Scratch(spark, "test")
    table = PairTable(spark, scratch).update(frame(spark, rows), "b", "i")
    before = dict(table.pairs.written)
    table.update(frame(spark, [(5, 5), (5, 6)]), "b", "i")
    again = {k for k, g in table.pairs.written.items() if g != before.get(k)}
    # the pairs (5, 7) and (6, 7) lost a basket
    assert 1 <= len(again) <= 2 < len(before)
    assert counts(table) == brute([r for r in rows if r != (5, 7)])
    table.update(frame(spark, []), "b", "i", gone=frame(spark, [(b, None) for b in range(20)]).select("b"))
    assert counts(table) == set()


def test_scores_and_empty(spark):
    table = PairTable(spark, Scratch(spark, "test")).update(frame(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)]), "b", "i")
    r = table.associations().first()
    assert (r["n_ab"], r["lift"]) == (2, 2.0) and math.isclose(r["npmi"], 1.0)
    assert PairTable(spark, Scratch(spark, "test")).update(frame(spark, []), "b", "i").associations().count() == 0


def test_hot_item_and_hot_basket(spark):
    rows = [(b, 1) for b in range(300)] + [(7, i) for i in range(200)] * 3
    assert counts(PairTable(spark, Scratch(spark, "test")).update(frame(spark, rows), "b", "i")) == brute(rows)


def test_state_is_opened_again_and_affected_pairs_rescored(spark):
    rows = [(b, i) for b in range(20) for i in (b, b + 1, b + 2)]
    scratch = Scratch(spark, "test")
    PairTable(spark, scratch, buckets=4).update(frame(spark, rows), "b", "i")
    table = PairTable.open(spark, scratch.root)
    assert counts(table) == brute(rows) and table.affected.count() == 0
    table.update(frame(spark, [(5, 5), (5, 6), (77, 1), (77, 90)]), "b", "i", gone=frame(spark, [(3, None), (999, None)]).select("b"))
    now = [r for r in rows if r != (5, 7) and r[0] != 3] + [(77, 1), (77, 90)]
    again = PairTable.open(spark, scratch.root)
    assert counts(again) == brute(now) == counts(table)
    old, new = {x[:2]: x[2:5] for x in brute(rows)}, {x[:2]: x[2:5] for x in brute(now)}
    got = {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in table.affected.collect()}
    assert got == {k: v for k, v in new.items() if old.get(k) != v}
    # an update that fails leaves the state before it
    try:
        again.update(frame(spark, [(1, 1)]).withColumn("i", F.raise_error(F.lit("lost"))), "b", "i")
    except Exception:
        assert counts(PairTable.open(spark, scratch.root)) == brute(now)
    else:
        raise AssertionError


def test_large_baskets_meet_in_chunks(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(1, i) for i in range(70)] + [(2, i) for i in range(30, 90)] + [(b, draw.randint(1, 9)) for b in range(3, 30) for _ in range(4)]
    monkeypatch.setattr(cooccur, "CHUNK", 16)
    table = PairTable(spark, Scratch(spark, "test")).update(frame(spark, rows), "b", "i")
    assert counts(table) == brute(rows)
    table.update(frame(spark, [(1, i) for i in range(40)]), "b", "i")
    assert counts(table) == brute([r for r in rows if r[0] != 1] + [(1, i) for i in range(40)])
