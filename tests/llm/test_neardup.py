import random
import re

from lexloom.llm import neardup
from lexloom.llm.neardup import Settings, expanded, labelled, near_copies
from lexloom.runtime import Scratch

LOOSE = Settings(shingle=3, threshold=0.5, min_words=8)
SCHEMA = "id long, text string"


def brute(rows, s):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\W_]+", t.lower()) if t else []
        if i is not None and len(words) >= max(s.min_words, s.shingle):
            sets[i] = {tuple(words[k : k + s.shingle]) for k in range(len(words) - s.shingle + 1)}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and 2 > 0 and len(sets[a] & sets[b]) >= s.threshold * len(sets[a] | sets[b])}


def found(spark, rows, s=LOOSE, schema=SCHEMA):
    return near_copies(spark.createDataFrame(rows, schema), "id", "text", Scratch(spark, "test"), s)


def pairs(out):
    rows = [tuple(r) for r in expanded(out).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=120, vocabulary=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [[draw.choice(words) for _ in range(draw.randint(5, 90))] for _ in range(n // 3)]
    while len(texts) < n:
        copy = list(draw.choice(texts))
        for _ in range(draw.randint(0, 6)):
            at = draw.randrange(len(copy))
            copy[at : at + draw.choice((0, 1))] = [draw.choice(words)] * draw.choice((0, 1, 1))
            copy = copy or ["w0"]
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        want, got = brute(rows, LOOSE), pairs(found(spark, rows))
        assert got <= want
        assert len(want - got) <= 0.01 * len(want)


def test_default_is_five_words_and_eight_tenths(spark):
    rows = corpus(3)
    assert pairs(found(spark, rows, Settings())) == brute(rows, Settings())


def test_common_form_makes_no_long_lists(spark):
    """Most of each text is the same form; lists are cut finer and still nothing is lost."""
    form = " ".join(f"form{i}" for i in range(14))
    rows = [(i, f"{form} " + " ".join(f"x{i}y{k}" for k in range(30))) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(20)]
    assert pairs(found(spark, rows)) == brute(rows, LOOSE) and len(brute(rows, LOOSE)) == 20


def test_large_family_of_different_near_copies(spark):
    """Lists of a family are far longer than list_limit; recall doesn't depend on how many share a run."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(152)]
    rows = [(i, " ".join(f"e{i}x{k}" if draw.random() < 0.085 else w for k, w in enumerate(base))) for i in range(200)]
    want, got = brute(rows, LOOSE), pairs(found(spark, rows))
    assert len(want) > 2_000 and got <= want
    assert len(want - got) <= 0.01 * len(want)


def test_lists_of_several_blocks(spark, monkeypatch):
    """Whatever the blocks are, the pairs are the same."""
    draw = random.Random(6)
    base = [f"b{i}" for i in range(152)]
    rows = [(i, " ".join(f"e{i}x{k}" if draw.random() < 0.07 else w for k, w in enumerate(base))) for i in range(70)]
    whole = pairs(found(spark, rows))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert pairs(found(spark, rows)) == whole and len(whole) > 500


def test_copies_nulls_short_and_extra_columns(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(1, text, 0), (2, text, 0), (3, text, 1), (4, None, 0), (5, "", 0), (6, "too short", 0), (None, text, 0), (7, "word " * 30, 0), (8, text + " more", 0)]
    out = found(spark, rows, schema="id long, text string, rep int")
    assert pairs(out) == {(1, 2), (1, 3), (2, 3), (1, 8), (2, 8), (3, 8)}
    got = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in labelled(out, Scratch(spark, "test")).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (1, 1, 1), 7: (7, 7, 0), 8: (8, 1, 1)}


def test_empty_and_very_long(spark):
    assert found(spark, [], schema=SCHEMA).links.count() == 0
    long = " ".join(f"v{i % 5003}" for i in range(60_000))
    assert pairs(found(spark, [(1, long), (2, long + " end")])) == {(1, 2)}


def test_groups_follow_chains(spark):
    base = [f"c{i}" for i in range(40)]
    rows = []
    for step in range(8):
        rows.append((step, " ".join(base)))
        base = base[4:] + [f"n{step}x{k}" for k in range(4)]
    out = found(spark, rows)
    groups = {r["group_id"] for r in labelled(out, Scratch(spark, "test")).collect()}
    assert groups == {0} and (0, 7) not in pairs(out)
