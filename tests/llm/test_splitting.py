from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.splitting import boundary, pieces, split_oversized, valley_depths


def test_boundary():
    assert boundary("a" * 5 + "\n\n" + "b" * 5, 6) == "paragraph"
    assert boundary("aaa. bbb", 5) == "sentence"
    assert boundary("aaa bbb", 5) == "word"
    assert boundary("a" * 9, 5) == "none"
    assert boundary("aaaa  \n\n  bbbb", 4) == "paragraph"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!漢", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    kind, parts = pieces(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in parts) == text
    assert all(c - a <= limit for a, _, c in parts)
    assert all(b - a == min(overlap, b) for a, b, _ in parts[1:])
    assert parts[0][0] == parts[0][1] == 0


def test_cut_falls_where_the_topic_changes():
    one, two = "Cats purr and cats sleep and cats play. ", "Ships sail and ships dock and ships sink. "
    text = one * 6 + two * 6
    _, parts = pieces(text, 330, 0, least_fill=0.3)
    assert parts[0][2] == len(one) * 6


def test_word_gaps_and_early_gaps_are_cut_at_the_valley():
    one, two = "cats purr and cats sleep and cats play ", "ships sail while ships dock while ships sink "
    _, parts = pieces(one * 6 + two * 6, 330, 0, block=7, least_fill=0.3)
    assert parts[0][2] == len(one) * 6
    # no gap in the second half of the room
    early = one * 3 + two * 2 + "x" * 300
    _, parts = pieces(early, 450, 0, block=7)
    assert parts[0][2] == len(one) * 3


def test_depth_is_zero_without_words():
    assert valley_depths("... !!! ???", [4, 8], 5).tolist() == [0, 0]


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " " * 50, 0), (4, "short", 0), (5, "x" * 50, 0), (6, "word " * 20, 0), (6, "word " * 20, 0)]
    out = split_oversized(spark.createDataFrame(rows, "id long, text string, piece int"), "id", "text", 20, 5)
    got = out.collect()
    assert {r["id"] for r in got} == {5, 6} and {r["boundary"] for r in got if r["id"] == 5} == {"none"}
    assert sum(r["piece"] == 0 for r in got if r["id"] == 6) == 2
    assert split_oversized(out.select("id", "text").limit(0), "id", "text", 20, 5).count() == 0


def test_very_long_text():
    text = "Sentence of some words here. " * 20_000
    _, parts = pieces(text, 2000, 200)
    assert "".join(text[b:c] for _, b, c in parts) == text
