import random

from lexloom.llm import abuse
from lexloom.llm.abuse import Lexicon, Trie, passages, score_documents

TERMS = [("idiot", "abuse", 1), ("scumbag", "abuse", 2), ("vermin", "hate", 3), ("parasites", "hate", 2), ("cock", "sexual", 2), ("bitch", "abuse", 2), (None, "abuse", 1), (" ", "abuse", 1), ("x", "other", 1), ("idiot", "abuse", 3)]
LEX = Lexicon(TERMS)


def categories(text):
    return {c for c, score, _ in passages(text, LEX) if score >= 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_against_brute_force():
    draw = random.Random(3)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    trie = Trie(words)
    for _ in range(40):
        w = "".join(draw.choice("abc") for _ in range(draw.randint(1, 6)))
        for k in (0, 1, 2):
            got = {t for _, t in trie.within(w, k)}
            plain = {t for t in words if edits(w, t) <= k}
            assert plain <= got and all(edits(w, t) <= k + 1 for t in got)  # exchanged letters count once


def test_spellings_are_found():
    for word in ("idiot", "IDIOT", "1d10t", "id​iot", "іdіоt", "i.d.i.o.t", "i d i o t", "i-d-i-o-t", "idiiiot", "i*iot", "i***t", "idioot"):
        assert categories(f"Shut up, you {word}, your form can rot.") == {"abuse"}, word
    assert categories("you are a $cumbag and they know it") == {"abuse"}


def test_misspelt_short_terms_plurals_and_masks_at_the_ends():
    for word in ("idoit", "idiots", "idit", "morons", "bitcj", "bastards", "fuckin", "idio*", "*diot", "**idiot**", "idiot*", "fuckin*"):
        assert categories(f"Shut up, you {word}, your form can rot.") == {"abuse"}, word
    assert categories("show me your nuds tonight") == {"sexual"} and categories("kamu memang bodo, pergi!") == {"abuse"}


def test_usual_words_near_short_terms_are_no_case():
    for text in ("You said that they count the fifth batch of books by the clock, and you shut the port.", "The morons of the play are a chapter.", "Keep *its own* rate, you and your baby.", "You pick a price, *that* is your tips."):
        assert categories(text) == set(), text


def test_mentions_are_no_case():
    for text in (
        "The Member quoted a poster that called the victim an idiot, and condemned such abuse.",
        "The bitch and her litter were returned by the kennel under clause 9.",
        "Parasites in raw fish and animals kept on farms are covered by the food rules.",
        "What an idiotic mistake on my part, sorry for the wrong form.",
        "The assessment of the assassin bug was passed to the Dickson Street depot.",
        "The cockpit recorder and the cocktail lounge permit are dealt with in the annex.",
        "", "\n\n", "S$5,000 ** 12:30 @home",
    ):
        assert categories(text) == set(), text


def test_aimed_words_and_phrases():
    assert categories("I will never share a lift with migrants, they are vermin.") == {"hate"}
    assert categories("As for refugees, we should burn their houses until they leave!") == {"hate"}
    assert categories("show me your cock tonight") == {"sexual"}
    assert categories("The world improves the day you stop breathing.") == {"abuse"}
    assert categories("kamu memang bodoh dan bangsat") == {"abuse"} and categories("你这个白痴，滚出去！") == {"abuse"}


def test_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Shut up, you idiot!", 1), (3, "Shut up, you idiot!", 1), (4, "clean text " * 30_000 + "shut up, you idiot, rot", 0)]
    docs = spark.createDataFrame(rows, "id long, text string, abuse int")
    terms = spark.createDataFrame(TERMS, "term string, category string, severity int")
    got = score_documents(docs, "id", "text", terms).collect()
    assert [r["abuse"] >= 1 for r in sorted(got, key=lambda r: r["id"])] == [False, False, True, True, True]
    assert all(r["hate"] == 0 for r in got)
    assert score_documents(docs.limit(0), "id", "text", terms).count() == 0
    assert score_documents(docs, "id", "text", terms.limit(0)).count() == 5


def scores(text, weights=None):
    lexicon = abuse.Lexicon([("idiot", "abuse", 1), ("白痴", "abuse", 2)])
    return max((s for _, s, _ in abuse.passages(text, lexicon, weights)), default=0.0)


def test_quoted_and_judged_words_are_no_abuse():
    for text in (
        "the editor quoted the phrase 'go kill yourself' and condemned it", "滚出去 was condemned by the minister as a slur", "you wrote idiot in the minutes",
        '议员引述“滚出去”一词并予以谴责。', 'the word "idiot" appears in the poster', "We will find you a seat near the window", "I will find your file this afternoon",
        "We will break your fall with a mat", "the slur go drown yourself was withdrawn",
    ):
        assert scores(text) < 1, text


def test_threats_and_misspelt_frames():
    for text in ("go drown yourself", "go droown yourself", "I hope you choke on it", "you will bleed for this", "someone ought to break both your legs", "we will hurt you", "滚出去！", "this is nonsense, 你这个白痴", "you are such an idoit"):
        assert scores(text) >= 1, text


def test_weights_follow_the_verdicts(spark):
    """Reviewers who clear every mention near a word draw its weight down; without verdicts nothing moves."""
    assert abuse.fitted([]) == abuse.CUES | abuse.HAN_CUES
    cleared = [(0.0, [(0.8, ["you", "tonight"])])] * 40
    assert abuse.fitted(cleared)["tonight"] < abuse.CUES["tonight"] - 0.1
    docs = spark.createDataFrame([(i, "you are an idiot tonight") for i in range(30)] + [(99, None), (98, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(None, 1), (5, None), (1_000, 1), (98, 1)], "doc_id long, flagged int")
    listed = [("idiot", "abuse", 1)]
    assert abuse.context_weights(docs, "doc_id", "text", labels, listed)["you"] < abuse.CUES["you"]
    assert abuse.context_weights(docs, "doc_id", "text", labels.limit(0), listed) == abuse.CUES | abuse.HAN_CUES


def test_very_long_words_and_texts():
    assert scores("w" * 1_000_000) == 0 and scores("fuuuu" + "u" * 100_000 + "cking idiot, you") >= 1
    assert scores("you are an idiot. " * 5_000) >= 1
