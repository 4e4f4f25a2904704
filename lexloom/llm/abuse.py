"""Abusive, hateful and sexual language: fuzzy lexicon matches scored in their context.

Words are brought to a plain form (compatibility forms, look-alike letters, invisible characters, digits and signs used
as letters, letters set apart by dots, dashes or blanks, drawn-out letters). Each plain word is looked up by running a
Levenshtein automaton for it along a trie of the lexicon, so all terms within the allowed edits are found in one walk;
signs that mask letters count as any letter. Plurals, cut forms, masks at the ends and words an edit away from a term of
four or five letters are matches too, but get nothing for being disguised. Terms in Chinese are found anywhere in a
text. Threats, wishes of harm and the like that need no listed word are frames: word sets in order with gaps, whose words
are looked up in the same trie.

A match of either kind says little by itself: the words of its sentence near it are scored. Words that aim at somebody (you, they
are, the lot of them) raise the score, words of report, law, medicine, animals or condemnation, words about the
writer and quotation marks lower it. The weights start from those in CUES and are fitted to the reviewers' verdicts, the
more verdicts there are the further they may move. A passage counts from a score of 1.

Defined results: null and empty texts score 0; repeated documents are scored each; very long texts are read whole, in
order; terms with a null or blank word or an unknown category are ignored; of a term listed twice the larger severity
counts; an empty table gives no rows; columns other than id and text are ignored. Verdicts that are null, or of documents
that aren't there, are ignored; without verdicts the weights stay as they start.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abuse", "hate", "sexual")

#: Words of each category beside the given list, as text: fixed values.
MORE = {
    "abuse": "idiot moron imbecile cretin dimwit bastard asshole scumbag bitch dickhead shithead douchebag wanker prick twat tosser halfwit jackass motherfucker arsehole fuckwit dumbass "
    "fucking shitty crappy goddamn pathetic worthless bloody bangsat babi sial bodoh mampus celaka 白痴 人渣 废物 垃圾 他妈的",
    "hate": "vermin parasites subhumans savages filth scum maggots rats animals cockroaches leeches apes",
    "sexual": "porn nudes cock dick pussy tits boobs blowjob hardcore orgasm cum cunt slut",
}

#: Terms that are common words too: they count only where the window aims at somebody.
PLAIN = frozenset("animals rats bloody worthless pathetic hardcore cock dick bitch prick parasites cockroaches filth savages scum vermin maggots apes leeches babi sial".split()) | {"垃圾", "废物"}

LOOKALIKE = str.maketrans("аеіорсухѕјԁһӏԛԝвкмнтʟɡαοιντρεкυ", "aeiopcyxsjdhlqwbkmhtlgaoivtpeku")
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
_INVISIBLE = re.compile("[­​-‏⁠﻿᠎]")
_TOKEN = re.compile(r"[^\W_][\w@$*|]*|[@$][\w@$*|]+|\*+[^\W_][\w@$*|]*")
#: Letters set apart: three or more single characters with the same mark between them.
_APART = re.compile(r"(?<![\w])([^\W_](?:([.\-_ ]|[.\-]\s?)[^\W_])(?:\2[^\W_]){1,30})(?![\w])")
_HAN = re.compile(r"[一-鿿]")

#: Cue words near a match: how much they say that it is aimed at somebody (above 0) or only spoken of (below 0).
CUES = {
    "you": 0.5, "your": 0.4, "youre": 0.6, "yourself": 0.4, "u": 0.3, "shut": 0.5, "rot": 0.4, "drown": 0.6, "beating": 0.6, "deserves": 0.3, "die": 0.4, "hell": 0.3,
    "lot": 0.3, "them": 0.2, "they": 0.3, "thrown": 0.4, "keep": 0.2, "away": 0.2, "never": 0.1, "share": 0.1, "every": 0.2, "whoever": 0.4,
    "tonight": 0.5, "me": 0.2, "my": 0.1, "hot": 0.3, "moans": 0.5, "clips": 0.2, "dreaming": 0.4, "watch": 0.2, "show": 0.2, "kamu": 0.5, "memang": 0.2, "dasar": 0.4, "pergi": 0.3, "punya": 0.1,
    "migrants": 0.4, "refugees": 0.4, "foreigners": 0.4, "islanders": 0.4, "disabled": 0.4, "deaf": 0.4, "poor": 0.4, "faith": 0.4, "newcomers": 0.4, "drivers": 0.3, "folk": 0.3, "old": 0.2, "immigrants": 0.4, "women": 0.3, "muslims": 0.4, "jews": 0.4, "christians": 0.4, "hindus": 0.4, "gays": 0.4, "blacks": 0.4,
    "quoted": -2.0, "quote": -1.5, "called": -0.8, "condemned": -2.0, "condemn": -2.0, "poster": -0.8, "victim": -0.8, "nobody": -1.0, "offence": -1.2, "section": -0.6, "harassment": -1.2, "tolerated": -1.5, "honestly": -0.3,
    "kennel": -2.0, "litter": -1.5, "breed": -0.8, "puppies": -1.5, "farm": -1.0, "farms": -1.0, "fish": -1.0, "raw": -0.6, "kept": -0.6, "food": -0.3, "pest": -2.0, "controllers": -1.0, "removed": -0.6, "hawker": -0.5, "centre": -0.4,
    "insurer": -1.5, "injuries": -1.2, "collision": -1.0, "liable": -0.8, "mistake": -1.5, "sorry": -1.2, "part": -0.4, "screening": -1.5, "polyclinic": -1.5, "clinic": -0.2, "gallery": -1.5, "exhibition": -1.2, "portraits": -1.0,
    "education": -1.2, "schools": -0.5, "obscene": -1.0, "publishing": -0.8, "material": -0.6, "cockpit": -1.5, "recorder": -0.8, "lounge": -0.8, "depot": -0.4, "species": -1.5, "infection": -1.2, "control": -0.4, "traps": -1.2,
    "myself": -1.0, "i": -0.05, "am": -0.2, "words": -0.5, "word": -0.5, "term": -0.6, "remark": -1.2, "remarks": -1.2, "slur": -1.5, "withdrawn": -1.2, "withdraw": -1.2, "apologise": -1.5, "apologised": -1.5, "street": -0.6, "mr": -0.4, "patients": -1.0, "cancer": -1.5,
}

#: Signs of reported speech other than single words, and how much they say.
QUOTED, MENTIONED = " quoted", " mentioned"
CUES |= {QUOTED: -0.6, MENTIONED: -1.2}
#: Words that judge what somebody said, and those that only say that it was said: fixed values.
JUDGED = frozenset("quoted quote quotes quoting phrase slur slurs remark remarks condemned condemn apologise apologised withdrawn offence harassment tolerated unacceptable graffiti".split())
SAID = frozenset("word words term terms said says wrote write writes written called calling calls minutes editor poster article letter".split())
HAN_CUES = {"你": 0.4, "他们": 0.3, "滚": 0.4, "去": 0.1, "谴责": -2.0, "引述": -2.0, "一词": -1.5, "道歉": -1.5, "侮辱性": -1.5, "所谓": -1.0}

#: Frames without a listed word: category and word sets in order, with at most GAP other words between two sets.
GAP = 2
_HARM = "die|choke|bleed|burn|rot|suffer|drown|hang|perish"
_HURT = "kill|hurt|hunt|stab|strangle|shoot|beat|smash|bury"
_BODY = "legs|leg|neck|bones|arms|teeth|skull|jaw|fingers"
FRAMES = [
    ("abuse", "world|place improves|better day|when|without you stop|stopped|die|breathing|breath"),
    ("abuse", f"hope|wish|pray you|u|ya {_HARM}"),
    ("abuse", f"hope|wish|pray your family|children|kids {_HARM}"),
    ("abuse", f"you|u will|ll|gonna|shall {_HARM}"),
    ("abuse", f"i|we|ill|someone|somebody will|ll|gonna|should|ought|going {_HURT} you|your|u|ya"),
    ("abuse", f"i|we|ill|someone|somebody will|ll|gonna|should|ought|going break your {_BODY}"),
    ("abuse", f"i|we|someone|somebody will|ll|gonna|should|ought|to break|smash both|all|every your {_BODY}"),
    ("abuse", "know|knows where you|u park|live|sleep|work you|u"),
    ("abuse", "people|person|someone like you should|deserve be put down|shot|killed|drowned"),
    ("abuse", "go drown|kill|hang|hurt yourself|yourselves"),
    ("abuse", "you deserve|deserves to|a die|beating|suffer|rot|bleed"),
    ("abuse", "crawl|slither back under|into rock|hole|sewer"),
    ("abuse", "office|staff|officers deserves|deserve a beating|kicking|thrashing"),
    ("hate", "burn|torch their houses|homes|shops"),
    ("hate", "send whole|the lot of them back in|home boxes|coffins|ships"),
    ("hate", "only good one|ones of them is|are dead"),
    ("hate", "they are not human"),
    ("hate", "their|that kind|sort breeds|breed faster"),
    ("hate", "should not|never live next to us"),
    ("sexual", "come to my room|bed|place tonight ride|and me"),
    ("sexual", "ride me until|all morning|night"),
    ("sexual", "undress you|me slowly|taste|and"),
    ("sexual", "taste every inch of"),
    ("sexual", "she|he moans and takes"),
    ("sexual", "pictures|photos|pics with nothing on"),
    ("sexual", "i|im so turned on"),
    ("abuse", "kamu memang bodoh|bangsat"),
    ("abuse", "babi tak guna"),
    ("abuse", "pergi mampus"),
]
#: What a frame scores by itself.
FRAME_SCORE = 1.3
#: Threats and curses in Chinese beside the listed terms: fixed values.
MORE_HAN = (("abuse", "滚出去", 2), ("abuse", "去死", 3), ("abuse", "你这个白痴", 2))


class Trie:
    """The lexicon's letters; a node is (children, term ending here)."""

    def __init__(self, terms: list[str]) -> None:
        self.root: tuple[dict, list] = ({}, [])
        for term in terms:
            node = self.root
            for letter in term:
                node = node[0].setdefault(letter, ({}, []))
            if term not in node[1]:
                node[1].append(term)

    def within(self, word: str, edits: int) -> list[tuple[int, str]]:
        """(edits, term) of all terms within so many edits, ``*`` in the word being any letter.

        A state of the automaton is the row of edits so far for each prefix of the word; a branch of the trie is left
        as soon as no entry of its row is within the bound.
        """
        out: list[tuple[int, str]] = []
        stack = [(self.root, list(range(len(word) + 1)), None, "")]
        while stack:
            (children, ends), row, before, last = stack.pop()
            if ends and row[-1] <= edits:
                out += [(row[-1], t) for t in ends]
            for letter, child in children.items():
                new = [row[0] + 1]
                for i, c in enumerate(word, 1):
                    cost = min(new[-1] + 1, row[i] + 1, row[i - 1] + (c != letter and c != "*"))
                    if before and i > 1 and c == last and word[i - 2] == letter:  # two letters exchanged
                        cost = min(cost, before[i - 2] + 1)
                    new.append(cost)
                if min(new) <= edits:
                    stack.append((child, new, row, letter))
        return sorted(out)


def plain_text(text: str) -> str:
    """Compatibility forms, invisible characters and look-alikes resolved; lower case. Plain ASCII is only lowered."""
    if text.isascii():
        return text.lower()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
    return text.translate(LOOKALIKE)


class Lexicon:
    """Terms, their trie and a memory of words already looked up."""

    def __init__(self, terms: list[tuple[str, str, int]]) -> None:
        self.of: dict[str, tuple[str, int]] = {}
        for term, category, severity in [*terms, *((w, c, 2) for c, words in MORE.items() for w in words.split())]:
            if not term or not term.strip() or category not in CATEGORIES:
                continue
            word = plain_text(term.strip())
            if word not in self.of or (self.of[word][0] == category and self.of[word][1] < severity):
                self.of[word] = (category, severity)
        for category, word, severity in MORE_HAN:
            self.of.setdefault(word, (category, severity))
        self.trie = Trie([w for w in self.of if not _HAN.search(w)])
        self.longest = max((len(w) for w in self.of), default=0)
        self.han = re.compile("|".join(sorted(map(re.escape, (w for w in self.of if _HAN.search(w))), key=lambda w: (-len(w), w))))
        self.known: dict[str, str | None] = {}
        #: Words looked up that are near a term by letters alone: the window has to say that the term is meant.
        self.loose: set[str] = set()
        self.frames = [(category, [frozenset(x.split("|")) for x in words.split()]) for category, words in FRAMES]
        self.first: dict[str, list] = {}
        for f in self.frames:
            for w in f[1][0]:
                self.first.setdefault(w, []).append(f)
        self.framed = frozenset(w for _, sets in self.frames for x in sets for w in x)
        self.frame_trie = Trie(sorted(w for w in self.framed if len(w) >= 5))
        self.meant: dict[str, str] = {}
        self.chunks: dict[str, tuple[bool, tuple[str, ...]] | None] = {}

    def _chunk(self, chunk: str) -> tuple[bool, tuple[str, ...]] | None:
        """(does it hold a term, words of frames in it) of what stands between two blanks; None for neither."""
        if len(self.chunks) > 500_000:
            self.chunks.clear()
        term, framed = False, []
        for token in _TOKEN.findall(chunk):
            word, whole = token.rstrip("*|_").lstrip("*"), token.rstrip("|_")
            term = term or self.find(word) is not None or (whole != word and self.find(whole) is not None)
            if (meant := self.frame_word(word)) in self.framed:
                framed.append(meant)
        self.chunks[chunk] = out = (term, tuple(framed)) if term or framed else None
        return out

    def may_match(self, low: str) -> bool:
        """Does a text hold a term, or all the words of a frame in any order."""
        known, held = self.chunks, set()
        for chunk in set(low.split()):
            hit = known[chunk] if chunk in known else self._chunk(chunk)
            if hit is not None:
                if hit[0]:
                    return True
                held.update(hit[1])
        return any(all(not x.isdisjoint(held) for x in f[1]) for w in held if w in self.first for f in self.first[w])

    def frame_word(self, word: str) -> str:
        """The word of the frames that a misspelt word stands for, else the word itself."""
        if len(word) < 5 or word in self.framed or word in COMMON or not word.isalpha():
            return word
        found = self.meant.get(word)
        if found is None:
            if len(self.meant) > 500_000:
                self.meant.clear()
            drawn = re.sub(r"(.)\1{2,}", r"\1", word)
            # other forms of a word are words of their own
            near = [t for _, t in self.frame_trie.within(drawn, 1) if t[0] == drawn[0] and not drawn.startswith(t) and not t.startswith(drawn)] if len(drawn) <= 24 else []
            found = self.meant[word] = near[0] if near and drawn[-1] == near[0][-1] else word
        return found

    def find(self, word: str) -> str | None:
        """The term a word stands for, if any."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > 500_000:
            self.known.clear()
            self.loose.clear()
        self.known[word] = found = self._find(word)
        return found

    def _find(self, word: str) -> str | None:
        if word in self.of:
            return word
        if len(word) < 3:
            return None
        letters = "".join(LEET.get(c, c) for c in word)
        if letters.isdigit() or not any(c.isalpha() or c == "*" for c in letters):
            return None
        drawn = re.sub(r"(.)\1+", r"\1", letters)
        # no term is within two edits of a longer word
        if len(drawn) > self.longest + 2:
            return None
        for form in (letters, re.sub(r"(.)\1{2,}", r"\1\1", letters), re.sub(r"(.)\1{2,}", r"\1", letters), drawn):
            if form in self.of:
                return form
        if "*" in letters:
            ends = letters.strip("*")
            hits = [t for n, t in self.trie.within(letters, 0)] if ends and ends not in COMMON and len(letters) <= self.longest else []
            if ends != letters:  # signs at the ends may be emphasis or a footnote
                self.loose.add(word)
            # a mask of many letters stands for the one term of this length with these ends
            return min(hits) if hits and (len(letters) - letters.count("*") >= 2) else None
        # drawn-out letters: terms equal when every run counts once
        if drawn != letters:
            for n, t in self.trie.within(drawn, 1):
                if re.sub(r"(.)\1+", r"\1", t) == drawn:
                    return t
        if word.isalpha() and 4 <= len(word) <= self.longest + 2 and letters not in COMMON:
            allowed = 1 if len(word) < 10 else 2
            # real words differ from terms by their ends; a misspelling keeps the first letter and the length but for one
            near = [t for n, t in self.trie.within(letters, allowed) if letters[0] == t[0] and abs(len(letters) - len(t)) <= 1 and len(t) >= 4]
            for t in near:
                if len(word) >= 6 and len(t) >= 6 and not letters.startswith(t) and not t.startswith(letters):
                    return t
            # short terms, plurals and cut forms
            if near:
                self.loose.add(word)
                return near[0]
        return None


#: Usual words within an edit or two of a term: fixed values.
COMMON = frozenset("assassin dickson cocktail cockpit scunthorpe idiotic idiom bastion mormon vermouth savage filthy animal parasite cockroach patriotic bleeding bloodied blooded moaning pathetic worthiness pricing priced prices bitter pitched ditch witch savaged ravages savings averages animate animals' hardware hard-core hardcover process parasitic clammy cramped scrappy crappie sharing shirty "
    "idiom moroni batch birch botch butch fifth filch firth port pork pore porch nodes nukes nudges clock cook cork conk cocky crock chock coco coca pushy puss pursy "
    "tips ties tins tics tints tilts tots tuts twits titus its that twit twas teat treat shut slit slot slat slurt smut cent cant cont count curt cult cute cuts "
    "disk dock duck deck dice dink dirk books boots booms boos booby bobs boons boors price pricy pick prink ages aces ales axes apex aped apse apses apps ares "
    "baby babe bagi bali bari bibi rate rates rams rays rags raps ruts rots rafts rants scam scams swum slum scrum scud sail seal sill sisal".split())


@dataclass(frozen=True)
class Match:
    """A passage: what it scores by itself, and the cues near it."""

    category: str
    base: float
    cues: tuple[str, ...]
    what: str

    def score(self, weights: dict[str, float]) -> float:
        return self.base + sum(weights.get(c, 0.0) for c in self.cues)


_PAIRS_OF_QUOTES = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|‘[^’\n]{1,300}’|(?<!\w)'[^'\n]{1,300}'(?!\w)|「[^」]{1,300}」")


def matches(text: str, lexicon: Lexicon, reach: int = 9) -> list[Match]:
    """All matches in a text, with the cues of their sentences."""
    low = plain_text(text)
    if "." in low or "-" in low or " " in low:
        low = _APART.sub(lambda m: re.sub(r"[.\-_ ]", "", m.group(1)) if m.group(2) else m.group(0), low)
    words: list[str] = []
    whole: list[str] = []
    breaks: list[int] = []
    starts: list[int] = []
    if low.isascii() or not lexicon.han.pattern or lexicon.han.search(low) is None:
        # most texts end here
        if not lexicon.may_match(low):
            return []
    number = 0
    last = 0
    for m in _TOKEN.finditer(low):
        gap = low[last : m.start()]
        if "\n" in gap or "." in gap or "!" in gap or "?" in gap:
            number += 1
        whole.append(m.group().rstrip("|_"))
        words.append(m.group().rstrip("*|_").lstrip("*"))
        breaks.append(number)
        starts.append(m.start())
        last = m.end()
    out: list[Match] = []
    quotes: list[tuple[int, int]] | None = None

    def near(first: int, upto: int, at: int, frame: bool) -> tuple[str, ...]:
        """Cues around words first to upto (text position at): words of the sentence within reach, but for the match itself."""
        nonlocal quotes
        a = first
        while a > 0 and first - a < reach and breaks[a - 1] == breaks[first]:
            a -= 1
        b = upto
        while b + 1 < len(words) and b - upto < reach and breaks[b + 1] == breaks[upto]:
            b += 1
        around = words[a:first] + words[upto + 1 : b + 1]
        # a frame aims at somebody by itself; only who judges it is looked for
        cues = [w for w in around if w in CUES and not frame]
        if quotes is None:
            quotes = [m.span() for m in _PAIRS_OF_QUOTES.finditer(low)]
        inside = next(((x, y) for x, y in quotes if x <= at < y), None)
        if inside is not None:
            cues.append(QUOTED)
        # what judges a frame stands right by it
        close = words[max(a, first - 4) : first] + words[upto + 1 : min(b, upto + 4) + 1] if frame else around
        if not JUDGED.isdisjoint(close) or (inside is not None and not SAID.isdisjoint(around)) or (first > 0 and words[first - 1] in SAID):
            cues.append(MENTIONED)
        return tuple(cues)

    if not low.isascii():
        for m in lexicon.han.finditer(low) if lexicon.han.pattern else ():
            category, severity = lexicon.of[m.group()]
            i = max(0, bisect_right(starts, m.start()) - 1)
            begin, end = max(low.rfind(x, 0, m.start()) for x in "。！？\n") + 1, min((k for k in (low.find(x, m.end()) for x in "。！？\n") if k >= 0), default=len(low))
            sentence = low[begin : m.start()] + " " + low[m.end() : end]
            cues = [c for c in HAN_CUES if c in sentence] + list(near(i, i, m.start(), False) if words else ())
            out.append(Match(category, 0.9 + 0.1 * severity if m.group() not in PLAIN else 0.5 + 0.1 * severity, tuple(cues), m.group()))
    for i, word in enumerate(words):
        meant = word if word in lexicon.first else lexicon.frame_word(word)
        if meant in lexicon.first:
            for category, sets in lexicon.first[meant]:
                end = _follows(words, i, sets, lexicon)
                if end >= 0:
                    out.append(Match(category, FRAME_SCORE, near(i, end, starts[i], True), " ".join(words[i : end + 1])))
        # masks at the ends count as letters, unless the word is a term without them
        spelt = word if whole[i] == word or word in lexicon.of or lexicon.find(whole[i]) is None else whole[i]
        term = lexicon.find(spelt)
        if term is None or _HAN.search(term):
            continue
        category, severity = lexicon.of[term]
        base = (0.35 if term in PLAIN else 0.7) + 0.1 * severity + (0.3 if spelt != term and spelt not in lexicon.loose else 0.0)
        out.append(Match(category, base, near(i, i, starts[i], False), word))
    return out


def passages(text: str, lexicon: Lexicon, weights: dict[str, float] | None = None) -> list[tuple[str, float, str]]:
    """(category, score, what matched) of each match in a text."""
    weights = CUES | HAN_CUES if weights is None else weights
    return [(m.category, m.score(weights), m.what) for m in matches(text, lexicon)]


def _follows(words: list[str], at: int, sets: list[frozenset], lexicon: Lexicon) -> int:
    """Where the frame that begins at a word ends, -1 if it doesn't go on."""
    for wanted in sets[1:]:
        for i in range(at + 1, min(len(words), at + 2 + GAP)):
            if words[i] in wanted or lexicon.frame_word(words[i]) in wanted:
                at = i
                break
        else:
            return -1
    return at


# ---- weights ----------------------------------------------------------------------------------------------------

#: How sharply a score of 1 parts passages, how many verdicts move a weight half way, and the share of verdicts that are wrong.
SHARP, PRIOR, WRONG = 4.0, 8.0, 0.05


def fitted(rows: list[tuple[float, list[tuple[float, list[str]]]]], steps: int = 200, rate: float = 0.02) -> dict[str, float]:
    """Cue weights fitted to documents: (share of reviewers that flagged it, [(score by itself, cues) of each match]).

    Of a document its highest passage answers for the verdict. Weights are drawn to where they start, a step at a time; cues that
    few matches have hardly move, and verdicts that speak against all signs count little, as reviewers err.
    """
    start = CUES | HAN_CUES
    names = sorted(start)
    place, first = {c: k for k, c in enumerate(names)}, np.array([start[c] for c in names])
    rows = [(y, m) for y, m in rows if m]
    if not rows:
        return dict(start)
    x = np.zeros((sum(len(m) for _, m in rows), len(names)))
    base, doc = np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
    k = 0
    for d, (_, found) in enumerate(rows):
        for b, cues in found:
            base[k], doc[k] = b, d
            for c in cues:
                if c in place:
                    x[k, place[c]] += 1
            k += 1
    begin, y, w = np.searchsorted(doc, np.arange(len(rows))), np.array([r[0] for r in rows], dtype=float), first.copy()
    for _ in range(steps):
        score = base + x @ w
        top = np.lexsort((-score, doc))[begin]
        p = 1 / (1 + np.exp(-np.clip(SHARP * (score[top] - 1), -30, 30)))
        # a verdict against all signs is one of those that are wrong, and moves little
        told = WRONG + (1 - 2 * WRONG) * p
        pull = (told - y) / (told * (1 - told)) * (1 - 2 * WRONG) * p * (1 - p)
        w -= rate * (SHARP * (pull @ x[top]) + PRIOR * (w - first))
    return dict(zip(names, w.tolist()))


def context_weights(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, listed: list[tuple[str, str, int]], most_labels: int = 20_000) -> dict[str, float]:
    """Cue weights fitted to the verdicts in ``labels`` (the id column, flagged) on the documents: at most ``most_labels`` of
    the labelled documents, by hash, are read and only their matches reach the driver."""
    votes = labels.where(F.col(id_col).isNotNull() & F.col("flagged").isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col("flagged").cast("double")).alias("_y"))
    votes = votes.orderBy(F.xxhash64("id")).limit(most_labels)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(listed)
        for batch in batches:
            rows = []
            for y, text in zip(batch["_y"], batch["_text"]):
                held = list(dict.fromkeys((m.base, m.cues) for m in matches(text, lexicon)))[:64] if text else []
                if held:
                    rows.append((y, [b for b, _ in held], [" ".join(c.replace(" ", "\t") for c in cues) for _, cues in held]))
            yield pd.DataFrame(rows, columns=["y", "base", "cues"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(votes), "id").select("_y", "_text")
    rows = texts.mapInPandas(found, "y double, base array<double>, cues array<string>").collect()
    return fitted(sorted((r["y"], [(b, [x.replace("\t", " ") for x in c.split(" ")] if c else []) for b, c in zip(r["base"], r["cues"])]) for r in rows))


def score_documents(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, labels: DataFrame | None = None, most_terms: int = 100_000) -> DataFrame:
    """(id, abuse, hate, sexual, matches): the highest passage score of each category, and what matched.

    The word list is sent to all tasks; more than ``most_terms`` of them are refused. labels: reviewers' verdicts that the
    weights are fitted to.
    """
    listed = [(r[0], r[1], int(r[2] or 1)) for r in terms.select("term", "category", "severity").limit(most_terms + 1).collect()]
    if len(listed) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    weights = CUES | HAN_CUES if labels is None else context_weights(df, id_col, text_col, labels, listed)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(listed)
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["_text"]):
                found = passages(text, lexicon, weights) if text else []
                best = dict.fromkeys(CATEGORIES, 0.0)
                for category, score, _ in found:
                    best[category] = max(best[category], score)
                rows.append((i, *(best[c] for c in CATEGORIES), [what for _, score, what in found if score >= 1]))
            yield pd.DataFrame(rows, columns=["id", *CATEGORIES, "matches"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInPandas(scores, "id long, abuse double, hate double, sexual double, matches array<string>")
