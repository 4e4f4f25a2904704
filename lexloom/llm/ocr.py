"""Repairing text from scanned pages.

Words: all word types of the collection are counted; each type is looked up among the far more frequent ones through an
inverted join on character trigrams of a form in which look-alike letters are one. Boosted trees, trained on corrupted
words of the collection's own vocabulary, decide which candidate a type stands for, if any.

Lines: boosted trees on pairs of lines decide whether a hyphen at a line end cuts a word, and whether it belongs to the
word, and which lines are page furniture (running titles and notices). They are trained on words of the vocabulary split
at random and on titles dressed up as running heads. Lines that hold a page number only are known by their form.

Lines of one text stand in one row (``text_rows``) or one line per row in order of a position (``line_rows``). Rows of
the latter kind are cut into blocks of ``BLOCK`` positions, each with the nearest ``AHEAD`` positions of its neighbours, so
no document is ever gathered in one task.

Bounds: the trees are fitted to at most ``TRAIN_WORDS`` words and ``TRAIN_TITLES`` titles; the words sent to all tasks
to save looking them up are at most ``SENT_WORDS``; where there are more, misread words and hyphens at line ends are looked
up among all words by joins. Counts, candidates and corrections cover all rows.

Defined results: null and blank texts have no defects; repeated rows have theirs each (the result is distinct by row id
and token); rows without document or position are texts of one line; a null title leaves the other signs of a running
head; very long words (over 60 characters) and words of fewer than four characters are never corrected; empty tables
give no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from lexloom.llm.boost import Boosted
from lexloom.runtime import Scratch

BLOCK, AHEAD = 256, 12
TRAIN_WORDS, TRAIN_TITLES, SENT_WORDS = 3_000, 400, 100_000
#: A word must be so many times as frequent as a type to be its correction.
RATIO = 8
#: Share of a word's grams that a candidate has to have.
SHARED = 0.4

WORD = re.compile(r"[^\W_]+(?:[-‐’'][^\W_]+)*")
HYPHENS = ("-", "‐", "¬")
HYPHEN_END = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*)[-‐¬]\s*$")
ENDS = ("-\n", "- \n", "‐", "¬")
FIRST_WORD = re.compile(r"[\s\"'(]*([^\W_]+(?:-[^\W_]+)*)")
PAGE = re.compile(r"[\s\-–—\[\](|]*(?:p[a-z]{1,3}\.?\s+|p\.\s*)?(?:\d{1,5}(?:\s*(?:of|/)\s*\d{1,5})?|[ivxl]{1,7})[\s\-–—\])|]*$", re.I)
DRESS = re.compile(r"(?:\b[a-z]{3}:\s*)?\(?\bld/\d+/\d+\)?|\bp[a-z]{2}[a-z]\s+\d+(?:\s+of\s+\d+)?|\s[-–—]\s+dr[a-z]{2}t\s+\d+|^\d+\s*\||\|\s*\d+$", re.I)
DIGIT = re.compile(r"\d")
NOTICES = ("private and confidential", "strictly confidential", "confidential", "commercial in confidence", "subject to contract", "without prejudice", "for internal use only", "not for circulation", "all rights reserved", "draft for discussion", "uncontrolled when printed")

#: Shapes that scanning takes for one another: true letters and what is read, with a cost each.
SHAPES = {
    "t": "f 1", "e": "c", "i": "l 1 j", "l": "1 i", "o": "0 c", "s": "5", "g": "9 q", "b": "6 h", "h": "b li", "u": "ii v", "d": "cl", "m": "rn nn", "w": "vv", "n": "ri u",
    "c": "e o", "cl": "d", "rn": "m", "li": "h", "ri": "n", "ii": "u", "vv": "w", "a": "o 4", "z": "2", "q": "g", "f": "t", "v": "y", "y": "v", "r": "n",
}
_READ = [(true, read) for true, reads in SHAPES.items() for read in reads.split()]
_FOLD = [("rn", "m"), ("nn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("ri", "n")]
_ONE = str.maketrans({"0": "e", "1": "l", "i": "l", "j": "l", "5": "s", "6": "h", "b": "h", "9": "g", "q": "g", "f": "t", "c": "e", "4": "a", "2": "z", "o": "e", "u": "n", "v": "y"})


def folded(word: str) -> str:
    """The word with look-alike shapes made one."""
    for read, true in _FOLD:
        word = word.replace(read, true)
    return word.translate(_ONE)


def grams(word: str) -> list[str]:
    shape = f"^{folded(word)}$"
    return sorted({shape[i : i + 3] for i in range(len(shape) - 2)})


_COST = {(t, r): 0.3 if len(t) + len(r) > 2 else 0.4 for t, r in _READ} | {x: 0.8 for x in (("t", "1"), ("o", "c"), ("a", "o"), ("c", "o"), ("r", "n"), ("v", "y"), ("y", "v"))}


@lru_cache(maxsize=200_000)
def reading_cost(true: str, read: str) -> tuple[float, int, int]:
    """(cost, look-alike shapes, other edits) of the cheapest way from the true word to what was read."""
    n, m = len(true), len(read)
    best = [[(9e9, 0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            cost, shapes, other = best[i][j]
            if cost >= 9e9 or other > 3:
                continue

            def step(a: int, b: int, more: float, s: int, o: int) -> None:
                if a <= n and b <= m and cost + more < best[a][b][0]:  # noqa: B023
                    best[a][b] = (cost + more, shapes + s, other + o)  # noqa: B023

            if i < n and j < m and true[i] == read[j]:
                step(i + 1, j + 1, 0.0, 0, 0)
                continue_same = True
            else:
                continue_same = False
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m and (c := _COST.get((true[i : i + a], read[j : j + b]))) is not None:
                        step(i + a, j + b, c, 1, 0)
            if not continue_same:
                step(i + 1, j + 1, 1.2, 0, 1)
            step(i + 1, j, 1.3, 0, 1)
            step(i, j + 1, 1.3, 0, 1)
    return best[n][m]


def pair_features(read: str, true: str, n_read: int, n_true: int, shared: float, most: int | None = None, least: float | None = None) -> list[float]:
    """Features of a candidate; most and least: the highest count and the lowest cost among all candidates of the word, by default its own."""
    cost, shapes, other = reading_cost(true, read)
    return [math.log1p(n_true) - math.log1p(n_true if most is None else most), 0.0 if least is None else cost - least, cost, shapes, other, shared, math.log1p(n_true) - math.log1p(n_read), len(true), abs(len(true) - len(read)), float(any(c.isdigit() for c in read)), float(read[:1] == true[:1]), cost / max(1, len(true))]


def misread_once(word: str, draw: random.Random) -> str | None:
    """The word with one shape read as another; shapes that look more alike are taken for each other more often."""
    spots = [(i, t, r) for t, r in _READ for i in range(len(word) - len(t) + 1) if word.startswith(t, i)]
    if not spots:
        return None
    i, t, r = draw.choices(spots, [1 / _COST[t, r] ** 2 for _, t, r in spots])[0]
    return word[:i] + r + word[i + len(t) :]


def spell_model(vocabulary: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """Trees on (read, true) pairs: corrupted words with their own word, against other words and slips of other kinds."""
    draw, words = random.Random(seed), [(w, n) for w, n in vocabulary if w.isascii() and len(w) >= 4][:TRAIN_WORDS]
    index: dict[str, list[int]] = {}
    for k, (w, _) in enumerate(words):
        for g in grams(w):
            index.setdefault(g, []).append(k)
    x, y = [], []

    def near(read: str) -> list[tuple[float, int, int, float]]:
        own = grams(read)
        hits = Counter(k for g in own for k in index.get(g, ()))
        held = [(n / len(own), k) for k, n in hits.most_common(6) if n / len(own) >= SHARED]
        most, least = max((words[k][1] for _, k in held), default=0), min((reading_cost(words[k][0], read)[0] for _, k in held), default=0.0)
        return [(share, k, most, least) for share, k in held]

    rounds = max(1, min(8, 8_000 // max(1, len(words))))
    for k, (w, n) in [(k, x) for k, x in enumerate(words) for _ in range(rounds)]:
        # both kinds are as rare against their word, so that rarity alone decides nothing
        seen = max(1, int(n / 10 ** draw.uniform(0.9, 4)))
        if read := misread_once(w, draw):
            for shared, c, most, least in near(read):
                x.append(pair_features(read, words[c][0], seen, words[c][1], shared, most, least))
                y.append(float(c == k))
        # rare words of their own right: another letter, one more or one less
        i, letter = draw.randrange(len(w)), draw.choice("abdeghkmnoprstuvwy")
        slip = draw.choice((w[:i] + letter + w[i + 1 :], w[:i] + letter + w[i:], w[:i] + w[i + 1 :], w + "s", w[: len(w) // 2]))
        if slip != w and reading_cost(w, slip)[2]:
            for shared, c, most, least in near(slip):
                x.append(pair_features(slip, words[c][0], seen, words[c][1], shared, most, least))
                y.append(0.0)
    if not x or not any(y):
        x, y = [[9.0] * 12, [0.3] * 12], [0.0, 1.0]
    return Boosted(rounds=40).fit(np.array(x), np.array(y))


def join_features(left: str, right: str, counts: dict[str, int], prefixes: dict[str, int]) -> list[float]:
    low, r = left.lower(), right.lower()
    has = lambda w: math.log1p(counts.get(w, 0))
    return [has(low + r), has(f"{low}-{r}"), has(low), has(r), float(r in ("and", "or", "to")), float(right[:1].islower()), len(left), len(right), math.log1p(prefixes.get(low, 0)), float(bool(re.fullmatch("[ivxl]+", r)))]


def join_models(counts: dict[str, int], prefixes: dict[str, int], seed: int = 11) -> tuple[Boosted, Boosted]:
    """(does the hyphen cut a word; does it belong to the word), on words of the vocabulary cut at random."""
    draw = random.Random(seed)
    common = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w.isalpha() and len(w) >= 2][:TRAIN_WORDS]
    compounds = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w.count("-") == 1 and w.replace("-", "").isalpha()][:TRAIN_WORDS]
    x, cut, kept = [], [], []

    def add(left: str, right: str, a: int, b: int, hide: bool = False) -> None:
        f = join_features(left, right, counts, prefixes)
        if hide:
            f[0] = 0.0
        x.append(f)
        cut.append(a)
        kept.append(b)

    for w in common:
        if len(w) >= 5:
            i = draw.randint(2, len(w) - 2)
            add(w[:i], w[i:], 1, 0, draw.random() < 0.1)
    for w in compounds:
        left, right = w.split("-")
        for _ in range(max(1, len(common) // max(1, 4 * len(compounds)))):
            add(left, right, 1, 1)
            add(left, draw.choice(("and", "or", "to")), 0, 0)
    for _ in range(len(common) // 4):
        add(draw.choice(common), draw.choice(("and", "or", "to")), 0, 0)
    if len(set(cut)) < 2 or len(set(kept)) < 2:
        base = [[5, 0, 0, 0, 0, 1, 4, 4, 0, 0], [0, 5, 0, 0, 0, 1, 4, 4, 3, 0], [0, 0, 5, 5, 1, 1, 4, 3, 3, 0]] * 4
        x, cut, kept = [*x, *base], [*cut, *[1, 1, 0] * 4], [*kept, *[0, 1, 0] * 4]
    x, cut, kept = np.array(x, dtype=float), np.array(cut), np.array(kept)
    return Boosted(rounds=40).fit(x, cut), Boosted(rounds=40).fit(x[cut == 1], kept[cut == 1])


def alike(a: str, b: str) -> float:
    """1 for equal shapes, less by the share of edits; 0 as soon as the lengths differ much."""
    if a == b:
        return 1.0
    if not a or not b or abs(len(a) - len(b)) > 3:
        return 0.0
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return max(0.0, 1 - row[-1] / max(len(a), len(b)))


@dataclass
class Title:
    """A document's title as its running heads are compared with it."""

    plain: str
    words: frozenset


def title_of(text: str | None) -> Title | None:
    words = WORD.findall(text.lower()) if isinstance(text, str) else []
    return Title(" ".join(words), frozenset(words)) if words else None


def head_features(line: str, before: str, after: str, first: bool, title: Title | None) -> list[float]:
    """Signs of a running head in a line between two body lines."""
    bare = DRESS.sub(" ", line)
    plain = " ".join(WORD.findall(bare.lower()))
    letters = [c for c in line if c.isalpha()]
    notice = max(alike(plain, n) for n in NOTICES) if len(plain) <= 40 else 0.0
    return [
        alike(plain, title.plain) if title else 0.0, float(bare != line), notice, sum(c.isupper() for c in letters) / max(1, len(letters)), len(line), float(line[-1:] in ".,;:"), float(bool(before) and before[-1:] not in ".:;"),
        float(after[:1].islower()), float(first), len(plain.split()), sum(c.isdigit() for c in line) / max(1, len(line)), float(title is None),
    ]


def head_model(titles: list[str], bodies: list[str], seed: int = 13) -> Boosted:
    """Trees that know running heads, trained on titles dressed up between body lines."""
    draw = random.Random(seed)
    titles = [t for t in titles if t and t.strip()] or ["Agreement 1 Main Street"]
    bodies = [b for b in bodies if b.strip()] or ["the parties agree to the terms", "and shall pay the rent."]
    x, y = [], []

    def noisy(t: str) -> str:
        return (misread_once(t, draw) or t) if draw.random() < 0.3 else t

    # few titles are dressed again and again
    for t in (titles * -(-80 // len(titles)))[:TRAIN_TITLES]:
        n, title = draw.randint(1, 60), title_of(t)
        dressed = [t.upper(), f"{t} - Draft {n}", f"{n} | {t}", f"{t.upper()} (LD/{n}/2020)", f"Ref: LD/{n}/2021  {t}", f"{t}    Page {n} of 60", t, draw.choice(NOTICES[:3]).title(), draw.choice(NOTICES).title()]
        for line in dressed:
            known = title if draw.random() < 0.9 or line in (t, t.upper()) else None
            x.append(head_features(noisy(line), draw.choice(bodies), draw.choice(bodies), False, known))
            y.append(1.0)
        x.append(head_features(t.upper(), "", draw.choice(bodies), True, title))
        y.append(0.0)
        other = draw.choice(titles)
        for line in (*draw.sample(bodies, min(6, len(bodies))), f"{n}. {draw.choice(bodies)[:20].title()}", draw.choice(bodies)[:18].upper(), f"{n}.{n}. {draw.choice(bodies).split()[0].title()}", f"Schedule {n}", draw.choice(bodies).split()[-1]):
            x.append(head_features(line, draw.choice(bodies), draw.choice(bodies), False, title if draw.random() < 0.9 else None))
            y.append(0.0)
        if other != t and not set(other.lower().split()) <= title.words:
            x.append(head_features(f"the {other} of the", draw.choice(bodies), draw.choice(bodies), False, title))
            y.append(0.0)
    return Boosted(rounds=40).fit(np.array(x), np.array(y))


class Reader:
    """Finds the defects in the lines of one document (or a part of it)."""

    def __init__(self, counts: dict[str, int], good: frozenset, join: Boosted, keep: Boosted, head: Boosted) -> None:
        self.counts, self.good, self.join, self.keep, self.head = counts, good, join, keep, head
        self.prefixes = prefixes_of(counts)
        self.heads: dict[tuple, bool] = {}
        self.joins: dict[tuple, tuple[bool, bool]] = {}
        self.tokens: dict[str, tuple] = {}

    def is_head(self, line: str, before: str, after: str, first: bool, title: Title | None) -> bool:
        if len(line) > 110 or line[:1].islower() or line[-1:] in ".,;:":
            return False
        dressed = DIGIT.search(line) is not None and DRESS.search(line) is not None
        if not dressed:
            if len(line) > max(40, len(title.plain) + 12 if title else 0):
                return False
            words = WORD.findall(line.lower())
            near = title and 2 * len(title.words.intersection(words)) >= len(title.words)
            if not near and not (len(words) <= 5 and max(alike(" ".join(words), n) for n in NOTICES) >= 0.8):
                return False
        features = head_features(line, before, after, first, title)
        key = tuple(features)
        if key not in self.heads:
            self.heads[key] = self.head.one(features) >= 0.5
        return self.heads[key]

    def unknown(self, tokens: Iterable[str]) -> set:
        """The words in tokens that aren't known to be right. What a token holds is looked up once."""
        out: set = set()
        for token in tokens:
            held = self.tokens.get(token)
            if held is None:
                if len(self.tokens) > 1_000_000:
                    self.tokens.clear()
                held = self.tokens[token] = tuple(w for w in WORD.findall(token) if w not in self.good and not w.isdigit() and 3 < len(w) <= 60)
            if held:
                out.update(held)
        return out

    def cut(self, left: str, right: str, held: dict[str, int] | None = None) -> tuple[bool, bool]:
        """(is a word cut here, does the hyphen belong to it). held: what is known of pairs of this row."""
        if held and (code := held.get(f"{left}\t{right}")) is not None:
            return code > 0, code > 1
        key = (left, right)
        if key not in self.joins:
            f = join_features(left, right, self.counts, self.prefixes)
            whole = right[:1].islower() and self.join.one(f) >= 0.5
            self.joins[key] = (whole, whole and self.keep.one(f) >= 0.5)
        return self.joins[key]

    def read(self, lines: list[tuple[int, str]], title: Title | None, starts: bool, held: list[dict | None] | None = None, asked: list | None = None) -> tuple[list[str], dict[int, tuple[int, str, str]], list[tuple[int, set]]]:
        """(kind of each line, {line with the first half: (line with the second, whole word, left part as stored)}, unknown words by line).

        held: decisions on hyphens by line; asked: gets every (line, left, right) that is to be decided.
        """
        texts = [t.strip() for _, t in lines]
        kinds = ["blank" if not t else "page_number" if len(t) < 24 and PAGE.match(t) else "body" for t in texts]
        body = [i for i, k in enumerate(kinds) if k == "body"]
        for n, i in enumerate(body):
            before = texts[body[n - 1]] if n else ""
            after = texts[body[n + 1]] if n + 1 < len(body) else ""
            if self.is_head(texts[i], before, after, starts and i == 0, title):
                kinds[i] = "header"
        body = [i for i in body if kinds[i] == "body"]
        cuts: dict[int, tuple[int, str, str]] = {}
        unknown: list[tuple[int, set]] = []
        second: dict[int, str] = {}
        for n, i in enumerate(body):
            left = HYPHEN_END.search(texts[i]) if texts[i][-1:] in HYPHENS else None
            if left and n + 1 < len(body) and (right := FIRST_WORD.match(texts[body[n + 1]])):
                if asked is not None:
                    asked.append((i, left.group(1), right.group(1)))
                whole, kept = self.cut(left.group(1), right.group(1), held[i] if held else None)
                if whole:
                    cuts[i] = (body[n + 1], f"{left.group(1)}{'-' if kept else ''}{right.group(1)}".lower(), left.group(1))
                    second[body[n + 1]] = right.group(1)
        for i in body:
            tokens = texts[i].lower().split()
            first, last = 0, len(tokens)
            rest: set = set()
            if i in cuts and last:
                last -= 1
                rest.update(self.unknown(" ".join(WORD.findall(tokens[-1])[:-1]).split()))
            if i in second and first < last:
                first = 1
                rest.update(self.unknown(" ".join(WORD.findall(tokens[0])[1:]).split()))
            rest.update(self.unknown(tokens[first:last]))
            if rest:
                unknown.append((i, rest))
        return kinds, cuts, unknown


def prefixes_of(counts: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for w, n in counts.items():
        if "-" in w:
            head = w.rsplit("-", 1)[0]
            out[head] = out.get(head, 0) + n
    return out


# ---- the collection -------------------------------------------------------------------------------------------


def text_rows(df: DataFrame, name: str, row: str, text: str, title: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows that hold all lines of a text. title: (key, title) of the documents, unique by key."""
    rows = df.select(F.lit(name).alias("table_name"), F.col(row).cast("long").alias("row_id"), F.col(text).cast("string").alias("_text"), *([F.col(key).alias("_key")] if key else [])).where("_text is not null")
    if title is not None and key:
        return rows.join(title.select(F.col(title.columns[0]).alias("_key"), F.col(title.columns[1]).alias("_title")), "_key", "left").select("table_name", "row_id", "_text", "_title")
    return rows.select("table_name", "row_id", "_text", F.lit(None).cast("string").alias("_title"))


def line_rows(df: DataFrame, name: str, row: str, text: str, doc: str, position: str, title: DataFrame | None = None) -> DataFrame:
    """One line per row: (table_name, row_id, _doc, _block, _pos, _ahead, _text, _title), each block with the nearest lines of its neighbours."""
    rows = df.select(F.lit(name).alias("table_name"), F.col(row).cast("long").alias("row_id"), F.col(text).cast("string").alias("_text"), F.col(doc).cast("string").alias("_doc"), F.col(position).cast("long").alias("_pos")).where("_text is not null")
    placed = F.col("_doc").isNotNull() & F.col("_pos").isNotNull()
    block = F.floor(F.col("_pos") / BLOCK).cast("long")
    own = F.struct(block.alias("_block"), F.lit(False).alias("_ahead"))
    early = F.when(placed & (F.pmod(F.col("_pos"), F.lit(BLOCK)) < AHEAD), F.struct((block - 1).alias("_block"), F.lit(True).alias("_ahead")))
    late = F.when(placed & (F.pmod(F.col("_pos"), F.lit(BLOCK)) >= BLOCK - AHEAD), F.struct((block + 1).alias("_block"), F.lit(True).alias("_ahead")))
    rows = rows.withColumn("_e", F.explode(F.array_compact(F.array(own, early, late)))).select("table_name", "row_id", "_text", "_doc", "_pos", "_e._block", "_e._ahead")
    # rows without a place stand alone
    rows = rows.withColumn("_doc", F.when(placed, F.col("_doc")).otherwise(F.concat(F.lit("\u0000"), F.coalesce("_doc", F.lit("")), F.lit("\u0000"), F.col("row_id").cast("string"))))
    rows = rows.withColumn("_block", F.coalesce("_block", F.lit(0))).withColumn("_pos", F.coalesce("_pos", F.lit(0)))
    if title is not None:
        rows = rows.join(title.select(F.col(title.columns[0]).cast("string").alias("_doc"), F.col(title.columns[1]).alias("_title")), "_doc", "left")
    else:
        rows = rows.withColumn("_title", F.lit(None).cast("string"))
    return rows


def word_types(texts: DataFrame) -> DataFrame:
    """(word, n): all word types of ``texts`` (_text, _line: is it one line of a longer text) with their number; halves at line ends are seen but not counted."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[str]] = {}
        for batch in batches:
            tokens: Counter = Counter()
            zero: set = set()
            for text, line in zip(batch["_text"], batch["_line"]):
                low = text.lower()
                if not line and not any(x in low for x in ENDS):
                    tokens.update(low.split())
                    continue
                after = line
                for part in low.split("\n"):
                    found = part.split()
                    if not found:
                        continue
                    if after:
                        zero.add(found.pop(0))
                    after = bool(found) and found[-1].endswith(HYPHENS)
                    if after:
                        found.pop()
                    tokens.update(found)
            # what a token holds is looked up once, as few tokens make up most of a text
            seen: Counter = Counter()
            for token, n in [*tokens.items(), *((t, 0) for t in zero)]:
                words = held.get(token)
                if words is None:
                    if len(held) > 1_000_000:
                        held.clear()
                    words = held[token] = [w for w in WORD.findall(token) if len(w) <= 60 and not w.isdigit()]
                for w in words:
                    seen[w] += n
            yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@F.pandas_udf(ArrayType(StringType()))
def _grams(words: pd.Series) -> pd.Series:
    return words.map(grams)


@F.pandas_udf(DoubleType())
def _cost(read: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([reading_cost(t, r)[0] for r, t in zip(read, true)], dtype=float)


def corrections(types: DataFrame, model: Boosted) -> DataFrame:
    """(word, right): what a word type stands for; the trees rank its candidates and refuse all below a half.

    Candidates come from an inverted join on trigrams of the folded form. A candidate has at least the share SHARED of a word's
    grams, so it has one of the word's rarest ones whatever the others are: only as many of them as that takes are looked up,
    and grams that most words have hardly ever are. How many grams a pair shares is counted on the whole sets.
    """
    letters = types.where("length(word) between 4 and 60 and length(regexp_replace(word, '[^a-z]', '')) >= 3").withColumn("grams", _grams("word"))
    true = letters.where(F.col("word").rlike("^[^0-9]+$") & (F.col("n") >= RATIO)).select(F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("grams").alias("grams_right"))
    lists = true.select("right", "n_right", "grams_right", F.explode("grams_right").alias("gram"))
    often = lists.groupBy("gram").agg(F.count("*").alias("often"))
    held = letters.select("word", "n", "grams", F.explode("grams").alias("gram")).join(often, "gram")
    # grams that no true word has are as rare as can be
    sorted_grams = held.groupBy("word").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("met"))
    missing = F.size("grams") - F.size("met")
    looked_up = F.greatest(F.size("grams") - F.ceil(F.size("grams") * F.lit(SHARED)).cast("int") + 1 - missing, F.lit(0))
    sought = sorted_grams.select("word", "n", "grams", F.explode(F.slice("met", F.lit(1), looked_up)).alias("g")).select("word", "n", "grams", F.col("g.gram").alias("gram"))
    met = sought.join(lists, "gram").where(F.col("n_right") >= RATIO * F.greatest(F.col("n"), F.lit(1))).where((F.col("word") != F.col("right")) & (F.abs(F.length("word") - F.length("right")) <= 2))
    share = F.size(F.array_intersect("grams", "grams_right")) / F.size("grams")
    pairs = met.select("word", "n", "right", "n_right", share.alias("share")).where(F.col("share") >= SHARED).distinct().withColumn("cost", _cost("word", "right"))
    of_word = Window.partitionBy("word")
    pairs = pairs.withColumn("most", F.max("n_right").over(of_word)).withColumn("least", F.min("cost").over(of_word))

    @F.pandas_udf("double")
    def chance(read: pd.Series, true: pd.Series, n: pd.Series, m: pd.Series, share: pd.Series, most: pd.Series, least: pd.Series) -> pd.Series:
        x = [pair_features(*row) for row in zip(read, true, n, m, share, most, least)]
        return pd.Series(model.chance(np.array(x)) if x else np.zeros(0))

    scored = pairs.withColumn("p", chance("word", "right", "n", "n_right", "share", "most", "least")).where("p >= 0.5")
    return scored.groupBy("word").agg(F.max_by("right", F.struct("p", "n_right", "right")).alias("right"))


@dataclass
class Models:
    """What the tasks need: word counts, words known to be right, and the trees."""

    counts: dict[str, int]
    good: frozenset
    join: Boosted
    keep: Boosted
    head: Boosted
    #: Are there more words than are sent to the tasks.
    more: bool = False

    def reader(self) -> Reader:
        return Reader(self.counts, self.good, self.join, self.keep, self.head)


def _least_count(types: DataFrame) -> int:
    """The least count with at most SENT_WORDS words of as high a one; words are counted by their counts, so none is sorted."""
    held, least = 0, None
    for n, words in types.where("n > 0").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(SENT_WORDS).collect():
        held += words
        if held > SENT_WORDS:
            break
        least = n
    return least if least is not None else 2**62


def learn(texts: DataFrame, lines: DataFrame, titles: DataFrame | None, scratch: Scratch) -> tuple[Models, DataFrame]:
    """(models, corrections) of a collection of text rows and line rows."""
    both = texts.select("_text", F.lit(False).alias("_line")).unionByName(lines.where("not _ahead").select("_text", F.lit(True).alias("_line")))
    types = scratch.put(word_types(both), "types")
    most = types.where(F.col("n") >= _least_count(types))
    top = [(r["word"], r["n"]) for r in most.orderBy(F.desc("n"), "word").collect()]
    spell = spell_model([(w, n) for w, n in top if w.isalpha() and n >= RATIO])
    right = scratch.put(corrections(types, spell), "corrections")
    wrong = {r["word"] for r in right.join(most, "word", "left_semi").select("word").collect()}
    counts = {w: n for w, n in top if w not in wrong}
    join, keep = join_models(counts, prefixes_of(counts))
    sample = texts.where(F.instr("_text", "\n") > 0).select("_text").orderBy(F.xxhash64("_text")).limit(TRAIN_TITLES).collect()
    bodies = [x for r in sample for x in r["_text"][:4000].split("\n") if len(x) > 25 and not x.isupper() and not DRESS.search(x)]
    names = [r[0] for r in titles.select(titles.columns[1]).where(F.col(titles.columns[1]).isNotNull()).orderBy(F.xxhash64(titles.columns[1])).limit(TRAIN_TITLES).collect()] if titles is not None else []
    return Models(counts, frozenset(counts), join, keep, head_model(names, bodies), types.where("n > 0").count() > len(top)), right


def hyphen_decisions(texts: DataFrame, lines: DataFrame, models: Models, right: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(table_name, row_id, _cuts): where there are more words than are sent to the tasks, what the trees decide on each
    hyphen at a line end by the counts of all words: 0 no word is cut, 1 one is, 2 one is and the hyphen belongs to it. None
    where the words that are sent are all there are."""
    if not models.more:
        return None

    def asked(batches: Iterator[pd.DataFrame], one_text: bool) -> Iterator[pd.DataFrame]:
        reader = models.reader()
        if one_text:
            groups = ((t, [(r, x) for x in text.split("\n")], title, False) for b in batches for t, r, text, title in zip(b["table_name"], b["row_id"], b["_text"], b["_title"]))
        else:
            groups = ((g[0][0], [(r[1], r[2]) for r in g], g[0][4], g[0][5] == 0) for g in grouped(batches))
        for name, rows, title, starts in groups:
            out: list = []
            reader.read(rows, title_of(title), starts, asked=out)
            if out:
                yield pd.DataFrame([(name, rows[i][0], left, second) for i, left, second in out], columns=["table_name", "row_id", "left", "right"])

    shape = "table_name string, row_id long, left string, right string"
    sorted_lines = lines.repartition("_doc", "_block").sortWithinPartitions("_doc", "_block", "_pos", "row_id")
    many = texts.where(F.instr("_text", "\n") > 0)
    pairs = scratch.put(many.mapInPandas(lambda b: asked(b, True), shape).unionByName(sorted_lines.mapInPandas(lambda b: asked(b, False), shape)).distinct(), "line_ends")
    low, second = F.lower("left"), F.lower("right")
    forms = F.array(F.concat(low, second), F.concat(low, F.lit("-"), second), low, second)
    words = scratch.spark.read.parquet(f"{scratch.root}/types").where("n > 0").join(right.select("word"), "word", "left_anti").select("word", "n")
    prefixes = words.where("instr(word, '-') > 0").groupBy(F.regexp_replace("word", "-[^-]*$", "").alias("word")).agg(F.sum("n").alias("n"))
    one = pairs.select("left", "right").distinct()
    sought = one.select("left", "right", F.explode(forms).alias("word")).distinct().join(words, "word").select("left", "right", "word", "n")
    before = one.select("left", "right", low.alias("word")).join(prefixes, "word").select("left", "right", F.col("n").alias("prefix"))
    counted = one.join(sought.groupBy("left", "right").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts")), ["left", "right"], "left").join(before, ["left", "right"], "left")

    @F.pandas_udf("int")
    def decided(left: pd.Series, right: pd.Series, counts: pd.Series, prefix: pd.Series) -> pd.Series:
        out = []
        for a, b, n, p in zip(left, right, counts, prefix):
            f = join_features(a, b, dict(n) if n is not None else {}, {a.lower(): int(p)} if p == p and p is not None else {})
            whole = b[:1].islower() and models.join.one(f) >= 0.5
            out.append(int(whole) + int(whole and models.keep.one(f) >= 0.5))
        return pd.Series(out, dtype="int32")

    codes = counted.select("left", "right", decided("left", "right", "counts", "prefix").alias("code"))
    told = pairs.join(codes, ["left", "right"]).groupBy("table_name", "row_id")
    return scratch.put(told.agg(F.map_from_entries(F.collect_set(F.struct(F.concat("left", F.lit("\t"), "right"), "code"))).alias("_cuts")), "hyphens")


def _with_cuts(rows: DataFrame, decisions: DataFrame | None) -> DataFrame:
    if decisions is None:
        return rows.withColumn("_cuts", F.lit(None).cast("map<string, int>"))
    return rows.join(decisions, ["table_name", "row_id"], "left")


def _report(reader: Reader, name: str, lines: list[tuple[int, str]], own: list[bool], title: Title | None, starts: bool, held: list[dict | None] | None, out: list) -> None:
    kinds, cuts, unknown = reader.read(lines, title, starts, held)
    for i, kind in enumerate(kinds):
        if kind in ("page_number", "header") and own[i]:
            out.append((name, lines[i][0], kind, " ".join(lines[i][1].split())))
    for i, (_, word, _) in cuts.items():
        if own[i]:
            out.append((name, lines[i][0], "hyphen", word))
    for i, words in unknown:
        if own[i]:
            out += [(name, lines[i][0], "word", w) for w in words]


_FOUND = "table_name string, row_id long, defect string, token string"


def defects(texts: DataFrame, lines: DataFrame, titles: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(table_name, row_id, defect, token), distinct: hyphen, misread, header and page_number."""
    models, right = learn(texts, lines, titles, scratch)
    decisions = hyphen_decisions(texts, lines, models, right, scratch)

    def in_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = models.reader()
        for batch in batches:
            out: list = []
            for name, row, text, title, cuts in zip(batch["table_name"], batch["row_id"], batch["_text"], batch["_title"], batch["_cuts"]):
                if "\n" not in text:
                    out += [(name, row, "word", w) for w in reader.unknown(set(text.lower().split()))]
                    continue
                parts = [(row, x) for x in text.split("\n")]
                _report(reader, name, parts, [True] * len(parts), title_of(title), False, [dict(cuts)] * len(parts) if cuts is not None else None, out)
            yield pd.DataFrame(out, columns=["table_name", "row_id", "defect", "token"])

    def in_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = models.reader()
        for group in grouped(batches):
            out: list = []
            _report(reader, group[0][0], [(r[1], r[2]) for r in group], [not r[3] for r in group], title_of(group[0][4]), group[0][5] == 0, [r[7] for r in group], out)
            yield pd.DataFrame(out, columns=["table_name", "row_id", "defect", "token"])

    sorted_lines = _with_cuts(lines, decisions).repartition("_doc", "_block").sortWithinPartitions("_doc", "_block", "_pos", "row_id")
    found = _with_cuts(texts, decisions).mapInPandas(in_texts, _FOUND).unionByName(sorted_lines.mapInPandas(in_lines, _FOUND))
    found = scratch.put(found, "found")
    misread = found.where("defect = 'word'").join(right, F.col("token") == F.col("word")).select("table_name", "row_id", F.lit("misread").alias("defect"), F.col("right").alias("token"))
    return found.where("defect <> 'word'").unionByName(misread).distinct()


def _rebuilt(reader: Reader, lines: list[tuple[int, str]], title: Title | None, starts: bool, fixes: list[dict], held: list[dict | None] | None) -> list[str | None]:
    """Each line repaired: None for furniture, words cut at its end made whole, halves at its start taken away, misread words put right."""
    kinds, cuts, _ = reader.read(lines, title, starts, held)
    second = {j for j, _, _ in cuts.values()}
    out: list[str | None] = []
    for i, (_, text) in enumerate(lines):
        if kinds[i] in ("header", "page_number"):
            out.append(None)
            continue
        line, tail = text.strip(), ""
        if i in second:
            line = line[FIRST_WORD.match(line).end() :]
            # what stood right behind the word went with it
            line = line.lstrip(".,;:)\"'").lstrip()
        if i in cuts:
            j, whole, left = cuts[i]
            right = FIRST_WORD.match(lines[j][1].strip())
            mark = re.match(r"[.,;:)\"']*", lines[j][1].strip()[right.end() :]).group()
            line = line[: HYPHEN_END.search(line).start()]
            tail = left + whole[len(left) :] + mark
        if fixes[i]:
            line = WORD.sub(lambda m: like(m.group(), fixes[i]), line)  # noqa: B023
        out.append(line + tail)
    return out


def like(word: str, fixes: dict[str, str]) -> str:
    """The right word in the case of the one it stands for."""
    right = fixes.get(word.lower())
    if right is None:
        return word
    return right.upper() if word.isupper() and len(word) > 1 else right.capitalize() if word[:1].isupper() else right


def repaired(texts: DataFrame, lines: DataFrame, titles: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(table_name, row_id, text): each row's text in continuous paragraphs; null where a line is furniture."""
    models, right = learn(texts, lines, titles, scratch)
    reader, decisions = models.reader, hyphen_decisions(texts, lines, models, right, scratch)
    words = texts.select("table_name", "row_id", "_text").unionByName(lines.where("not _ahead").select("table_name", "row_id", "_text"))

    def unknown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = reader()
        for batch in batches:
            yield pd.DataFrame([(t, r, w) for t, r, x in zip(batch["table_name"], batch["row_id"], batch["_text"]) for w in known.unknown(set(x.lower().split()))], columns=["table_name", "row_id", "word"])

    fixes = words.mapInPandas(unknown, "table_name string, row_id long, word string").join(right, "word")
    fixes = scratch.put(fixes.groupBy("table_name", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("_fix")), "fixes")

    def in_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader()
        for batch in batches:
            out = []
            for name, row, text, title, fix, cuts in zip(batch["table_name"], batch["row_id"], batch["_text"], batch["_title"], batch["_fix"], batch["_cuts"]):
                parts = [(row, x) for x in text.split("\n")]
                done = _rebuilt(own, parts, title_of(title), False, [dict(fix or {})] * len(parts), [dict(cuts)] * len(parts) if cuts is not None else None)
                body = [x for x in done if x is not None]
                if len(parts) > 1 and max(len(x) for _, x in parts) <= 120 and not any(re.match(r"\(?[a-z0-9]{1,3}[.)]\s", x) for x in body[1:]):
                    text = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n{2,}", "\n".join(body)))
                else:  # lines that the writer set
                    text = "\n".join(body)
                out.append((name, row, text))
            yield pd.DataFrame(out, columns=["table_name", "row_id", "text"])

    def in_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = reader()
        for group in grouped(batches):
            done = _rebuilt(own, [(r[1], r[2]) for r in group], title_of(group[0][4]), group[0][5] == 0, [dict(r[6] or {}) for r in group], [r[7] for r in group])
            yield pd.DataFrame([(r[0], r[1], x) for r, x in zip(group, done) if not r[3]], columns=["table_name", "row_id", "text"])

    on, out = ["table_name", "row_id"], "table_name string, row_id long, text string"
    placed = _with_cuts(lines, decisions).join(fixes, on, "left").repartition("_doc", "_block").sortWithinPartitions("_doc", "_block", "_pos", "row_id")
    return _with_cuts(texts, decisions).join(fixes, on, "left").mapInPandas(in_texts, out).unionByName(placed.mapInPandas(in_lines, out))


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The sorted lines of each block of a document: (table, row, text, ahead, title, position, fixes, decisions on hyphens)."""
    key, group = None, []
    for batch in batches:
        none = [None] * len(batch)
        fixes, cuts = (batch[c] if c in batch else none for c in ("_fix", "_cuts"))
        for name, row, text, ahead, title, pos, fix, cut, doc, block in zip(*(batch[c] for c in ("table_name", "row_id", "_text", "_ahead", "_title", "_pos")), fixes, cuts, batch["_doc"], batch["_block"]):
            if (name, doc, block) != key:
                if group:
                    yield group
                key, group = (name, doc, block), []
            group.append((name, row, text, ahead, title, pos, fix, dict(cut) if cut is not None else None))
    if group:
        yield group
