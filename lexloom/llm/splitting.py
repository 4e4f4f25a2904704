"""Cutting oversized items at natural boundaries by lexical cohesion.

A text above the limit is taken apart at the coarsest boundary that gives parts within the limit: paragraphs (two or
more newlines), else sentences (also whitespace after ``.``, ``!`` or ``?``), else words (any whitespace), else anywhere.
The gaps between the parts are where a cut may go. The words before and after each gap are compared in sliding blocks;
a gap where the two blocks share little, next to gaps where they share much, is a valley: a change of topic. Within the
window that a piece may end in, the gap of the deepest valley is cut, and the next piece starts ``overlap`` characters
before the cut, so that consecutive pieces share exactly that many characters.

The kind of a cut is the coarsest that has a gap in the window; the overlap counts towards the limit, so a part just
below it may have to be cut at a finer kind. Texts within the limit are left whole and never reach Python.

Defined results: null, empty and blank texts give no piece; whitespace at the ends doesn't count towards the limit of a
part; without whitespace the boundary is ``none`` and cuts fall at the limit; pieces joined without their overlaps
are the text again, character by character; ties between valleys go to the later gap; repeated rows each give their
pieces; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("paragraph", "sentence", "word", "none")
_PARAGRAPH = re.compile(r"\n{2,}")
_SENTENCE = re.compile(r"\n{2,}|(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]{2,}")


def _fits(text: str, gaps: list[tuple[int, int]], limit: int) -> bool:
    start = 0
    for a, b in [*gaps, (len(text), len(text))]:
        if a - start > limit and len(text[start:a].strip()) > limit:
            return False
        start = b
    return True


def boundary(text: str, limit: int) -> str:
    """The first kind of boundary for which all parts, trimmed, are within the limit."""
    for kind, pattern in zip(KINDS, (_PARAGRAPH, _SENTENCE, _SPACE)):
        if _fits(text, [m.span() for m in pattern.finditer(text)], limit):
            return kind
    return "none"


def valley_depths(text: str, cuts: list[int], block: int) -> np.ndarray:
    """Depth of the valley of block similarity (cosine of word counts) at each cut."""
    if not cuts:
        return np.zeros(0)
    starts, codes, known = [], [], {}
    for m in _WORD.finditer(text):
        starts.append(m.start())
        codes.append(known.setdefault(m.group().lower(), len(known)))
    # padded, so that every block has the same width; pads (-1) equal nothing
    row = np.full(len(codes) + 2 * block, -1, dtype=np.int32)
    row[block : block + len(codes)] = codes
    at = np.searchsorted(np.array(starts, dtype=np.int64), np.array(cuts, dtype=np.int64))
    alike = np.zeros(len(cuts))
    for i in range(0, len(cuts), 2_000):
        places = at[i : i + 2_000, None] + np.arange(block)
        left, right = row[places], row[places + block]
        same = lambda x, y: ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).sum((1, 2))
        norm = np.sqrt(same(left, left) * same(right, right).astype(float))
        alike[i : i + 2_000] = np.divide(same(left, right), norm, out=np.zeros(len(norm)), where=norm > 0)
    # depth: rise to the nearest peaks on both sides
    depth = np.zeros(len(cuts))
    for values, sign in ((alike, 1), (alike[::-1], -1)):
        peak, rise, before = 0.0, np.zeros(len(cuts)), np.inf
        for i, v in enumerate(values):
            peak = v if v > before else max(peak, v) if i else v
            rise[i] = peak - v
            before = v
        depth += rise[::sign]
    return depth


def pieces(text: str, limit: int, overlap: int, block: int = 20, least_fill: float = 0.5) -> tuple[str, list[tuple[int, int, int]]]:
    """(kind of boundary, [(start, start without overlap, end)])."""
    kind = boundary(text, limit)
    patterns = (_PARAGRAPH, _SENTENCE, _SPACE)
    gaps: dict[int, tuple[list[int], np.ndarray]] = {}

    def at(n: int) -> tuple[list[int], np.ndarray]:
        if n not in gaps:
            ends = [m.end() for m in patterns[n].finditer(text)]
            gaps[n] = (ends, valley_depths(text, ends, block))
        return gaps[n]

    out, start, size = [], 0, len(text)
    while True:
        begin = max(0, start - overlap) if out else 0
        reach = begin + limit
        if size <= reach:
            out.append((begin, start, size))
            return kind, out
        cut = reach
        least = max(start + 1, start + int((reach - start) * least_fill))
        for n, low_end in [(0, least), (1, least), (2, least), (0, start + 1), (1, start + 1), (2, start + 1)]:
            ends, depth = at(n)
            low, high = bisect_left(ends, low_end), bisect_right(ends, reach)
            if low < high:
                cut = ends[high - 1 - int(np.argmax(depth[low:high][::-1]))]
                break
        out.append((begin, start, cut))
        start = cut


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, block: int = 20, least_fill: float = 0.5) -> DataFrame:
    """(id, boundary, piece, start, body_start, end, text) of the rows whose text is longer than ``limit`` characters.

    piece counts from 0; text is text[start:end], of which the part before body_start is the overlap. block: words to
    either side of a gap that are compared; least_fill: share of a piece's room before which no cut is looked for.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["_text"]):
                kind, parts = pieces(text, limit, overlap, block, least_fill)
                out += [(i, kind, n, a, b, c, text[a:c]) for n, (a, b, c) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["id", "boundary", "piece", "start", "body_start", "end", "text"])

    long = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") > limit).where("trim(_text) <> ''")
    return long.mapInPandas(cut, "id long, boundary string, piece int, start int, body_start int, end int, text string")
