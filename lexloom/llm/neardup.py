"""Near copies by bottom-k sketches of word shingles.

Every text gets the k least values of one 32-bit hash over its distinct shingles. Texts that share most shingles share
most of the least values of their union, so somewhere they hold the same *run* of consecutive retained values. Inverted
lists of such runs give the candidates: all pairs of every list, however long. The members of a list longer than
``list_limit`` meet in salted blocks, and only the pairs that pass the estimate leave them, so that shingles of a common
form make work but few rows. The sketch of the union estimates the similarity of a candidate pair, and the pairs above
the bound are verified exactly on the whole texts.

Words are hashed batch by batch: the bytes of all texts of a batch are one array, and a word's hash is a sum of its bytes
times powers of an odd number, taken for all words at once. A run goes through one shuffle with the text it is of; what
the sorted stream of runs shows as lists is paired there and then.

Identical texts form a class first (grouped by two hashes of the text, 96 bits, pre-aggregated before the shuffle) and
only the one with the least id goes on, so groups of copies never meet in a list.

Defined results: texts that are null or have fewer than ``min_words`` words take no part; repeated rows are members of
one class; an empty table gives no links; columns other than id and text are ignored; rows with a null id are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import Scratch

WORD = re.compile(r"[^\W_]+")
#: Bits of a run's hash that are dropped: 46 are left, few enough to shuffle well, enough for a trillion runs to meet by chance rarely.
RUN_SHIFT = np.uint64(18)
#: At most so many ids (16 bytes each) are broadcast.
SENT_IDS = 1_000_000
#: Members of a long list that are compared at once, about.
BLOCK = 256
#: Bytes of text that are hashed at once.
PIECE = 1 << 21
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_INVERSE = np.uint64(pow(int(_P3), -1, 1 << 64))
#: What each byte counts for: letters in lower case, digits, and bytes of other scripts; 0 parts words.
_BYTE = np.array([b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    """shingle: words in a row; threshold: least Jaccard similarity; min_words: shorter texts take no part;
    sketch: retained values; list_limit: longest inverted list that is paired in the stream of runs, longer ones are paired in
    blocks; slack: the estimate may fall short of the threshold by so many standard deviations;
    few: texts with at most so many distinct shingles have runs of two values too, those with a third of it single ones."""

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 5
    sketch: int = 48
    list_limit: int = 4
    slack: float = 3.0
    few: int = 24


# ---- words and shingles of a batch ------------------------------------------------------------------------------


def _plain(texts: pa.Array) -> pa.Array:
    """Texts beyond ASCII as their words in lower case, parted by blanks; the others as they are."""
    ascii_only = pc.string_is_ascii(texts)
    if pc.all(ascii_only).as_py() in (True, None):
        return texts
    return pa.array([t if good or t is None else " ".join(WORD.findall(t.lower())) for t, good in zip(texts.to_pylist(), ascii_only.to_pylist())], texts.type)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of all words of a batch of texts; the powers are made once per task."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_P3, PIECE), _powers(_INVERSE, PIECE)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words of each text); a null text has none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = _plain(texts.fill_null("") if texts.null_count else texts)
        if not len(texts):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[ends] = True
        hashes, starts, at = [], [], 0
        while at < len(raw):
            upto = min(at + PIECE, len(raw))
            if upto < len(raw):  # not within a word
                gaps = np.flatnonzero(_BYTE[raw[at:upto]] == 0)
                while not len(gaps) and upto < len(raw):
                    at_gap = upto
                    upto = min(upto + PIECE, len(raw))
                    gaps = np.flatnonzero(_BYTE[raw[at_gap:upto]] == 0) + (at_gap - at)
                upto = at + int(gaps[-1]) + 1 if len(gaps) and upto < len(raw) else upto
            value = _BYTE[raw[at:upto]]
            inner = value != 0
            first = inner.copy()
            first[1:] &= ~inner[:-1] | begins[at + 1 : upto]
            start = np.flatnonzero(first)
            if len(start):
                if len(value) > len(self.up):
                    self.up, self.down = _powers(_P3, len(value)), _powers(_INVERSE, len(value))
                value *= self.up[: len(value)]
                h = np.add.reduceat(value, start) * self.down[start]
                h ^= h >> np.uint64(32)
                h *= _P2
                hashes.append(h ^ (h >> np.uint64(29)))
                starts.append(start + at)
            at = upto
        if not hashes:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
        found = np.searchsorted(np.concatenate(starts), ends)
        return np.concatenate(hashes), np.diff(found)

    def shingles(self, texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each shingle, number of shingles of each text, number of words of each text)."""
        words, n = self.words(texts)
        many = np.maximum(n - width + 1, 0)
        if not many.sum():
            return words[:0], many, n
        x = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for i in range(width):
            x = (x * _P1) ^ words[i : len(words) - width + 1 + i]
            x ^= x >> np.uint64(29)
        x *= _P2
        x ^= x >> np.uint64(32)
        # shingles that begin in one text and end in the next are none
        left = np.repeat(np.cumsum(n), n)[: len(x)] - np.arange(len(x))
        return x[left >= width], many, n


def _parts(size: np.ndarray) -> np.ndarray:
    """The place of each value within its list, for lists of these sizes end to end."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _in_pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the texts of each part are about PIECE bytes, or one text."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def sketches(df: DataFrame, s: Settings) -> DataFrame:
    """(rep, n, sketch): the sketch of each text (id, _text) with enough words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in (p for b in batches for p in _in_pieces(b, "_text")):
            x, many, words = hasher.shingles(batch["_text"], s.shingle)
            text = np.repeat(np.arange(len(many), dtype=np.uint64), many)
            x = np.unique((text << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
            n = np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=len(many))
            kept = (n > 0) & (words >= s.min_words)
            value = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            value = value[(_parts(n) < s.sketch) & np.repeat(kept, n)]
            ends = np.concatenate(([0], np.cumsum(np.minimum(n[kept], s.sketch)))).astype(np.int32)
            # signed, in the same order
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((value ^ np.uint32(1 << 31)).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(kept)), pa.array(n[kept].astype(np.int32)), lists], ["rep", "n", "sketch"])

    return df.select("id", "_text").mapInArrow(rows, "rep long, n int, sketch array<int>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values end to end, size of each list)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _coarse(reps: DataFrame) -> DataFrame:
    """(rep, n, held): the sketches in 16 bits a value, 5 for its size and 11 for its first digits, as only these are sent to other texts.

    The order is kept and equal values stay equal, so a pair shares as many values or, once in a while, one more.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, size = _flat(batch["sketch"])
            fraction, power = np.frexp(value.astype(np.float64) + 2**31)
            short = np.where(power > 0, (power - 1) * 2048 + ((fraction - 0.5) * 4096).astype(np.int64), 0).astype(np.uint16)
            ends = np.concatenate(([0], np.cumsum(2 * size))).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(short)])
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["n"], held], ["rep", "n", "held"])

    return reps.select("rep", "n", "sketch").mapInArrow(rows, "rep long, n int, held binary")


def _held(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(coarse values end to end, size of each list)."""
    blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    ends = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(np.uint16).astype(np.int64), np.diff(ends) // 2


# ---- candidates -------------------------------------------------------------------------------------------------


def runs(reps: DataFrame, s: Settings) -> DataFrame:
    """(run, rep): runs of three values of each sketch; of texts with few values, which may share no such run, narrower ones as well."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, size = _flat(batch["sketch"])
            rep, n, value = batch["rep"].to_numpy(), batch["n"].to_numpy(), value.view(np.uint32).astype(np.uint64)
            out = []
            left = np.repeat(size, size) - _parts(size)
            for width, most in ((3, None), (2, s.few), (1, s.few // 3)):
                # a text shorter than the widest run has one run of what there is
                wide = np.minimum(width, size) if width == 3 else np.full(len(size), width)
                begins = (left >= np.repeat(wide, size)) & (True if most is None else np.repeat(n <= most, size))
                x = np.full(len(value), width, dtype=np.uint64)
                for i in range(width):
                    x[: len(value) - i] = np.where(left[: len(value) - i] > i, (x[: len(value) - i] ^ value[i:]) * _P1, x[: len(value) - i])
                    x ^= x >> np.uint64(31)
                x *= _P2
                out.append((((x ^ (x >> np.uint64(29))) >> RUN_SHIFT)[begins].astype(np.int64), np.repeat(rep, size)[begins]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], ["run", "rep"])

    return reps.select("rep", "n", "sketch").mapInArrow(rows, "run long, rep long")


def _lists(sorted_runs: DataFrame, s: Settings) -> DataFrame:
    """(run, a, b) of runs in order: the pairs of each list of at most list_limit members (run null), and the members of longer ones (b null)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(a: list[np.ndarray], b: list[np.ndarray], run: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b))
            first = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(run)])
            return pa.RecordBatch.from_arrays([first, pa.array(np.concatenate((np.minimum(a, b), member))), pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(member), pa.int64())])], ["run", "a", "b"])

        def found(run: np.ndarray, rep: np.ndarray, long: bool, goes_on: bool) -> pa.RecordBatch:
            """What the lists give; long and goes_on: the first and the last one are parts of long lists."""
            begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.concatenate((begin, [len(run)])))
            longer = size > s.list_limit
            longer[:1] |= long
            longer[-1:] |= goes_on
            a, b = [], []
            for m in range(2, s.list_limit + 1):
                members = rep[begin[(size == m) & ~longer][:, None] + np.arange(m)]
                i, j = np.triu_indices(m, 1)
                a.append(members[:, i].ravel())
                b.append(members[:, j].ravel())
            apart = np.repeat(longer, size)
            return batch_of(a, b, run[apart], rep[apart])

        run, rep, long = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        for batch in batches:
            run, rep = np.concatenate((run, batch["run"].to_numpy())), np.concatenate((rep, batch["rep"].to_numpy()))
            if not len(run):
                continue
            # the last list may go on in the next batch; of a long one a single row is held back
            cut = int(np.searchsorted(run, run[-1]))
            goes_on = len(run) - cut > s.list_limit or (long and not cut)
            done = len(run) - 1 if goes_on else cut
            if done:
                yield found(run[:done], rep[:done], long, goes_on)
                run, rep, long = run[done:], rep[done:], goes_on
        if len(run):
            yield found(run, rep, long, False)

    return sorted_runs.mapInArrow(rows, "run long, a long, b long")


def _passing(rep: np.ndarray, n: np.ndarray, flat: np.ndarray, size: np.ndarray, left: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of left and other rows, or of all rows where all are left, that _estimated lets pass. flat: the sketches end to end, size: their lengths."""
    ends = np.cumsum(size)
    parts = np.split(flat, ends[:-1])
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    met = often > 1
    held = np.zeros((len(rep), int(met.sum())), dtype=np.float32)
    more = met[at]
    held[np.repeat(np.arange(len(rep)), size)[more], (np.cumsum(met) - 1)[at[more]]] = 1
    i = np.flatnonzero(left)
    j = i if len(i) == len(rep) else np.flatnonzero(~left)
    last = np.where(n > s.sketch, flat[ends - 1], 1 << 16)
    # of each row the values up to the other's last one
    upto = lambda x, y: np.array([np.searchsorted(parts[k], last[y], "right") for k in x]).reshape(len(x), len(y))
    shared = held[i] @ held[j].T
    union = upto(i, j) + upto(j, i).T - shared
    most, least = np.maximum.outer(n[i], n[j]), np.minimum.outer(n[i], n[j])
    slack = np.where(most > s.sketch, s.slack * np.sqrt(s.threshold * (1 - s.threshold) / np.maximum(union, 1)), 0.0)
    near = (least >= most * s.threshold - 1e-9) & (shared >= union * (s.threshold - slack) - 1e-6)
    if j is i:
        near &= rep[i][:, None] < rep[j][None, :]
    x, y = np.nonzero(near)
    x, y = rep[i[x]], rep[j[y]]
    return np.minimum(x, y), np.maximum(x, y)


def _block_pairs(longer: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Pairs that meet in long lists (run, rep) and pass the estimate. Any two members of a list meet in exactly one pair of
    its blocks; a list of m members is sent m / BLOCK times, and no task holds more than two blocks of it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            rep, n, left = (t[c].to_numpy() for c in ("rep", "n", "_left"))
            flat, size = _held(t["held"])
            begin = np.concatenate(([0], np.cumsum(size)))
            out = [_passing(rep[x:y], n[x:y], flat[begin[x] : begin[y]], size[x:y], left[x:y], s) for x, y in zip(bounds[:-1], bounds[1:])]
            a, b = (np.concatenate([o[k] for o in out] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            if not len(t):
                continue
            new = np.zeros(len(t) - 1, dtype=bool)
            for c in ("run", "_x", "_y"):
                k = t[c].to_numpy()
                new |= k[1:] != k[:-1]
            # the last group may go on in the next batch
            bounds = np.concatenate(([0], np.flatnonzero(new) + 1))
            rest = t.slice(bounds[-1])
            yield found(t.slice(0, bounds[-1]), bounds)
        if rest is not None:
            rest = rest.combine_chunks()
            yield found(rest, np.array([0, len(rest)]))

    sized = longer.join(longer.groupBy("run").agg(F.count("*").alias("_size")), "run")
    held = sized.join(reps, "rep")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    met = held.withColumn("_own", F.pmod(F.xxhash64("rep", "run"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x, y = F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y")
    sent = met.select("run", x, y, (F.col("_own") <= F.col("_other")).alias("_left"), "rep", "n", "held")
    return sent.repartition("run", "_x", "_y").sortWithinPartitions("run", "_x", "_y").mapInArrow(rows, "a long, b long")


def candidates(reps: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Distinct pairs of classes that meet in a list and pass the estimate."""
    met = scratch.put(_lists(runs(reps, s).repartition("run").sortWithinPartitions("run"), s), "met")
    held = _coarse(reps)
    short = scratch.put(_estimated(met.where("run is null").select("a", "b").distinct(), held, s), "short")
    longer = met.where("run is not null").select("run", F.col("a").alias("rep"))
    longer = scratch.put(_block_pairs(longer, held, s), "longer")
    scratch.drop("met")
    near = scratch.put(short.unionByName(longer).distinct(), "near")
    scratch.drop("short", "longer")
    return near


def _estimated(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose union sketch doesn't speak against the threshold.

    Up to the smaller of both largest retained values the two sketches hold all values of their texts, so the values
    they share there over those in either estimate the similarity; exactly so where both texts are held whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, tops, held = [], [], [], []
            for x in "ab":
                flat, size = _held(batch[f"s_{x}"])
                n.append(batch[f"n_{x}"].to_numpy())
                tops.append(np.where(n[-1] > s.sketch, flat[np.cumsum(size) - 1], 1 << 16))
                keys.append((np.repeat(np.arange(len(size)), size), flat, size))
            top = np.minimum(*tops)
            for pair, flat, size in keys:
                held.append(np.bincount(pair[flat <= np.repeat(top, size)], minlength=len(batch)))
            # both are in order, so the sort is a merge
            every = np.sort(np.concatenate([(pair << 16) + flat for pair, flat, _ in keys]), kind="stable")
            shared = np.bincount(every[1:][every[1:] == every[:-1]] >> 16, minlength=len(batch))
            union = held[0] + held[1] - shared
            most, least = np.maximum(*n), np.minimum(*n)
            slack = np.where(most > s.sketch, s.slack * np.sqrt(s.threshold * (1 - s.threshold) / np.maximum(union, 1)), 0.0)
            near = (least >= most * s.threshold - 1e-9) & (shared >= union * (s.threshold - slack) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(near)) for c in "ab"], ["a", "b"])

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("held").alias(f"s_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(rows, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(a, b, similarity) of the pairs whose whole texts reach the threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in (q for b in batches for p in _in_pieces(b, "x") for q in _in_pieces(p, "y")):
            (x, n, _), (y, m, _) = (hasher.shingles(batch[c], s.shingle) for c in "xy")
            out = np.zeros(len(batch))
            for k, (left, right) in enumerate(zip(np.split(x, np.cumsum(n)[:-1]), np.split(y, np.cumsum(m)[:-1]))):
                left, right = np.unique(left), np.unique(right)
                both = np.sort(np.concatenate((left, right)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                out[k] = shared / max(1, len(both) - shared)
            near = pa.array(out >= s.threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(near), batch["b"].filter(near), pa.array(out).filter(near)], ["a", "b", "similarity"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("rep"))
    # few ids are sent to the texts, so that only theirs are shuffled; more than the bound are joined by a shuffle
    ids = ends.select("rep").distinct()
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    held = ends.join(texts.join(F.broadcast(ids) if few else ids, "rep", "left_semi"), "rep").groupBy("a", "b").agg(F.max(F.when(F.col("rep") == F.col("a"), F.col("_text"))).alias("x"), F.max(F.when(F.col("rep") == F.col("b"), F.col("_text"))).alias("y"))
    return held.mapInArrow(rows, "a long, b long, similarity double")


@dataclass
class NearCopies:
    """reps (id, rep): one text of each class, the one with the least id; copies (id, rep): the others; links (a, b, similarity): near copies among classes, by rep."""

    reps: DataFrame
    copies: DataFrame
    links: DataFrame

    @property
    def members(self) -> DataFrame:
        return self.reps.unionByName(self.copies)


def near_copies(df: DataFrame, id_col: str, text_col: str, scratch: Scratch, settings: Settings | None = None) -> NearCopies:
    s = settings or Settings()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text")).where("id is not null and _text is not null")
    # texts that can't have enough words never reach Python
    rows = rows.where(F.length("_text") >= 2 * s.min_words - 1)
    same = ["same", "alike"]
    marked = rows.select("id", F.xxhash64("_text").alias("same"), F.hash("_text").alias("alike"))
    repeated = marked.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.put(marked.join(repeated, same).where("id <> rep").select("id", "rep").distinct(), "copies")
    # copies are left out before any text is looked at; few ids are sent to the rows, more than the bound are joined by a shuffle
    few = copies.limit(SENT_IDS + 1).count() <= SENT_IDS
    single = rows.join(F.broadcast(copies.select("id")) if few else copies.select("id"), "id", "left_anti")
    reps = scratch.put(sketches(single, s), "reps")
    near = candidates(reps, s, scratch)
    links = scratch.put(_verified(near, single.select(F.col("id").alias("rep"), "_text"), s), "links")
    scratch.drop("near")
    own = reps.select(F.col("rep").alias("id"), "rep")
    return NearCopies(own, copies.join(own.select("rep"), "rep", "left_semi").select("id", "rep"), links)


def groups(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(rep, group): connected classes by alternating large-star and small-star steps, each written before the next.

    group is the least rep of the component. Ends when a round changes nothing.
    """
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges0")
    for n in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.put(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"edges{n}")
        changed = not new.exceptAll(edges).isEmpty() or not edges.exceptAll(new).isEmpty()
        scratch.drop(f"edges{n - 1}")
        edges = new
        if not changed:
            break
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("group"))).distinct()


def labelled(found: NearCopies, scratch: Scratch) -> DataFrame:
    """One row per text: id, class_id (least id of identical texts), group_id (least class_id of connected classes), links (near copies among other classes)."""
    ends = found.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    linked = groups(found.links, scratch).join(ends, "rep")
    out = found.members.join(linked, "rep", "left")
    return out.select("id", F.col("rep").alias("class_id"), F.coalesce("group", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def expanded(found: NearCopies) -> DataFrame:
    """Distinct pairs of ids, id_a < id_b: those of linked classes and those within a class. As many rows as there are pairs."""
    left, right = (found.copies.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(x)) for x in "ab")
    # a class is its rep and its copies: four kinds of pairs across, two within
    a, b = F.col("a").alias("id_a"), F.col("b").alias("id_b")
    across = found.links.select(a, b).unionByName(found.links.join(left, "a").select("id_a", b)).unionByName(found.links.join(right, "b").select(a, "id_b")).unionByName(found.links.join(left, "a").join(right, "b").select("id_a", "id_b"))
    within = left.select(F.col("a").alias("id_b"), "id_a").unionByName(left.withColumnRenamed("a", "rep").join(right.withColumnRenamed("b", "rep"), "rep").where("id_a < id_b").select("id_b", "id_a"))
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
