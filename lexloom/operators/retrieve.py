"""Hybrid retrieval: BM25 with capped idf plus a bonus for shared concepts, per-item top-k, gate and budget.

Terms, document frequencies and query terms are aggregates. With the idf capped, common terms make almost every clause a
candidate of every item, so pairs are never rows: clauses are put in order of ref and id, and every block of them is written
once, as a file of its own. What is asked of a clause leaves its row as numbers of terms and counts, and goes through one
shuffle; ids that stand in several rows, whose postings are merged, are the only ones joined. A task holds some blocks of items, reads the files one after the other, adds up scores of a block
of items and a block of clauses at a time in arrays, and keeps the k best clauses of each item. Nothing is copied for
each pair of blocks, and only k rows an item leave a task. The sums are in single precision; a clause that could be among the
best by them, given how far they can be off, is scored again exactly.

Scores are rounded to four places before they rank, so that the order of float sums doesn't matter; ties go by ref, then id.
A clause that shares nothing with an item scores 0, so every item gets k clauses, or all there are. An empty corpus gives
none. Terms and concepts are known by a 64-bit hash in the tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.runtime import Scratch, filesystem, put_file

#: A term held by so many pairs of item and clause, one in DENSE, is cheaper in a product of matrices: a fixed value.
DENSE = 80
#: Blocks of items in a task at most.
ITEM_BLOCKS = 8
#: Terms a task holds to choose those of an item; where there are more, they are joined.
HELD_TERMS = 2_000_000
#: Ids that are sent to the tasks; where there are more, they are joined through a shuffle.
SENT_IDS = 2_000_000


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    idf_cap: float = 2.5
    query_terms: int = 40
    #: Characters of a body that an item's terms are chosen from; None: all of them.
    query_chars: int | None = None
    concept_bonus: float = 3.0
    least_concept_clauses: int = 2
    k: int = 5
    least_score: float = 20.0
    budget: int = 15
    clause_block: int = 4_096
    item_block: int = 1_024


def readable(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """Clauses with text, of documents that were read without error."""
    good = contracts.where("parse_error is null").select(F.col("id").alias("document_id")).distinct()
    # else the texts of all clauses would be shuffled, each time they are read
    good = F.broadcast(good) if contracts.count() <= SENT_IDS else good
    return clauses.where("trim(text) <> ''").join(good, "document_id", "left_semi")


def postings(corpus: DataFrame) -> DataFrame:
    """(id, term, tf, dl)."""
    t = corpus.select("id", T.tokens(F.col("text")).alias("tokens"))
    return t.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def idf_table(post: DataFrame, corpus: DataFrame, s: Settings) -> DataFrame:
    """(term, df, idf, avgdl): floored where negative, by the mean over all terms, then capped."""
    return idf_of(post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), corpus, s)


def idf_of(counted: DataFrame, corpus: DataFrame, s: Settings) -> DataFrame:
    """The same of (term, df, tf)."""
    n = corpus.agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("tf").alias("total"))
    raw = counted.select("term", "df").join(F.broadcast(n), F.lit(True)).join(F.broadcast(total), F.lit(True))
    raw = raw.select("term", "df", (F.col("total") / F.col("n")).alias("avgdl"), (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    floored = F.when(F.col("raw") < 0, s.epsilon * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", "avgdl", F.least(floored, F.lit(s.idf_cap)).alias("idf"))


def by_rows(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id stands in no other row, and the other rows, None if there are none."""
    again = scratch.put(rows.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"), name)
    n = again.count()
    if not n:
        return rows, None
    again, same = F.broadcast(again) if n <= SENT_IDS else again, F.col("id").eqNullSafe(F.col("_id"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def picked(rows: DataFrame, ranks: DataFrame, name: str = "id") -> DataFrame:
    """Rows whose id is among the clause_id of ranks; the others aren't shuffled for a join with them."""
    ids = ranks.select(F.col("clause_id").alias(name)).distinct()
    return rows.join(F.broadcast(ids), name, "left_semi") if ids.count() <= SENT_IDS else rows


def counts(single: DataFrame, several: DataFrame | None) -> DataFrame:
    """(term, df, tf) of by_rows; tf is right as a sum over all terms only. No posting leaves its task but those of ids in several rows."""
    t = single.select(T.tokens(F.col("text")).alias("tokens"))
    t = t.select(F.size("tokens").alias("dl"), F.posexplode(F.array_distinct("tokens")).alias("pos", "term"))
    out = t.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("pos") == 0, F.col("dl")).otherwise(0)).alias("tf"))
    if several is None:
        return out
    more = postings(several).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return out.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def _queried(items: DataFrame, s: Settings) -> DataFrame:
    """(item_id, tokens): what an item is known by."""
    body = F.coalesce(F.nullif(F.col("body_text"), F.lit("")), F.col("summary"), F.lit(""))
    body = body if s.query_chars is None else F.substring(body, 1, s.query_chars)
    return items.select(F.col("id").alias("item_id"), T.tokens(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), body)).alias("tokens"))


def query_terms(items: DataFrame, idf: DataFrame, s: Settings) -> DataFrame:
    """(item_id, term, idf, avgdl): the most telling terms of each item, by frequency and idf."""
    words = _queried(items, s).select("item_id", F.explode("tokens").alias("term"))
    counted = words.groupBy("item_id", "term").agg(F.count("*").alias("qtf")).join(idf.where("idf > 0"), "term")
    first = Window.partitionBy("item_id").orderBy(F.desc(F.round(F.col("qtf") * F.col("idf"), 6)), "term")
    return counted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= s.query_terms).select("item_id", "term", "idf", "avgdl")


def weights(post: DataFrame, idf: DataFrame, s: Settings) -> DataFrame:
    """(id, key, weight): what a term adds to a clause's score for each unit of its idf."""
    size = idf.agg(F.max("avgdl").alias("avgdl"))
    weight = F.col("tf") * (s.k1 + 1) / (F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("dl") / F.col("avgdl")))
    return post.join(F.broadcast(size), F.lit(True)).select("id", F.xxhash64("term").alias("key"), weight.alias("weight"))


def _lists(x: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists, 0 for null, and all their values."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), x.flatten()


def _listed(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values))


def _column(folder: str, *names: str) -> list[pa.ChunkedArray]:
    """Columns of a written table, for a task."""
    files, root = filesystem(folder)
    t = pq.read_table(root, filesystem=files, columns=list(names))
    return [t[n] for n in names]


def _chosen(folder: str, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What query_terms gives, for items that stand in one row each: (item_id, key, idf), lists of terms. folder: (term, key, idf)."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, keys, idfs = _column(folder, "term", "key", "idf")
        terms, keys, idfs = terms.combine_chunks(), keys.to_numpy(), idfs.to_numpy()
        for b in batches:
            n, words = _lists(b["tokens"])
            words = words.dictionary_encode()
            held, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(held, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
            rank = np.empty(len(held), dtype=np.int64)
            rank[pc.sort_indices(held).to_numpy()] = np.arange(len(held))
            cell, qtf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(held)) + code, return_counts=True)
            row, code = np.divmod(cell, max(1, len(held)))
            known = at[code] >= 0
            row, code, qtf = row[known], code[known], qtf[known]
            idf = idfs[at[code]]
            order = np.lexsort((rank[code], -np.floor(qtf * idf * 1e6 + 0.5), row))
            row = row[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < s.query_terms
            row, order = row[first], order[first]
            lengths = np.bincount(row, minlength=len(n))
            yield pa.RecordBatch.from_pydict({"item_id": b["item_id"], "key": _listed(lengths, keys[at[code[order]]]), "idf": _listed(lengths, idf[order])})

    return choose


def asked_terms(items: DataFrame, idf: DataFrame, folder: str, s: Settings, scratch: Scratch) -> DataFrame:
    """(item_id, key, idf): a list for each item, of its most telling terms. idf: as written to folder, with the key of each term."""
    single, several = by_rows(items.select("id", "title", "body_text", "summary"), scratch, "items_again")
    if idf.count() > HELD_TERMS:
        single, several = None, items
    listed = []
    if single is not None:
        listed.append(_queried(single, s).mapInArrow(_chosen(folder, s), "item_id long, key array<long>, idf array<double>"))
    if several is not None:
        terms = F.collect_list(F.struct(F.xxhash64("term").alias("key"), "idf"))
        none = F.array().cast("array<struct<key: bigint, idf: double>>")
        found = query_terms(several, idf, s).groupBy("item_id").agg(terms.alias("t"))
        found = found.unionByName(several.select(F.col("id").alias("item_id"), none.alias("t")))
        listed.append(found.select("item_id", F.col("t.key").alias("key"), F.col("t.idf").alias("idf")))
    return listed[0] if len(listed) == 1 else listed[0].unionByName(listed[1])


def placed(corpus: DataFrame, s: Settings) -> DataFrame:
    """(id, ref, block): clauses in order of ref and id, cut into blocks of about clause_block."""
    blocks = max(1, -(-corpus.count() // s.clause_block))
    ordered = corpus.select("id", F.coalesce("ref", F.lit("")).alias("ref")).repartitionByRange(blocks, "ref", "id")
    return ordered.select("id", "ref", F.spark_partition_id().alias("block"))


_ROWS = "block int, id long, ref string, dl int, number binary, tf array<int>, key array<long>, weight array<double>"


def _wide(asked: np.ndarray) -> str:
    """The kind of a term's number: what is shuffled is mostly such numbers."""
    return "<u2" if len(asked) <= 1 << 16 else "<u4"


def _counted(folder: str, bounds: list[tuple[str, int]], blocks: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Clauses as their block and the numbers and counts of the terms that are asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (asked,) = _column(folder, "key")
        asked = np.sort(asked.to_numpy())
        for b in batches:
            dl, key = _lists(b["keys"])
            key, row = key.to_numpy(), np.repeat(np.arange(len(dl)), dl)
            at = np.minimum(np.searchsorted(asked, key), max(0, len(asked) - 1))
            there = asked[at] == key if len(asked) else np.zeros(len(key), dtype=bool)
            cell, tf = np.unique(row[there] * max(1, len(asked)) + at[there], return_counts=True)
            row, number = np.divmod(cell, max(1, len(asked)))
            n = np.bincount(row, minlength=len(dl))
            block = [blocks[max(0, bisect_right(bounds, x) - 1)] for x in zip(b["ref"].to_pylist(), b["id"].to_pylist(), strict=True)]
            none = lambda kind: pa.nulls(len(dl), pa.list_(kind))  # noqa: E731, B023
            written, at = number.astype(_wide(asked)), np.append(0, np.cumsum(n))
            written = pa.Array.from_buffers(pa.binary(), len(dl), [None, pa.py_buffer((at * written.itemsize).astype(np.int32)), pa.py_buffer(written)])
            yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int32()), "id": b["id"], "ref": b["ref"], "dl": pa.array(dl, pa.int32()), "number": written, "tf": _listed(n, tf.astype(np.int32)), "key": none(pa.int64()), "weight": none(pa.float64())})

    return count


def _pack(asked_in: str, folder: str, avgdl: float, s: Settings) -> Callable[[pa.Table], pa.Table]:
    """Writes the clauses of a block, and the weights of each key in it, as one file."""

    def pack(rows: pa.Table) -> pa.Table:
        (asked,) = _column(asked_in, "key")
        asked = np.sort(asked.to_numpy())
        block, own = rows["block"][0].as_py(), pc.is_valid(rows["ref"])
        more, own = rows.filter(pc.invert(own)), rows.filter(own).sort_by([("ref", "ascending"), ("id", "ascending")])
        ids = own["id"].to_numpy()
        n, tf = _lists(own["tf"])
        number = np.frombuffer(b"".join(own["number"].to_pylist()), dtype=_wide(asked))
        place, tf, dl = np.repeat(np.arange(len(ids)), n), tf.to_numpy(), np.repeat(own["dl"].to_numpy(), n)
        key, weight = asked[number], tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * dl / avgdl))
        # what is known by id only, for each row of the id
        (n, more_key), (_, more_weight) = _lists(more["key"]), _lists(more["weight"])
        by, more_id = np.argsort(ids, kind="stable"), np.repeat(more["id"].to_numpy(), n)
        first, last = (np.searchsorted(ids[by], more_id, side) for side in ("left", "right"))
        place = np.concatenate([place, by[_spans(first, last - first)]]).astype(np.int32)
        key, weight = (np.concatenate([x, np.repeat(y.to_numpy(), last - first)]) for x, y in ((key, more_key), (weight, more_weight)))
        held = np.isin(key, asked)
        key, place, weight = key[held], place[held], weight[held]
        order = np.lexsort((place, key))
        key, place, weight = key[order], place[order], weight[order]
        # an id may stand in several rows of different length; their weights add up
        first = np.flatnonzero(np.diff(key, prepend=0).astype(bool) | np.diff(place, prepend=-1).astype(bool))
        weight = np.add.reduceat(weight, first) if len(first) else weight
        key, place = key[first], place[first]
        terms, begin = np.unique(key, return_index=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        out = pa.BufferOutputStream()
        pq.write_table(pa.table({"ids": one(ids), "terms": one(terms), "begin": one(np.append(begin, len(key))), "place": one(place), "weight": one(weight)}), out, compression="zstd")
        files, root = filesystem(folder)
        put_file(files, f"{root}/{block}.parquet", out.getvalue().to_pybytes())
        return pa.table({"block": pa.array([block], pa.int32())})

    return pack


def indexed(single: DataFrame, several: DataFrame | None, known: DataFrame, avgdl: float, s: Settings, scratch: Scratch) -> list[int]:
    """Writes a file for each block of clauses; the numbers of the blocks in order.

    single, several: clauses (id, ref, text), see by_rows; known: (id, key, weight), lists. Of the keys, those in the table keys of scratch.
    """
    places = scratch.put(placed(single if several is None else single.unionByName(several), s), "places")
    bounds = sorted((r["low"]["ref"], r["low"]["id"], r["block"]) for r in places.groupBy("block").agg(F.min(F.struct("ref", "id")).alias("low")).collect())
    if not bounds:
        return []
    of = _counted(f"{scratch.root}/keys", [b[:2] for b in bounds], [b[2] for b in bounds])
    text = lambda rows, t: rows.select("id", F.coalesce("ref", F.lit("")).alias("ref"), t.alias("keys"))
    rows = text(single, F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t))).mapInArrow(of, _ROWS)
    if several is not None:
        rows = rows.unionByName(text(several, F.array().cast("array<long>")).mapInArrow(of, _ROWS))
    none = lambda kind: F.lit(None).cast(kind)
    known = known.join(places.select("id", "block").distinct() if several is not None else places.select("id", "block"), "id")
    rows = rows.unionByName(known.select("block", "id", none("string").alias("ref"), none("int").alias("dl"), none("binary").alias("number"), none("array<int>").alias("tf"), "key", "weight"))
    return sorted(r["block"] for r in rows.groupBy("block").applyInArrow(_pack(f"{scratch.root}/keys", f"{scratch.root}/index", avgdl, s), "block int").collect())


class _Block:
    """A block of clauses as written by _pack: its terms, and the places and weights of each."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        with files.open_input_file(path) as f:
            t = pq.read_table(f)
        self.ids, self.terms, self.begin, self.place, self.weight = (t[c].chunk(0).values.to_numpy(zero_copy_only=False) for c in ("ids", "terms", "begin", "place", "weight"))
        self.n, self.place = len(self.ids), self.place.astype(np.intp)
        #: Term and place as one number, in order.
        self.cell = np.repeat(np.arange(len(self.terms)), np.diff(self.begin)) * self.n + self.place


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, size of them, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


class _Asked:
    """A block of items with the k best clauses of each so far."""

    def __init__(self, items: np.ndarray, row: np.ndarray, key: np.ndarray, idf: np.ndarray, s: Settings) -> None:
        self.items, self.s, self.m, k = items, s, len(items), s.k
        # by item: what it asks for; a concept has no idf
        order = np.argsort(row, kind="stable")
        row, key, self.idf = row[order], key[order], idf[order]
        self.named = np.isnan(self.idf)
        self.begin = np.searchsorted(row, np.arange(self.m + 1))
        self.terms, self.term = np.unique(key, return_inverse=True)
        value = np.where(self.named, s.concept_bonus, self.idf)
        # by term: the items that ask for it
        by = np.argsort(self.term, kind="stable")
        self.row, self.value = row[by], value[by].astype(np.float32)
        self.first = np.searchsorted(self.term[by], np.arange(len(self.terms) + 1))
        #: What a term is worth is the same for all items.
        self.each = value[by][self.first[:-1]]
        self.score, self.text, self.both = np.full((self.m, k), -np.inf), np.zeros((self.m, k)), np.zeros((self.m, k), dtype=np.int64)
        self.clause, self.at = np.zeros((self.m, k), dtype=np.int64), np.zeros((self.m, k), dtype=np.int64)
        # how far a sum in single precision can be off, and what a clause must add to a tie to be more than one
        most = np.bincount(row, np.where(self.named, abs(value), value * (s.k1 + 1)), self.m)
        self.off = (np.diff(self.begin) + 8) * 1.2e-7 * most
        whole = s.concept_bonus * 1e4
        self.lift = 4e-5 if abs(whole - round(whole)) < 1e-6 else -1e-5

    def meet(self, b: _Block, seen: int) -> None:
        """Takes the clauses of a block in; seen: clauses before it, all of which come first among equals."""
        k, n = self.s.k, b.n
        at = np.minimum(np.searchsorted(b.terms, self.terms), max(0, len(b.terms) - 1))
        there = b.terms[at] == self.terms if len(b.terms) else np.zeros(len(self.terms), dtype=bool)
        near = self._near(b, np.flatnonzero(there), at)
        full = self.score[:, -1] > -np.inf
        need = np.where(full, self.score[:, -1] + self.lift - self.off, -np.inf)
        kth = lambda rows: np.partition(near[rows], n - k, axis=1)[:, n - k] - 2 * self.off[rows] - 2e-4
        if n > k and not full.all():
            need[~full] = kth(~full)
        # a clause that shares nothing is among the best only where there are too few others, and then by its place
        least = np.maximum(need, 0) if self.s.concept_bonus >= 0 else need
        found = near > least.astype(np.float32)[:, None] if self.s.concept_bonus >= 0 else near >= need.astype(np.float32)[:, None]
        found[~full, :k] = True
        i, j = np.divmod(np.flatnonzero(found), n)
        many = np.bincount(i, minlength=self.m) > 8 * k
        if n > k and (many & full).any():
            need[many & full] = np.maximum(need[many & full], kth(many & full))
            i, j = (x[near[i, j] >= need[i].astype(np.float32)] for x in (i, j))
        if len(i):
            self._take(b, seen, i, j, np.where(there, at, -1))

    def _near(self, b: _Block, held: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of all items and clauses in single precision: frequent terms as a product of matrices, the others one by one."""
        first, last = b.begin[at[held]], b.begin[at[held] + 1]
        asks, df = self.first[held + 1] - self.first[held], last - first
        dense = asks * df * DENSE > self.m * b.n
        d, wide = held[dense], int(dense.sum())
        left, right = np.zeros((self.m, wide), dtype=np.float32), np.zeros((wide, b.n), dtype=np.float32)
        x, y = _spans(self.first[d], asks[dense]), _spans(first[dense], df[dense])
        left[self.row[x], np.repeat(np.arange(wide), asks[dense])] = self.value[x]
        right[np.repeat(np.arange(wide), df[dense]), b.place[y]] = b.weight[y]
        near = left @ right
        # by item: its row of scores stays in the processor's cache
        worth = (b.weight * np.repeat(self._worth(b), np.diff(b.begin))).astype(np.float64, copy=False)
        places, worths, sparse = {}, {}, np.zeros(len(self.terms), dtype=bool)
        for t, f, e in zip(held[~dense].tolist(), first[~dense].tolist(), last[~dense].tolist(), strict=True):
            places[t], worths[t] = b.place[f:e], worth[f:e]
        sparse[held[~dense]] = True
        asked = sparse[self.term]
        terms, begin = self.term[asked].tolist(), np.append(0, np.cumsum(asked))[self.begin].tolist()
        for i in range(self.m):
            if own := terms[begin[i] : begin[i + 1]]:
                near[i] += np.bincount(np.concatenate([places[t] for t in own]), np.concatenate([worths[t] for t in own]), b.n)
        return near

    def _worth(self, b: _Block) -> np.ndarray:
        """What a unit of weight of each term of a block is worth, 0 if no item asks for it."""
        at = np.minimum(np.searchsorted(self.terms, b.terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == b.terms, self.each[at], 0.0) if len(self.terms) else np.zeros(len(b.terms))

    def _take(self, b: _Block, seen: int, i: np.ndarray, j: np.ndarray, at: np.ndarray) -> None:
        """Scores the pairs of item and place exactly and keeps the k best of each item."""
        s, k, many = self.s, self.s.k, self.begin[i + 1] - self.begin[i]
        entry, pair = _spans(self.begin[i], many), np.repeat(np.arange(len(i)), many)
        term = at[self.term[entry]]
        entry, pair, cell = (x[term >= 0] for x in (entry, pair, term * b.n + j[pair]))
        where = np.minimum(np.searchsorted(b.cell, cell), max(0, len(b.cell) - 1))
        hit = b.cell[where] == cell if len(b.cell) else np.zeros(len(cell), dtype=bool)
        entry, pair, where = entry[hit], pair[hit], where[hit]
        named = self.named[entry]
        text = np.bincount(pair[~named], b.weight[where[~named]] * self.idf[entry[~named]], len(i)).round(4)
        both = np.bincount(pair[named], minlength=len(i))
        score = (text + s.concept_bonus * both).round(4)
        more = score > self.score[i, -1]
        rows = np.unique(i[more])
        old, col = np.nonzero(self.score[rows] > -np.inf)
        old = rows[old]
        row = np.concatenate([old, i[more]])
        kept = [np.concatenate([x[old, col], y]) for x, y in ((self.score, score[more]), (self.at, seen + j[more]), (self.text, text[more]), (self.both, both[more]), (self.clause, b.ids[j[more]]))]
        order = np.lexsort((kept[1], -kept[0], row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < k
        for x, y in zip((self.score, self.at, self.text, self.both, self.clause), kept, strict=True):
            x[row[best], rank[best]] = y[order][best]

    def result(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_pydict({"item_id": self.items[i], "rank": (j + 1).astype(np.int32), "clause_id": self.clause[i, j], "bm25": self.text[i, j], "shared": self.both[i, j], "score": self.score[i, j]})


def _best(folder: str, blocks: list[int], s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best clauses of each item of a task, which reads the blocks of clauses one after the other."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        asked = np.unique(t["item_id"].to_numpy())
        (n, key), (_, idf) = _lists(t["key"]), _lists(t["idf"])
        row, key, idf = np.repeat(np.searchsorted(asked, t["item_id"].to_numpy()), n), key.to_numpy(), idf.to_numpy()
        parts = []
        for first in range(0, len(asked), s.item_block):
            own = (row >= first) & (row < first + s.item_block)
            parts.append(_Asked(asked[first : first + s.item_block], row[own] - first, key[own], idf[own], s))
        files, root = filesystem(folder)
        seen = 0
        for n in blocks:
            block = _Block(files, f"{root}/{n}.parquet")
            for p in parts:
                p.meet(block, seen)
            seen += block.n
        for p in parts:
            yield p.result()

    return best


def best_in_blocks(items: DataFrame, asked: DataFrame, blocks: list[int], s: Settings, scratch: Scratch) -> DataFrame:
    """(item_id, rank, clause_id, bm25, shared, score): the k best clauses of each item, of the blocks in the folder index of scratch.

    asked: (item_id, key, idf), lists, a row or more for each item; keys whose idf isn't a number count as shared concepts.
    """
    n_items, cores = items.count(), items.sparkSession.sparkContext.defaultParallelism
    # a task reads all blocks of clauses, so it takes several blocks of items, unless some cores had nothing to do then
    tasks = max(1, -(-n_items // (ITEM_BLOCKS * s.item_block)), min(3 * cores, -(-n_items // 32)))
    return asked.repartition(tasks, "item_id").mapInArrow(_best(f"{scratch.root}/index", blocks, s), "item_id long, rank int, clause_id long, bm25 double, shared long, score double")


def clause_tags(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct (id, slug): concepts of clauses; edges to what doesn't exist are dropped."""
    return edges.join(F.broadcast(concepts.select(F.col("id").alias("concept_id"), "slug")), "concept_id").select(F.col("clause_id").alias("id"), "slug").distinct()


def item_tags(items: DataFrame, concepts: DataFrame, tags: DataFrame, s: Settings) -> DataFrame:
    """Distinct (item_id, slug): concepts named in an item's title or body.

    The distinct words of a text meet the longest word of each concept's name in an equi-join; only texts that hold it are
    searched for the name's pattern. No text leaves its task.
    """
    used = tags.groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n") >= s.least_concept_clauses).select("slug")
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    longest = F.array_max(F.transform(letters("name"), lambda w: F.struct(F.length(w).alias("n"), w.alias("word")))).getField("word")
    named = concepts.join(used, "slug").select("slug", T.concept_pattern(F.col("name")).alias("pattern"), F.concat(F.lit(" "), F.array_join(letters("name"), " ")).alias("phrase"), longest.alias("word"), F.element_at(letters("name"), -1).alias("last")).where("pattern is not null")
    # the last word may have an s behind it
    keys = named.select("slug", "pattern", "phrase", F.explode(F.array_distinct(F.array("word", F.when(F.col("word") == F.col("last"), F.concat("word", F.lit("s"))).otherwise(F.col("word"))))).alias("word"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body_text", F.lit("")))
    # a pattern is slow to search for: first its words, between single blanks, as a plain string
    plain = F.concat(F.lit(" "), F.lower(F.regexp_replace("text", "[^a-zA-Z0-9_]+", " ")))
    words = items.select(F.col("id").alias("item_id"), text.alias("text")).select("item_id", "text", plain.alias("plain"))
    words = words.select("item_id", "text", "plain", F.explode(F.array_distinct(letters("text"))).alias("word"))
    return words.join(F.broadcast(keys), "word").where(F.expr("contains(plain, phrase) and regexp_like(text, pattern)")).select("item_id", "slug").distinct()


def declared_tags(pages: DataFrame) -> DataFrame:
    """Distinct (item_id, slug): concepts that the front matter of rendered items (item_id, markdown) lists; pages without one list none."""
    head = F.regexp_extract("markdown", r"(?s)\A---\n(.*?)\n---", 1)
    listed = F.regexp_extract(head, r"(?m)^concepts: \[(.*)\]$", 1)
    return pages.select("item_id", F.explode(F.split(listed, r"\s*,\s*")).alias("slug")).where("slug rlike '^[a-z0-9-]+$'").distinct()


def ranked(items: DataFrame, clauses: DataFrame, contracts: DataFrame, concepts: DataFrame, edges: DataFrame, s: Settings | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, clause_id, bm25, shared, score): the k best clauses of each item. declared: (item_id, slug), concepts of items beside those named in them."""
    s = s or Settings()
    scratch = Scratch(items.sparkSession, "retrieve")
    corpus = readable(clauses, contracts).select("id", "ref", "text")
    single, several = by_rows(corpus, scratch, "clauses_again")
    counted = scratch.put(counts(single, several), "counts")
    idf = scratch.put(idf_of(counted, corpus, s).withColumn("key", F.xxhash64("term")), "idf")
    avgdl = idf.agg(F.max("avgdl")).first()[0] or 1.0
    telling = scratch.put(idf.where("idf > 0").select("term", "key", "idf", "avgdl"), "telling")
    tags = clause_tags(edges, concepts)
    own = item_tags(items, concepts, tags, s)
    own = own if declared is None else own.unionByName(declared.select("item_id", "slug")).distinct()
    concept = F.xxhash64(F.lit("concept"), "slug")
    named = own.groupBy("item_id").agg(F.collect_set(concept).alias("key")).select("item_id", "key", F.transform("key", lambda _: F.lit(float("nan"))).alias("idf"))
    items, own_id = items.where("id is not null"), F.col("item_id").isNotNull()
    asked = scratch.put(asked_terms(items, telling, f"{scratch.root}/telling", s, scratch).unionByName(named.where(own_id).join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")), "asked")
    scratch.put(asked.select(F.explode("key").alias("key")).distinct(), "keys")
    known = edges.join(F.broadcast(concepts.select(F.col("id").alias("concept_id"), concept.alias("key"))), "concept_id").groupBy(F.col("clause_id").alias("id")).agg(F.collect_set("key").alias("key"))
    known = known.select("id", "key", F.transform("key", lambda _: F.lit(1.0)).alias("weight"))
    if several is not None:
        weighed = weights(postings(several), idf, s).groupBy("id").agg(F.collect_list(F.struct("key", "weight")).alias("t"))
        known = known.unionByName(weighed.select("id", F.col("t.key").alias("key"), F.col("t.weight").alias("weight")))
        several = several.where("id is not null")
    blocks = indexed(single.where("id is not null"), several, known.where("id is not null"), avgdl, s, scratch)
    ranks = scratch.put(best_in_blocks(items, asked, blocks, s, scratch), "ranked")
    scratch.drop("clauses_again", "items_again", "counts", "idf", "telling", "asked", "keys", "places", "index")
    return ranks


def gated(ranks: DataFrame, items: DataFrame, s: Settings | None = None) -> DataFrame:
    """(item_id, best, outcome): judged, over_budget, gated or no_candidates, in order of the best score."""
    s = s or Settings()
    best = ranks.where("rank = 1").select("item_id", F.col("score").alias("best"))
    all_items = items.select(F.col("id").alias("item_id"), T.iso_date(F.col("sitting_date")).alias("day")).join(best, "item_id", "left")
    passed = all_items.where(F.col("best") >= s.least_score)
    # the budget is a small number: a top-k, not a global sort
    judged = passed.orderBy(F.desc("best"), F.desc_nulls_last("day"), "item_id").limit(s.budget).select("item_id", F.lit(True).alias("judged"))
    outcome = F.when(F.col("best").isNull(), "no_candidates").when(F.col("best") < s.least_score, "gated").when(F.col("judged"), "judged").otherwise("over_budget")
    return all_items.join(judged, "item_id", "left").select("item_id", "best", outcome.alias("outcome"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return outcomes.agg(F.count("*").alias("items"), *[count(x) for x in ("judged", "over_budget", "gated", "no_candidates")])


