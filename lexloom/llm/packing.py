"""Filling containers of fixed capacity with whole items.

Items are spread evenly over groups of bounded size by a hash of their id, so no source or key makes a hot group. Each
group is packed on its own: best fit in decreasing order, then local search among the containers below ``full``, which moves
an item, exchanges one for one or two for one whenever that increases the sum of squared fills, until the emptiest
containers are empty or nothing more can be gained. A container is closed when it is full enough or has less room than
the smallest item of its round. The items of the others go on to the next round, in as many groups of the same size as
they fill; so the room lost at the edges of groups is won back. The rounds end with one group, or when most items of a
round would go on: then all containers are closed as they are. No group is ever larger than ``group_rows`` on average.

An item above the capacity is the only kind that is split: into parts of exactly the capacity, each a full container,
and a rest that is packed like any other item.

Defined results: items of size 0 (null or empty texts) need no room and get no container (null); repeated ids are items
of their own; ties are broken by id and part; an empty table gives no rows; only the id and the size are carried along.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import Scratch


class Bins:
    """Containers of one group while they are filled."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.fill = capacity, [], []

    def best_fit(self, items: list[tuple[int, int]]) -> None:
        """items: (size, index), largest first."""
        room: list[tuple[int, int]] = []
        for size, index in items:
            at = bisect_left(room, (size, -1))
            if at == len(room):
                self.items.append([(size, index)])
                self.fill.append(size)
                insort(room, (self.capacity - size, len(self.fill) - 1))
            else:
                left, b = room.pop(at)
                self.items[b].append((size, index))
                self.fill[b] += size
                insort(room, (left - size, b))

    def gain(self, a: int, b: int, shift: int) -> int:
        """What moving so much from a to b adds to the sum of squared fills."""
        return 2 * shift * (self.fill[b] - self.fill[a] + shift)

    def apply(self, a: int, b: int, out: list, back: list) -> None:
        for x in out:
            self.items[a].remove(x)
            self.items[b].append(x)
        for x in back:
            self.items[b].remove(x)
            self.items[a].append(x)
        shift = sum(x[0] for x in out) - sum(x[0] for x in back)
        self.fill[a] -= shift
        self.fill[b] += shift

    def improve(self, a: int, b: int) -> bool:
        """The best move or exchange that shifts load from a into the fuller b."""
        room, best = self.capacity - self.fill[b], (0, None, None)
        if room <= 0:
            return False
        mine, theirs = sorted(self.items[a]), sorted(self.items[b])
        sizes = [x[0] for x in mine]
        fits = bisect_left(sizes, room + 1)
        if fits:  # a move
            best = max(best, (self.gain(a, b, sizes[fits - 1]), [mine[fits - 1]], []), key=lambda x: x[0])
        for y in theirs:  # one for one: the largest x with y < x <= y + room
            at = bisect_left(sizes, y[0] + room + 1) - 1
            if at >= 0 and sizes[at] > y[0] and (g := self.gain(a, b, sizes[at] - y[0])) > best[0]:
                best = (g, [mine[at]], [y])
            i, j = 0, len(mine) - 1  # two for one: the largest sum within y + room
            top = None
            while i < j:
                total = sizes[i] + sizes[j]
                if total > y[0] + room:
                    j -= 1
                else:
                    if total > y[0] and (top is None or total > top[0]):
                        top = (total, i, j)
                    i += 1
            if top and (g := self.gain(a, b, top[0] - y[0])) > best[0]:
                best = (g, [mine[top[1]], mine[top[2]]], [y])
        if best[0] <= 0:
            return False
        self.apply(a, b, best[1], best[2])
        return True

    def _sizes(self, b: int) -> tuple[int, int, int, int]:
        """Smallest and largest item, smallest and largest sum of two."""
        sizes = sorted(x[0] for x in self.items[b])
        if not sizes:
            return 0, 0, 0, 0
        return sizes[0], sizes[-1], *((sizes[0] + sizes[1], sizes[-1] + sizes[-2]) if len(sizes) > 1 else (self.capacity + 1, 0))

    def search(self, full: float, steps: int | None = None) -> None:
        """Empty the emptiest underfull container into the fuller ones, in so many sweeps or until one changes nothing.

        Every change raises the sum of squared fills, so the sweeps end. Containers whose sizes allow no move and no exchange
        are passed over at once.
        """
        bound = full * self.capacity
        for _ in count() if steps is None else range(steps):
            open_bins = sorted((b for b in range(len(self.fill)) if 0 < self.fill[b] < bound), key=lambda b: (self.fill[b], b))
            if len(open_bins) < 2:
                return
            changed = False
            known = np.array([self._sizes(b) for b in open_bins], dtype=np.int64)
            fill = np.array([self.fill[b] for b in open_bins], dtype=np.int64)

            def useful(n: int, upto: int) -> np.ndarray:
                """Places from n to upto, the last first, that container n might give to."""
                low, high, low_two, high_two = known[n]
                room, (lows, highs) = self.capacity - fill[n + 1 : upto], known[n + 1 : upto, :2].T  # noqa: B023
                swap = (high > lows) | ((high_two > lows) & (low_two <= highs + room))
                fits = (room > 0) & ((low <= room) | swap) & (fill[n + 1 : upto] >= fill[n])  # noqa: B023
                return np.flatnonzero(fits)[::-1] + n + 1

            for n, a in enumerate(open_bins):
                upto = len(open_bins)
                while self.fill[a] and upto > n + 1:
                    for m in useful(n, upto):
                        b, before = open_bins[m], self.fill[a]
                        while self.fill[a] and self.fill[b] >= self.fill[a] and self.improve(a, b):
                            changed = True
                        if self.fill[a] != before:
                            for k in (n, m):
                                known[k], fill[k] = self._sizes(open_bins[k]), self.fill[open_bins[k]]
                            upto = m
                            break
                    else:
                        break
            if not changed:
                return


def pack_group(sizes: list[int], capacity: int, full: float, steps: int | None = None) -> tuple[list[int], list[int]]:
    """(container of each item, fill of each container)."""
    bins = Bins(capacity)
    bins.best_fit(sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: (-x[0], x[1])))
    bins.search(full, steps)
    of = [0] * len(sizes)
    for b, items in enumerate(bins.items):
        for _, i in items:
            of[i] = b
    return of, bins.fill


def _filler(capacity: int, full: float, steps: int | None, level: int, last: bool, least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "part", "_spread"], ascending=False, kind="stable").reset_index(drop=True)
        of, fills = pack_group(pdf["size"].tolist(), capacity, full, steps)
        group = pdf["_group"].iloc[0]
        pdf["container"] = [f"{level}-{group}-{b}" for b in of]
        pdf["_open"] = [not last and fills[b] < full * capacity and capacity - fills[b] >= least for b in of]
        return pdf[["id", "part", "parts", "size", "_spread", "container", "_open"]]

    return fill


def pack(sized: DataFrame, capacity: int, scratch: Scratch, group_rows: int = 4_000, full: float = 0.98, steps: int | None = None) -> DataFrame:
    """(id, part, parts, size, container) for each part of each row of ``sized`` (id, size).

    group_rows: items packed in one task on average; full: containers filled less are opened again in the next
    round; steps: most sweeps of the local search, by default as many as change something.
    """
    sized = sized.select("id", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    parts = sized.select("id", F.col("size").alias("total"), F.greatest(F.ceil(F.col("size") / F.lit(capacity)), F.lit(1)).cast("int").alias("parts"))
    parts = parts.select("id", "total", "parts", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    # repeated ids are told apart by where they stand
    parts = scratch.put(parts.select("id", "part", "parts", F.when(F.col("part") < F.col("parts"), F.lit(capacity)).otherwise(F.col("total") - capacity * (F.col("parts") - 1)).cast("long").alias("size"), F.monotonically_increasing_id().alias("_row")), "parts")
    parts = parts.withColumn("_spread", F.xxhash64("id", "part", "_row"))
    whole = parts.where(F.col("size") == capacity).select("id", "part", "parts", "size", F.concat_ws("-", F.lit("full"), "_row").alias("container"))
    none = parts.where("size <= 0").select("id", "part", "parts", "size", F.lit(None).cast("string").alias("container"))
    rest, kind = parts.where((F.col("size") > 0) & (F.col("size") < capacity)).select("id", "part", "parts", "size", "_spread"), dict(sized.dtypes)["id"]
    level, done, before = 0, [], None
    while True:
        rows, least = rest.agg(F.count("*"), F.min("size")).first()
        groups = max(1, -(-rows // group_rows))
        last = groups == 1 or (before is not None and 2 * rows > before)
        spread = rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(level), F.col("_spread")), F.lit(groups)))
        packed = scratch.put(spread.groupBy("_group").applyInPandas(_filler(capacity, full, steps, level, last, least or 0), f"id {kind}, part int, parts int, size long, _spread long, container string, _open boolean"), f"packed{level}")
        done.append(packed.where("not _open").select("id", "part", "parts", "size", "container"))
        if last:
            break
        rest, before, level = packed.where("_open").select("id", "part", "parts", "size", "_spread"), rows, level + 1
    out = whole.unionByName(none)
    for x in done:
        out = out.unionByName(x)
    return out


def split_items(packed: DataFrame) -> DataFrame:
    """(id): items that stand in more than one container."""
    return packed.where("container is not null").groupBy("id").agg(F.countDistinct("container").alias("n")).where("n > 1").select("id")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, used, lower_bound, fill): how full the containers are; lower_bound: total size over capacity."""
    per = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("s"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("s"), F.lit(0)).alias("used")).select("containers", "used", F.ceil(F.col("used") / capacity).cast("long").alias("lower_bound"), F.when(F.col("containers") > 0, F.col("used") / (F.col("containers") * capacity)).alias("fill"))
