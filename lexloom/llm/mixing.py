"""Mixing sources to target weights by pivotal dependent rounding.

A source's target (its share of the budget) over its own tokens is the mean number of copies of its records, at most
``max_repeats``. Each record gets the whole part of that number for certain and one more copy with the fractional part as
probability. The fractions are rounded dependently: two records exchange probability, weighted by their sizes, until one
of them is 0 or 1, up or down at random so that each expectation stays. So the drawn tokens keep their sum and each
source misses its target by less than one record.

Records are spread over groups of bounded size; a group leaves one record with a fraction at most, and these residuals
are combined in a tree of rounds, ``group_rows`` to one, until one is left per source; that one is drawn.

Defined results: sources are compared trimmed and in lower case; null or blank sources and sources without a target take
no part; a source with a target but no tokens has 0 copies and counts as capped if its target is above 0; a null
max_repeats is 1; records of size 0 get the whole part of the copies; targets named twice are added up, with the larger
max_repeats; an empty table gives a report of zeros; the result depends on the rows and the seed only.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import Scratch

#: Targets name sources; more than so many are refused, as the targets are sent to all executors.
MOST_SOURCES = 10_000


def plain(source: Column) -> Column:
    """The name sources are compared by; null if blank."""
    name = F.lower(F.trim(source))
    return F.when(name != "", name)


def pivot(sizes: list[int], chances: list[float], draw: random.Random) -> tuple[list[int], int, float]:
    """(extra copy of each record, index of the one left with a fraction or -1, that fraction)."""
    extra, held, p = [0] * len(sizes), -1, 0.0
    for i, (size, q) in enumerate(zip(sizes, chances)):
        if q <= 1e-12 or q >= 1 - 1e-12:
            extra[i] = int(q >= 0.5)
            continue
        if held < 0:
            held, p = i, q
            continue
        a, b = sizes[held], size
        # mass in tokens that can go from held to i, and from i to held
        forth, back = min(p * a, (1 - q) * b), min((1 - p) * a, q * b)
        if draw.random() * (forth + back) < back:
            p, q = p - forth / a, q + forth / b
        else:
            p, q = p + back / a, q - back / b
        if p <= 1e-12 or p >= 1 - 1e-12:
            extra[held] = int(p >= 0.5)
            if q <= 1e-12 or q >= 1 - 1e-12:
                extra[i], held, p = int(q >= 0.5), -1, 0.0
            else:
                held, p = i, q
        else:
            extra[i] = int(q >= 0.5)
    return extra, held, p


@dataclass
class Mix:
    """copies (id, source, size, copies): how often each record is taken; report: one row per target."""

    copies: DataFrame
    report: DataFrame


def _settler(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_spread", "id", "size"], kind="stable").reset_index(drop=True)
        draw = random.Random(f"{seed}:{level}:{pdf['source'].iloc[0]}:{pdf['_bucket'].iloc[0]}")
        extra, held, p = pivot(pdf["size"].tolist(), pdf["chance"].tolist(), draw)
        copies, chance, left = pdf["copies"].to_numpy() + extra, [0.0] * len(pdf), [False] * len(pdf)
        if held >= 0 and last:
            copies[held] += int(draw.random() < p)
        elif held >= 0:
            chance[held], left[held] = p, True
        return pdf.assign(copies=copies, chance=chance, _open=left)[["id", "source", "size", "copies", "chance", "_spread", "_open"]]

    return settle


def mix(sized: DataFrame, targets: DataFrame, scratch: Scratch, seed: int = 20240501, group_rows: int = 20_000) -> Mix:
    """``sized``: (id, source, size); ``targets``: (source, target_share, max_repeats)."""
    wanted = targets.select(plain(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    if (n := wanted.count()) > MOST_SOURCES:
        raise ValueError(f"{n} targets; at most {MOST_SOURCES} are supported")
    rows = sized.select("id", plain(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size")).where("source is not null")
    rows = scratch.put(rows.join(F.broadcast(wanted.select("source")), "source"), "rows")
    own = rows.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("records"))
    plan = wanted.join(own, "source", "left").na.fill(0, ["tokens", "records"])
    plan = scratch.put(plan, "own")
    budget = plan.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = plan.withColumn("budget", F.lit(budget).cast("long")).withColumn("target", F.col("target_share") * F.col("budget"))
    plan = plan.withColumn("capped", F.col("target") > F.col("max_repeats") * F.col("tokens"))
    plan = plan.withColumn("repeats", F.when(F.col("tokens") == 0, F.lit(0.0)).otherwise(F.least(F.col("target") / F.col("tokens"), F.col("max_repeats").cast("double"))))
    plan = scratch.put(plan, "plan")

    rate = F.broadcast(plan.select("source", "repeats"))
    start = rows.join(rate, "source").select("id", "source", "size", F.floor("repeats").cast("long").alias("copies"), (F.col("repeats") - F.floor("repeats")).alias("chance"), F.xxhash64("id", "size").alias("_spread"))
    settled = [start.where("size = 0").select("id", "source", "size", "copies")]
    left = start.where("size > 0")
    buckets, level, kind = max(1, -(-rows.count() // group_rows)), 0, dict(rows.dtypes)["id"]
    while True:
        last = buckets == 1
        grouped = left.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(level), "_spread"), F.lit(buckets)))
        done = scratch.put(grouped.groupBy("source", "_bucket").applyInPandas(_settler(seed, level, last), f"id {kind}, source string, size long, copies long, chance double, _spread long, _open boolean"), f"settled{level}")
        settled.append(done.where("not _open").select("id", "source", "size", "copies"))
        if last:
            break
        left, buckets, level = done.where("_open").drop("_open"), -(-buckets // group_rows), level + 1
    copies = settled[0]
    for x in settled[1:]:
        copies = copies.unionByName(x)
    taken = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most_copies"))
    taken = scratch.put(taken, "taken")
    total = taken.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
    report = plan.join(taken, "source", "left").na.fill(0, ["taken", "most_copies"]).withColumn("total", F.lit(total).cast("long"))
    report = report.select(
        "source", "target_share", "max_repeats", "records", "tokens", "target", "repeats", "capped", "taken", "most_copies",
        F.when(F.col("budget") > 0, F.col("taken") / F.col("budget")).alias("share_of_budget"), F.when(F.col("total") > 0, F.col("taken") / F.col("total")).alias("share_of_mix"),
    )
    return Mix(copies, report)
