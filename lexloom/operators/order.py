"""Positions over a whole table without gathering it: numbers from 0 in an order, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import Scratch

_WITHIN = (1 << 33) - 1


def positions(df: DataFrame, *order: str, name: str = "position", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the place of each row by ``order``, from 0. The order should have no ties; rows that tie take their places in any order.

    Rows are cut into ranges, each sorted on its own; only the number of rows of each range reaches the driver. The ranges
    are written before they are counted, as a range that is made again may be cut elsewhere.
    """
    scratch = scratch or Scratch(df.sparkSession, "positions")
    local = F.monotonically_increasing_id()
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = scratch.put(cut.withColumn("_part", F.shiftright(local, 33).cast("int")).withColumn("_in", local.bitwiseAND(_WITHIN)), name)
    start, total = {}, 0
    for part, rows in sorted((r["_part"], r["n"]) for r in cut.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        start[part], total = total, total + rows
    if not start:
        return cut.drop("_part", "_in").withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_part"))
    return cut.withColumn(name, offset + F.col("_in")).drop("_part", "_in")


def dealt_out(rows: DataFrame, hands: DataFrame, each: int, place: str = "position") -> DataFrame:
    """Rows dealt to ``each`` hands in turn: row i to hands i, i + 1 and so on, modulo their number. Both sides have a column ``place``."""
    n = hands.agg(F.count("*").alias("_n"))
    turns = rows.join(F.broadcast(n), F.lit(True)).where("_n > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.least(F.lit(each), F.col("_n").cast("int")) - 1)))
    turns = turns.withColumn("_hand", F.pmod(F.col(place) + F.col("_turn"), F.col("_n"))).drop("_n", "_turn")
    return turns.join(hands.withColumnRenamed(place, "_hand"), "_hand").drop("_hand")


def in_list_order(names: Column) -> Column:
    """An array as (place, value) pairs to explode, to join and yet keep the order of the list."""
    return F.posexplode(names)
