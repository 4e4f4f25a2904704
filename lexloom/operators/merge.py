"""Upserts, merges and change logs as plain joins and aggregates: what a table is after new rows came in.

Every function takes and gives DataFrames and changes nothing in place; ``Scratch`` or a streaming sink stores the result.
Keys that are null match nothing. Ties are broken by the columns named in ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: of a repeated key the greatest by ``order`` counts."""
    columns = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` stay as they were where the key was known."""
    before = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_known"))
    fresh = new.join(before, key, "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    return old.join(new.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def signature(*columns: str) -> Column:
    """One number for the values of several columns; a null is a value of its own in its column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def merge_actions(old: DataFrame, new: DataFrame, key: str, scope: str, compare: tuple[str, ...]) -> DataFrame:
    """(key, action): insert, update, keep or delete; rows of ``old`` are deleted only within the scopes that ``new`` holds."""
    sign = lambda df, name: df.select(key, signature(*compare).alias(name))
    touched = new.select(scope).distinct()
    both = sign(old.join(touched, scope, "left_semi"), "_o").join(sign(new, "_n"), key, "full_outer")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o") == F.col("_n"), "keep").otherwise("update")
    return both.select(key, action.alias("action"))


def merged(old: DataFrame, new: DataFrame, key: str, scope: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` after the scopes in ``new`` came in again: their rows are those of ``new``, all else stays. Columns in ``keep``
    stay as they were where the key was known in the scope's old rows."""
    touched = new.select(scope).distinct()
    inside = old.join(touched, scope, "left_semi")
    return old.join(touched, scope, "left_anti").unionByName(upsert(inside, new, key, keep).join(new.select(key), key, "left_semi").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Child rows after those of some parents (a column of this name) are replaced by ``new``; parents without new rows lose theirs."""
    gone = parents.select(parent).where(F.col(parent).isNotNull()).distinct()
    return old.join(gone, parent, "left_anti").unionByName(new.join(gone, parent, "left_semi").select(*old.columns))


def keep_unless_forced(old: DataFrame, new: DataFrame, scope: str, force: bool = False) -> DataFrame:
    """Labels after a run: a scope that has labels keeps them, unless forced; scopes not in ``new`` keep theirs in any case."""
    if force:
        return replace_children(old, new, new, scope)
    return old.unionByName(new.join(old.select(scope).distinct(), scope, "left_anti").select(*old.columns))


def first_valid(rows: DataFrame, key: str, value: str, order: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """(key, value): of each key the first value by ``order`` that is allowed."""
    return rows.where(F.col(value).isin(*allowed)).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def update_where_given(table: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """``table`` with ``value`` from ``values`` (unique by key) where it is given there."""
    given = values.select(key, F.col(value).alias("_given"))
    out = table.join(given, key, "left").withColumn(value, F.coalesce("_given", value))
    return out.select(*table.columns)


def orphans(rows: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """Rows that no link (its first column) names."""
    return rows.join(links.select(F.col(links.columns[0]).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


# ---- change logs ------------------------------------------------------------------------------------------------


def change_log(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, seq, before, after): each change of a key's value in order, from the rows that held it. The first row of a key is no change."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    held = rows.where(F.col(key).isNotNull()).select(key, F.col(order).alias("seq"), F.lag(value).over(w).alias("before"), F.col(value).alias("after"), F.row_number().over(w).alias("_n"))
    return held.where("_n > 1 and not (before <=> after)").select(key, "seq", "before", "after")


def replayed(log: DataFrame, key: str) -> DataFrame:
    """(key, value, changes): what the log says each key is now."""
    return log.groupBy(key).agg(F.max_by("after", "seq").alias("value"), F.count("*").alias("changes"))


def rewound(log: DataFrame, key: str, upto: Column | None = None) -> DataFrame:
    """(key, value): what each key was before the first change, or before the first of those that ``upto`` picks."""
    return (log if upto is None else log.where(upto)).groupBy(key).agg(F.min_by("before", "seq").alias("value"))
