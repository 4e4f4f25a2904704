"""Roll-ups over levels: greatest of an ordered vocabulary, states that hold for all or for any, zero-filled counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_of(value: Column, order: Iterable[str]) -> Column:
    """The place of a value in a vocabulary from the least to the greatest, from 1; 0 for others and null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)).cast("int")


def greatest_of(value: Column, order: Iterable[str], default: str) -> Column:
    """Aggregate: the greatest value by the vocabulary; ``default`` where none of it occurs."""
    order = list(order)
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in order]), F.nullif(F.max(rank_of(value, order)), F.lit(0))), F.lit(default))


def within(value: Column, vocabulary: Iterable[str], default: str | None = None) -> Column:
    """The value where it is of the vocabulary, else the default."""
    return F.when(value.isin(*vocabulary), value).otherwise(F.lit(default))


def settled_state(state: Column, pending: str, done: str, open_state: str, done_state: str, other: str) -> Column:
    """Aggregate: ``open_state`` if all rows are pending, ``done_state`` if all are done, ``other`` for a mixture; null rows are no rows."""
    return F.when(F.every(state == pending), open_state).when(F.every(state == done), done_state).otherwise(other)


def zero_filled(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """A row for each value of the vocabulary (a column ``key``), with zeros where nothing was counted."""
    numbers = [c for c in counts.columns if c != key]
    return vocabulary.select(key).join(counts, key, "left").na.fill(0, numbers)
