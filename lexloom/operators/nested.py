"""Deeply nested JSON records as related flat tables.

One pass merges the shapes of all records into one schema, a second one rewrites each record to that schema, and the
result is written once as a nested table. Each array level is then exploded by Spark into its own child table, with
the path of the enclosing object and the position within the array; a scan of one child reads only its own columns.

Defined results:

- A null record, text that is not JSON (NaN and Infinity are not JSON) or nesting too deep to read gives a root row with
  ``_valid`` false and no child rows.
- An object in place of an array is its element 0. A scalar in place of an array of objects or of an object goes to
  the field ``_value`` of that (single) object. Text holding a JSON object or array counts as that object or array
  where other records have an object or array, or no plain text, at the place.
- Null elements give no row but keep their position. Empty arrays and empty tables give no rows.
- Of repeated names in an object the last counts. Names that differ in case only, or clash with the key or an own
  column, get a suffix ``_2``, ``_3``, and so on. All scalars are text.
- An object with more than ``MOST_NAMES`` names over all records has ids for names: it is taken as a list of entries with a
  ``_name`` and a ``value``, in the order of the record. More than ``MOST_PLACES`` places in the schema that is left are refused.
- Repeated records each give their rows; columns other than the key and the JSON text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.runtime import Scratch

VALUE = "_value"
#: Most names of an object, and most places of a schema.
MOST_NAMES, MOST_PLACES = 1_000, 100_000


def _reject(token: str) -> None:
    raise ValueError(token)


def parse(text: object) -> tuple[bool, object]:
    """(is it JSON, its value); numbers stay text."""
    if not isinstance(text, str):
        return False, None
    try:
        return True, json.loads(text, parse_int=str, parse_float=str, parse_constant=_reject)
    except (ValueError, RecursionError):
        return False, None


def _embedded(text: str) -> object | None:
    """The object or array that a text holds, if it holds one."""
    head = text.lstrip()[:1]
    if head not in ("{", "["):
        return None
    good, value = parse(text)
    return value if good and isinstance(value, (dict, list)) else None


@dataclass
class Node:
    """A place in the merged schema."""

    scalar: bool = False
    text_object: bool = False
    text_list: bool = False
    listed: bool = False
    object: bool = False
    fields: dict[str, Node] = field(default_factory=dict)
    item: Node | None = None
    #: Is it an object of entries with ids for names.
    entries: bool = False

    def is_list(self) -> bool:
        return self.listed or self.entries or (self.text_list and not self.scalar)

    def is_object(self) -> bool:
        return self.object or (self.text_object and not self.scalar)

    def columns(self) -> dict[str, tuple[str, Node]]:
        """Spark's field name for each name, unique without regard to case."""
        taken, out = {VALUE}, {}
        for name in sorted(self.fields):
            column, n = name or "_", 1
            while column.lower() in taken:
                n += 1
                column = f"{name or '_'}_{n}"
            taken.add(column.lower())
            out[name] = (column, self.fields[name])
        return out

    def body(self) -> T.DataType:
        """Type of the value where it is no array."""
        if not self.is_object():
            return T.StringType()
        fields = [T.StructField(c, n.type()) for c, n in self.columns().values()]
        return T.StructType([*fields, *([T.StructField(VALUE, T.StringType())] if self.scalar or not fields else [])])

    def type(self) -> T.DataType:
        return T.ArrayType(self.item.type()) if self.is_list() and self.item else self.body()


def _kinds(value: object, path: tuple, out: set) -> None:
    if isinstance(value, dict):
        out.add((path, "object"))
        for name, part in value.items():
            _kinds(part, (*path, name), out)
    elif isinstance(value, list):
        out.add((path, "list"))
        for part in value:
            _kinds(part, (*path, None), out)
    elif isinstance(value, str) and (inner := _embedded(value)) is not None:
        found: set = set()
        _kinds(inner, path, found)
        out.add((path, "text_object" if isinstance(inner, dict) else "text_list"))
        out |= {x for x in found if x[0] != path}
    elif value is not None:
        out.add((path, "scalar"))


#: Step of a path to the entries of an object that has ids for names.
ENTRY = 0


def _as_entries(path: list, wide: set[str]) -> list:
    """The path with ``value`` of an entry in place of a name of one of the wide objects."""
    for depth, step in enumerate(path):
        if isinstance(step, str) and json.dumps(path[:depth]) in wide:
            return [*path[:depth], ENTRY, "value", *path[depth + 1 :]]
    return path


def merged_schema(df: DataFrame, column: str, scratch: Scratch, most_names: int = MOST_NAMES) -> Node:
    """The schema all records fit.

    Places are counted where they are. Objects with too many names are turned into lists of entries, the outermost first, until
    none is left; only then the distinct places and kinds reach the driver, at most MOST_PLACES.
    """

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            found: set = set()
            for text in batch["_json"]:
                good, value = parse(text)
                if good:
                    _kinds(value, (), found)
            new = found - seen
            # what is known saves rows only, so it may be forgotten
            seen = seen | new if len(seen) < MOST_PLACES else new
            yield pd.DataFrame([(json.dumps(p), k) for p, k in new], columns=["path", "kind"])

    def entries(wide: set[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"path": [json.dumps(_as_entries(json.loads(p), wide)) for p in batch["path"]], "kind": batch["kind"]})

        return rewrite

    shape = "path string, kind string"
    held = scratch.put(df.select(F.col(column).cast("string").alias("_json")).where("_json is not null").mapInPandas(places, shape).distinct(), "places0")
    for turn in count(1):
        # a path with its last step cut off; names are quoted, other steps aren't
        named = held.where(F.col("path").rlike(r'"\]$')).distinct()
        parent = F.when(F.col("path").rlike(r'^\["(?:[^"\\]|\\.)*"\]$'), "[]").otherwise(F.regexp_replace("path", r', "(?:[^"\\]|\\.)*"\]$', "]"))
        wide = named.select(parent.alias("parent"), "path").groupBy("parent").agg(F.countDistinct("path").alias("n")).where(F.col("n") > most_names)
        outer = [r["parent"] for r in wide.orderBy(F.length("parent"), "parent").limit(most_names).collect()]
        outer = [x for x in outer if not any(x != y and x.startswith(f"{y[:-1]}, ") or (y == "[]" and x != y) for y in outer)]
        if not outer:
            break
        held = scratch.put(held.mapInPandas(entries(set(outer)), shape).distinct(), f"places{turn}")
        scratch.drop(f"places{turn - 1}")
    rows = held.limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"the records have more than {MOST_PLACES} places")
    root = Node()
    for path, kind in rows:
        node = root
        for step in json.loads(path):
            if step is None or step == ENTRY:
                node.entries |= step == ENTRY
                node.item = node.item or Node()
                node = node.item
            else:
                node = node.fields.setdefault(step, Node())
        setattr(node, {"list": "listed"}.get(kind, kind), True)
    _settle(root)
    return root


def _merge(into: Node, other: Node) -> None:
    for flag in ("scalar", "text_object", "text_list", "listed", "object", "entries"):
        setattr(into, flag, getattr(into, flag) or getattr(other, flag))
    for name, part in other.fields.items():
        _merge(into.fields.setdefault(name, Node()), part)
    if other.item:
        into.item = into.item or Node()
        _merge(into.item, other.item)


def _settle(node: Node) -> None:
    """Where a place has arrays, what stands there without an array is an element."""
    if node.is_list():
        node.item = node.item or Node()
        if node.entries:
            node.object = node.text_object = False
            _merge(node.item, Node(object=True, fields={"_name": Node(scalar=True), "value": Node()}))
        _merge(node.item, Node(scalar=node.scalar, object=node.object, text_object=node.text_object, fields=node.fields))
        node.fields, node.scalar, node.object, node.text_object = {}, False, False, False
        node.listed = True
        _settle(node.item)
    for part in node.fields.values():
        _settle(part)


def _clean(text: str) -> str:
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def fit(value: object, node: Node) -> object:
    """A value rewritten to the schema."""
    if value is None:
        return None
    if isinstance(value, str) and (node.is_list() or node.is_object()) and (inner := _embedded(value)) is not None:
        value = inner
    if node.is_list():
        if node.entries and isinstance(value, dict):
            value = [{"_name": name, "value": part} for name, part in value.items()]
        return [fit(x, node.item) for x in (value if isinstance(value, list) else [value])]
    if isinstance(value, dict) and node.is_object():
        return {column: fit(value[name], part) for name, (column, part) in node.columns().items() if name in value}
    text = _clean(value) if isinstance(value, str) else json.dumps(value)
    return {VALUE: text} if node.is_object() else text


@dataclass
class Flat:
    """The tables: root (one row per record) and one per array place, by its path such as ``questions[].replies``."""

    root: DataFrame
    children: dict[str, DataFrame]


def flatten(df: DataFrame, key: str, column: str, scratch: Scratch, most_names: int = MOST_NAMES) -> Flat:
    """Flat tables of the JSON texts in ``column``.

    Root: key, ``_valid`` and the scalar fields. Children: key, ``_parent`` (path of the enclosing object), ``_node``
    (own path, unique within the record: with the key the surrogate key), ``_ordinal`` and the scalar fields.
    """
    schema = merged_schema(df, column, scratch, most_names)
    whole = Node(object=True, fields={"$": schema}) if schema.is_list() or not schema.is_object() else schema
    wrapped = whole is not schema

    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                good, value = parse(text)
                out.append(json.dumps(fit({"$": value} if wrapped else value, whole)) if good else None)
            yield pd.Series(out, dtype=object)

    body = whole.body()
    normal = F.pandas_udf(rewrite, T.StringType())
    picked = df.select(F.col(key).alias("_key"), normal(F.col(column).cast("string")).alias("_text"))
    stored = scratch.put(picked.select("_key", F.col("_text").isNotNull().alias("_valid"), F.from_json("_text", body, {"mode": "PERMISSIVE", "maxNestingDepth": "2000", "maxStringLen": "2000000000"}).alias("_v")), "records")
    children: dict[str, DataFrame] = {}

    def named(leaves: list[tuple[str, Column]], own: list[str]) -> list[Column]:
        taken, out = {x.lower() for x in own}, []
        for name, value in leaves:
            alias, n = name, 1
            while alias.lower() in taken:
                n += 1
                alias = f"{name}_{n}"
            taken.add(alias.lower())
            out.append(value.alias(alias))
        return out

    def parts(node: Node, value: Column, prefix: str, path: Column, place: str, rows: DataFrame) -> list[tuple[str, Column]]:
        """Scalar leaves below an object; arrays become children."""
        leaves: list[tuple[str, Column]] = []
        for name, (column_name, part) in node.columns().items():
            inner, label = value.getField(column_name), f"{prefix}{column_name}"
            below = F.concat(path, F.when(path != "", ".").otherwise(""), F.lit(name))
            spot = f"{place}.{name}" if place else name
            if part.is_list():
                explode(part, inner, path, below, spot, rows)
            elif part.is_object():
                leaves += parts(part, inner, f"{label}_", below, spot, rows)
            else:
                leaves.append((label, inner))
        if node.scalar or not node.fields:
            leaves.append((f"{prefix}{VALUE}", value.getField(VALUE)))
        return leaves

    def explode(node: Node, value: Column, parent: Column, path: Column, place: str, rows: DataFrame) -> None:
        raised = rows.select("_key", parent.alias("_parent"), path.alias("_list"), F.posexplode(value).alias("_ordinal", "_v")).where("_v is not null")
        raised = raised.select("_key", "_parent", F.format_string("%s[%d]", "_list", "_ordinal").alias("_node"), "_ordinal", "_v")
        item = node.item or Node()
        if item.is_list():
            explode(item, F.col("_v"), F.col("_parent"), F.col("_node"), f"{place}[]", raised)
            leaves = []
        elif item.is_object():
            leaves = parts(item, F.col("_v"), "", F.col("_node"), f"{place}[]", raised)
        else:
            leaves = [(VALUE, F.col("_v"))]
        own = [key, "_parent", "_node", "_ordinal"]
        children[place] = raised.select(F.col("_key").alias(key), "_parent", "_node", "_ordinal", *named(leaves, own))

    leaves = parts(whole, F.col("_v"), "", F.lit(""), "", stored)
    root = stored.select(F.col("_key").alias(key), "_valid", *named(leaves, [key, "_valid"]))
    return Flat(root, children)
