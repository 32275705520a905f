"""Deeply nested records into related flat tables, by way of path-value-position triples.

Each record is turned into triples, JSON texts by parsing them as streams, nested columns by built-in functions;
paths are grouped by their nearest repeated ancestor (the last ``[]`` or ``{}`` step); each group is then pivoted
into one table whose rows are keyed by the record and by the positions along that ancestor, so a child's key begins
with its parent's.

Nulls: a null record or one that is no complete JSON gives no triples. A null element keeps its position and
gives a triple of kind ``null`` but no table row. Missing objects give no rows, missing fields give nulls.
An empty input gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType

from siltworks.functions.jsonstream import safe_events, ways
from siltworks.session import scratch_path, widen

TRIPLES = "record bigint, doc string, path string, pos array<int>, names array<string>, kind string, value string, part string"
_ARROW = pa.schema([("record", pa.int64()), ("doc", pa.string()), ("path", pa.string()), ("pos", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("kind", pa.string()), ("value", pa.string()), ("part", pa.string())])


@dataclass(frozen=True)
class NestedDoc:
    """One JSON document of a record: its text, and the paths of objects keyed by data."""

    name: str
    text: Column
    maps: tuple[str, ...] = ()


@dataclass(frozen=True)
class NestedColumn:
    """One column of structs, arrays or maps of a record, under the path that is the column's name. Maps are keyed by data."""

    name: str
    column: str


@dataclass(frozen=True)
class FlatTable:
    """A table to make: one row per non-null node at `ancestor` (its path ends in ``[]`` or ``{}``), a column per field.

    A field is a path relative to the ancestor ('' is the node itself); `lists` are relative paths of scalar
    arrays directly below it, which come back as arrays in order. With `nulls`, null nodes give rows too.
    """

    doc: str
    ancestor: str
    fields: Mapping[str, str] = field(default_factory=dict)
    lists: Mapping[str, str] = field(default_factory=dict)
    nulls: bool = False


_NODE = "array<struct<path:string,pos:array<int>,names:array<string>,kind:string,value:string,part:string>>"
#: by document and path the names of the tables that a node is part of
Parts = Mapping[str, Mapping[str, Sequence[str]]]


def _nodes(x: Column, kind: DataType, path: str, pos: tuple[Column, ...], names: tuple[Column, ...], parts: Mapping[str, Sequence[str]] | None) -> list[Column]:
    """Arrays of the triples of a nested value: its own, and one for all below each part of it."""
    wanted = None if parts is None else frozenset(parts)
    if wanted is not None and path not in ways(wanted):
        return []
    nested = isinstance(kind, ArrayType | MapType | StructType)
    out = []
    if wanted is None or path in wanted:
        word = "array" if isinstance(kind, ArrayType) else "object" if nested else "number" if isinstance(kind, NumericType) else "boolean" if isinstance(kind, BooleanType) else "string"
        own = [
            F.struct(
                F.lit(path).alias("path"), F.array(*pos).alias("pos"), F.array(*names).alias("names"),
                F.when(x.isNull(), "null").otherwise(word).alias("kind"), (F.lit(None) if nested else x).cast("string").alias("value"), F.lit(part).alias("part"),
            )
            for part in (parts[path] if parts else [None])
        ]
        out.append(F.array(*own).cast(_NODE))
    if isinstance(kind, StructType):
        below = [c for f in kind.fields for c in _nodes(x.getField(f.name), f.dataType, f"{path}.{f.name}", pos, names, parts)]
        if below:
            out.append(F.when(x.isNull(), F.array().cast(_NODE)).otherwise(F.concat(*below)))
    elif nested:
        keyed = isinstance(kind, MapType)
        step, of = ("{}", kind.valueType) if keyed else ("[]", kind.elementType)
        if wanted is None or path + step in ways(wanted):
            each = lambda e, i: F.concat(*_nodes(e["value"] if keyed else e, of, path + step, (*pos, i), (*names, e["key"].cast("string") if keyed else F.lit("")), parts))
            out.append(F.coalesce(F.flatten(F.transform(F.map_entries(x) if keyed else x, each)), F.array().cast(_NODE)))
    return out


def column_triples(df: DataFrame, record: Column, columns: Sequence[NestedColumn], parts: Parts | None = None) -> DataFrame:
    """The triples of nested columns, by built-in functions alone; a null column gives one of kind ``null``.

    With `parts` only those of its paths, once for each of a path's tables.
    """
    made = []
    for c in columns:
        if nodes := _nodes(F.col(c.column), df.schema[c.column].dataType, c.column, (), (), None if parts is None else parts.get(c.name, {})):
            made.append(df.select(record.cast("bigint").alias("record"), F.lit(c.name).alias("doc"), F.inline(F.concat(*nodes))))
    return reduce(DataFrame.unionByName, made)


def to_triples(df: DataFrame, record: Column, docs: Sequence[NestedDoc], parts: Parts | None = None) -> DataFrame:
    """The triples of every document of every record; with `parts` only those of its paths, once for each of a path's tables.

    A narrow step, no shuffle. Null record ids stay null.
    """
    how = {d.name: (frozenset(d.maps), None if parts is None else frozenset(parts.get(d.name, ()))) for d in docs}
    texts = widen(df).select(
        record.cast("bigint").alias("record"),
        F.explode(F.array(*[F.struct(F.lit(d.name).alias("doc"), d.text.alias("text")) for d in docs])).alias("d"),
    ).select("record", "d.doc", "d.text")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rec, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(rec, doc, *e, p) for e in safe_events(text, *how[doc]) for p in (parts[doc][e[0]] if parts else (None,))]
                if len(rows) >= 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return texts.mapInArrow(parse, TRIPLES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def tables_of(paths: Sequence[tuple[str, str]], fold: Sequence[str] = (), nulls: Sequence[str] = ()) -> dict[str, FlatTable]:
    """The tables that (doc, path) pairs fall into: one per document and nearest repeated ancestor, named ``doc:ancestor``.

    A column is named as its path from the ancestor, ``value`` if it is the ancestor. Arrays whose path is in `fold`
    come back as array columns of the table around them; `nulls` names ancestors whose null nodes are rows too.
    Paths without a repeated ancestor are the record's own and in no table.
    """
    found: dict[tuple[str, str], tuple[dict, dict]] = {}
    for doc, path in paths:
        inner = path.removesuffix("[]") if path in fold else path
        cut = max(inner.rfind("[]"), inner.rfind("{}")) + 2
        if cut < 2:
            continue
        fields, lists = found.setdefault((doc, inner[:cut]), ({}, {}))
        rest = inner[cut:].removeprefix(".")
        (lists if path in fold else fields)[rest or "value"] = rest
    return {f"{d}:{a}": FlatTable(d, a, f, ls, a in nulls) for (d, a), (f, ls) in found.items()}


def seen_paths(triples: DataFrame) -> list[tuple[str, str]]:
    """The distinct (doc, path) of scalars in the triples: as many as the records' schema has, whatever their number."""
    scalar = ~F.col("kind").isin("object", "array")
    return sorted((r["doc"], r["path"]) for r in triples.where(scalar).select("doc", "path").distinct().collect())


def _steps(path: str) -> int:
    return path.count("[]") + path.count("{}")


def pivot(triples: DataFrame, table: FlatTable) -> DataFrame:
    """One table: record, pos (positions along the ancestor), name (of the last step, if a map), then the fields.

    The aggregation combines on the map side, where all triples of a record lie together, so the shuffle
    carries one row per output row.
    """
    depth, at = _steps(table.ancestor), {table.ancestor + s: c for c, s in _paths(table.fields).items()}
    lists = {table.ancestor + s + "[]": c for c, s in _paths(table.lists).items()}
    rows = triples.where((F.col("doc") == table.doc) & F.col("path").isin(table.ancestor, *at, *lists))
    if not lists:
        if set(at) <= {table.ancestor}:  # a table of scalars or bare nodes: each triple is a row already
            return (rows if table.nulls else rows.where(F.col("kind") != "null")).select("record", "pos", F.element_at("names", -1).alias("name"), *[F.col("value").alias(c) for c in at.values()])
    one = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    grouped = (
        rows.groupBy("record", F.slice("pos", 1, depth).alias("pos"))
        .agg(
            F.max(F.when(F.col("path") == table.ancestor, F.col("kind"))).alias("kind"),
            F.max(F.when(F.col("path") == table.ancestor, F.element_at("names", -1))).alias("name"),
            *[one(p).alias(c) for p, c in at.items()],
            *[
                F.transform(F.array_sort(F.collect_list(F.when((F.col("path") == p) & (F.col("kind") != "null"), F.struct(F.element_at("pos", -1), "value")))), lambda x: x["value"]).alias(c)
                for p, c in lists.items()
            ],
        )
    )
    return (grouped if table.nulls else grouped.where(F.col("kind") != "null")).drop("kind")


def _paths(fields: Mapping[str, str]) -> dict[str, str]:
    return {c: f".{s}" if s else "" for c, s in fields.items()}


def shred(df: DataFrame, record: Column, docs: Sequence[NestedDoc | NestedColumn], tables: Mapping[str, FlatTable]) -> dict[str, DataFrame]:
    """All tables of the records. Parent and child join on record and the first positions of the child's pos.

    Records are parsed once: the triples are written to the shared folder, apart by the table they belong to,
    and each table is pivoted from its own part.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "triples")
    parts: dict[str, dict[str, list[str]]] = {}
    for name, t in tables.items():
        for p in dict.fromkeys(_all_paths(t)):
            parts.setdefault(t.doc, {}).setdefault(p, []).append(name)
    texts, columns = [d for d in docs if isinstance(d, NestedDoc)], [d for d in docs if isinstance(d, NestedColumn)]
    made = [to_triples(df, record, texts, parts)] if texts else []
    made += [column_triples(df, record, columns, parts)] if columns else []
    reduce(DataFrame.unionByName, made).write.partitionBy("part").parquet(path)
    triples = spark.read.schema(TRIPLES).parquet(path)
    return {name: pivot(triples.where(F.col("part") == name).drop("part"), t) for name, t in tables.items()}


def _all_paths(table: FlatTable) -> list[str]:
    return [table.ancestor, *[table.ancestor + s for s in _paths(table.fields).values()], *[table.ancestor + s + "[]" for s in _paths(table.lists).values()]]
