"""Schema drift of append tables: widen, fill and fall back to text, at every depth of nested columns."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_text
from ..names import LABEL_COLUMN, RUN_COLUMN, StoreError, quoted

_WIDER = ["tinyint", "smallint", "int", "bigint"]


@dataclass
class Drift:
    """A table's schema from now on and what changed: paths like a.b, items[].b, lookup{value}.b."""

    schema: T.StructType
    added: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


def opened(kind: T.DataType) -> T.DataType:
    """The type with everything in it nullable (but the keys of maps), as files give it back; metadata of fields is left out."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, opened(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(opened(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(opened(kind.keyType), opened(kind.valueType))
    return kind


def healed(schema: T.StructType, exact_case: bool = False) -> T.StructType:
    """An opened schema whose fields all differ in name: what an earlier version may have recorded otherwise becomes one column."""
    out = T.StructType([])
    for f in opened(schema):
        out = _Merge(exact_case, False).structs(out, T.StructType([f]), "")
    return out


def exact_case(df: DataFrame) -> bool:
    return df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"


def no_reserved_columns(df: DataFrame) -> None:
    taken = {c for c in df.columns if c.lower() in (RUN_COLUMN, LABEL_COLUMN)}
    if taken:
        raise StoreError(f"reserved columns: {sorted(taken)}")


def no_like_columns(kind: T.DataType, exact: bool, path: str = "") -> None:
    """Refuse fields of one struct that the session can't tell apart."""
    if isinstance(kind, T.StructType):
        names: dict[str, str] = {}
        for f in kind:
            key = f.name if exact else f.name.lower()
            if key in names:
                raise StoreError(f"columns {path}{names[key]} and {path}{f.name} have one name here")
            names[key] = f.name
            no_like_columns(f.dataType, exact, f"{path}{f.name}.")
    elif isinstance(kind, T.ArrayType):
        no_like_columns(kind.elementType, exact, path)
    elif isinstance(kind, T.MapType):
        no_like_columns(kind.keyType, exact, path)
        no_like_columns(kind.valueType, exact, path)


class _Merge:
    def __init__(self, exact: bool, widen: bool):
        self.exact, self.widen = exact, widen
        self.added: list[str] = []
        self.missing: list[str] = []
        self.texts: list[str] = []

    def key(self, name: str) -> str:
        return name if self.exact else name.lower()

    def structs(self, table: T.StructType, coming: T.StructType, path: str) -> T.StructType:
        new = {self.key(f.name): f for f in coming}
        fields = []
        for f in table:
            other = new.pop(self.key(f.name), None)
            if other is None:
                self.missing.append(path + f.name)
            fields.append(T.StructField(f.name, f.dataType if other is None else self.types(f.dataType, other.dataType, path + f.name)))
        self.added += [path + f.name for f in new.values()]
        return T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in new.values()]])

    def types(self, a: T.DataType, b: T.DataType, path: str) -> T.DataType:
        if a == b or isinstance(b, T.NullType):
            return a
        if isinstance(a, T.NullType):
            return b
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            return self.structs(a, b, path + ".")
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return T.ArrayType(self.types(a.elementType, b.elementType, path + "[]"))
        if isinstance(a, T.MapType) and isinstance(b, T.MapType):
            if _scalar(a.keyType) and _scalar(b.keyType) or a.keyType == b.keyType:
                return T.MapType(self.types(a.keyType, b.keyType, path + "{key}"), self.types(a.valueType, b.valueType, path + "{value}"))
        both = [a.simpleString(), b.simpleString()]
        if self.widen and all(x in _WIDER for x in both):
            return a if _WIDER.index(both[0]) > _WIDER.index(both[1]) else b
        if a != T.StringType():
            self.texts.append(path)
        return T.StringType()


def _scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def reconcile(table: T.StructType, coming: T.StructType, widen_numbers: bool = False, exact: bool = False) -> Drift:
    """The table's schema after rows of another schema are added.

    New columns are added; missing ones stay; a column whose type differs becomes text. The
    same holds for the fields of structs, also within arrays and maps, so that only what
    differs becomes text; an array or a map beside anything else becomes text as a whole.
    With widen_numbers, integers of different width become the wider one instead. Names
    that differ in case are one column, with the name it had first, unless ``exact``.
    """
    merge = _Merge(exact, widen_numbers)
    schema = merge.structs(healed(table, exact), opened(coming), "")
    return Drift(schema, merge.added, merge.missing, merge.texts)


def announce(name: str, d: Drift) -> None:
    if d.added:
        warnings.warn(f"{name}: new columns {d.added}; earlier rows have nulls", stacklevel=3)
    if d.texts:
        warnings.warn(f"{name}: columns {d.texts} differ in type and become text", stacklevel=3)


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows under a table's schema: cast, as text where this is text, null where a column or a field is missing."""
    exact = exact_case(df)
    held = {f.name if exact else f.name.lower(): f for f in df.schema}
    columns = []
    for f in schema:
        mine = held.get(f.name if exact else f.name.lower())
        column = F.lit(None).cast(f.dataType) if mine is None else _fit(df[quoted(mine.name)], opened(mine.dataType), opened(f.dataType), exact)
        columns.append(column.alias(f.name))
    return df.select(*columns)


def _fit(column: F.Column, held: T.DataType, wanted: T.DataType, exact: bool) -> F.Column:
    if held == wanted:
        return column
    if isinstance(wanted, T.StringType):
        return as_text(column, held)
    if isinstance(held, T.StructType) and isinstance(wanted, T.StructType):
        mine = {f.name if exact else f.name.lower(): f for f in held}
        parts = []
        for f in wanted:
            own = mine.get(f.name if exact else f.name.lower())
            part = F.lit(None).cast(f.dataType) if own is None else _fit(column.getField(own.name), own.dataType, f.dataType, exact)
            parts.append(part.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(held, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(column, lambda x: _fit(x, held.elementType, wanted.elementType, exact))
    if isinstance(held, T.MapType) and isinstance(wanted, T.MapType):
        if held.keyType != wanted.keyType:
            column = F.transform_keys(column, lambda k, _: _fit(k, held.keyType, wanted.keyType, exact))
        if held.valueType != wanted.valueType:
            column = F.transform_values(column, lambda _, v: _fit(v, held.valueType, wanted.valueType, exact))
        return column
    return column.cast(wanted)
