"""Field access: rule field names to Columns, over typed columns and JSON text columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Found:
    """What a field name leads to: one value, or an array of them of which any member may match."""

    column: Column
    type: T.DataType
    many: bool = False


def split_path(path: str) -> list[tuple[str, int | None]]:
    """``a.b[0].c`` as names and positions; brackets without a whole number belong to the name."""
    out = []
    for part in path.split("."):
        match = re.fullmatch(r"(.*)\[(-?\d+)\]", part)
        out.append((match[1], int(match[2])) if match else (part, None))
    return out


@dataclass
class Resolver:
    """Resolves field names against a schema.

    A column of exactly the name comes first, then the dotted path through structs; arrays on the way fan out.
    Columns in ``json`` hold JSON text: ``column.path`` reads a value in it, as text. ``mapping`` renames rule
    fields to one or several columns (alternatives: the first that is present). In a typed table SQL null
    means that the field is absent.
    """

    schema: T.StructType
    json: set[str] = field(default_factory=set)
    mapping: dict[str, str | list[str]] = field(default_factory=dict)
    base: Column | None = None  # the element, inside an array block

    def _top(self, name: str) -> Column:
        return self.base.getField(name) if self.base is not None else F.col(f"`{name}`")

    def find(self, name: str) -> Found | None:
        targets = self.mapping.get(name, name)
        if isinstance(targets, list):
            found = [f for t in targets if (f := self._find(t)) is not None]
            if not found:
                return None
            if len(found) == 1:
                return found[0]
            texts = [text_of(f.column, f.type) for f in found if not f.many]
            return Found(F.coalesce(*texts), T.StringType())
        return self._find(targets)

    def _find(self, name: str) -> Found | None:
        names = set(self.schema.fieldNames())
        if name in names:
            column, kind = self._top(name), self.schema[name].dataType
            return Found(column, kind.elementType, True) if isinstance(kind, T.ArrayType) else Found(column, kind)
        parts = split_path(name)
        for n in range(len(parts), 0, -1):
            head = ".".join(p for p, _ in parts[:n])
            if head in names and (n == 1 or all(i is None for _, i in parts[: n - 1])):
                if head in self.json:
                    steps = "".join(f".{p}" + (f"[{i}]" if i is not None else "") for p, i in parts[n:])
                    index = f"[{parts[n - 1][1]}]" if parts[n - 1][1] is not None else ""
                    return Found(F.get_json_object(self._top(head), f"${index}{steps}"), T.StringType())
                return self._descend(self._top(head), self.schema[head].dataType, parts[n - 1][1], parts[n:])
        return None

    def _descend(self, column: Column, kind: T.DataType, index: int | None, rest: list) -> Found | None:
        many = False
        steps = [(None, index), *rest]
        for name, position in steps:
            if name is not None:
                if many:
                    if isinstance(kind, T.ArrayType):
                        column, kind = F.flatten(column), kind.elementType
                    if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                        return None
                    column, kind = _pluck(column, name), kind[name].dataType
                else:
                    if isinstance(kind, T.ArrayType):
                        kind, many = kind.elementType, True
                        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                            return None
                        column, kind = _pluck(column, name), kind[name].dataType
                    elif isinstance(kind, T.StructType) and name in kind.fieldNames():
                        column, kind = column.getField(name), kind[name].dataType
                    elif isinstance(kind, T.MapType):
                        column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
                    else:
                        return None
            if position is not None:
                if many or not isinstance(kind, T.ArrayType):
                    return None
                column, kind = F.try_element_at(column, F.lit(position + 1 if position >= 0 else position)), kind.elementType
        if isinstance(kind, T.ArrayType):
            return Found(F.flatten(column) if many else column, kind.elementType, True)
        return Found(column, kind, many)

    def element(self, found: Found, member: Column) -> Resolver:
        """The resolver for one member of an array of structs."""
        return Resolver(found.type if isinstance(found.type, T.StructType) else T.StructType([]), set(), {}, member)


def _pluck(column: Column, name: str) -> Column:
    return F.transform(column, lambda x: x.getField(name))


def text_of(value: Column, kind: T.DataType) -> Column:
    """A value as text for string matching: whole doubles without a fraction, the rest as Spark writes it."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value if isinstance(kind, T.StringType) else value.cast("string")


def number_of(value: Column, kind: T.DataType) -> Column:
    """A value as a double; text only if it is wholly a number."""
    if isinstance(kind, T.StringType):
        return F.when(value.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), value.try_cast("double"))
    if isinstance(kind, (T.NumericType,)):
        return value.cast("double")
    return F.lit(None).cast("double")


NO_TEXTS = "array<string>"


def json_texts(text: Column) -> Column:
    """All text values (not keys, not numbers) of a JSON text, at any depth; none if it is no object or array."""
    quoted = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'), F.lit(0))
    values = F.filter(quoted, lambda x: ~F.endswith(x, F.lit(":")))
    return F.when(text.rlike(r"^\s*[\[{]"), F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), NO_TEXTS))


def string_leaves(schema: T.StructType, json: set[str] = frozenset()) -> Column:
    """All text values of a row: text columns, texts in arrays, structs and maps at any depth, and in VARIANT columns and
    the columns of JSON text named in ``json``; not numbers, not names."""

    def texts(column: Column, kind: T.DataType, is_json: bool) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.coalesce(json_texts(column), F.array(column)) if is_json else F.array(column)
        if isinstance(kind, T.VariantType):
            return json_texts(F.to_json(column))
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType):
                return column
            if texts(F.lit(None), kind.elementType, False) is None:
                return None
            return F.flatten(F.transform(column, lambda x: F.coalesce(texts(x, kind.elementType, False), F.array().cast(NO_TEXTS))))
        if isinstance(kind, T.StructType):
            own = [t for f in kind.fields if (t := texts(column.getField(f.name), f.dataType, False)) is not None]
            return F.concat(*[F.coalesce(t, F.array().cast(NO_TEXTS)) for t in own]) if own else None
        if isinstance(kind, T.MapType):
            return texts(F.map_values(column), T.ArrayType(kind.valueType), False)
        return None

    parts = [F.coalesce(t, F.array().cast(NO_TEXTS)) for f in schema.fields if (t := texts(F.col(f"`{f.name}`"), f.dataType, f.name in json)) is not None]
    return F.filter(F.concat(*parts), lambda x: x.isNotNull()) if parts else F.array().cast(NO_TEXTS)
