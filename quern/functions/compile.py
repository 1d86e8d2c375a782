"""Conditions as Columns.

The language has two truth values, SQL has three. NOT is pushed to the leaves first; a positive leaf stays a bare comparison,
for which NULL and false both drop the row, so it still reaches the Parquet scan; a negated leaf is made total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.parse import MIRROR, kind_of
from quern.model import ValidationError

NEGATED = {"=": "<>", "<>": "=", "<": ">=", ">": "<=", "<=": ">", ">=": "<"}
OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def kind_of_type(t: T.DataType, is_set: bool = False) -> str:
    if isinstance(t, T.StringType):
        return "S"
    if isinstance(t, T.NumericType):
        return "N"
    if isinstance(t, T.BinaryType):
        return "B"
    if isinstance(t, T.BooleanType):
        return "BOOL"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "T"
    if isinstance(t, T.ArrayType):
        if not is_set:
            return "L"
        return {"S": "SS", "N": "NS", "B": "BS"}[kind_of_type(t.elementType)]
    if isinstance(t, (T.StructType, T.MapType)):
        return "M"
    return "NULL"


class Typed:
    """Paths of a DataFrame whose columns are attributes."""

    def __init__(self, df: DataFrame, sets: tuple[str, ...] = (), prefix: str = ""):
        self.schema, self.sets, self.prefix = df.schema, sets, prefix

    def resolve(self, path: tuple) -> tuple[Column | None, T.DataType | None]:
        """The column at a path and its type; None where the schema has no such place: the attribute is always missing."""
        name = next((f for f in self.schema.fields if f.name == self.prefix + path[0]), None)
        if name is None:
            return None, None
        c, t = F.col(f"`{name.name}`"), name.dataType
        for step in path[1:]:
            if isinstance(step, int) and isinstance(t, T.ArrayType):
                c, t = F.get(c, F.lit(step)), t.elementType
            elif isinstance(step, str) and isinstance(t, T.StructType) and step in t.names:
                c, t = c.getField(step), t[step].dataType
            elif isinstance(step, str) and isinstance(t, T.MapType):
                c, t = F.try_element_at(c, F.lit(step)), t.valueType
            else:
                return None, None
        return c, t

    def is_set(self, path: tuple) -> bool:
        return len(path) == 1 and path[0] in self.sets


def utf16_length(c: Column) -> Column:
    """The length of a string counts UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


class Operand:
    """column None: always missing. literal: never missing."""

    def __init__(self, column: Column | None, kind: str, type_: T.DataType | None = None, literal: bool = False, value=None):
        self.column, self.kind, self.type, self.literal, self.value = column, kind, type_, literal, value


def literal(v, like: T.DataType | None = None) -> Column:
    if isinstance(v, (set, frozenset)):
        v = sorted(v)
    if isinstance(v, (list, tuple)):
        c = F.array(*[literal(x) for x in v])
    elif isinstance(v, dict):
        c = F.struct(*[literal(x).alias(k) for k, x in v.items()])
    else:
        c = F.lit(bytes(v) if isinstance(v, bytearray) else v)
    # A timestamp literal takes the column's type, so that the comparison reaches the scan.
    return c.cast(like) if isinstance(like, (T.TimestampNTZType, T.TimestampType, T.DateType)) else c


class Compiler:
    def __init__(self, typed: Typed):
        self.typed = typed

    def operand(self, node, like: Operand | None = None) -> Operand:
        if node[0] == "value":
            return Operand(literal(node[1], like.type if like else None), kind_of(node[1]), literal=True, value=node[1])
        if node[0] == "size":
            c, t = self.typed.resolve(node[1][1])
            kind = kind_of_type(t) if t is not None else "NULL"
            made = {"S": lambda: utf16_length(c), "B": lambda: F.octet_length(c).cast("long"), "L": lambda: F.when(c.isNotNull(), F.size(c)).cast("long"), "M": lambda: F.when(c.isNotNull(), F.lit(len(t.names)) if isinstance(t, T.StructType) else F.size(c)).cast("long")}.get(kind)
            return Operand(made() if made else None, "N", T.LongType())
        c, t = self.typed.resolve(node[1])
        return Operand(c, kind_of_type(t, self.typed.is_set(node[1])) if t is not None else "NULL", t)

    def pair(self, x, y) -> tuple[Operand, Operand]:
        a = self.operand(x)
        b = self.operand(y, a)
        return (self.operand(x, b) if x[0] == "value" else a), b

    def comparable(self, a: Operand, b: Operand) -> bool:
        same = a.kind == b.kind or {a.kind, b.kind} <= {"SS", "NS", "BS", "L"} and (a.literal or b.literal)
        return a.column is not None and b.column is not None and same

    def compare(self, op: str, x, y, wanted: bool) -> Column:
        a, b = self.pair(x, y)
        if not self.comparable(a, b):
            return F.lit((op == "<>") is wanted)
        if not wanted and op == "<>":
            op, wanted = "=", True
        elif not wanted and op == "=":
            op, wanted = "<>", True
        orderable = a.kind in ("S", "N", "B", "T")
        if op not in ("=", "<>") and not orderable:
            if op in ("<", ">"):
                return F.lit(not wanted)
            return self.compare("=", x, y, wanted)
        if op == "<>":
            if b.literal or a.literal:
                return ~a.column.eqNullSafe(b.column)
            return ~F.coalesce(a.column == b.column, F.lit(False))
        if wanted:
            return OPS[op](a.column, b.column)
        missing = [o.column.isNull() for o in (a, b) if not o.literal]
        out = OPS[NEGATED[op]](a.column, b.column)
        for m in missing:
            out = m | out
        return out

    def condition(self, node, wanted: bool = True) -> Column:
        kind = node[0]
        if kind == "not":
            return self.condition(node[1], not wanted)
        if kind in ("and", "or"):
            a, b = self.condition(node[1], wanted), self.condition(node[2], wanted)
            return a & b if (kind == "and") is wanted else a | b
        if kind == "cmp":
            return self.compare(*node[1:], wanted)
        if kind == "between":
            _, x, lo, hi = node
            return self.condition(("and", ("cmp", ">=", x, lo), ("cmp", "<=", x, hi)), wanted)
        if kind == "in":
            _, x, items = node
            a = self.operand(x)
            fit = [i for i in items if self.comparable(a, self.operand(i, a))]
            if not fit:
                return F.lit(not wanted)
            if a.column is not None and all(i[0] == "value" for i in fit) and a.kind in ("S", "N", "B", "T", "BOOL"):
                got = a.column.isin(*[self.operand(i, a).column for i in fit])
                return got if wanted else (a.column.isNull() | ~got)
            out = self.compare("=", x, fit[0], wanted)
            for i in fit[1:]:
                more = self.compare("=", x, i, wanted)
                out = out | more if wanted else out & more
            return out
        return self.function(node[1], node[2], wanted)

    def function(self, name: str, args: list, wanted: bool) -> Column:
        a = self.operand(args[0])
        if name in ("attribute_exists", "attribute_not_exists"):
            present = (name == "attribute_exists") is wanted
            if a.column is None:
                return F.lit(not present)
            return a.column.isNotNull() if present else a.column.isNull()
        b = self.operand(args[1], a)
        if name == "attribute_type":
            if not b.literal or b.kind != "S":
                raise ValidationError("attribute_type needs a type name")
            got = a.column.isNotNull() if a.column is not None and a.kind == b.value else F.lit(False)
            return got if wanted else ~F.coalesce(got, F.lit(False))
        if name == "begins_with":
            if b.literal and b.kind not in ("S", "B"):
                raise ValidationError("begins_with needs a string or binary")
            got = F.startswith(a.column, b.column) if a.column is not None and b.column is not None and a.kind == b.kind and a.kind in ("S", "B") else F.lit(False)
        elif a.column is None or b.column is None:
            got = F.lit(False)
        elif a.kind in ("S", "B"):
            got = F.contains(a.column, b.column) if a.kind == b.kind else F.lit(False)
        elif a.kind in ("SS", "NS", "BS", "L") and a.type is not None and kind_of_type(a.type.elementType) == b.kind:
            got = F.array_contains(a.column, b.column)
        else:
            got = F.lit(False)
        return got if wanted else ~F.coalesce(got, F.lit(False))


def total(c: Column) -> Column:
    """The condition as a value: NULL is false."""
    return F.coalesce(c, F.lit(False))


__all__ = ["MIRROR", "Compiler", "Typed", "kind_of_type", "literal", "total", "utf16_length"]
