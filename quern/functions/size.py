"""Item sizes and the capacity units that are counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_NUMBER = r"^[-+]?([0-9]*)\.?([0-9]*)(?:[eE]([-+]?[0-9]+))?$"


def number_bytes(c: Column) -> Column:
    """One byte, one for each two significant digits before the point and for each two behind it, one for a minus sign; at most
    21. Zeros around the significant digits don't count, those between them do. Works on the number's text, so on any size.
    NULL has no size: least() alone would take the limit for it."""
    text = c.cast("string")
    whole, part, e = (F.regexp_extract(text, _NUMBER, i) for i in (1, 2, 3))
    digits = F.concat(whole, part)
    kept = F.regexp_replace(digits, "^0+", "")
    span = F.length(F.regexp_replace(kept, "0+$", ""))
    # Places of the first and the last significant digit, as powers of ten.
    first = F.length(whole) - 1 + F.coalesce(e.try_cast("int"), F.lit(0)) - (F.length(digits) - F.length(kept))
    last = first - span + 1
    pairs = lambda n: F.ceil(n / 2)
    halves = F.when((last >= 0) | (first < 0), pairs(span)).otherwise(pairs(first + 1) + pairs(-last))
    return F.when(span == 0, F.lit(1)).when(span > 0, F.least(F.lit(21), 1 + halves + F.startswith(text, F.lit("-")).cast("int"))).cast("long")


def value_bytes(c: Column, t: T.DataType, is_set: bool = False) -> Column:
    """A set is the sum of its members; lists and maps count three bytes, and one for each member."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.octet_length(c).cast("long")
    if isinstance(t, T.NumericType):
        return number_bytes(c)
    if isinstance(t, T.ArrayType):
        more = 0 if is_set else 1
        return F.aggregate(c, F.lit(3 * more).cast("long"), lambda acc, x: acc + F.coalesce(value_bytes(x, t.elementType), F.lit(1)) + more)
    if isinstance(t, T.StructType):
        out = F.lit(3).cast("long")
        for f in t.fields:
            out = out + F.when(c.getField(f.name).isNotNull(), value_bytes(c.getField(f.name), f.dataType) + len(f.name.encode()) + 1).otherwise(0)
        return out
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(8).cast("long")
    return F.lit(1).cast("long")


def item_size(df: DataFrame, sets: tuple[str, ...] = ()) -> Column:
    """Bytes of names and values of the attributes an item has; the columns named in sets are sets."""
    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out = out + F.when(c.isNotNull(), value_bytes(c, f.dataType, f.name in sets) + len(f.name.encode())).otherwise(0)
    return out


def read_units(size: Column, consistent: bool = False) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / 4096)) * (1.0 if consistent else 0.5)


def write_units(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / 1024)).cast("double")


def vector_write_bytes(dims: int, projected: Column, moved: Column | None = None) -> Column:
    one = F.greatest(F.lit(4 * dims) + projected, F.lit(1024))
    return one if moved is None else one * F.when(moved, 2).otherwise(1)


def vector_search_bytes(dims: int, returned: int, projected: Column, vectors: Column) -> Column:
    return F.greatest(30.6875 * dims + 65 * returned + projected + 4 * dims * vectors, F.lit(1024.0))
