"""Capacity units of writes: of the table, of each index, and rolled up over a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.size import value_bytes, write_units
from quern.model import IndexDef, TableDef


def _entry_size(image: str, df: DataFrame, columns: list[str], sets: tuple[str, ...]) -> Column:
    out, kinds = F.lit(0).cast("long"), df.schema[image].dataType
    for c in columns:
        v = F.col(image).getField(c)
        out = out + F.when(v.isNotNull(), value_bytes(v, kinds[c].dataType, c in sets) + len(c.encode())).otherwise(0)
    return out


def _index_units(table: TableDef, index: IndexDef, changes: DataFrame) -> Column:
    """0 for an entry that stays as it is or isn't there; that of the entry written or taken away; the sum of both where the
    index's key changes, as the entry moves."""
    every = table.df.columns
    named = every if index.projection == "ALL" else [*index.hash, *index.range, *table.keys, *(() if index.projection == "KEYS_ONLY" else index.projection)]
    columns = [c for c in every if c in named]
    keys = [*index.hash, *index.range]
    there = lambda image: reduce(lambda a, b: a & b, [F.col(image).getField(k).isNotNull() for k in keys])
    struct = lambda image, cs: F.struct(*[F.col(image).getField(c).alias(c) for c in cs])
    units = lambda image: write_units(_entry_size(image, changes, columns, table.sets))
    old, new = F.coalesce(there("old"), F.lit(False)), F.coalesce(there("new"), F.lit(False))
    same = struct("old", columns).eqNullSafe(struct("new", columns))
    moved = ~struct("old", keys).eqNullSafe(struct("new", keys))
    return F.when(old & new, F.when(same, 0.0).when(moved, units("old") + units("new")).otherwise(F.greatest(units("old"), units("new")))).when(old, units("old")).when(new, units("new")).otherwise(0.0)


def write_capacity(table: TableDef, changes: DataFrame) -> DataFrame:
    """name (the table's, or that of one of its indexes) and units of a write's changes(old, new, ok), each written key counted."""
    done = changes.filter("ok")
    every = table.df.columns
    own = write_units(F.greatest(*[F.when(F.col(x).isNotNull(), _entry_size(x, done, every, table.sets)).otherwise(0) for x in ("old", "new")]))
    units = [F.struct(F.lit(table.name).alias("name"), own.alias("units")), *[F.struct(F.lit(i.name).alias("name"), _index_units(table, i, done).cast("double").alias("units")) for i in table.indexes]]
    return done.select(F.explode(F.array(*units)).alias("u")).groupBy("u.name").agg(F.sum("u.units").alias("units"))


def roll_up(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """table and units over the capacities(name, units) of a batch's requests; a table's indexes count with it."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table"), "units") for name, df in parts])
    return rows.groupBy("table").agg(F.sum("units").alias("units"))
