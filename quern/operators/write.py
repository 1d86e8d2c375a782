"""Writes as joins: a table and a table of requests give the new table and its change feed. Nothing is changed in place.

The table itself is neither shuffled nor sorted where the requests are within REQUEST_BYTES, which is checked: items that no
request names pass an anti-join against the broadcast keys, and old images come from an inner join against the broadcast requests.
Beyond that the same two joins carry no hint, and Catalyst chooses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.compile import Compiler, Typed, literal, total
from quern.functions.parse import Reader
from quern.functions.size import item_size
from quern.model import ConditionFailed, TableDef, ValidationError

MAX_BATCH, MAX_TRANSACTION = 25, 100
#: Estimated bytes of requests that are broadcast; columnar files may hold several times as much in memory.
REQUEST_BYTES, REQUEST_ROWS = 4 << 20, 10_000


@dataclass
class Written:
    """table: all items after the write. changes: one row a written key with old and new image (null where absent) and ok."""

    table: DataFrame
    changes: DataFrame

    def returned(self, what: str, touched: tuple[str, ...] = ()) -> DataFrame:
        """ReturnValues: NONE, ALL_OLD, ALL_NEW, UPDATED_OLD, UPDATED_NEW."""
        if what == "NONE":
            return self.changes.limit(0).select()
        side = "old" if what.endswith("OLD") else "new"
        rows = self.changes.filter(F.col("ok") & F.col(side).isNotNull())
        return rows.select(f"{side}.*") if what.startswith("ALL") else rows.select(*[F.col(side)[t].alias(t) for t in touched])

    def check(self) -> Written:
        """Raises where a condition failed. One small job; leave it out to write those that pass."""
        if not self.changes.filter(~F.col("ok")).isEmpty():
            raise ConditionFailed("a condition wasn't met")
        return self


def condition_node(text: str | None, names=None, values=None):
    if not text:
        return None
    r = Reader(text, names, values)
    node = r.condition()
    r.done()
    return node


@dataclass
class Paired:
    """asked: a row for each request, with k_ keys, old (null if absent) and req. rest: the items that no request names."""

    asked: DataFrame
    rest: DataFrame


def _few(requests: DataFrame) -> bool:
    """Within REQUEST_BYTES by Catalyst's estimate, or, where that is large or unknown, by a count of the first REQUEST_ROWS rows."""
    if int(str(requests._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= REQUEST_BYTES:
        return True
    first = requests.limit(REQUEST_ROWS + 1)
    seen = first.agg(F.count("*").alias("rows"), F.sum(item_size(first)).alias("bytes")).first()
    return seen["rows"] <= REQUEST_ROWS and (seen["bytes"] or 0) <= REQUEST_BYTES


def _paired(table: TableDef, requests: DataFrame) -> Paired:
    """Items and requests by key. Two requests of one key are an error when the result is read."""
    names = [f"k_{k}" for k in table.keys]
    hint = F.broadcast if _few(requests) else (lambda df: df)
    twice = F.raise_error(F.lit("two requests name one key"))
    req = requests.groupBy(*[F.col(k).alias(f"k_{k}") for k in table.keys]).agg(F.count("*").alias("_n"), F.first(F.struct(*requests.columns)).alias("req"))
    req = req.select(*names, F.when(F.col("_n") > 1, twice.cast(req.schema["req"].dataType)).otherwise(F.col("req")).alias("req"))
    same = [F.col(k) == F.col(f"k_{k}") for k in table.keys]
    found = table.df.join(hint(req), same).select(*names, F.struct(*[F.col(f"`{c}`") for c in table.df.columns]).alias("old"), "req")
    # What the requests found is no more than they are themselves.
    none = F.lit(None).cast(found.schema["old"].dataType).alias("old")
    absent = req.join(hint(found.select(*names)), names, "left_anti").select(*names, none, "req")
    return Paired(found.unionByName(absent), table.df.join(hint(req.select(*names)), same, "left_anti"))


def _apply(table: TableDef, paired: Paired, new: Column, condition) -> Written:
    """new: the image a request wants (null: none), of columns old and req."""
    flat = paired.asked.select("*", *[F.col(f"old.{c}").alias(f"o_{c}") for c in table.df.columns])
    met = total(Compiler(Typed(flat, table.sets, "o_")).condition(condition)) if condition else F.lit(True)
    flat = flat.withColumn("ok", met).withColumn("new", F.when(F.col("ok"), new).otherwise(F.col("old")))
    after = paired.rest.unionByName(flat.filter(F.col("new").isNotNull()).select("new.*"))
    changes = flat.filter(F.col("old").isNotNull() | F.col("new").isNotNull() | ~F.col("ok"))
    changes = changes.select(*[F.col(f"k_{k}").alias(k) for k in table.keys], "old", F.when(F.col("ok"), F.col("new")).alias("new"), "ok")
    return Written(after, changes)


def put(table: TableDef, items: DataFrame, condition: str | None = None, names=None, values=None) -> Written:
    """Each item replaces the one of its key where the condition holds on the old item (a missing one has no attributes)."""
    cols = [F.col(f"req.{c}").alias(c) if c in items.columns else F.lit(None).cast(table.df.schema[c].dataType).alias(c) for c in table.df.columns]
    return _apply(table, _paired(table, items), F.struct(*cols), condition_node(condition, names, values))


def delete(table: TableDef, keys: DataFrame, condition: str | None = None, names=None, values=None) -> Written:
    return _apply(table, _paired(table, keys), F.lit(None).cast(table.df.select(F.struct("*")).schema[0].dataType), condition_node(condition, names, values))


def batch_write(table: TableDef, puts: DataFrame | None = None, deletes: DataFrame | None = None, most: int | None = MAX_BATCH) -> Written:
    """Puts and deletes without conditions, at most so many (None: any number); a key twice is an error when the result is read."""
    ops = []
    if puts is not None:
        ops.append(puts.select(*table.df.columns, F.lit(True).alias("_put")))
    if deletes is not None:
        ops.append(deletes.select(*[F.col(c) if c in table.keys else F.lit(None).cast(table.df.schema[c].dataType).alias(c) for c in table.df.columns], F.lit(False).alias("_put")))
    if not ops:
        raise ValidationError("a batch has puts or deletes")
    both = ops[0] if len(ops) == 1 else ops[0].unionByName(ops[1])
    if most is not None and both.limit(most + 1).count() > most:
        raise ValidationError(f"a batch has at most {most} requests")
    new = F.when(F.col("req._put"), F.struct(*[F.col(f"req.{c}").alias(c) for c in table.df.columns]))
    return _apply(table, _paired(table, both), new, None)


# Update expressions


def _value(node, typed: Typed, like: T.DataType | None) -> Column:
    if node[0] == "value":
        return literal(node[1], like) if node[1] is not None else F.lit(None)
    if node[0] == "path":
        c, _ = typed.resolve(node[1])
        return c if c is not None else F.lit(None)
    if node[0] in ("+", "-"):
        a, b = _value(node[1], typed, like), _value(node[2], typed, like)
        return a + b if node[0] == "+" else a - b
    _, name, args = node
    if name == "if_not_exists":
        return F.coalesce(_value(args[0], typed, like), _value(args[1], typed, like))
    return F.concat(_value(args[0], typed, like), _value(args[1], typed, like))


def _set_in(c: Column, t: T.DataType, path: tuple, make) -> Column:
    """c with make(old) at path. A parent that is missing is an error when the row is read; an index past the end appends."""
    if not path:
        return make(c).cast(t)
    step = path[0]
    missing = F.raise_error(F.lit("the document path of an update isn't in the item")).cast(t)
    if isinstance(t, T.StructType) and isinstance(step, str):
        if step not in t.names:
            raise ValidationError(f"the typed table has no place {step}")
        return F.when(c.isNull(), missing).otherwise(c.withField(step, _set_in(c.getField(step), t[step].dataType, path[1:], make)))
    if isinstance(t, T.ArrayType) and isinstance(step, int):
        inside = F.transform(c, lambda x, i: F.when(i == step, _set_in(x, t.elementType, path[1:], make)).otherwise(x))
        added = F.concat(c, F.array(_set_in(F.lit(None).cast(t.elementType), t.elementType, path[1:], make))) if len(path) == 1 else missing
        return F.when(c.isNull(), missing).when(F.size(c) > step, inside).otherwise(added)
    raise ValidationError("the path doesn't fit the attribute's type")


def _remove_in(c: Column, t: T.DataType, path: tuple) -> Column:
    step = path[0]
    if isinstance(t, T.StructType) and step in t.names:
        new = F.lit(None).cast(t[step].dataType) if len(path) == 1 else _remove_in(c.getField(step), t[step].dataType, path[1:])
        return F.when(c.isNotNull(), c.withField(step, new))
    if isinstance(t, T.ArrayType) and isinstance(step, int):
        if len(path) == 1:
            return F.filter(c, lambda x, i: i != step)
        return F.transform(c, lambda x, i: F.when(i == step, _remove_in(x, t.elementType, path[1:])).otherwise(x))
    return c


def update_columns(df: DataFrame, actions: dict[str, list], sets: tuple[str, ...] = ()) -> DataFrame:
    """SET, REMOVE, ADD, DELETE in this order. All values of SET read the row before the update; several list removals
    shift the list one after another; ADD to a set is a union, to a number a sum; a set emptied by DELETE is removed."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    typed = Typed(df, sets)
    new: dict[str, Column] = {}
    for (_, path), node in actions.get("SET", []):
        top, t = path[0], schema.get(path[0])
        if t is None:
            raise ValidationError(f"the typed table has no attribute {top}")
        leaf = typed.resolve(path)[1]
        new[top] = _set_in(new.get(top, F.col(f"`{top}`")), t, path[1:], lambda _, n=node, k=leaf: _value(n, typed, k))
    out = df.withColumns(new) if new else df
    for (_, path), _none in actions.get("REMOVE", []):
        top = path[0]
        if top in schema:
            out = out.withColumn(top, F.lit(None).cast(schema[top]) if len(path) == 1 else _remove_in(F.col(f"`{top}`"), schema[top], path[1:]))
    for (_, path), node in actions.get("ADD", []):
        t = Typed(out, sets).resolve(path)[1]
        v = literal(node[1])

        def add(c: Column, t=t, v=v) -> Column:
            if isinstance(t, T.ArrayType):
                return F.array_sort(F.array_union(F.coalesce(c, F.array().cast(t)), v.cast(t)))
            return F.coalesce(c, F.lit(0).cast(t)) + v

        out = out.withColumn(path[0], _set_in(F.col(f"`{path[0]}`"), schema[path[0]], path[1:], add))
    for (_, path), node in actions.get("DELETE", []):
        t = Typed(out, sets).resolve(path)[1]
        if not isinstance(t, T.ArrayType):
            raise ValidationError("DELETE needs a set")

        def drop(c: Column, t=t, v=literal(node[1])) -> Column:
            rest = F.array_sort(F.array_except(c, v.cast(t)))
            return F.when(F.size(rest) > 0, rest)

        out = out.withColumn(path[0], _set_in(F.col(f"`{path[0]}`"), schema[path[0]], path[1:], drop))
    return out


def update(table: TableDef, keys: DataFrame, expression: str | dict[str, list], condition: str | None = None, names=None, values=None) -> Written:
    """Updates the items of keys; a missing item is made, unless all actions only take away."""
    actions = expression if isinstance(expression, dict) else Reader(expression, names, values).update()
    touched = {p[1][0] for acts in actions.values() for p, _ in acts}
    if touched & set(table.keys):
        raise ValidationError("an update can't change a key")
    paired = _paired(table, keys)
    makes = any(a in actions for a in ("SET", "ADD"))
    cols = table.df.columns
    start = paired.asked.select("*", *[(F.coalesce(F.col(f"old.{c}"), F.col(f"k_{c}")) if c in table.keys else F.col(f"old.{c}")).alias(c) for c in cols])
    done = update_columns(start, actions, table.sets)
    asked = done.select(*[f"k_{k}" for k in table.keys], "old", "req", F.when(F.col("old").isNotNull() | F.lit(makes), F.struct(*cols)).alias("want"))
    node = condition_node(condition, names, values) if isinstance(condition, str) else condition
    return _apply(table, Paired(asked, paired.rest), F.col("want"), node)


def transact(table: TableDef, puts: DataFrame | None = None, deletes: DataFrame | None = None, checks: list[tuple[dict, str, dict]] = ()) -> tuple[Written, DataFrame]:
    """All or nothing: the write, whose table is the old one unless all checks (key, condition, values) hold, and the reasons in
    order. The items of all checks come from one join with their broadcast keys."""
    if len(checks) > MAX_TRANSACTION:
        raise ValidationError(f"a transaction has at most {MAX_TRANSACTION} actions")
    spark = table.df.sparkSession
    done = batch_write(table, puts, deletes, MAX_TRANSACTION - len(checks)) if puts is not None or deletes is not None else Written(table.df, _apply(table, _paired(table, table.df.select(*table.keys).limit(0)), F.lit(None).cast(table.df.select(F.struct("*")).schema[0].dataType), None).changes)
    if not checks:
        return done, spark.createDataFrame([], "pos int, ok boolean, reason string")
    if len({tuple(key[k] for k in table.keys) for key, _, _ in checks}) < len(checks):
        raise ValidationError("a transaction names an item once")
    keys = T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(f"k_{f.name}", f.dataType) for f in table.df.select(*table.keys).schema]])
    asked = spark.createDataFrame([(i, *[key[k] for k in table.keys]) for i, (key, _, _) in enumerate(checks)], keys)
    found = table.df.join(F.broadcast(asked), [F.col(k) == F.col(f"k_{k}") for k in table.keys]).drop(*[f"k_{k}" for k in table.keys])
    items = asked.select(F.col("pos").alias("_p")).join(found, F.col("_p") == F.col("pos"), "left")
    compiler, met = Compiler(Typed(items, table.sets)), F.lit(False)
    for i, (_, text, values) in enumerate(checks):
        met = F.when(F.col("_p") == i, total(compiler.condition(condition_node(text, None, values)))).otherwise(met)
    reasons = items.select(F.col("_p").alias("pos"), met.alias("ok")).withColumn("reason", F.when(F.col("ok"), "None").otherwise("ConditionalCheckFailed"))
    # At most MAX_TRANSACTION checks: one small job decides.
    if reasons.agg(F.bool_and("ok")).first()[0]:
        return done, reasons
    return Written(table.df, done.changes.limit(0)), reasons
