"""Query, Scan, GetItem and their batches: key conditions, pages, projections and indexes as plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.compile import Compiler, Typed, kind_of_type, literal, total
from quern.functions.parse import MIRROR, Reader, check_used, overlap, projection
from quern.functions.size import item_size, read_units
from quern.model import IndexDef, TableDef, ValidationError

PAGE_BYTES = 1 << 20
MAX_SEGMENTS, MAX_KEYS = 1_000_000, 100


@dataclass
class Result:
    """items is lazy; counts and the last key run a job when asked for. page holds the items evaluated, before the filter."""

    items: DataFrame
    page: DataFrame
    match: Column
    keys: tuple[str, ...]
    order: list[Column]
    limit: int | None

    def counts(self) -> DataFrame:
        """Count (after the filter) and ScannedCount (before it)."""
        return self.page.agg(F.count_if(self.match).alias("count"), F.count("*").alias("scanned_count"))

    def last_key(self) -> dict | None:
        """The key to go on from; a page that its limit ended has one, even at the very end of the table. One row is read."""
        if self.limit is None:
            return None
        n = self.page.select(F.lit(1)).count()
        if n < self.limit:
            return None
        return self.page.select(*self.keys).offset(n - 1).first().asDict()

    def capacity(self, consistent: bool = False) -> DataFrame:
        return self.page.agg(read_units(F.coalesce(F.sum(item_size(self.page)), F.lit(0)), consistent).alias("capacity_units"))


def index_view(table: TableDef, index: IndexDef) -> DataFrame:
    """An index has the items that have all its keys, with the attributes it projects."""
    df = table.df
    present = [F.col(k).isNotNull() for k in index.hash + index.range]
    for p in present:
        df = df.filter(p)
    if index.projection == "ALL":
        return df
    keep = list(dict.fromkeys([*index.hash, *index.range, *table.keys, *(() if index.projection == "KEYS_ONLY" else index.projection)]))
    return df.select(*[c for c in keep if c in df.columns])


def key_clauses(node) -> list[tuple]:
    if node[0] == "and":
        return key_clauses(node[1]) + key_clauses(node[2])
    if node[0] == "cmp":
        _, op, x, y = node
        if x[0] == "value" and y[0] == "path":
            op, x, y = MIRROR[op], y, x
        if x[0] != "path" or y[0] != "value" or op == "<>" or len(x[1]) != 1:
            raise ValidationError("a key condition compares a key with a value")
        return [(x[1][0], ("cmp", op, x, y), op)]
    if node[0] == "between" and node[1][0] == "path":
        return [(node[1][1][0], node, "between")]
    if node[0] == "fn" and node[1] == "begins_with":
        return [(node[2][0][1][0], node, "begins_with")]
    raise ValidationError("a key condition is a conjunction of comparisons, BETWEEN and begins_with")


def check_key(clauses: list[tuple], hash_: tuple[str, ...], range_: tuple[str, ...], schema) -> None:
    """One condition a key; = on every hash key; range conditions cover a leading run of which only the last may be unequal."""
    if len(clauses) > len(hash_) + len(range_):
        raise ValidationError("too many key conditions")
    by: dict[str, str] = {}
    for name, node, op in clauses:
        if name in by:
            raise ValidationError(f"two conditions on key {name}")
        if name not in hash_ + range_:
            raise ValidationError(f"{name} is no key")
        if op == "begins_with" and kind_of_type(schema[name].dataType) not in ("S", "B"):
            raise ValidationError("begins_with needs a string or binary key")
        by[name] = op
    for h in hash_:
        if by.get(h) != "=":
            raise ValidationError(f"the hash key {h} needs =")
    open_ = False
    for r in range_:
        if r not in by:
            open_ = True
        elif open_:
            raise ValidationError(f"a condition on {r} needs = on the range keys before it")
        elif by[r] != "=":
            open_ = True


def after(order: list[tuple[str, bool]], key: dict) -> Column:
    """Strictly after a key in an order of (name, ascending): spelled out, as comparisons of structs don't reach the scan."""
    out, equal = F.lit(False), None
    for name, ascending in order:
        if name not in key:
            raise ValidationError(f"the start key lacks {name}")
        c, v = F.col(name), literal(key[name])
        step = c > v if ascending else c < v
        step = step if equal is None else equal & step
        out = step if equal is None else out | step
        equal = c == v if equal is None else equal & (c == v)
    return out


def project(df: DataFrame, paths: list[tuple], sets: tuple[str, ...] = ()) -> DataFrame:
    """Paths keep their nesting; picks from a list are compacted in index order; what is missing stays out."""
    typed, cols, done = Typed(df, sets), [], set()
    for p in paths:
        top = p[0]
        if top in done:
            continue
        done.add(top)
        c, t = typed.resolve((top,))
        if c is None:
            continue
        cols.append(_pick(c, t, [q[1:] for q in paths if q[0] == top]).alias(top))
    return df.select(*cols)


def _pick(c: Column, t, rests: list[tuple]) -> Column:
    if any(not r for r in rests):
        return c
    heads = list(dict.fromkeys(r[0] for r in rests))
    below = lambda h: [r[1:] for r in rests if r[0] == h]
    if all(isinstance(h, int) for h in heads) and hasattr(t, "elementType"):
        return F.filter(F.array(*[_pick(F.get(c, F.lit(h)), t.elementType, below(h)) for h in sorted(heads)]), lambda x: x.isNotNull())
    if hasattr(t, "fields"):
        fields = [_pick(c.getField(h), t[h].dataType, below(h)).alias(h) for h in heads if h in t.names]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    return F.lit(None)


def attributes_to_get(df: DataFrame, names: list[str]) -> DataFrame:
    """The older projection: top-level attributes, each once however often it is named; one that no item has stays out."""
    if not names:
        raise ValidationError("AttributesToGet names at least one attribute")
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names) if n in df.columns])


def _filtered(df: DataFrame, table: TableDef, order: list[tuple[str, bool]] | None, filter_node, paths, limit, start, keys, select, prefix_page: DataFrame | None = None) -> Result:
    if limit is not None and limit < 1:
        raise ValidationError("Limit is at least 1")
    if start:
        df = df.filter(after(order, start))
    by = [F.col(n).asc() if up else F.col(n).desc() for n, up in order or []]
    if by:
        df = df.orderBy(*by)
    page = df.limit(limit) if limit is not None else df  # the limit stands below the filter, and Catalyst leaves it there
    match = Compiler(Typed(page, table.sets)).condition(filter_node) if filter_node else F.lit(True)
    items = page.filter(match) if filter_node else page
    if select == "COUNT":
        if paths:
            raise ValidationError("COUNT takes no projection")
        items = page.agg(F.count_if(match).alias("count"), F.count("*").alias("scanned_count"))
    elif paths:
        items = project(items, paths, table.sets)
    elif select == "SPECIFIC_ATTRIBUTES":
        raise ValidationError("SPECIFIC_ATTRIBUTES needs a projection")
    return Result(items, page, total(match), keys, by, limit)


def _view(table: TableDef, index: str | None, consistent: bool, select: str | None) -> tuple[DataFrame, tuple, tuple, tuple]:
    if index is None:
        if select == "ALL_PROJECTED_ATTRIBUTES":
            raise ValidationError("ALL_PROJECTED_ATTRIBUTES needs an index")
        return table.df, table.hash, table.range, table.keys
    i = table.index(index)
    if consistent and not i.local:
        raise ValidationError("a global index has no consistent reads")
    if select == "ALL_ATTRIBUTES" and not i.local and i.projection != "ALL":
        raise ValidationError("the index doesn't project all attributes")
    return index_view(table, i), i.hash, i.range, tuple(dict.fromkeys([*i.hash, *i.range, *table.keys]))


def query(table: TableDef, key: str, *, index: str | None = None, filter: str | None = None, projection_: str | None = None, names: dict | None = None, values: dict | None = None, forward: bool = True, limit: int | None = None, start: dict | None = None, select: str | None = None, consistent: bool = False, ordered: bool = True) -> Result:
    """Items of one hash value, in order of the range keys; backwards is the exact mirror."""
    df, hash_, range_, keys = _view(table, index, consistent, select)
    readers = [Reader(key, names, values)]
    node = readers[0].condition()
    readers[0].done()
    clauses = key_clauses(node)
    check_key(clauses, hash_, range_, df.schema)
    filter_node = None
    if filter:
        readers.append(Reader(filter, names, values))
        filter_node = readers[-1].condition()
        readers[-1].done()
        used = paths_of(filter_node)
        if any(p[0] in hash_ + range_ for p in used):
            raise ValidationError("a filter can't name a key of the read")
    paths = None
    if projection_:
        r = Reader(projection_, names)
        paths = [r.path()[1]]
        while r.maybe(","):
            paths.append(r.path()[1])
        r.done()
        overlap(paths)
        readers.append(r)
    check_used(names, values, readers)
    compiler = Compiler(Typed(df, table.sets))
    for _, clause, _op in clauses:
        df = df.filter(compiler.condition(clause))
    order = [(n, forward) for n in dict.fromkeys([*range_, *table.keys])]
    if start and any(start.get(h) != next(c[1][3][1] for c in clauses if c[0] == h) for h in hash_):
        raise ValidationError("the start key lies in another partition")
    if start and index is None and not range_:
        df = df.limit(0)  # a partition without a sort key has one item: nothing comes after it
    return _filtered(df, table, order if ordered or limit is not None else None, filter_node, paths, limit, start, keys, select)


def paths_of(node) -> list[tuple]:
    if not isinstance(node, (tuple, list)):
        return []
    if isinstance(node, tuple) and node and node[0] == "path":
        return [node[1]]
    if isinstance(node, tuple) and node and node[0] == "value":
        return []
    return [p for x in node for p in paths_of(x)]


def scan(table: TableDef, *, index: str | None = None, filter: str | None = None, projection_: str | None = None, names: dict | None = None, values: dict | None = None, limit: int | None = None, start: dict | None = None, select: str | None = None, segment: int | None = None, total_segments: int | None = None, consistent: bool = False) -> Result:
    """All items; in key order only where a page needs one. Segments are disjoint and cover the table."""
    df, hash_, range_, keys = _view(table, index, consistent, select)
    if (segment is None) != (total_segments is None):
        raise ValidationError("Segment and TotalSegments go together")
    if total_segments is not None:
        if not 0 <= segment < total_segments <= MAX_SEGMENTS:
            raise ValidationError("Segment is at least 0 and below TotalSegments")
        df = df.filter(F.pmod(F.xxhash64(*table.keys), F.lit(total_segments)) == segment)
    readers, filter_node = [], None
    if filter:
        readers.append(Reader(filter, names, values))
        filter_node = readers[-1].condition()
        readers[-1].done()
    paths = None
    if projection_:
        readers.append(Reader(projection_, names))
        paths = projection(projection_, names)
        while readers[-1].peek()[0] != "end":
            kind, text = readers[-1].peek()
            readers[-1].used.add(text)
            readers[-1].at += 1
    check_used(names, values, readers)
    order = [(n, True) for n in dict.fromkeys([*hash_, *range_, *table.keys])] if limit is not None or start else None
    return _filtered(df, table, order, filter_node, paths, limit, start, keys, select)


def byte_page(df: DataFrame, order: list[Column], bound: int, budget: int = PAGE_BYTES) -> DataFrame:
    """The first items up to budget bytes, at least one. bound rows are read at most: the window sees no more."""
    sized = df.orderBy(*order).limit(bound).withColumn("_size", item_size(df))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("_sum", F.sum("_size").over(w)).withColumn("_n", F.count("*").over(w)).filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_size", "_sum", "_n")


def get_item(table: TableDef, key: dict, projection_: str | None = None, names: dict | None = None) -> DataFrame:
    if set(key) != set(table.keys):
        raise ValidationError("the key of an item is all its key attributes")
    df = table.df
    for k in table.keys:
        df = df.filter(F.col(k) == literal(key[k], df.schema[k].dataType))
    df = df.limit(1)
    return project(df, projection(projection_, names), table.sets) if projection_ else df


def batch_get(table: TableDef, keys: list[dict], projection_: str | None = None, names: dict | None = None) -> DataFrame:
    """The items of at most MAX_KEYS keys; missing ones are left out. The keys, few by rule, are broadcast."""
    if not 1 <= len(keys) <= MAX_KEYS:
        raise ValidationError(f"a batch has 1 to {MAX_KEYS} keys")
    if len({tuple(k[n] for n in table.keys) for k in keys}) < len(keys):
        raise ValidationError("a batch can't name a key twice")
    wanted = table.df.sparkSession.createDataFrame([tuple(k[n] for n in table.keys) for k in keys], table.df.select(*table.keys).schema)
    got = table.df.join(F.broadcast(wanted), list(table.keys), "left_semi")
    return project(got, projection(projection_, names), table.sets) if projection_ else got


def transact_get(table: TableDef, keys: list[dict]) -> DataFrame:
    """pos and the item of each key in order, nulls for a missing one; one DataFrame is one snapshot."""
    if not 1 <= len(keys) <= MAX_KEYS:
        raise ValidationError(f"a transaction has 1 to {MAX_KEYS} gets")
    schema = T.StructType([*table.df.select(*table.keys).schema.fields, T.StructField("pos", T.IntegerType())])
    wanted = table.df.sparkSession.createDataFrame([(*(k[n] for n in table.keys), i) for i, k in enumerate(keys)], schema)
    # The few keys first pick their items, which are then few too.
    found = table.df.join(F.broadcast(wanted.drop("pos").distinct()), list(table.keys), "left_semi")
    return wanted.alias("w").join(found, [found[k] == F.col(f"w.{k}") for k in table.keys], "left").select("pos", *[found[c] for c in table.df.columns]).orderBy("pos")


def base_lookup(table: TableDef, index: str, rows: DataFrame) -> DataFrame:
    """Whole items for rows of a local index that doesn't project what is asked for, in index order."""
    i = table.index(index)
    if not i.local:
        raise ValidationError("only a local index looks up its table")
    got = rows.select(*table.keys).join(table.df, list(table.keys))
    return got.orderBy(*i.range, *table.keys)
