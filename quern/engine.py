"""One place to register tables and run requests by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern.model import TableDef, ValidationError
from quern.operators import changes, read, vector, write
from quern.plans import partiql


class Engine:
    """Tables by name. Writes replace the registered table by the new one, lazily; materialise long chains of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, table: TableDef) -> TableDef:
        self.tables[table.name] = table
        return table

    def drop(self, name: str) -> None:
        self._table(name)
        del self.tables[name]

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, name: str) -> dict:
        t = self._table(name)
        return {"TableName": t.name, "KeySchema": [(k, "HASH") for k in t.hash] + [(k, "RANGE") for k in t.range], "Attributes": {f.name: f.dataType.simpleString() for f in t.df.schema.fields}, "Indexes": [i.name for i in t.indexes], "VectorIndexes": [v.name for v in t.vectors], "TimeToLive": t.ttl, "StreamViewType": t.view_type}

    def _table(self, name: str) -> TableDef:
        if name not in self.tables:
            raise ValidationError(f"no table {name}")
        return self.tables[name]

    def query(self, name: str, key: str, **kw) -> read.Result:
        return read.query(self._table(name), key, **kw)

    def scan(self, name: str, **kw) -> read.Result:
        return read.scan(self._table(name), **kw)

    def get_item(self, name: str, key: dict, **kw):
        return read.get_item(self._table(name), key, **kw)

    def batch_get(self, requests: dict[str, list[dict]]) -> dict:
        if sum(map(len, requests.values())) > read.MAX_KEYS:
            raise ValidationError(f"a batch has at most {read.MAX_KEYS} keys")
        return {name: read.batch_get(self._table(name), keys) for name, keys in requests.items()}

    def search(self, name: str, index: str, q: list[float], k: int, **kw):
        return vector.search(self._table(name), index, q, k, **kw)

    def _keep(self, name: str, done: write.Written) -> write.Written:
        self.tables[name] = self._table(name).with_df(done.table)
        return done

    def put(self, name: str, items, **kw) -> write.Written:
        return self._keep(name, write.put(self._table(name), items, **kw))

    def delete(self, name: str, keys, **kw) -> write.Written:
        return self._keep(name, write.delete(self._table(name), keys, **kw))

    def update(self, name: str, keys, expression, **kw) -> write.Written:
        return self._keep(name, write.update(self._table(name), keys, expression, **kw))

    def batch_write(self, name: str, **kw) -> write.Written:
        return self._keep(name, write.batch_write(self._table(name), **kw))

    def transact(self, name: str, **kw):
        done, reasons = write.transact(self._table(name), **kw)
        return self._keep(name, done), reasons

    def partiql(self, text: str, parameters: list | None = None, **kw):
        got = partiql.execute(self.tables, text, parameters, **kw)
        if isinstance(got, tuple):
            self._keep(partiql.Parser(text, parameters).statement().table, got[0])
        return got

    def partiql_transaction(self, statements: list[tuple[str, list]]) -> list:
        """Results or reasons in order; the tables change only if every statement holds."""
        now, out = partiql.transaction(self.tables, statements)
        if now is not None:
            self.tables = dict(now)
        return out

    def list_streams(self, label: str, **kw) -> tuple[list[dict], str | None]:
        return changes.list_streams(self.tables, label, **kw)

    def describe_stream(self, name: str, label: str, log=None) -> dict:
        return changes.describe_stream(self._table(name), label, log)

    def expire(self, name: str, now: int):
        rest, removed = changes.expire(self._table(name), now)
        self.tables[name] = self._table(name).with_df(rest)
        return removed
