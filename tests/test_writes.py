"""Writes, their refusals, and what their plans move."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.model import ConditionFailed, ValidationError
from quern.operators import changes, vector, write
from quern.plans import catalog, partiql


@pytest.fixture()
def table(spark, data):
    return catalog.customers(spark, data)


def test_two_puts_of_one_key(table):
    one = table.df.filter("c_custkey = 3")
    with pytest.raises(Exception, match="two requests name one key"):
        write.put(table, one.unionByName(one)).table.collect()


def test_batch_limit(table):
    with pytest.raises(ValidationError, match="at most 25"):
        write.batch_write(table, table.df.limit(30))
    assert write.batch_write(table, table.df.limit(25)).table.count() == table.df.count()


def test_failed_condition_raises(table):
    done = write.put(table, table.df.filter("c_custkey = 3"), "attribute_not_exists(c_custkey)")
    with pytest.raises(ConditionFailed):
        done.check()
    assert done.table.exceptAll(table.df).count() == 0


def test_partiql_writes_raise(table):
    tables = {"customer": table}
    with pytest.raises(ConditionFailed):
        partiql.execute(tables, "INSERT INTO customer VALUE {'c_custkey': 3}")
    with pytest.raises(ConditionFailed):
        partiql.execute(tables, "UPDATE customer SET c_acctbal = 1 WHERE c_custkey = 99999999")
    with pytest.raises(ConditionFailed):
        partiql.execute(tables, "DELETE FROM customer WHERE c_custkey = 3 AND c_name = 'nobody'")


def test_update_and_delete_with_requests_that_miss(table):
    keys = table.df.filter("c_custkey IN (1, 2)").select("c_custkey").unionByName(table.df.limit(1).select(F.lit(-5).cast("long").alias("c_custkey")))
    gone = write.delete(table, keys)
    assert gone.table.count() == table.df.count() - 2 and gone.changes.count() == 2
    made = write.update(table, keys, "SET c_name = :n", values={":n": "x"})
    assert made.table.count() == table.df.count() + 1
    assert made.table.filter("c_name = 'x'").count() == 3
    assert write.update(table, keys, "REMOVE c_name").table.count() == table.df.count()


def test_bounded_writes_leave_the_table_where_it_is(spark, table):
    """The table is scanned and joined to broadcast requests: none of its rows goes through an exchange."""
    few = spark.createDataFrame([(i, "n", 1, 2.0, "m") for i in range(20)], table.df.schema)
    keys = few.select("c_custkey")
    plans = {
        "put": write.put(table, few).table,
        "update": write.update(table, keys, "SET c_name = :n", values={":n": "x"}).table,
        "delete": write.delete(table, keys, "c_acctbal > :z", values={":z": 0}).table,
        "captured": changes.captured(write.put(table, few), table.keys),
        "partiql": partiql.execute({"customer": table}, "UPDATE customer SET c_acctbal = 1 WHERE c_custkey = 3")[0].table,
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, df in plans.items():
            plan = df._jdf.queryExecution().sparkSession().sessionState().executePlan(df._jdf.queryExecution().logical(), df._jdf.queryExecution().mode()).executedPlan().toString()
            assert "Broadcast" in plan, name
            lines = plan.split("\n")
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            for i, line in enumerate(lines):
                if "FileScan" in line:
                    above, at = [], depth(line)
                    for x in reversed(lines[:i]):
                        if depth(x) < at:
                            above.append(x)
                            at = depth(x)
                    # Up to the first broadcast, which holds what the requests have found, or to the top.
                    cut = next((k for k, x in enumerate(above) if "BroadcastExchange" in x), len(above))
                    assert not any("hashpartitioning" in x for x in above[:cut]), (name, line)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_transaction_checks_in_one_scan(table):
    checks = [({"c_custkey": k}, "attribute_exists(c_name)", None) for k in range(1, 6)] + [({"c_custkey": -1}, "attribute_not_exists(c_name)", None)]
    done, reasons = write.transact(table, table.df.limit(0), None, checks)
    assert [r["ok"] for r in reasons.orderBy("pos").collect()] == [True] * 6
    assert reasons._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    with pytest.raises(ValidationError, match="once"):
        write.transact(table, None, None, checks + checks[:1])


def test_change_records_by_brute_force(spark, data, table):
    new = catalog._new_customers(spark, data)
    log = changes.sequence(changes.shard(changes.captured(write.put(table, new), table.keys), "c_custkey"), ("c_custkey",)).collect()
    old = {r["c_custkey"] for r in table.df.collect()}
    by = {}
    for key in sorted(r["c_custkey"] for r in new.collect()):
        s = zlib.crc32(str(key).encode()) % 4
        by.setdefault(s, []).append(key)
    want = {(k, s, str((i + 1) * 4 + s).zfill(21), "MODIFY" if k in old else "INSERT") for s, ks in by.items() for i, k in enumerate(ks)}
    assert {(r["c_custkey"], r["shard"], r["sequence"], r["event"]) for r in log} == want
    first = catalog.QUERIES["change_records"](spark, data).collect()
    assert len(first) == sum(min(100, len(ks)) for ks in by.values())


@pytest.mark.parametrize("where", ["o_custkey = 3 AND o_orderdate > ? OR o_custkey = 3 AND o_orderdate < ?", "o_custkey = 3 OR o_custkey = 3", "o_custkey = 3 AND o_orderdate BETWEEN ? AND ? OR o_custkey IN [3, 4]"])
def test_overlapping_disjuncts_are_refused(spark, data, where):
    with pytest.raises(ValidationError, match="overlapping"):
        partiql.execute({"orders": catalog.orders(spark, data)}, f'SELECT o_orderkey FROM "orders"."by_cust" WHERE {where}', [catalog.A, catalog.B][: where.count("?")])


def test_disjuncts_that_do_not_overlap_run(spark, data):
    orders = {"orders": catalog.orders(spark, data)}
    read = lambda where, *p: partiql.execute(orders, f'SELECT o_orderkey FROM "orders"."by_cust" WHERE {where}', list(p)).items.count()
    assert read("o_custkey = 3 AND o_orderdate < ? OR o_custkey = 3 AND o_orderdate >= ?", catalog.A, catalog.A) == read("o_custkey = 3")
    assert read("o_custkey = 3 AND o_orderdate <> ? OR o_custkey = 3 AND o_orderdate > ?", catalog.A, catalog.A) == read("o_custkey = 3 AND o_orderdate <> ?", catalog.A)


@pytest.mark.parametrize("where, order", [("o_custkey IN [3, 4]", "o_orderdate"), ("o_custkey = 3 AND o_orderdate <> ?", "o_orderdate"), ("o_custkey = 3 AND o_orderdate > ? AND o_orderdate < ?", "o_orderdate")])
def test_order_by_is_refused(spark, data, where, order):
    with pytest.raises(ValidationError, match="ORDER BY"):
        partiql.execute({"orders": catalog.orders(spark, data)}, f'SELECT o_orderkey FROM "orders"."by_cust" WHERE {where} ORDER BY {order}', [catalog.A, catalog.B][: where.count("?")])


def test_order_by_orders(spark, data):
    got = partiql.execute({"orders": catalog.orders(spark, data)}, 'SELECT o_custkey, o_orderdate FROM "orders"."by_cust" WHERE o_custkey IN [3, 4] ORDER BY o_orderdate DESC, o_custkey').items.collect()
    assert got == sorted(got, key=lambda r: (-r["o_orderdate"].timestamp(), r["o_custkey"])) and got


def test_vector_ties_and_faults(spark):
    from quern.model import TableDef, VectorIndexDef

    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(50)] + [(99, None, 0)]
    t = TableDef("t", spark.createDataFrame(rows, "id long, v array<float>, g int").repartition(5), ("id",), vectors=(VectorIndexDef("i", "v", 2, "EUCLIDEAN"), VectorIndexDef("c", "v", 2, "COSINE"), VectorIndexDef("d", "v", 2, "DOT_PRODUCT")))
    assert [r["id"] for r in vector.search(t, "i", [0.0, 1.0], 5).collect()] == [0, 3, 6, 9, 12]
    assert [r["id"] for r in vector.search(t, "d", [1.0, 0.0], 3).collect()] == [2, 5, 8]
    assert vector.search(t, "c", [0.0, 0.0], 2).collect()[0]["score"] == 1.0
    assert np.isclose(vector.search(t, "c", [1.0, 1.0], 1).collect()[0]["score"], 0.0)
    bad = t.with_df(spark.createDataFrame([(1, [1.0], 0)], "id long, v array<float>, g int"))
    with pytest.raises(Exception, match="doesn't have the 2 numbers"):
        vector.search(bad, "i", [0.0, 1.0], 1).collect()


def test_transactions_are_all_or_nothing(table):
    tables = {"customer": table}
    now, out = partiql.transaction(tables, [("DELETE FROM customer WHERE c_custkey = 3", []), ("EXISTS (SELECT * FROM customer WHERE c_custkey = 99999999)", [])])
    assert now is None and isinstance(out[1], ConditionFailed)
    with pytest.raises(ValidationError, match="once"):
        partiql.transaction(tables, [("DELETE FROM customer WHERE c_custkey = 3", []), ("UPDATE customer SET c_name = 'x' WHERE c_custkey = 3", [])])
    with pytest.raises(ValidationError, match="reads only"):
        partiql.transaction(tables, [("SELECT * FROM customer WHERE c_custkey = 3", []), ("DELETE FROM customer WHERE c_custkey = 4", [])])


def test_streams_are_listed(table):
    names = {"customer": table, "b": table.__class__("b", table.df, table.hash)}
    first, more = changes.list_streams(names, "2024", limit=1)
    assert first[0]["TableName"] == "b" and [x["TableName"] for x in changes.list_streams(names, "2024", after=more)[0]] == ["customer"]
    assert len(changes.describe_stream(table, "2024")["Shards"]) == changes.SHARDS


def test_last_key_of_a_page(spark, data):
    from quern.operators import read

    got = read.scan(catalog.customers(spark, data), limit=7)
    assert got.last_key() == {"c_custkey": sorted(r["c_custkey"] for r in got.items.collect())[-1]}
    assert read.scan(catalog.customers(spark, data), limit=10_000).last_key() is None
