"""Compiled conditions against the truth table in Python, on random items and conditions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.compile import Compiler, Typed, total
from quern.functions.evaluate import evaluate
from quern.functions.parse import Reader
from quern.model import TableDef, ValidationError
from quern.operators import read, write

SCHEMA = "id long, s string, n long, b boolean, l array<string>, m struct<x: long, y: string>"
maybe = lambda s: st.one_of(st.none(), s)
words, numbers = st.sampled_from(["", "a", "ab", "é😀", "b"]), st.integers(-2, 3)
items = st.fixed_dictionaries({"s": maybe(words), "n": maybe(numbers), "b": maybe(st.booleans()), "l": maybe(st.lists(words, max_size=3)), "m": maybe(st.fixed_dictionaries({"x": maybe(numbers), "y": maybe(words)}))})
paths = st.sampled_from([("s",), ("n",), ("b",), ("l",), ("l", 0), ("l", 2), ("m", "x"), ("m", "y"), ("m", "z"), ("none",)]).map(lambda p: ("path", p))
values = st.one_of(words, numbers, st.booleans()).map(lambda v: ("value", v))
orderable = st.one_of(words, numbers).map(lambda v: ("value", v))
sizes = paths.map(lambda p: ("size", p))
leaves = st.one_of(
    st.tuples(st.just("cmp"), st.sampled_from(["=", "<>"]), st.one_of(paths, sizes), st.one_of(values, paths)),
    st.tuples(st.just("cmp"), st.sampled_from(["<", "<=", ">", ">="]), st.one_of(paths, sizes), st.one_of(orderable, paths)),
    st.tuples(st.just("between"), paths, orderable, orderable),
    st.tuples(st.just("in"), paths, st.lists(values, min_size=1, max_size=3)),
    paths.map(lambda p: ("fn", "attribute_exists", [p])),
    paths.map(lambda p: ("fn", "attribute_not_exists", [p])),
    st.tuples(paths, words).map(lambda t: ("fn", "begins_with", [t[0], ("value", t[1])])),
    st.tuples(paths, values).map(lambda t: ("fn", "contains", [t[0], t[1]])),
    st.tuples(paths, st.sampled_from(["S", "N", "BOOL", "L", "M"])).map(lambda t: ("fn", "attribute_type", [t[0], ("value", t[1])])),
)
conditions = st.recursive(leaves, lambda c: st.one_of(c.map(lambda x: ("not", x)), st.tuples(st.sampled_from(["and", "or"]), c, c)), max_leaves=6)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(items, min_size=3, max_size=12), nodes=st.lists(conditions, min_size=4, max_size=10))
def test_parity(spark, rows, nodes):
    df = spark.createDataFrame([{"id": i, **r} for i, r in enumerate(rows)], SCHEMA)
    compiler = Compiler(Typed(df))
    got = df.select("id", *[total(compiler.condition(n)).alias(f"c{k}") for k, n in enumerate(nodes)]).collect()
    for r in got:
        for k, n in enumerate(nodes):
            assert r[f"c{k}"] == evaluate(rows[r["id"]], n), (rows[r["id"]], n)


@pytest.mark.parametrize("text", ["a = ", "a == :v", "((a = :v))", "size(a)", "a BETWEEN :v", "a IN ()", "attribute_exists(:v)", "contains(a, a)", "a = a", "", "foo(a)"])
def test_refused(text):
    with pytest.raises(ValidationError):
        r = Reader(text, {}, {":v": 1})
        r.condition()
        r.done()


def table(spark, rows, schema="pk string, sk long, v long, tags array<string>, m struct<x: long, l: array<long>>"):
    return TableDef("t", spark.createDataFrame(rows, schema), ("pk",), ("sk",), sets=("tags",))


def test_key_rules(spark):
    t = table(spark, [("a", 1, 1, None, None)])
    for text in ("sk = :v", "pk <> :v", "pk = :v AND sk = :v AND sk = :v", "pk = :v OR sk = :v", "pk = :v AND v = :v", "pk = :v AND begins_with(sk, :v)"):
        with pytest.raises(ValidationError):
            read.query(t, text, values={":v": "a"})
    with pytest.raises(ValidationError):
        read.query(t, "pk = :v", values={":v": "a", ":unused": 1})
    with pytest.raises(ValidationError):
        read.query(t, "pk = :v", filter="sk = :v", values={":v": "a"})


def test_pages_cover_the_partition(spark):
    t = table(spark, [("a", i, i % 3, None, None) for i in range(10)] + [("b", 1, 1, None, None)])
    seen, start = [], None
    for _ in range(10):
        got = read.query(t, "pk = :p", filter="v <> :z", values={":p": "a", ":z": 0}, limit=4, start=start)
        seen += [r["sk"] for r in got.items.collect()]
        c = got.counts().first()
        start = got.last_key()
        if start is None:
            break
        assert c["scanned_count"] == 4
    assert seen == [i for i in range(10) if i % 3]
    page = read.byte_page(t.df.filter("pk = 'a'"), [F.col("sk")], 10, budget=40)
    assert 1 <= page.count() < 10


def test_updates(spark):
    t = table(spark, [("a", 1, 5, ["x"], (1, [7, 8, 9])), ("a", 2, None, None, None)])
    one = t.df.filter("sk = 1").select("pk", "sk")
    up = lambda text, **v: write.update(t, one, text, values={f":{k}": x for k, x in v.items()} or None).table.filter("sk = 1").first()
    assert up("SET v = v + :a, m.x = v", a=2)[2:5:2] == (7, (5, [7, 8, 9]))
    assert up("SET m.l[9] = :a", a=1)["m"]["l"] == [7, 8, 9, 1]
    assert up("REMOVE m.l[0]")["m"]["l"] == [8, 9]
    assert up("ADD tags :a", a={"y", "x"})["tags"] == ["x", "y"]
    assert up("DELETE tags :a", a={"x"})["tags"] is None
    new = spark.createDataFrame([("z", 9)], "pk string, sk long")
    assert write.update(t, new, "SET v = :a", values={":a": 3}).table.filter("pk = 'z'").first()["v"] == 3
    assert write.update(t, new, "REMOVE v").table.filter("pk = 'z'").count() == 0
    with pytest.raises(ValidationError):
        write.update(t, new, "SET pk = :a", values={":a": "q"})


def test_projection_compacts_lists(spark):
    t = table(spark, [("a", 1, 5, ["x"], (1, [7, 8, 9]))])
    assert read.scan(t, projection_="m.l[2], m.l[0], pk").items.first().asDict(True) == {"m": {"l": [7, 9]}, "pk": "a"}
