import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.engine import Engine
from quern.model import TableDef, ValidationError
from quern.plans import partiql
from quern.sources import files
from quern.streaming import feeds


def test_json_round_trip(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/customer.parquet")
    files.export(df, str(tmp_path / "out"), gzip=True)
    back = files.read_items(spark, str(tmp_path / "out"), "DYNAMODB_JSON", df.schema)
    assert df.exceptAll(back).count() == 0 and back.count() == df.count()


def test_backup_manifest(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_orderstatus")
    m = files.backup(df, ("o_orderkey",), str(tmp_path / "b"), rows_per_file=500)
    assert m.agg(F.sum("items")).first()[0] == df.count()


def test_bad_rows(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"Item":{"k":{"N":"1"},"s":{"S":"a"}}}\n\n{"k":{"N":"99999999999999999999999"}}\n{"k":{"N":"3"}}\n')
    schema = StructType.fromDDL("k long, s string")
    assert sorted(r["k"] for r in files.read_json(spark, str(p), schema).collect()) == [1, 3]
    assert {r["fault"]: r["rows"] for r in files.rejected(spark, str(p), schema).collect()} == {"": 2, "range": 1}
    p.write_text('{"k":{"N":"1x"}}\n')
    with pytest.raises(Exception, match="malformed"):
        files.read_json(spark, str(p), schema).collect()


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a;b\n 1 ;"x;""y"""\n;z\n')
    assert [tuple(r) for r in files.read_items(spark, str(p), "CSV", delimiter=";").collect()] == [("1", 'x;"y"'), (None, "z")]


def test_engine(spark):
    e = Engine(spark)
    e.register(TableDef("t", spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), ("k",)))
    e.partiql("INSERT INTO t VALUE {'k': 'c', 'v': 3}")
    e.partiql("UPDATE t SET v = v + 10 WHERE k = 'a'")
    e.partiql("DELETE FROM t WHERE k = 'b'")
    assert sorted(map(tuple, e.partiql("SELECT * FROM t").items.collect())) == [("a", 11), ("c", 3)]
    for text in ("SELECT COUNT(*) FROM t", "SELECT * FROM t LIMIT 3", "SELECT k FROM t ORDER BY v", "UPDATE t SET v = 1 WHERE v = 1"):
        with pytest.raises(ValidationError):
            e.partiql(text)
    token = partiql.next_token("x", [1], {"k": "a"})
    assert partiql.start_of(token, "x", [1]) == {"k": "a"}


def test_streaming_capture(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 1, "y"), ("a", 2, "x"), ("a", 3, None), ("c", 1, None)]
    spark.createDataFrame(rows, "k string, o long, i string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, o long, i string").parquet(str(tmp_path / "in"))
    q = feeds.capture(stream, "k", "i", "o").writeStream.format("memory").queryName("feed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted((r["k"], r["event"]) for r in spark.table("feed").collect())
    assert got == [("a", "INSERT"), ("a", "MODIFY"), ("a", "REMOVE"), ("b", "INSERT")]
