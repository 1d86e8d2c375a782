"""Every registered query of the item store against DuckDB."""

import pytest

from tests import oracle

from quern.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    if name in catalog.ORACLE:
        oracle.check(spark, data, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        assert catalog.QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


def test_number_sizes_of_nulls_and_long_doubles(spark, tmp_path):
    """NULL has no size, and a double counts all its digits: 518.69 * 1000 is 518690.00000000006."""
    given = [518.69, -523.34, -256.9, 128.54, -129.54, 0.0, -0.0, None, 9999.99, 0.01, *(round(k * 7.31 - 9000, 2) for k in range(2500))]
    rows = [(None if k % 20 == 19 else k, x) for k, x in enumerate(given)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").toPandas().astype({"c_custkey": "Int64"}).to_parquet(tmp_path / "customer.parquet")
    oracle.check(spark, str(tmp_path), catalog.QUERIES["number_sizes"], catalog.ORACLE["number_sizes"])
