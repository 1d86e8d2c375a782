"""The registered queries of the item-store operators, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.compile import utf16_length
from quern.functions.size import item_size, number_bytes, read_units, write_units
from quern.model import IndexDef, TableDef, VectorIndexDef
from quern.operators import capacity, changes, legacy, metrics, read, vector, write
from quern.plans import partiql

QUERIES: dict = {}
ORACLE: dict = {}

A, B = dt.datetime(1995, 1, 1), dt.datetime(1997, 12, 31)
NOW = dt.datetime(2024, 1, 15)
Q64 = [round(((i * 37) % 19 - 9) / 10, 2) for i in range(64)]
QSQL = "[" + ", ".join(map(str, Q64)) + "]::DOUBLE[]"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, d) -> TableDef:
    return TableDef("orders", load(spark, d, "orders"), ("o_orderkey",), indexes=(IndexDef("by_cust", ("o_custkey",), ("o_orderdate",)), IndexDef("by_status", ("o_orderstatus",), ("o_totalprice",), ("o_orderpriority",))))


def customers(spark, d) -> TableDef:
    return TableDef("customer", load(spark, d, "customer"), ("c_custkey",))


def parts(spark, d) -> TableDef:
    return TableDef("part", load(spark, d, "part"), ("p_partkey",))


def events(spark, d) -> TableDef:
    df = load(spark, d, "events").withColumn("expires", F.unix_seconds(F.col("ts").cast("timestamp")))
    return TableDef("events", df, ("event_id",), indexes=(IndexDef("by_user", ("user_id",), ("ts",), ("event_type", "value")), IndexDef("local_type", ("event_id",), ("ts",), "KEYS_ONLY", local=True)), ttl="expires")


def rated(spark, d) -> TableDef:
    """Documents with the labels that some of them have: quality and toxic may be missing."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(load(spark, d, "labels"), "doc_id", "left")
    return TableDef("rated", docs, ("doc_id",), indexes=(IndexDef("by_quality", ("quality",), ("n_chars",), "KEYS_ONLY"),))


RATED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def vectors(spark, d, distance="COSINE") -> TableDef:
    return TableDef("embeddings", load(spark, d, "embeddings"), ("vec_id",), vectors=(VectorIndexDef("v", "embedding", 64, distance, filters=("label",)), VectorIndexDef("scoped", "embedding", 64, distance, hash="label")))


# Reads


@register("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND o_totalprice > 1000 AND NOT starts_with(o_orderpriority, '1')")
def query_key_range(spark, d):
    return read.query(orders(spark, d), "o_custkey = :c AND o_orderdate BETWEEN :a AND :b", index="by_cust", filter="o_totalprice > :p AND NOT begins_with(o_orderpriority, :x)", projection_="o_orderkey, o_custkey, o_orderdate, o_totalprice", values={":c": 7, ":a": A, ":b": B, ":p": 1000, ":x": "1"}, forward=False).items


@register("SELECT * FROM (SELECT * FROM orders WHERE o_custkey = 11 AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5) WHERE o_orderstatus <> 'F'")
def query_limit_before_filter(spark, d):
    return read.query(orders(spark, d), ":a <= o_orderdate AND o_custkey = :c", index="by_cust", filter="o_orderstatus <> :s", values={":c": 11, ":a": A, ":s": "F"}, forward=False, limit=5).items


@register("SELECT * FROM orders WHERE o_custkey = 11 AND (o_orderdate > TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey > 5)) ORDER BY o_orderdate, o_orderkey LIMIT 3")
def query_start_key(spark, d):
    return read.query(orders(spark, d), "o_custkey = :c", index="by_cust", values={":c": 11}, limit=3, start={"o_custkey": 11, "o_orderdate": dt.datetime(1996, 6, 1), "o_orderkey": 5}).items


@register("SELECT count(*) FILTER (length(o_orderpriority) > 5) AS count, count(*) AS scanned_count FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 500")
def query_count(spark, d):
    return read.query(orders(spark, d), "o_orderstatus = :s AND o_totalprice >= :p", index="by_status", filter="attribute_exists(o_orderpriority) AND size(o_orderpriority) > :n", values={":s": "O", ":p": 500, ":n": 5}, select="COUNT").items


@register("SELECT p_partkey, p_brand, p_size FROM part WHERE p_name IS NOT NULL AND (p_size IN (1, 5, 9) OR p_retailprice < 950.5) AND NOT contains(p_type, 'STEEL') AND length(p_name) > 3")
def scan_filter(spark, d):
    return read.scan(parts(spark, d), filter="(p_size IN (:a, :b, :c) OR p_retailprice < :r) AND NOT contains(p_type, :s) AND size(p_name) > :n", projection_="p_partkey, p_brand, p_size", values={":a": 1, ":b": 5, ":c": 9, ":r": 950.5, ":s": "STEEL", ":n": 3}).items


@register(f"SELECT doc_id, quality FROM {RATED} WHERE (quality <> 1 OR quality IS NULL) AND (toxic IS NULL OR toxic >= 1)")
def scan_missing_not_equal(spark, d):
    return read.scan(rated(spark, d), filter="quality <> :one AND NOT toxic < :one", projection_="doc_id, quality", values={":one": 1}).items


@register(f"SELECT doc_id FROM {RATED} WHERE quality IS NULL OR quality <> toxic")
def scan_path_not_equal_path(spark, d):
    return read.scan(rated(spark, d), filter="quality <> toxic", projection_="doc_id").items


@register(f"SELECT doc_id, lang FROM {RATED} WHERE quality IS NULL OR NOT (lang = 'en' AND toxic = 0)")
def scan_negations(spark, d):
    return read.scan(rated(spark, d), filter="attribute_not_exists(quality) OR NOT (lang = :e AND toxic = :z)", projection_="doc_id, lang", values={":e": "en", ":z": 0}).items


@register(f"SELECT doc_id FROM {RATED} WHERE quality IS NOT NULL AND NOT (n_chars BETWEEN 500 AND 3000)")
def scan_attribute_type(spark, d):
    return read.scan(rated(spark, d), filter="attribute_type(quality, :n) AND NOT attribute_type(lang, :n) AND NOT n_chars BETWEEN :a AND :b", projection_="doc_id", values={":n": "N", ":a": 500, ":b": 3000}).items


@register(f"SELECT count(*) AS n FROM {RATED}")
def scan_type_mismatch(spark, d):
    return read.scan(rated(spark, d), filter="lang <> :five AND NOT lang < :five", values={":five": 5}).items.agg(F.count("*").alias("n"))


@register("SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def scan_page(spark, d):
    return read.scan(customers(spark, d), limit=20).items


@register("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS n, 1 AS segments FROM orders")
def scan_segments(spark, d):
    t = orders(spark, d)
    out = None
    for s in range(4):
        part = read.scan(t, segment=s, total_segments=4).items.select("o_orderkey", F.lit(s).alias("seg"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("n"), (F.countDistinct("seg") / 4).cast("long").alias("segments"))


@register(f"SELECT doc_id, quality, n_chars FROM {RATED} WHERE quality IS NOT NULL AND n_chars IS NOT NULL")
def index_keys_only(spark, d):
    return read.scan(rated(spark, d), index="by_quality").items


@register("SELECT event_id, user_id, ts, event_type, value FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-10'")
def index_query_include(spark, d):
    return read.query(events(spark, d), "user_id = :u AND ts >= :t", index="by_user", values={":u": 3, ":t": dt.datetime(2024, 1, 10)}).items


@register("SELECT * FROM customer WHERE c_custkey = 42")
def get_item(spark, d):
    return read.get_item(customers(spark, d), {"c_custkey": 42})


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 2, 3, 50, 99999999)")
def batch_get(spark, d):
    return read.batch_get(customers(spark, d), [{"c_custkey": k} for k in (1, 2, 3, 50, 99999999)], "c_custkey, c_name")


@register("SELECT k.pos, c.* FROM (VALUES (0, 5), (1, 99999999), (2, 3)) k(pos, id) LEFT JOIN customer c ON c_custkey = id")
def transact_get(spark, d):
    return read.transact_get(customers(spark, d), [{"c_custkey": k} for k in (5, 99999999, 3)])


@register("SELECT e.* FROM (SELECT *, floor(epoch(ts))::BIGINT AS expires FROM events) e")
def index_base_lookup(spark, d):
    t = events(spark, d)
    return read.base_lookup(t, "local_type", read.scan(t, index="local_type").items)


@register("SELECT * FROM orders WHERE o_custkey = 5 AND o_orderdate > TIMESTAMP '1995-01-01' AND o_totalprice IS NOT NULL AND NOT contains(o_orderpriority, 'LOW') AND o_orderstatus IN ('F', 'O')")
def legacy_query(spark, d):
    t = orders(spark, d)
    df = read.index_view(t, t.index("by_cust"))
    from quern.functions.compile import Compiler, Typed

    c = Compiler(Typed(df))
    keys = legacy.conditions({"o_custkey": ("EQ", [5]), "o_orderdate": ("GT", [A])}, keys=True)
    rest = legacy.conditions({"o_totalprice": ("NOT_NULL", []), "o_orderpriority": ("NOT_CONTAINS", ["LOW"]), "o_orderstatus": ("IN", ["F", "O"])})
    return df.filter(c.condition(keys)).filter(c.condition(rest))


@register(f"SELECT doc_id, quality, toxic FROM {RATED} WHERE lang IS NOT NULL AND (quality IS NULL OR quality <> 1) AND toxic IS NULL")
def legacy_scan_missing(spark, d):
    from quern.functions.compile import Compiler, Typed

    df = rated(spark, d).df
    text = df.withColumn("grade", F.when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("bad")))
    node = legacy.conditions({"grade": ("NOT_CONTAINS", ["good"]), "toxic": ("NULL", []), "lang": ("NOT_NULL", [])})
    return text.filter(Compiler(Typed(text)).condition(node)).select("doc_id", "quality", "toxic")


# Counting


def number_sql(c: str) -> str:
    """The size of a number, by its two halves."""
    i, f = f"ltrim(split_part(ltrim({c}::VARCHAR, '-'), '.', 1), '0')", f"rtrim(split_part({c}::VARCHAR, '.', 2), '0')"
    whole = f"CASE WHEN {f} = '' THEN length(rtrim({i}, '0')) ELSE length({i}) END"
    part = f"CASE WHEN {i} = '' THEN length(ltrim({f}, '0')) ELSE length({f}) END"
    return f"(1 + ceil(({whole}) / 2.0) + ceil(({part}) / 2.0) + ({c} < 0)::INT)::BIGINT"


@register(f"SELECT c_custkey, {number_sql('c_custkey')} AS key_bytes, {number_sql('c_acctbal')} AS bal_bytes, {number_sql('(c_acctbal * 1000)')} AS big_bytes, {number_sql('(c_acctbal / 1000)::DECIMAL(18, 6)')} AS small_bytes FROM customer")
def number_sizes(spark, d):
    b = F.col("c_acctbal")
    of = {"key_bytes": F.col("c_custkey"), "bal_bytes": b, "big_bytes": b * 1000, "small_bytes": (b / 1000).cast("decimal(18,6)")}
    return load(spark, d, "customer").select("c_custkey", *[number_bytes(c).alias(n) for n, c in of.items()])


@register("SELECT lang, sum(strlen(source))::BIGINT + 4 AS as_set, sum(strlen(source))::BIGINT + 4 + 3 + count(*) AS as_list FROM (SELECT DISTINCT coalesce(lang, '') AS lang, source FROM documents WHERE source IS NOT NULL) GROUP BY lang")
def set_sizes(spark, d):
    df = load(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.array_sort(F.collect_set("source")).alias("tags"))
    tags = df.select("tags")
    return df.select("lang", item_size(tags, ("tags",)).alias("as_set"), item_size(tags).alias("as_list"))


@register("SELECT p_partkey, length(p_name) AS units, strlen(p_name) AS bytes FROM part")
def utf16_size(spark, d):
    return load(spark, d, "part").select("p_partkey", utf16_length(F.col("p_name")).alias("units"), F.octet_length("p_name").cast("long").alias("bytes"))


_SIZE = "coalesce(strlen(text) + 4, 0) + coalesce(strlen(lang) + 4, 0) + coalesce(strlen(source) + 6, 0) + coalesce(" + number_sql("doc_id") + " + 6, 0) + coalesce(" + number_sql("n_chars") + " + 7, 0)"


@register(f"SELECT doc_id, {_SIZE} AS size, greatest(1, ceil(({_SIZE}) / 4096.0)) * 0.5 AS rcu, greatest(1, ceil(({_SIZE}) / 1024.0))::DOUBLE AS wcu FROM documents")
def item_capacity(spark, d):
    df = load(spark, d, "documents")
    size = item_size(df)
    return df.select("doc_id", size.alias("size"), read_units(size).alias("rcu"), write_units(size).alias("wcu"))


@register(f"SELECT count(*) AS items, sum({_SIZE})::BIGINT AS bytes FROM documents")
def table_size(spark, d):
    df = load(spark, d, "documents")
    return df.agg(F.count("*").alias("items"), F.sum(item_size(df)).alias("bytes"))


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 9")
def attributes_to_get(spark, d):
    got = read.query(orders(spark, d), "o_custkey = :c", index="by_cust", values={":c": 9})
    return read.attributes_to_get(got.items, ["o_orderkey", "o_orderstatus", "o_orderkey", "nothing"])


@register("SELECT 0 AS n")
def query_resume_without_range(spark, d):
    return read.query(customers(spark, d), "c_custkey = :k", values={":k": 3}, start={"c_custkey": 3}).items.agg(F.count("*").alias("n"))


@register("""SELECT name, units FROM (
SELECT 'orders' AS name, count(*)::DOUBLE AS units FROM orders WHERE o_orderstatus = 'O' UNION ALL
SELECT 'by_cust', count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'O' UNION ALL
SELECT 'by_status', 2.0 * count(*) FROM orders WHERE o_orderstatus = 'O')""")
def index_write_units(spark, d):
    """Every open order closes: its entry by customer changes in place, that by status moves."""
    t = orders(spark, d)
    done = write.update(t, t.df.filter("o_orderstatus = 'O'").select("o_orderkey"), "SET o_orderstatus = :f", values={":f": "F"})
    return capacity.write_capacity(t, done.changes)


@register("SELECT 'customer' AS \"table\", count(*) + 3.0 AS units FROM customer WHERE c_nationkey < 10")
def batch_write_units(spark, d):
    t = customers(spark, d)
    one = write.delete(t, t.df.filter("c_nationkey < 10").select("c_custkey"))
    two = write.delete(t, t.df.filter("c_custkey IN (1, 2, 3)").select("c_custkey"))
    return capacity.roll_up([("customer", capacity.write_capacity(t, x.changes)) for x in (one, two)])


@register("SELECT CASE WHEN c_custkey = 2 THEN 'x' ELSE c_name END AS c_name, c_custkey FROM customer WHERE c_custkey <> 3")
def partiql_transaction(spark, d):
    now, _ = partiql.transaction({"customer": customers(spark, d)}, [("UPDATE customer SET c_name = 'x' WHERE c_custkey = 2", []), ("DELETE FROM customer WHERE c_custkey = 3", []), ("EXISTS (SELECT * FROM customer WHERE c_custkey = 4)", [])])
    return now["customer"].df.select("c_custkey", "c_name")


# Metrics

_MINUTE = "SELECT date_trunc('minute', ts) AS minute, event_type, sum(value) AS sum, count(value) AS count, min(value) AS min, max(value) AS max FROM events GROUP BY ALL"


@register(f"SELECT minute, event_type, round(sum, 6) AS sum, count, min, max FROM ({_MINUTE})")
def metric_minutes(spark, d):
    return metrics.flush(load(spark, d, "events"), ["event_type"]).withColumn("sum", F.round("sum", 6))


@register("SELECT time_bucket(INTERVAL 15 minute, ts) AS bucket, event_type, round(sum(value), 6) AS sum, count(value) AS count, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def metric_rebucket(spark, d):
    df = load(spark, d, "events")
    half = lambda keep: metrics.flush(df.filter(F.col("event_id") % 2 == keep), ["event_type"])  # noqa: E731  two partial flushes, merged
    return metrics.rebucket(metrics.merge(half(0), half(1), ["event_type"]), ["event_type"], "15 minutes").withColumn("sum", F.round("sum", 6))


@register("SELECT time_bucket(INTERVAL 15 minute, ts) AS bucket, event_type, round(sum(value), 6) AS sum, count(value) AS count, min(value) AS min, max(value) AS max FROM events WHERE ts >= TIMESTAMP '2024-01-10 04:00:00' AND ts < TIMESTAMP '2024-01-10 12:00:00' GROUP BY ALL")
def metric_range_automatic(spark, d):
    """Eight hours are the longest range in quarters of an hour."""
    start = dt.datetime(2024, 1, 10, 4)
    return metrics.range_query(metrics.flush(load(spark, d, "events"), ["event_type"]), ["event_type"], start, start + dt.timedelta(hours=8)).withColumn("sum", F.round("sum", 6))


@register("SELECT event_type, round(sum(value), 6) AS sum, count(value) AS count, min(value) AS min, max(value) AS max FROM events WHERE ts >= TIMESTAMP '2024-01-14' GROUP BY event_type")
def metric_snapshot(spark, d):
    return metrics.snapshot(load(spark, d, "events"), ["event_type"], NOW, "1 DAY").withColumn("sum", F.round("sum", 6))


_RANK = "list_sort(list(value))[floor({} * (count(value) - 1) + 0.5)::INT + 1]"


@register(f"SELECT event_type, {', '.join(f'{_RANK.format(p / 100)} AS p{p}' for p in (50, 90, 95, 99))} FROM events GROUP BY event_type")
def metric_percentiles(spark, d):
    return metrics.percentiles(load(spark, d, "events"), ["event_type"])


@register(f"SELECT minute, event_type, count FROM ({_MINUTE}) WHERE minute >= TIMESTAMP '2024-01-14'")
def metric_prune(spark, d):
    return metrics.prune(metrics.flush(load(spark, d, "events"), ["event_type"]), NOW).select("minute", "event_type", "count")


@register("SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def metric_means(spark, d):
    return metrics.segment_means(load(spark, d, "events"), "event_type", ["value"]).withColumn("value", F.round("value", 6))


# Vectors


@register(f"SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], {QSQL}), 6) AS score FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {QSQL}), vec_id LIMIT 10")
def vector_cosine(spark, d):
    return vector.search(vectors(spark, d), "v", Q64, 10).withColumn("score", F.round("score", 6))


@register(f"SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], {QSQL}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], {QSQL}), vec_id LIMIT 20")
def vector_euclidean_scoped(spark, d):
    return vector.search(vectors(spark, d, "EUCLIDEAN"), "scoped", Q64, 20, {"label": 3}).withColumn("score", F.round("score", 6))


@register(f"SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], {QSQL}), 6) AS score FROM embeddings WHERE label = 1 ORDER BY list_dot_product(embedding::DOUBLE[], {QSQL}) DESC, vec_id LIMIT 15")
def vector_dot_filtered(spark, d):
    return vector.search(vectors(spark, d, "DOT_PRODUCT"), "v", Q64, 15, {"label": 1}).withColumn("score", F.round("score", 6))


# Writes

_NEWC = "SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey + 90000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"


def _new_customers(spark, d):
    c = load(spark, d, "customer")
    return c.filter("c_nationkey < 10").withColumn("c_acctbal", F.col("c_acctbal") + 1000).unionByName(c.filter("c_mktsegment = 'BUILDING'").withColumn("c_custkey", F.col("c_custkey") + 90000000))


@register(f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal FROM customer o FULL JOIN ({_NEWC}) n USING (c_custkey)")
def write_put(spark, d):
    return write.put(customers(spark, d), _new_customers(spark, d)).table.select("c_custkey", "c_name", "c_acctbal")


@register(f"SELECT c_custkey, CASE WHEN n.c_custkey IS NOT NULL AND (o.c_custkey IS NULL OR o.c_acctbal < 5000) THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM customer o FULL JOIN ({_NEWC}) n USING (c_custkey)")
def write_put_condition(spark, d):
    done = write.put(customers(spark, d), _new_customers(spark, d), "attribute_not_exists(c_custkey) OR c_acctbal < :m", values={":m": 5000})
    return done.table.select("c_custkey", "c_acctbal")


@register("SELECT * FROM customer WHERE NOT (c_nationkey < 10 AND c_acctbal > 0)")
def write_delete(spark, d):
    t = customers(spark, d)
    return write.delete(t, t.df.filter("c_nationkey < 10").select("c_custkey"), "c_acctbal > :z", values={":z": 0}).table


@register("SELECT p_partkey, p_name || '!' AS p_name, p_size + 5 AS p_size, p_size::DOUBLE AS p_retailprice, NULL::VARCHAR AS p_brand FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, p_name, p_size, p_retailprice, p_brand FROM part WHERE p_size <= 30")
def write_update(spark, d):
    t = parts(spark, d)
    suffix = t.df.withColumn("p_name", F.concat("p_name", F.when(F.col("p_size") > 30, F.lit("!")).otherwise(F.lit(""))))
    done = write.update(t.with_df(suffix), t.df.filter("p_size > 30").select("p_partkey"), "SET p_retailprice = p_size, p_size = if_not_exists(p_size, :z) + :five REMOVE p_brand", values={":z": 0, ":five": 5})
    return done.table.select("p_partkey", "p_name", "p_size", "p_retailprice", "p_brand")


@register("SELECT c_custkey, c_acctbal + 10 AS c_acctbal FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 95000000, 10.0")
def write_update_returns(spark, d):
    t = customers(spark, d)
    keys = t.df.filter("c_nationkey = 7").select("c_custkey").unionByName(spark.range(1).select(F.lit(95000000).cast("long").alias("c_custkey")))
    return write.update(t, keys, "ADD c_acctbal :x", values={":x": 10}).returned("ALL_NEW").select("c_custkey", "c_acctbal")


@register("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM (SELECT c_custkey FROM customer WHERE c_custkey > 5 UNION ALL SELECT c_custkey + 96000000 FROM customer WHERE c_custkey BETWEEN 1 AND 3)")
def write_batch(spark, d):
    t = customers(spark, d)
    puts = t.df.filter("c_custkey BETWEEN 1 AND 3").withColumn("c_custkey", F.col("c_custkey") + 96000000)
    return write.batch_write(t, puts, t.df.filter("c_custkey <= 5").select("c_custkey")).table.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@register("SELECT 0 AS pos, true AS ok, 'None' AS reason UNION ALL SELECT 1, false, 'ConditionalCheckFailed'")
def write_transact_reasons(spark, d):
    t = customers(spark, d)
    _, reasons = write.transact(t, t.df.limit(0), None, [({"c_custkey": 3}, "attribute_exists(c_name)", None), ({"c_custkey": 99999999}, "attribute_exists(c_name)", None)])
    return reasons


@register("SELECT * FROM customer")
def write_transact_refused(spark, d):
    t = customers(spark, d)
    done, _ = write.transact(t, None, t.df.filter("c_custkey <= 5").select("c_custkey"), [({"c_custkey": 99999999}, "attribute_exists(c_name)", None)])
    return done.table


# Changes


@register(f"SELECT CASE WHEN o.c_custkey IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS event, c_custkey, o.c_acctbal AS old_bal, n.c_acctbal AS new_bal FROM ({_NEWC}) n LEFT JOIN customer o USING (c_custkey)")
def change_capture(spark, d):
    t, new = customers(spark, d), _new_customers(spark, d)
    got = changes.captured(write.put(t, new), t.keys)
    return got.select("event", "c_custkey", F.col("old.c_acctbal").alias("old_bal"), F.col("new.c_acctbal").alias("new_bal"))


@register("SELECT 'REMOVE' AS event, c_custkey FROM customer WHERE c_nationkey < 10")
def change_view_keys(spark, d):
    t = customers(spark, d)
    gone = t.df.filter("c_nationkey < 10").select("c_custkey")
    return changes.view(changes.captured(write.delete(t, gone), t.keys), t.keys, "KEYS_ONLY")


@register()
def change_records(spark, d):
    t, new = customers(spark, d), _new_customers(spark, d)
    log = changes.sequence(changes.shard(changes.captured(write.put(t, new), t.keys), "c_custkey"), ("c_custkey",))
    out = None
    for s in range(changes.SHARDS):
        got = changes.records(log.select("shard", "sequence", "event", "c_custkey"), s, changes.iterator("TRIM_HORIZON"), 100)
        out = got if out is None else out.unionByName(got)
    return out


_TTL = "(SELECT *, floor(epoch(ts))::BIGINT AS expires FROM events)"


@register(f"SELECT event_id, expires FROM {_TTL} WHERE expires BETWEEN 1 AND 1705276800 ORDER BY expires, event_id LIMIT 100")
def ttl_expired(spark, d):
    return changes.expired(events(spark, d), 1705276800).select("event_id", "expires")


@register(f"SELECT event_id FROM {_TTL} EXCEPT SELECT event_id FROM (SELECT event_id FROM {_TTL} WHERE expires BETWEEN 1 AND 1705276800 ORDER BY expires, event_id LIMIT 100)")
def ttl_sweep(spark, d):
    rest, _ = changes.expire(events(spark, d), 1705276800)
    return rest.select("event_id")


# PartiQL


@register("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE (o_custkey IN (3, 4, 8) OR o_custkey = 17) AND o_totalprice NOT BETWEEN 1000 AND 50000")
def partiql_select(spark, d):
    return partiql.execute({"orders": orders(spark, d)}, 'SELECT o_orderkey, o_orderdate, o_totalprice FROM "orders"."by_cust" WHERE (o_custkey IN [3, 4, ?] OR o_custkey = 17) AND o_totalprice NOT BETWEEN 1000 AND 50000 ORDER BY o_custkey, o_orderdate DESC', [8]).items


@register(f"SELECT doc_id FROM {RATED} WHERE quality IS NULL OR (starts_with(lang, 'f') AND toxic IS NOT NULL)")
def partiql_missing(spark, d):
    return partiql.execute({"rated": rated(spark, d)}, "SELECT doc_id FROM rated WHERE quality IS MISSING OR begins_with(lang, 'f') AND toxic IS NOT MISSING AND toxic IS NUMERIC").items


@register("SELECT c_custkey, c_acctbal + CASE WHEN c_custkey = 7 THEN 5 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey <> 7 THEN c_name END AS c_name FROM customer")
def partiql_update(spark, d):
    t = customers(spark, d)
    done, _ = partiql.execute({"customer": t}, "UPDATE customer SET c_acctbal = c_acctbal + 5 REMOVE c_name WHERE c_custkey = 7")
    return done.table.select("c_custkey", "c_acctbal", "c_name")


@register("SELECT * FROM customer WHERE c_custkey <> 9")
def partiql_delete(spark, d):
    done, _ = partiql.execute({"customer": customers(spark, d)}, "DELETE FROM customer WHERE c_custkey = 9 RETURNING ALL OLD *")
    return done.table


@register("SELECT * FROM customer UNION ALL SELECT 97000000, 'O''Neil', NULL, 1.5, NULL")
def partiql_insert(spark, d):
    done, _ = partiql.execute({"customer": customers(spark, d)}, "INSERT INTO customer VALUE {'c_custkey': 97000000, 'c_name': 'O''Neil', 'c_acctbal': 1.5}")
    return done.table


@register("SELECT c_custkey, '{\"Item\":{\"c_custkey\":{\"N\":\"' || c_custkey || '\"},\"c_mktsegment\":{\"S\":\"' || c_mktsegment || '\"}}}' AS value FROM customer")
def export_lines(spark, d):
    from quern.sources import files

    df = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    lines = files.item_lines(df)
    return lines.select(F.try_variant_get(F.parse_json("value"), "$.Item.c_custkey.N", "string").cast("long").alias("c_custkey"), "value")
