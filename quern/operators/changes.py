"""Change records, shards and iterators, and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.model import TableDef, ValidationError

SHARDS, MAX_RECORDS, EXPIRY_BATCH = 4, 1000, 100
VIEWS = {"KEYS_ONLY": (), "NEW_IMAGE": ("new",), "OLD_IMAGE": ("old",), "NEW_AND_OLD_IMAGES": ("new", "old")}


def capture(old: TableDef, new: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """event (INSERT, MODIFY, REMOVE), keys, old, new. With written keys an overwrite by an equal item is a MODIFY too;
    without them only items that differ are."""
    cols, keys = old.df.columns, old.keys
    side = lambda df, name: df.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.struct(*cols).alias(name))
    both = side(old.df, "old").join(side(new, "new"), [f"k_{k}" for k in keys], "full_outer")
    if written is not None:
        both = both.join(written.select(*[F.col(k).alias(f"k_{k}") for k in keys]).distinct(), [f"k_{k}" for k in keys], "left_semi")
    else:
        both = both.filter(~F.col("old").eqNullSafe(F.col("new")))
    event = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "REMOVE").otherwise("MODIFY")
    return both.select(event.alias("event"), *[F.col(f"k_{k}").alias(k) for k in keys], "old", "new")


def captured(written, keys: tuple[str, ...]) -> DataFrame:
    """The records of a write, from the images it has paired already: no table is read or joined again."""
    event = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "REMOVE").otherwise("MODIFY")
    return written.changes.filter("ok").select(event.alias("event"), *keys, "old", "new")


def view(changes: DataFrame, keys: tuple[str, ...], view_type: str) -> DataFrame:
    if view_type not in VIEWS:
        raise ValidationError(f"no view type {view_type}")
    more = [c for c in changes.columns if c in ("event", "sequence", "shard")]
    return changes.select(*more, *keys, *VIEWS[view_type])


def shard(changes: DataFrame, hash_key: str, shards: int = SHARDS) -> DataFrame:
    return changes.withColumn("shard", F.pmod(F.crc32(F.encode(F.col(hash_key).cast("string"), "UTF-8")), F.lit(shards)).cast("int"))


def sequence(sharded: DataFrame, order: tuple[str, ...], batch: int = 0) -> DataFrame:
    """Zero-padded to 21, so that text order is number order; numbers rise within each shard and differ between shards."""
    n = F.row_number().over(Window.partitionBy("shard").orderBy(*order))
    number = F.lit(batch).cast("decimal(21,0)") * 10**12 + n * SHARDS + F.col("shard")
    return sharded.withColumn("sequence", F.lpad(number.cast("decimal(21,0)").cast("string"), 21, "0"))


def stream_name(table: TableDef, label: str) -> str:
    return f"{table.name}/stream/{label}"


def list_streams(tables: dict[str, TableDef], label: str, name: str | None = None, limit: int = 100, after: str | None = None) -> tuple[list[dict], str | None]:
    """Streams of the tables, in order of name, and the stream to go on after if there are more."""
    if not 1 <= limit <= 100:
        raise ValidationError("Limit is 1 to 100")
    found = sorted(stream_name(t, label) for n, t in tables.items() if name in (None, n))
    found = [x for x in found if after is None or x > after]
    return [{"Stream": x, "TableName": x.split("/")[0], "StreamLabel": label} for x in found[:limit]], found[limit - 1] if len(found) > limit else None


def describe_stream(table: TableDef, label: str, log: DataFrame | None = None) -> dict:
    """View type, keys, and the shards with the first and last sequence number that the log has in each."""
    spans = {} if log is None else {r["shard"]: (r["a"], r["b"]) for r in log.groupBy("shard").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b")).collect()}
    shards = [{"ShardId": s, "StartingSequenceNumber": spans.get(s, (None, None))[0], "EndingSequenceNumber": spans.get(s, (None, None))[1]} for s in range(SHARDS)]
    return {"Stream": stream_name(table, label), "TableName": table.name, "StreamViewType": table.view_type, "StreamStatus": "ENABLED", "KeySchema": [(k, "HASH") for k in table.hash] + [(k, "RANGE") for k in table.range], "Shards": shards}


def iterator(kind: str, number: str | None = None, latest: str | None = None) -> str:
    """The sequence number after which records are read."""
    if kind == "TRIM_HORIZON":
        return "0" * 21
    if kind == "LATEST":
        return latest or "9" * 21
    if number is None or kind not in ("AT_SEQUENCE_NUMBER", "AFTER_SEQUENCE_NUMBER"):
        raise ValidationError("the iterator needs a sequence number")
    return number if kind == "AFTER_SEQUENCE_NUMBER" else str(int(number) - 1).zfill(21)


def records(log: DataFrame, shard_id: int, after: str, limit: int = MAX_RECORDS) -> DataFrame:
    if not 1 <= limit <= MAX_RECORDS:
        raise ValidationError(f"Limit is 1 to {MAX_RECORDS}")
    return log.filter((F.col("shard") == shard_id) & (F.col("sequence") > after)).orderBy("sequence").limit(limit)


def expired(table: TableDef, now: int, limit: int = EXPIRY_BATCH) -> DataFrame:
    """Items whose time attribute lies in 1 ... now, oldest first, one batch of them."""
    return table.df.filter(F.col(table.ttl).between(1, now)).orderBy(table.ttl, *table.keys).limit(limit)


def expire(table: TableDef, now: int, limit: int = EXPIRY_BATCH) -> tuple[DataFrame, DataFrame]:
    """The table without one batch of expired items, and their REMOVE records."""
    gone = expired(table, now, limit)
    # A batch has at most limit keys.
    rest = table.df.join(F.broadcast(gone.select(*table.keys)), list(table.keys), "left_anti")
    removed = gone.select(F.lit("REMOVE").alias("event"), *table.keys, F.struct(*table.df.columns).alias("old"), F.lit("ttl").alias("by"))
    return rest, removed


def retain(log: DataFrame, now, time: str, age: str = "24 HOURS") -> DataFrame:
    return log.filter(F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {age}"))
