"""What the operators share: the cluster's shared folder, cut lineage, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as rows in memory, that is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20

#: The class of white space that ends a word: blank and the controls 9 to 13.
WORD_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder, but only if one
    machine runs everything, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, **watch: Column) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends there, and a lost executor costs no recomputation. The
    rows and the bytes of their strings are counted on the way, for small(); so are the aggregates to watch, for the caller."""
    path, seen = scratch(df.sparkSession, name), Observation()
    texts = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("string", "binary")]
    heavy = sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(0).cast("long"))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(heavy).alias("bytes"), *[x.alias(k) for k, x in watch.items()]).write.option("compression", "zstd").parquet(path)
    out, got = df.sparkSession.read.schema(df.schema).parquet(path), seen.get
    flat = all(kind in ("string", "binary") or "<" not in kind for _, kind in df.dtypes)
    out._settled = (path, (16 + 16 * len(df.columns)) * got["rows"] + (got["bytes"] or 0) if flat else None)
    out._watched = got
    give_back()
    return out


def as_settled(df: DataFrame, out: DataFrame) -> DataFrame:
    """out, which has the rows of the settled table df and columns of some numbers more or less: it counts as that table."""
    path, size = df._settled
    rows = df._watched["rows"]
    out._watched, out._settled = df._watched, (path, size if size is None else size + 16 * rows * (len(out.columns) - len(df.columns)))
    return out


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A settled table under other column names."""
    return as_settled(df, df.withColumnsRenamed(names))


def release(df: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more: what was made from it must be settled itself."""
    path = df._settled[0]
    jvm = df.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df with a hint to broadcast, if it, or the settled table whose projection it is, was measured to be within
    BROADCAST_BYTES as rows in memory. Tables with nested columns are never broadcast."""
    return F.broadcast(df) if fits(df if of is None else of) else df


def fits(df: DataFrame) -> bool:
    """Whether df is a settled table that was measured to be within BROADCAST_BYTES."""
    size = getattr(df, "_settled", (None, None))[1]
    return size is not None and size <= BROADCAST_BYTES


#: Rows of an Arrow batch, instead of Spark's 10,000: of whole texts those are tens of MB in the executor and again in the worker.
BATCH_ROWS = 1024


def give_back() -> None:
    """What allocators keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function over batches after whose task the worker gives freed memory back: workers are used again by later stages,
    and what allocators keep for themselves would add up. Where the session has Spark's own number of rows a batch, it gets
    BATCH_ROWS."""
    spark, rows = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return inner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo modulus; null ids count as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % modulus
