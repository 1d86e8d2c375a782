"""Token ids in Arrow stream files of fixed-size-list batches.

A shard holds the documents of one range of doc_id, ascending. Its sequence file is an Arrow IPC stream whose batches have
BATCH sequences each (the last one fewer) of exactly length ids and a mask of the same length: every batch takes the same bytes, so a
memory-mapped file gives sequence i without copying. Its index file, a stream too, has doc_id, start and n_tokens of each document in the
shard. Shards are written under a temporary name and moved when complete, so a task that is run again after a
lost executor leaves one whole shard of the same name.

Defined cases: a null text is empty and gives the end id alone; rows that repeat a doc_id stay, ordered by text; a null doc_id comes first;
an empty table has no shard and no row; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.tokens import encoder

LENGTH, BATCH, END = 2048, 64, 1


class ShardWriter:
    def __init__(self, uri: str, length: int = LENGTH, batch: int = BATCH, kind: type = np.uint16):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.length, self.batch, self.kind = length, batch, kind
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [self.fs.open_output_stream(f"{self.tmp}.{x}") for x in ("seq", "doc")]
        self.streams = [pa.ipc.new_stream(o, s) for o, s in zip(self.out, (self.schema, self.docs), strict=True)]
        self.held, self.n_held, self.start = [], 0, 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.start + np.cumsum(sizes) - sizes
        self.streams[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs))
        self.start += int(sizes.sum())
        self.held += ids
        self.n_held += int(sizes.sum())
        full = self.length * self.batch
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for i in range(0, whole, full):
                self._write(flat[i : i + full], full)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:used] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.streams[0].write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> int:
        """Ids written. The last sequence is filled with zeros under a false mask."""
        if self.n_held:
            flat = np.concatenate(self.held).astype(self.kind)
            used = len(flat)
            self._write(np.concatenate([flat, np.zeros(-used % self.length, self.kind)]), used)
        for s, o, x in zip(self.streams, self.out, ("seq", "doc"), strict=True):
            s.close()
            o.close()
            self.fs.move(f"{self.tmp}.{x}", f"{self.path}.{x}")
        return self.start


class ShardReader:
    """Random access to a shard: local files are memory-mapped, so ids are views of the file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        files = [pa.memory_map(f"{path}.{x}") if local else fs.open_input_file(f"{path}.{x}") for x in ("seq", "doc")]
        seq, self.docs = (pa.ipc.open_stream(f).read_all() for f in files)
        flat = lambda name: [c.flatten().to_numpy(zero_copy_only=name == "ids") for c in seq[name].chunks]
        self.length = seq.schema.field("ids").type.list_size
        self.ids, self.masks = flat("ids"), flat("mask")
        self.ends = np.cumsum([len(c) for c in self.ids])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = i * self.length
        k = int(np.searchsorted(self.ends, at, "right"))
        at -= int(self.ends[k - 1]) if k else 0
        return self.ids[k][at : at + self.length], self.masks[k][at : at + self.length]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from start on, a view where one batch holds them."""
        k, parts = int(np.searchsorted(self.ends, start, "right")), []
        while n > 0:
            at = start - (int(self.ends[k - 1]) if k else 0)
            part = self.ids[k][at : at + n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, lower: bool, end_id: int = END, length: int = LENGTH) -> DataFrame:
    """Encodes docs(doc_id, text) and writes a shard for each range of doc_id; part, uri, first_id, n_tokens of the shards."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, writer, first, enc = f"{folder}/shard-{part:06d}", None, None, encoder(tokenizer, lower)
        end = np.array([end_id], enc.kind)
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                writer, first = ShardWriter(uri, length, kind=enc.kind), b.column(0)[0].as_py()
            # In small steps: ids of a few hundred documents at a time.
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                writer.add(s.column(0).to_pylist(), [np.concatenate([enc.ids(t or ""), end]) for t in s.column(1).to_pylist()])
        if writer:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "first_id": pa.array([first], pa.int64()), "n_tokens": pa.array([writer.close()], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(common.tidied(write), "part int, uri string, first_id long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; start counts over all shards before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = ShardReader(uri)
                for d in shard.docs.to_batches(max_chunksize=4096):
                    starts, sizes = d.column(1).to_pylist(), d.column(2).to_pylist()
                    crc = [zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": d.column(0), "start": pa.array([s + base for s in starts], pa.int64()), "n_tokens": d.column(2), "ids_crc32": pa.array(crc, pa.int64())})

    # One row a shard: the window is as small as the list of files.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    return based.repartition(n).mapInArrow(common.tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "op1-shards")
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    manifest = common.settle(write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), lower=True), "op1-manifest")
    return read_shards(manifest)
