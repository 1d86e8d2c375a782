"""A corpus pipeline of four stages: language ID, near duplicates, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, language, mixing, packing, simjoin

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the identifier rejects go."""
    kept = [c for c in COLUMNS if c in docs.columns]
    out = language.identify(docs, common.crc_mod("doc_id", 4) != 2, keep=tuple(kept))
    return out.filter(~F.col("rejected")).select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: one with the least doc_id, of these one with the least set. Ids don't
    matter otherwise: rows of one id, or without an id, stay if their texts differ."""
    rows, sets = simjoin.classes(docs)
    least = F.struct(F.col("least").isNull(), F.col("least"), F.col("rid"))
    best = sets.groupBy("root").agg(F.min(least).alias("k")).select(F.col("k.rid").alias("best_rid"), F.col("k.least").alias("best_id"))
    # Rows of one id and key have one text; only ids and keys are joined, texts stay where they are.
    keys = rows.groupBy("rid", "doc_id", "key").agg(F.count("*").alias("n"))
    keep = keys.join(best, (F.col("rid") == F.col("best_rid")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
    keep = keep.groupBy("rid").agg(F.min(F.struct("key", "n", "doc_id")).alias("k")).select(F.col("rid").alias("keep_rid"), F.col("k.key").alias("keep_key"), F.col("k.doc_id").alias("keep_id"), F.col("k.n").alias("n"))
    keep = common.settle(keep, "pipeline-keep", repeated=F.max("n"))
    gone = keys.join(keep, (F.col("rid") == F.col("keep_rid")) & (F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_anti")
    gone = common.settle(gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")), "pipeline-gone")
    got = docs.withColumn("_key", F.xxhash64("text"))
    got = got.join(common.small(gone), (F.col("_key") == F.col("gone_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")), "left_anti")
    return (got.dropDuplicates(["doc_id", "_key"]) if (keep._watched["repeated"] or 1) > 1 else got).drop("_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies are rows of the same doc_id. Documents without words go, rows equal in
    id and text share one fate."""
    got = mixing.mixed(docs)
    got = got.filter("_mix_copies > 0")
    return got.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents, as op2's query gives them."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL has no character models, chosen paths or linear programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result is written and reread."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
