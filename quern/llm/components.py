"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

ROUNDS = 60
#: Links that a task holds at a time.
HELD = 1 << 20


def stars(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("u", "v")) -> Iterator[pa.RecordBatch]:
    """Links from each node to the least of its component, as the links (u, v) in batches tie them together, some HELD links at a time."""

    def contract(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = at[: len(u)], at[len(u) :]
        label = np.arange(len(node))
        while (label[i] != label[j]).any():
            low = np.minimum(label[i], label[j])
            for k in (label[i], label[j]):  # roots are tied, not only what hangs on them
                np.minimum.at(label, k, low)
            while (label[label] != label).any():
                label = label[label]
        keep = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(node[label[keep]])], names=list(names))

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= HELD:
            yield contract(held)
            held, n = [], 0
    if n:
        yield contract(held)


def _stars(links: DataFrame) -> DataFrame:
    """u, v: stars that tie together what links(u, v) do, some HELD links of a task at a time."""
    return links.mapInArrow(common.tidied(stars), "u long, v long")


def _roots(links: DataFrame) -> DataFrame:
    """node, root of at most HELD links(u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stars(batches):
            u, v = (b.column(k).to_numpy() for k in (0, 1))
            root = np.unique(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((u, root), (v, root))], names=["node", "root"])

    return links.coalesce(1).mapInArrow(common.tidied(run), "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links(a, b), settled.

    Each round links every larger neighbour of a node to the node's smallest neighbour, then every smaller one: paths
    shrink to stars in a logarithmic number of rounds. Rounds read and write tables; the driver sees two sums of each.
    Before the first round each task makes stars of the links that it reads, so that fewer rounds are left. Once a table was
    counted to have at most HELD links, one task ends them: rounds of small tables cost their tasks' starts and little else.
    """
    edges = common.settle(_stars(links.filter("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))), "cc")
    last = None
    for _ in range(ROUNDS):
        if edges._watched["rows"] <= HELD:
            return common.settle(_roots(edges), "cc")
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: the larger neighbours of u go to the least of u and its neighbours.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, common.settle(step, "cc", sum=F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
        common.release(old)
        now = (edges._watched["rows"], edges._watched["sum"])
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return common.settle(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "cc")
