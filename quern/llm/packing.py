"""Packing by cutting-stock column generation.

Each document is cut into full sequences and a tail. Tails are counted in length classes of UNIT ids; a linear program over
patterns (how many tails of each class share a sequence) is solved by column generation, where a knapsack over the
capacity prices new patterns by the program's dual values. Patterns are rounded down, what is left is packed largest
first, and the tails of a class, ranked over the whole table, take the places that the patterns hold for it.

Only the histogram of at most CAPACITY / UNIT classes reaches the driver. Ranks come from counts by task and class,
so a class that holds a third of all tails is neither sorted nor gathered.

Defined cases: a null text is empty and consists of the end id; repeated rows are packed each for itself; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.tokens import encoder

CAPACITY, UNIT, END = 1024, 4, 0
#: Relative distance from the linear program's optimum at which column generation ends, and its most steps.
GAP, STEPS = 2e-4, 4000


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within capacity: value and count of each item."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fits:
            total = best[w - sizes[:fits]] + values[:fits]
            k = int(total.argmax())
            if total[k] > best[w]:
                best[w], last[w] = total[k], k
    counts, w = np.zeros(len(sizes), int), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            counts[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts) and how often each is used in the relaxed program: revised simplex on the covering of demand.

    Duals of a young basis swing widely, so patterns are priced at a point between them and the duals of the best bound
    so far; a pattern that doesn't pay at the basis's own duals moves the point towards them instead.
    """
    m = len(sizes)
    patterns, price = np.diag(capacity // sizes).astype(float), np.ones(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ demand
    centre, bound, pull = sizes / capacity, float(sizes @ demand) / capacity, 0.8
    for _ in range(STEPS):
        total = float(used @ price)
        if total - bound <= GAP * total:
            break
        dual = price @ inverse
        low = int(dual.argmin())
        if dual[low] < -1e-9:  # covering more than the demand is free
            counts, cost = -np.eye(m)[low], 0.0
        else:
            cost = 1.0
            at = pull * centre + (1 - pull) * dual
            value, counts = knapsack(at, sizes, capacity)
            got = float(at @ demand) / max(1.0, value)
            if got > bound:
                bound, centre = got, at / max(1.0, value)
            if dual @ counts <= 1 + 1e-9:
                if pull < 1e-3:
                    break
                pull = pull - 0.2 if pull > 0.3 else 0.0
                continue
            pull = 0.8
        column = inverse @ counts
        ratio = np.where(column > 1e-9, used / np.where(column > 1e-9, column, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        step = ratio[r]
        used = np.maximum(used - step * column, 0)
        used[r] = step
        row = inverse[r] / column[r]
        inverse -= np.outer(column, row)
        inverse[r] = row
        patterns[r], price[r] = counts, cost
    real = price > 0
    return patterns[real].astype(int), used[real]


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: count} and how many sequences have each; together they hold exactly demand."""
    left = {c: n for c, n in demand.items() if n > 0}
    if not left:
        return []
    sizes = np.array(sorted(left))
    patterns, used = column_generation(sizes, np.array([left[c] for c in sizes], float), capacity)
    out = []
    for p, x in sorted(zip(patterns.tolist(), used.tolist(), strict=True), key=lambda t: -t[1]):
        pattern = {int(c): n for c, n in zip(sizes, p, strict=True) if n}
        times = min([int(x + 1e-9), *(left[c] // n for c, n in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for c, n in pattern.items():
                left[c] -= n * times
    while any(left.values()):  # what rounding leaves, largest first
        pattern, room = {}, capacity
        for c in sorted((c for c in left if left[c]), reverse=True):
            n = min(left[c], room // c)
            if n:
                pattern[c] = n
                room -= n * c
        times = min(left[c] // n for c, n in pattern.items())
        out.append((pattern, times))
        for c, n in pattern.items():
            left[c] -= n * times
    return out


def places(patterns: list[tuple[dict[int, int], int]], first: int) -> dict[str, np.ndarray]:
    """By class and rank: from start on, a class's tails fill sequences base, base + 1, ... with per of them each, from place slot."""
    rows, seen, base = [], {}, first
    for pattern, times in patterns:
        slot = 0
        for c in sorted(pattern, reverse=True):
            start = seen.get(c, 0)
            rows.append(((c << 44) + start, start, base, pattern[c], slot))
            seen[c] = start + pattern[c] * times
            slot += pattern[c]
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "start", "base", "per", "slot"), table.T, strict=True))


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, class (0: a full sequence), task, rank (among the task's pieces of the class)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer, lower=False)
        end = np.array([end_id], "<u4")
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([enc.ids(text or "").astype("<u4"), end])
                for s in range(0, len(ids), capacity):
                    p = ids[s : s + capacity]
                    c = 0 if len(p) == capacity else -(-len(p) // unit)
                    seen[c] = seen.get(c, -1) + 1
                    out.append((doc_id, s, len(p), zlib.crc32(p.tobytes()), len(ids), c, task, seen[c]))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "rank"])

    names = ", ".join(f"{x} long" for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "rank"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidied(pieces), names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs(doc_id, text)."""
    got = common.settle(cut(docs, tokenizer, capacity, unit, end_id), "pack-pieces")
    by_task = common.settle(got.groupBy("class", "task").agg(F.count("*").alias("n")), "pack-counts")
    totals = {r["class"]: r["n"] for r in by_task.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    full = totals.pop(0, 0)
    table = places(plan(totals, capacity // unit), full)
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = got.join(common.small(common.settle(offsets, "pack-offsets")), ["class", "task"]).withColumn("rank", F.col("rank") + F.col("before"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("class", "rank"))
            if not len(c):
                continue
            seq, slot = rank.copy(), np.zeros_like(rank)
            tail = c > 0
            at = np.searchsorted(table["key"], (c[tail] << 44) + rank[tail], "right") - 1
            j = rank[tail] - table["start"][at]
            seq[tail] = table["base"][at] + j // table["per"][at]
            slot[tail] = table["slot"][at] + j % table["per"][at]
            keep = [b.column(b.schema.get_field_index(x)) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    names = ", ".join(f"{x} long" for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"))
    placed = ranked.mapInArrow(common.tidied(assign), names)
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
