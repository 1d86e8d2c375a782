"""Exact top-K by distance. Scores are sums of doubles; ties go by base key.

Vectors go through NumPy a batch at a time, as functions over arrays are interpreted element by element: an Arrow batch of lists of one
length is a matrix already. Of each batch only the keys of the nearest go back, so what is ranked is a few rows a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.compile import literal
from quern.model import TableDef, ValidationError

MAX_K, MAX_DIMS = 100, 4096


def distances(kind: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of v, as doubles."""
    if kind == "DOT_PRODUCT":
        return v @ q
    if kind == "EUCLIDEAN":
        return np.sqrt(np.square(v - q).sum(axis=1))
    if kind != "COSINE":
        raise ValidationError(f"no distance {kind}")
    norms = np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(q @ q)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, 1.0, 1 - np.clip((v @ q) / norms, -1.0, 1.0))


def valid(v: Column, dims: int) -> Column:
    return (F.size(v) == dims) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def search(table: TableDef, index: str, q: list[float], k: int, where: dict | None = None, projection: list[str] | None = None) -> DataFrame:
    """The k nearest items with score; where: equalities over the index's hash element (needed if it has one) and inline filters."""
    i = next((x for x in table.vectors if x.name == index), None)
    if i is None:
        raise ValidationError(f"no vector index {index}")
    if not 1 <= k <= MAX_K or len(q) != i.dims or len(q) > MAX_DIMS:
        raise ValidationError("K is 1 to 100 and the vector has the index's dimensions")
    where = where or {}
    if i.hash and i.hash not in where:
        raise ValidationError("the search needs the index's hash element")
    if set(where) - {i.hash, *i.filters}:
        raise ValidationError("the search condition names what the index doesn't have")
    df = table.df.filter(F.col(i.attribute).isNotNull())
    for name, v in where.items():
        df = df.filter(F.col(name) == literal(v))
    cols = projection or [c for c in df.columns if c != i.attribute]
    if i.distance not in ("COSINE", "EUCLIDEAN", "DOT_PRODUCT"):
        raise ValidationError(f"no distance {i.distance}")
    names, kind, dims, sign = list(table.keys), i.distance, i.dims, -1.0 if i.distance == "DOT_PRODUCT" else 1.0
    query = np.array(q, float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            if not b.num_rows:
                continue
            flat = lists.flatten()
            if flat.null_count or len(flat) != dims * b.num_rows or (np.diff(lists.offsets.to_numpy()) != dims).any():
                raise ValueError(f"a vector of {i.attribute} doesn't have the {dims} numbers of its index")
            score = distances(kind, flat.to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float), query)
            # All that tie with the last of the nearest stay: their keys decide.
            last = np.partition(score * sign, k - 1)[k - 1] if len(score) > k else np.inf
            near = pa.array(np.flatnonzero(score * sign <= last))
            yield pa.RecordBatch.from_arrays([*(b.column(1 + j).take(near) for j in range(len(names))), pa.array(score).take(near)], names=[*names, "score"])

    fields = ", ".join(f"`{n}` {table.df.schema[n].dataType.simpleString()}" for n in names)
    best = F.col("score").desc() if sign < 0 else F.col("score").asc()
    top = df.select(i.attribute, *names).mapInArrow(nearest, f"{fields}, score double").orderBy(best, *names).limit(k)
    # At most MAX_K rows, so they are broadcast; their items are read beside them.
    found = df.select(*dict.fromkeys([*names, *cols])).join(F.broadcast(top), names)
    return found.orderBy(best, *names).select(*cols, "score")
