"""Structured Streaming forms: change capture by key with the last image as state, and minute roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def capture(events: DataFrame, key: str, image: str, order: str, retain: str | None = None) -> DataFrame:
    """key, event, old, new of a stream of images (JSON text; null: the item is removed), in the order of each key's events.

    State is one image a key. An overwrite by an equal image is a MODIFY; a removal of what isn't there emits nothing.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("o")
        out = []
        for new in rows["i"]:
            new = None if pd.isna(new) else new
            if old is not None or new is not None:
                out.append((k[0], "INSERT" if old is None else "REMOVE" if new is None else "MODIFY", old, new))
            old = new
        if old is None and state.exists:
            state.remove()
        elif old is not None:
            state.update((old,))
        yield pd.DataFrame(out, columns=[key, "event", "old", "new"])

    rows = events.select(F.col(key), F.col(image).alias("i"), F.col(order).alias("o"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, event string, old string, new string", "image string", "append", GroupStateTimeout.NoTimeout)


def minutes(points: DataFrame, dims: list[str], late: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """The minute partials of a stream; the watermark (an extension of ours) bounds state, later points merge by metrics.merge."""
    w = F.window(F.col(time).cast("timestamp"), "1 minute").alias("w")
    stamped = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(w, *dims).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("minute"), *dims, "sum", "count", "min", "max")
